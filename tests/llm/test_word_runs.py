import hashlib
import random
import re
import zlib
from fractions import Fraction

from topicloom.llm import catalogue, word_runs

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_runs(words):
    """Runs (start, length, period) by walking every period over all words."""
    n, found = len(words), {}
    for p in range(1, n // 3 + 1):
        i = 0
        while i + p < n:
            j = i
            while j + p < n and words[j] == words[j + p]:
                j += 1
            if j - i + p >= max(24, 3 * p):
                found.setdefault((i, j - i + p), p)
            i = max(j, i + 1)
    return sorted(((s, n, p) for (s, n), p in found.items()), key=lambda r: (r[0], r[2]))


def plain_collapse(words, runs):
    gone = {i for s, n, p in runs for i in range(s + p, s + n)}
    return " ".join(w for i, w in enumerate(words) if i not in gone)


def periodic_texts(seed, n, words=300):
    rng = random.Random(seed)
    for _ in range(n):
        text, goal = [], rng.randint(0, words)
        while len(text) < goal:
            kind = rng.random()
            if kind < 0.4:
                text += [rng.choice("abcdefghijklmnop") for _ in range(rng.randint(1, 40))]
            elif kind < 0.85:
                base = [rng.choice("abcd") for _ in range(rng.randint(1, 60))]
                text += [base[i % len(base)] for i in range(rng.randint(1, 6 * len(base)))]
            else:
                text += ["z"] * rng.randint(1, 60)
        yield " ".join(text)


def test_runs_equal_plain_walk(spark, odd, none):
    texts = list(periodic_texts(5, 300)) + [" ".join(["x"] * 3000), "a b c " * 700, "ü é " * 24, " \t", "", None]
    docs = spark.createDataFrame([(i, t, "x", "y") for i, t in enumerate(texts)], "doc_id long, text string, runs string, row string")
    rows = word_runs.collapse(docs).collect()
    assert len(rows) == len(texts)
    seen = 0
    for r in rows:
        words = WORDS.findall(texts[r.doc_id] or "")
        runs = plain_runs(words)
        seen += len(runs)
        assert [(x.start, x.length, x.period) for x in r.runs] == runs
        assert r.collapsed == plain_collapse(words, runs) and r.row == "y"
    assert seen > 300
    found = word_runs.collapse(odd)
    assert found.count() == odd.count() and set(odd.columns) <= set(found.columns)
    by = {r.doc_id: r for r in found.collect()}
    assert by[1].runs == [] and by[1].collapsed == "" and len(by[7].runs) == 1 and by[7].runs[0].period == 11
    assert word_runs.collapse(none).count() == 0


def test_z_function():
    rng = random.Random(1)
    for _ in range(200):
        x = [rng.randint(0, 2) for _ in range(rng.randint(0, 40))]
        plain = [next((k for k in range(len(x) - i) if x[k] != x[i + k]), len(x) - i) for i in range(len(x))]
        assert word_runs.z_function(x) == plain


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.001"
    texts = {r.doc_id: r.text for r in spark.read.parquet(f"{folder}/documents.parquet").collect()}
    rows = catalogue.QUERIES["op11_word_runs"](spark, folder).collect()
    assert len(rows) == len(texts)
    planted = 0
    for r in rows:
        words = WORDS.findall(texts[r.doc_id] or "")
        n, h = len(words), zlib.crc32(str(r.doc_id).encode())
        if h % 10 == 0 and n:
            g = h // 10
            a = g % n
            p = 1 + (n - a) // (3 + g % 8)
            words = [w if i < a else words[a + (i - a) % p] for i, w in enumerate(words)]
            planted += 1
        if n > 4000:
            continue
        runs = plain_runs(words)
        best = max(runs, key=lambda x: (Fraction(x[1], x[2]), -x[0], -x[2]), default=None)
        assert r.n_runs == len(runs)
        assert (r.start, r.length, r.period) == (best or (None,) * 3)
        assert r.exponent_milli == (1000 * best[1] // best[2] if best else None)
        assert r.runs_sha256 == hashlib.sha256("".join(f"{s},{n},{p}\n" for s, n, p in runs).encode()).hexdigest()
        assert r.collapsed_sha256 == hashlib.sha256(plain_collapse(words, runs).encode()).hexdigest()
    assert planted > 10
