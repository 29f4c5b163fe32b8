import random
from collections import Counter, defaultdict

import numpy as np
import public_tokenizers
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from topicloom.llm import common, language_id, mixing, near_dup, quality_rules
from topicloom.llm.common import read, written
from topicloom.llm.near_dup import Likeness

LOWER = bytes.maketrans(bytes(range(65, 91)), bytes(range(97, 123)))


def plain_set(text, width):
    w = (text or "").encode().translate(LOWER).split()
    if not w:
        return frozenset()
    width = min(width, len(w))
    return frozenset(tuple(w[i : i + width]) for i in range(len(w) - width + 1))


def plain_groups(rows, width, percent):
    """Component of each id by comparing all pairs."""
    sets = [(i, plain_set(t, width)) for i, t in rows if i is not None]
    up = {i: i for i, _ in sets}

    def top(x):
        while up[x] != x:
            x = up[x]
        return x

    for at, (i, a) in enumerate(sets):
        for j, b in sets[:at]:
            n = len(a & b)
            if a and b and 100 * n >= percent * (len(a) + len(b) - n):
                x, y = top(i), top(j)
                up[max(x, y)] = min(x, y)
    return {i: top(i) for i in up}


def agree(docs, like):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    want = plain_groups(rows, like.words, like.percent)
    found = near_dup.groups(docs, like=like).collect()
    assert len(found) == len(rows)
    for r in found:
        assert r.component_id == (None if r.doc_id is None else want[r.doc_id])
        assert r.kept == (r.doc_id is None or r.doc_id == r.component_id)
    assert Counter(r.n_shingles for r in found) == Counter(len(plain_set(t, like.words)) for _, t in rows)


def edited(words, n, rng):
    out = list(words)
    for i in rng.sample(range(len(out)), n):
        out[i] = f"new{rng.random()}"
    return out


def copies(spark):
    """Exact copies, stars, chains, weaker copies and a passage that many texts share."""
    rng = random.Random(4)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    texts = []
    for size in (8, 30, 80, 200):
        base = [word() for _ in range(size)]
        texts += [" ".join(base)] * 3 + [" ".join(base).upper()]
        texts += [" ".join(edited(base, k, rng)) for k in (1, 1, 2, 2, 3, 4, 5) for _ in range(3) if k < size]
        step = base
        for _ in range(6):
            step = edited(step, max(1, size // 40), rng)
            texts.append("\n".join(step))
    passage = [word() for _ in range(60)]
    texts += [" ".join([word() for _ in range(30)] + passage + [word() for _ in range(30)]) for _ in range(25)]
    texts += [None, "", " ", "one", "one", "One two", "one two three"]
    rng.shuffle(texts)
    rows = [(i, t) for i, t in enumerate(texts)] + [(None, texts[5]), (3, texts[3])]
    return spark.createDataFrame(rows, "doc_id long, text string").repartition(4)


@pytest.mark.parametrize("like", [Likeness(3, 85), Likeness()])
def test_planted_groups(spark, like):
    agree(copies(spark), like)


def test_small_sketches_and_join_paths(spark, no_broadcast):
    agree(copies(spark), Likeness(3, 85, k=48))


def test_table(spark):
    agree(read(spark, "/root/testdata/sf0.001", "documents"), Likeness(3, 85))


def test_odd_rows(odd, none):
    agree(odd, Likeness(3, 85))
    assert near_dup.groups(none).count() == 0 and near_dup.deduplicate(none).columns == odd.columns
    kept = near_dup.deduplicate(odd)
    assert kept.columns == odd.columns and sorted(r.doc_id or -1 for r in kept.collect()) == [-1, -1, 1, 2, 3, 4, 6, 7, 8, 9, 10, 11]


def test_one_key_with_two_texts(spark):
    docs = spark.createDataFrame([(1, "a b c d"), (2, "e f g h"), (3, "a b c d"), (3, "e f g h")], "doc_id long, text string")
    assert {r.component_id for r in near_dup.groups(docs, like=Likeness(3, 85)).collect()} == {1}


def test_components(spark):
    rng = np.random.default_rng(2)
    edges = [(i, i + 1) for i in range(40)] + [(1000, int(x)) for x in range(1001, 1060)]
    edges += [tuple(map(int, e)) for e in rng.integers(2000, 2300, (260, 2))] + [(5000, 5000)]
    up = {x: x for e in edges for x in e}
    changed = True
    while changed:
        changed = False
        for a, b in edges:
            low = min(up[a], up[b])
            changed |= up[a] != low or up[b] != low
            up[a] = up[b] = low
    found = {r.id: r.component for r in near_dup.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: c for x, c in up.items() if x in found} and all(x in found or x == c for x, c in up.items())


def test_pipeline_equals_plain_steps(spark):
    folder = "/root/testdata/sf0.001"
    rows = [r.asDict() for r in read(spark, folder, "documents").collect()]
    measured = [dict(zip(quality_rules.MEASURES, quality_rules.measure_text(r["text"]))) for r in rows]
    rules = [x for x in quality_rules.RULES if x.name != "few_words"]
    ok = lambda m: not any(eval(x.fails.replace("OR", "or").replace("AND", "and"), {}, m) for x in rules)  # noqa: E731, S307
    rows = [r for r, m in zip(rows, measured) if ok(m)]
    profiles = language_id.learn(spark.createDataFrame([(r["text"], r["lang"]) for r in rows], "text string, lang string"))
    own, kept = defaultdict(list), []
    judged = [(*profiles.judge(r["text"]), min(12, (len(r["text"]) + 1).bit_length() - 1) if r["text"] else 0) for r in rows]
    for r, (lang, score, length) in zip(rows, judged):
        if r["lang"] == lang:
            own[lang, length].append(int(score * 1000))
    for r, (lang, score, length) in zip(rows, judged):
        lengths = sorted(x for name, x in own if name == lang)
        if lang != "und" and lengths:
            scores = sorted(own[lang, max([x for x in lengths if x <= length] or lengths[:1])])
            if score >= scores[int(0.002 * len(scores))] / 1000 - 0.03:
                kept.append(r)
    rows = kept
    group = plain_groups([(r["doc_id"], r["text"]) for r in rows], 5, 80)
    rows = [r for r in rows if group[r["doc_id"]] == r["doc_id"]]
    known = Tokenizer.from_file(public_tokenizers.path("word_bpe_49k.json"))
    found = defaultdict(list)
    for r in corpus_pipeline.run(spark, folder).collect():
        found[r.doc_id].append(np.frombuffer(bytes(r.ids), "<u4").tolist())
    sizes, taken, largest = Counter(), Counter(), Counter()
    for r in rows:
        ids = known.encode(r["text"], add_special_tokens=False).ids
        copies = found.pop(r["doc_id"], [])
        n = len(r["text"].encode().split())
        assert len(copies) <= 3 and all(c == ids for c in copies)
        sizes[r["source"]] += n
        taken[r["source"]] += n * len(copies)
        largest[r["source"]] = max(largest[r["source"]], n)
    assert not found
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long")
    target = {r.source: r.target for r in mixing.mix(docs).select("source", "target").distinct().collect()}
    assert all(abs(taken[n] - target[n]) <= largest[n] / 2 + 1 for n in sizes)
    mixed = corpus_pipeline.mix(spark, docs, folder)
    texts = {r["text"] for r in rows}
    assert mixed.columns == docs.columns and all(r.text in texts for r in mixed.collect())


def test_foreign_texts_are_rejected(spark):
    """Texts in languages that no document names go; short and long texts of the corpus stay."""
    folder = "/root/testdata/sf0.01"
    docs = read(spark, folder, "documents").filter("text IS NOT NULL")
    # Public-domain sentences.
    foreign = [
        "Nel mezzo del cammin di nostra vita mi ritrovai per una selva oscura, ché la diritta via era smarrita. Ahi quanto a dir qual era è cosa dura esta selva selvaggia e aspra e forte che nel pensier rinova la paura!",
        "Mieleni minun tekevi, aivoni ajattelevi lähteäni laulamahan, saa'ani sanelemahan, sukuvirttä suoltamahan, lajivirttä laulamahan. Sanat suussani sulavat, puhe'et putoelevat.",
        "Litwo! Ojczyzno moja! ty jesteś jak zdrowie. Ile cię trzeba cenić, ten tylko się dowie, kto cię stracił. Dziś piękność twą w całej ozdobie widzę i opisuję, bo tęsknię po tobie.",
    ]
    planted = spark.createDataFrame([(-1 - i, t * 3, None, "x", len(t) * 3) for i, t in enumerate(foreign)], docs.schema)
    kept = {r.doc_id for r in corpus_pipeline.language(spark, docs.unionByName(planted), folder).select("doc_id").collect()}
    assert not any(i < 0 for i in kept)
    worded = {r.doc_id for r in docs.filter(F.col("text").rlike(r"\p{L}")).select("doc_id").collect()}
    assert len(worded - kept) <= 0.01 * len(worded)


def test_stages_on_odd_rows(spark, odd_tables):
    folder, _ = odd_tables
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, folder)
        assert out.count() >= 0 and stage(spark, docs.limit(0), folder).count() == 0, name
        if name != "tokens":
            assert out.columns == docs.columns


def test_near_duplicates_by_row(spark):
    a, b, c = "one two three four five six", "seven eight nine ten eleven twelve", "red green blue black white grey"
    rows = [(4, a), (4, a), (None, a), (7, a), (7, b), (7, c), (None, c), (None, c), (3, b), (None, "no copy of this at all"), (None, None), (8, "")]
    docs = spark.createDataFrame([(i, t, "en", "s", 0) for i, t in rows], "doc_id long, text string, lang string, source string, n_chars long")
    kept = corpus_pipeline.near_duplicates(spark, docs.repartition(3), "")
    assert kept.columns == docs.columns
    want = {(4, a): 1, (3, b): 1, (7, c): 1, (None, "no copy of this at all"): 1, (None, None): 1, (8, ""): 1}
    assert Counter((r.doc_id, r.text) for r in kept.collect()) == want


def test_run_writes_each_stage(spark, monkeypatch):
    seen = []

    def stage(spark, docs, sf_dir):
        seen.append(docs)
        return docs.withColumn("text", F.upper("text"))

    monkeypatch.setattr(corpus_pipeline, "STAGES", [("first", stage), ("second one", stage)])
    seen.append(corpus_pipeline.run(spark, "/root/testdata/sf0.001"))
    files = [set(d.inputFiles()) for d in seen]
    assert all(files) and not (files[0] & files[1] or files[1] & files[2] or files[0] & files[2])


def test_only_the_last_result_stays(spark, monkeypatch, tmp_path):
    """What stages write on their way goes, also where a stage fails."""
    def stage(spark, docs, sf_dir):
        return written(docs.withColumn("text", F.upper("text")), "on-the-way")

    def broken(spark, docs, sf_dir):
        written(docs, "on-the-way")
        raise ValueError("no result")

    monkeypatch.setattr(common, "fresh_path", lambda spark, label: str(tmp_path / f"{label}-{len(list(tmp_path.iterdir()))}-{label}"))
    monkeypatch.setattr(corpus_pipeline, "fresh_path", common.fresh_path)
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("a", stage), ("b", stage), ("c", stage)])
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert rows.count() == 200 and [p.name[0] for p in tmp_path.iterdir()] == ["c"]
    monkeypatch.setattr(corpus_pipeline, "STAGES", [("d", broken)])
    with pytest.raises(ValueError):
        corpus_pipeline.run(spark, "/root/testdata/sf0.001")
    assert [p.name[0] for p in tmp_path.iterdir()] == ["c"]
