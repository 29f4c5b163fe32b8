import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.llm import catalogue, language_id, quality_knn
from topicloom.llm.common import read

FOLDER = "/root/testdata/sf0.1"


@pytest.fixture(scope="module")
def truth(spark):
    docs = {r.doc_id: r for r in read(spark, FOLDER, "documents", "doc_id", "lang").collect()}
    labels = {r.doc_id: r.quality for r in read(spark, FOLDER, "labels").collect()}
    return docs, labels


def test_quality_on_held_out_documents(spark, truth):
    rows = [r for r in catalogue.op8_quality_neighbours(spark, FOLDER).collect() if r.held_out and r.doc_id in truth[1]]
    good = [r for r in rows if truth[1][r.doc_id] == 1]
    junk = [r for r in rows if truth[1][r.doc_id] == 0]
    assert len(junk) > 30 and np.mean([r.predicted for r in good]) > 0.97 and np.mean([r.predicted for r in junk]) < 0.1
    assert all(0 <= r.score <= 1 for r in rows)


def test_votes_equal_plain_cosines(spark):
    texts = [f"{'word ' * (i % 9 + 3)} {'$$$' * (i % 3)} text {i}" for i in range(120)]
    labels = np.array([float(i % 3 == 0) for i in range(120)])
    voters = quality_knn.Voters.of(quality_knn.features(texts), labels)
    rows = (quality_knn.features(texts) * voters.weights) @ voters.axes
    rows /= np.linalg.norm(rows, axis=1, keepdims=True)
    for text, own, got in zip(texts, rows, voters.scores(texts)):
        cosines = sorted(((float(own @ v), y) for v, y in zip(voters.vectors, labels)), reverse=True)[:15]
        votes = [(max(c, 0), y) for c, y in cosines]
        assert abs(got - sum(c * y for c, y in votes) / sum(c for c, _ in votes)) < 0.15


def test_quality_of_odd_rows(spark, odd, none):
    labels = spark.createDataFrame([(5, 1), (7, 0), (9, 0), (1, 1), (8, None), (99, 1)], "doc_id long, label int")
    voters = quality_knn.learn(odd, labels)
    found = quality_knn.score(odd, voters).collect()
    assert len(found) == odd.count() and all(0 <= r.score <= 1 for r in found)
    assert {r.score for r in found if not r.text} == {voters.prior}
    assert quality_knn.score(none, voters).count() == 0
    untaught = quality_knn.learn(none, labels)
    assert {r.score for r in quality_knn.score(odd, untaught).collect()} == {0.5}
    assert len(quality_knn.learn(odd, labels, most=2).labels) == 2


def test_language_on_held_out_documents(spark, truth):
    rows = [r for r in catalogue.op9_language_profiles(spark, FOLDER).collect() if r.held_out]
    assert np.mean([r.lang_pred == truth[0][r.doc_id].lang for r in rows]) > 0.97


def plain_grams(text):
    words = "".join(c.lower() if c.isalpha() and len(c.lower()) == 1 else c if c.isalpha() else " " for c in text).split()
    joined = " " + " ".join(words) + " " if words else ""
    for n in (1, 2, 3):
        for i in range(len(joined) - n + 1):
            gram = joined[i : i + n]
            if gram != " " and not (n == 3 and gram[1] == " "):
                yield gram


def plain_profile(texts, size):
    counts = {}
    for text in texts:
        for gram in plain_grams(text or ""):
            counts[gram] = counts.get(gram, 0) + 1
    packed = lambda g: sum(ord(c) << 21 * i for i, c in enumerate(reversed(g)))
    return sorted(counts, key=lambda g: (-counts[g], packed(g)))[:size]


def test_distances_equal_plain_profiles(odd):
    profiles = language_id.learn(odd, size=60)
    rows = odd.collect()
    langs = sorted({r.lang for r in rows if r.lang and r.text and any(map(str.isalpha, r.text))})
    known = {k: plain_profile([r.text for r in rows if r.lang == k], 60) for k in langs}
    assert profiles.languages == langs
    for r in rows:
        own = plain_profile([r.text], 60)
        far = profiles.distances(r.text)
        if not own:
            assert far is None
            continue
        want = [sum(abs(known[k].index(g) - i) if g in known[k] else 60 for i, g in enumerate(own)) / (60 * len(own)) for k in langs]
        assert np.allclose(far, want)


def test_language_of_odd_rows(odd, none):
    found = language_id.identify(odd, language_id.learn(odd)).collect()
    assert len(found) == odd.count()
    for r in found:
        letters = r.text is not None and any(map(str.isalpha, r.text))
        assert (r.lang_pred != "und") == letters and 0 <= r.score <= 1 and (letters or r.score == 0)
    assert language_id.identify(none, language_id.learn(odd)).count() == 0
    assert {r.lang_pred for r in language_id.identify(odd, language_id.learn(none)).collect()} == {"und"}


def test_counting_hands_on_what_it_cannot_hold(odd, monkeypatch):
    want = language_id.learn(odd)
    rows = [(r.lang, r.text) for r in odd.select("lang", "text").filter("lang IS NOT NULL AND text IS NOT NULL").collect()]
    monkeypatch.setattr(language_id, "HELD", 10)
    import pyarrow as pa

    batches = [pa.RecordBatch.from_pylist([{"lang": a, "text": b}]) for a, b in rows]
    sums = {}
    for out in language_id._count(iter(batches)):
        for r in out.to_pylist():
            sums[r["lang"], r["gram"]] = sums.get((r["lang"], r["gram"]), 0) + r["n"]
    for i, lang in enumerate(want.languages):
        top = sorted((g for k, g in sums if k == lang), key=lambda g: (-sums[lang, g], g))[:400]
        ranks = dict(zip(want.grams.tolist(), want.ranks[:, i].tolist()))
        assert all(ranks[g] == r for r, g in enumerate(top))
