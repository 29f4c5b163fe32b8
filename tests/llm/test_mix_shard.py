from collections import Counter, defaultdict

from pyspark.sql import functions as F

from topicloom.llm import mixing, sharding
from topicloom.llm.common import read

FOLDER = "/root/testdata/sf0.01"


def filled(sizes, weights, total):
    """Water level by bisection."""
    lo, hi = 0.0, 1e12
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if sum(min(3 * s, mid * w) for s, w in zip(sizes, weights)) < total else (lo, mid)
    return [min(3 * s, lo * w) for s, w in zip(sizes, weights)]


def test_targets_met(spark):
    docs = read(spark, FOLDER, "documents", "doc_id", "source", "text")
    rows = mixing.mix(docs).collect()
    sizes, taken = Counter(), Counter()
    for r in rows:
        assert 0 <= r.taken <= 3 * r["size"]
        sizes[r.source] += r["size"]
        taken[r.source] += r.taken
    names = sorted(sizes)
    weights = [(5, 2, 1)[i % 3] for i in range(len(names))]
    want = dict(zip(names, filled([sizes[n] for n in names], weights, sum(sizes.values()))))
    for r in rows:
        assert abs(r.target - want[r.source]) < 1e-3 * want[r.source]
    assert all(abs(taken[n] - want[n]) <= 1 for n in names)
    again = {r.doc_id: r.taken for r in mixing.mix(docs.repartition(5)).collect()}
    assert again == {r.doc_id: r.taken for r in rows}


def test_odd_rows_and_join_path(odd, none, no_broadcast):
    rows = mixing.mix(odd).collect()
    assert len(rows) == odd.count() and mixing.mix(none).count() == 0
    by = defaultdict(list)
    for r in rows:
        by[r.source].append(r)
    for group in by.values():
        assert len({(r.source_size, r.target) for r in group}) == 1
        assert abs(sum(r.taken for r in group) - group[0].target) <= len(group)
    assert [r.taken for r in rows if r.doc_id in (1, 2, 3)] == [0, 0, 0]


def test_repeat_takes_the_words(odd):
    mixed = mixing.mix(odd).persist()
    want = {(r.doc_id, r.source): r.n for r in mixed.groupBy("doc_id", "source").agg(F.sum("taken").alias("n")).collect() if r.n}
    got = Counter()
    for r in mixing.repeat(mixed).select("doc_id", "source", "text").collect():
        got[r.doc_id, r.source] += len(r.text.encode().split())
    assert dict(got) == want


def test_given_weights(spark):
    docs = spark.createDataFrame([(i, "ab"[i % 2], "w " * 10) for i in range(40)], "doc_id long, source string, text string")
    weights = spark.createDataFrame([("a", 3.0)], "source string, weight double")
    found = {r.source: (r.target, r.n) for r in mixing.mix(docs, weights, share=0.5).groupBy("source", "target").agg(F.sum("taken").alias("n")).collect()}
    assert found == {"a": (200.0, 200), "b": (0.0, 0)}


def test_shards(spark):
    docs = read(spark, FOLDER, "documents")
    rows = sharding.shard(docs, 40, bucket_bytes=100_000).select("doc_id", "shard", "slot").collect()
    slots = defaultdict(list)
    for r in rows:
        slots[r["shard"]].append(r["slot"])
    assert len({r.doc_id for r in rows}) == len(rows) == 1000 and len(slots) == 40
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(map(len, slots.values())) - min(map(len, slots.values())) <= 1
    again = sharding.shard(docs.repartition(7), 40, bucket_bytes=100_000).select("doc_id", "shard", "slot").collect()
    assert sorted(again) == sorted(rows)
    order = [r.doc_id for r in sorted(rows, key=lambda r: (r["shard"], r["slot"]))]
    up = sum(a < b for a, b in zip(order, order[1:]))
    assert 400 < up < 600 and order != sorted(order)


def test_shards_of_odd_rows(odd, none, tmp_path):
    found = sharding.shard(odd, 3, bucket_bytes=50)
    assert found.count() == odd.count() and sharding.shard(none, 3).count() == 0
    assert Counter(r["shard"] for r in found.collect()).most_common()[0][1] <= -(-odd.count() // 3)
    sharding.write_shards(found, str(tmp_path / "out"))
    back = odd.sparkSession.read.parquet(str(tmp_path / "out"))
    assert back.count() == odd.count() and {r["shard"] for r in back.collect()} == {0, 1, 2}


def test_repeated_rows_spread_over_buckets(spark):
    rows = [(1, "the same text again and again")] * 3000 + [(i, f"text {i}") for i in range(2, 1000)]
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    found = sharding.shuffled(docs, bucket_bytes=10_000).persist()
    assert Counter(r.doc_id for r in found.select("_row.doc_id").collect()) == Counter(i for i, _ in rows)
    per_bucket = [r["count"] for r in found.filter("_row.doc_id = 1").groupBy("_bucket").count().collect()]
    assert len(per_bucket) >= 10 and max(per_bucket) < 600


def test_tied_rows_are_taken_whole_but_one(spark, monkeypatch):
    monkeypatch.setattr(mixing, "CELL_ROWS", 20)
    text = "\n".join(f"  line {i}\tof\u00a0six words here" for i in range(7))
    docs = spark.createDataFrame([(key, s, text) for s in "ab" for key in (None, 5) for _ in range(100)], "doc_id long, source string, text string")
    mixed = mixing.mix(docs.repartition(4)).persist()
    for s, rows in {s: [r for r in mixed.collect() if r.source == s] for s in "ab"}.items():
        assert len(rows) == 200 and sum(r.taken % r["size"] != 0 for r in rows) <= 1
        assert abs(sum(r.taken for r in rows) - rows[0].target) <= 1
    texts = Counter((r.source, r.text) for r in mixing.repeat(mixed).collect())
    cut = [t for _, t in texts if t != text]
    assert 1 <= len(cut) <= 2 and all(text.startswith(t) for t in cut) and all(n == 1 for (_, t), n in texts.items() if t != text)
