import hashlib
import random
import re
import zlib

import duckdb
import pytest
from pyspark.sql import functions as F

from check import compare
from topicloom.llm import catalogue, prefix_trie

WORDS = re.compile(r"[^\x20\x09-\x0D]+")


def plain_trie(convs):
    """Nodes of {conv_id: [(role, text)]}: (conv, depth) to (parent's conv, members, children, leaves, saved, ends)."""
    members = {}
    for c, turns in convs.items():
        for d in range(len(turns) + 1):
            members.setdefault(tuple(turns[:d]), []).append(c)
    children, leaves, saved = dict.fromkeys(members, 0), dict.fromkeys(members, 0), dict.fromkeys(members, 0)
    for prefix in sorted(members, key=len, reverse=True):
        if not children[prefix]:
            leaves[prefix] = 1
        if prefix:
            saved[prefix] += (len(members[prefix]) - 1) * len(WORDS.findall(prefix[-1][1]))
            children[prefix[:-1]] += 1
            leaves[prefix[:-1]] += leaves[prefix]
            saved[prefix[:-1]] += saved[prefix]
    out = {}
    for prefix, cs in members.items():
        ends = sorted(c for c in cs if len(convs[c]) == len(prefix))
        parent = min(members[prefix[:-1]]) if prefix else None
        out[min(cs), len(prefix)] = (parent, len(cs), children[prefix], leaves[prefix], saved[prefix], ends)
    return out


def sha(ends):
    return hashlib.sha256(",".join(map(str, ends)).encode()).hexdigest()


def check(trie, convs):
    ends = {}
    for r in trie.ends.collect():
        ends.setdefault((r.depth, r.a, r.b), []).append(r.conv_id)
    digests = {(r.depth, r.a, r.b): r.ends_sha256 for r in prefix_trie.end_digests(trie.ends).collect()}
    assert digests == {n: sha(sorted(cs)) for n, cs in ends.items()}
    found = {}
    for r in trie.nodes.collect():
        assert (r.conv_id, r.depth) not in found
        found[r.conv_id, r.depth] = (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, sorted(ends.get((r.depth, r.a, r.b), [])))
    assert found == plain_trie(convs)


def turns_of(rng, n, deep=()):
    convs = {}
    for c in range(n):
        length = rng.choice((1, 2, 3, 5, 8))
        convs[c * 3 - 6] = [(rng.choice(("user", "")), rng.choice(("a b", "a", "c d e", ""))) for _ in range(length)]
    for c, length, change in deep:
        convs[c] = [("user", "again and again" if i != change else "other") for i in range(length)]
    return convs


@pytest.fixture
def small_parts(spark):
    """Many small range partitions and Arrow batches, so that conversations cross them."""
    settings = {"spark.sql.shuffle.partitions": "7", "spark.sql.adaptive.coalescePartitions.enabled": "false", "spark.sql.execution.arrow.maxRecordsPerBatch": "11"}
    old = {k: spark.conf.get(k) for k in settings}
    for k, v in settings.items():
        spark.conf.set(k, v)
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


@pytest.mark.parametrize("height", [1, 4, 32, None])
def test_trie_equals_plain(spark, small_parts, height):
    rng = random.Random(4)
    convs = turns_of(rng, 60, [(1000, 131, 131), (1001, 131, 70), (1003, 90, 200), (4, 131, 131)])
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    rng.shuffle(rows)
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").repartition(4)
    rows = prefix_trie.numbered(table, ["turn"], prefix_trie.turn_digest(F.col("role"), F.col("text")))
    check(prefix_trie.of_digests(rows, ["place"], rows.filter("place = 1").select("conv_id"), height), convs)


def test_one_hot_conversation_and_copies(spark, small_parts):
    convs = {c: [("user", "hello there"), ("bot", f"x{c % 2}")] for c in range(40)} | {99: [("user", "a")] * 80, 100: []}
    rows = [(c, i, *turn) for c, turns in convs.items() for i, turn in enumerate(turns)]
    table = spark.createDataFrame(rows, "conv_id long, place long, role string, text string")
    digests = table.select("conv_id", "place", *prefix_trie.turn_digest(F.col("role"), F.col("text")))
    every = spark.createDataFrame([(c,) for c in convs], "conv_id long")
    check(prefix_trie.of_digests(digests, ["place"], every), convs)


def test_odd_rows(spark):
    rows = [(1, None, None, None), (1, 0, "u", "b"), (1, 0, "u", "a"), (1, 0, "u", "a"), (None, 1, "u", "a"), (2, None, "", ""), (2, 5, "u", "a" * 9000)]
    table = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string").withColumns({"depth": F.lit("x"), "n_convs": F.lit("y"), "t1": F.lit("z")})
    convs = {1: [("", ""), ("u", "a"), ("u", "a"), ("u", "b")], 2: [("", ""), ("u", "a" * 9000)]}
    check(prefix_trie.build(table), convs)
    empty = prefix_trie.build(table.limit(0))
    assert empty.nodes.count() == 0 and prefix_trie.end_digests(empty.ends).count() == 0


def test_query_equals_plain(spark):
    folder = "/root/testdata/sf0.01"
    given = {}
    for r in sorted(spark.read.parquet(f"{folder}/conversations.parquet").collect(), key=lambda r: (r.conv_id, r.turn)):
        given.setdefault(r.conv_id, []).append((r.role or "", r.text or ""))
    convs = {}
    for c, turns in given.items():
        h = zlib.crc32(str(c).encode()) % 4
        convs[c] = given.get(c - c % 20, [])[:h] + turns[h:]
    rows = catalogue.QUERIES["op12_prefix_trie"](spark, folder).collect()
    found = {(r.conv_id, r.depth): (r.parent_conv_id, r.n_convs, r.n_children, r.n_leaves, r.saved_tokens, r.ends_sha256) for r in rows}
    assert len(found) == len(rows)
    assert found == {n: (*v[:-1], sha(v[-1])) for n, v in plain_trie(convs).items()}


def test_query_equals_sql(spark):
    folder = "/root/testdata/sf0.001"
    con = duckdb.connect()
    con.sql(f"CREATE VIEW conversations AS SELECT * FROM read_parquet('{folder}/conversations.parquet')")
    ours = catalogue.QUERIES["op12_prefix_trie"](spark, folder).toPandas()
    assert compare(ours, con.sql(catalogue.ORACLES["op12_prefix_trie"]).df()).startswith("OK")
