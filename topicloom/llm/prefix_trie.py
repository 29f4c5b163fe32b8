"""Trie of conversation prefixes, with subtree totals by bands of depth.

A node is a distinct sequence of first turns.  It is named by its depth and two rolling hashes of
its turns, which a scan over the conversations in order gives: rows are range partitioned by
conversation and place, so even one conversation of a third of all rows spreads over many tasks;
what a task needs of the tasks before it is one small row each, which the driver composes.

Subtree totals.  Depths are cut into bands of equal height.  A node adds its own value to itself
and its ancestors within its band only (one explosion of at most a band's height).  The totals of
the band's roots are completed band by band, deepest first; each completed root's total is then
added to its ancestors in the band above (one more such explosion).  The height is at least
``LEAST_HEIGHT`` and grows with the square root of the depth, which bounds rounds and explosion.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import word_count, written
from topicloom.session import cut_lineage, lookup_join

LEAST_HEIGHT = 32
#: Odd multipliers of the two rolling hashes (modulo 2^64).
LANES = (0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F)
NODE = ["depth", "a", "b"]


def turn_digest(role: Column, text: Column) -> list[Column]:
    """Two 64-bit hashes of a turn and the number of its words; null counts as empty."""
    role, text = F.coalesce(role, F.lit("")), F.coalesce(text, F.lit(""))
    return [F.xxhash64(role, text).alias("t1"), F.xxhash64(F.lit("turn"), text, role).alias("t2"), word_count(text).alias("words")]


def _in_order(rows: DataFrame, order: Sequence[str], keep: Sequence[str | Column]) -> DataFrame:
    """Rows in order of (conv_id, ``order``), nulls first, over range partitions whose number is in ``part``."""
    by = ["conv_id", *order]
    ranged = rows.filter(F.col("conv_id").isNotNull()).repartitionByRange(*by).sortWithinPartitions(*by)
    return cut_lineage(ranged.select(F.spark_partition_id().alias("part"), "conv_id", *keep))


@dataclass(frozen=True)
class _Ends:
    """What a partition says of itself: its first and last conversation and the rows of the last one."""

    first: int
    last: int
    rows: int


def _partition_ends(sorted_rows: DataFrame) -> dict[int, _Ends]:
    def ends(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part = first = last = None
        rows = 0
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            if first is None:
                part, first = batch.column("part")[0].as_py(), int(conv[0])
            other = np.flatnonzero(conv != conv[-1])
            tail = len(conv) - (other[-1] + 1 if len(other) else 0)
            rows = rows + tail if last == conv[-1] and tail == len(conv) else tail
            last = int(conv[-1])
        if first is not None:
            yield pa.RecordBatch.from_pydict({"part": pa.array([part], pa.int32()), "first": [first], "last": [last], "rows": [rows]})

    found = sorted_rows.select("part", "conv_id").mapInArrow(ends, "part int, first long, last long, rows long").collect()
    return {r["part"]: _Ends(r["first"], r["last"], r["rows"]) for r in sorted(found, key=lambda r: r["part"])}


def _rows_before(ends: dict[int, _Ends]) -> dict[int, int]:
    """For each partition, the rows that its first conversation has in the partitions before it."""
    before, open_, rows = {}, None, 0
    for part, e in ends.items():
        before[part] = rows if e.first == open_ else 0
        rows = e.rows + (before[part] if e.first == e.last else 0)
        open_ = e.last
    return before


def _places(conv: np.ndarray, last: int | None, rows: int) -> np.ndarray:
    """Number of each row within its conversation, from 0; the first conversation goes on after ``rows`` rows if it is ``last``."""
    new = np.concatenate([[conv[0] != last], conv[1:] != conv[:-1]])
    at = np.arange(len(conv))
    start = np.maximum.accumulate(np.where(new, at, -1))
    return np.where(start >= 0, at - start, at + rows)


def numbered(rows: DataFrame, order: Sequence[str], keep: Sequence[str | Column]) -> DataFrame:
    """``conv_id``, the kept columns (of type long) and ``place``, the row's number in its conversation, from 1.

    Rows without a conversation go.  Rows that tie in ``order`` come in the order of the table.
    """
    tied = rows.withColumn("_tie", F.monotonically_increasing_id())
    ordered = _in_order(tied, [*order, "_tie"], keep)
    before = _rows_before(_partition_ends(ordered))

    def number(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows = None, None
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            if rows is None:
                last, rows = int(conv[0]), before[batch.column("part")[0].as_py()]
            place = _places(conv, last, rows)
            last, rows = int(conv[-1]), int(place[-1]) + 1
            yield batch.drop_columns(["part"]).append_column("place", pa.array(place + 1))

    kept = ordered.drop("part")
    names = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in kept.schema)
    return ordered.mapInArrow(number, f"{names}, place long")


def _power(base: int, exponent: np.ndarray) -> np.ndarray:
    """base ** exponent, modulo 2^64."""
    out, square, left = np.ones(len(exponent), np.uint64), np.uint64(base), exponent.astype(np.uint64)
    with np.errstate(over="ignore"):
        while left.any():
            out = np.where(left & np.uint64(1), out * square, out)
            square, left = square * square, left >> np.uint64(1)
    return out


def _sums(turns: np.ndarray, depth: np.ndarray, lane: int, open_: int) -> np.ndarray:
    """Sum of turn / lane^depth within each conversation, the first one going on from ``open_``.

    Times lane^depth it is the rolling hash of the prefix: hash * lane + turn at each step.
    """
    with np.errstate(over="ignore"):
        total = np.cumsum(turns.view(np.uint64) * _power(pow(lane, -1, 1 << 64), depth), dtype=np.uint64)
        start = np.arange(len(depth)) - depth
        base = np.where(start > 0, total[np.maximum(start, 1) - 1], np.uint64(0))
        return total - base + np.where(start < 0, np.uint64(open_), np.uint64(0))


@dataclass(frozen=True)
class _Carry:
    """What a partition needs of those before it: rows of its first conversation there and its last sums (both lanes); the next conversation after it."""

    rows: int
    sums: tuple[np.ndarray, np.ndarray]
    next_conv: int | None


def _carries(sorted_rows: DataFrame, ends: dict[int, _Ends], height: int) -> dict[int, _Carry]:
    before = _rows_before(ends)

    def tails(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, last, rows, open_ = None, None, 0, [0, 0]
        kept: list[np.ndarray] = [np.zeros(0, np.uint64)] * 2
        for batch in batches:
            if not batch.num_rows:
                continue
            conv = batch.column("conv_id").to_numpy()
            if part is None:
                part = batch.column("part")[0].as_py()
                last, rows = int(conv[0]), before[part]
            depth = _places(conv, last, rows)
            tail = int(np.flatnonzero(np.concatenate([[True], conv[1:] != conv[:-1]]))[-1])
            for lane in (0, 1):
                sums = _sums(batch.column(f"t{lane + 1}").to_numpy(), depth, LANES[lane], open_[lane])
                goes_on = tail == 0 and conv[0] == last
                kept[lane] = np.concatenate([kept[lane] if goes_on else kept[lane][:0], sums[tail:]])[-height:]
                open_[lane] = int(sums[-1])
            last, rows = int(conv[-1]), int(depth[-1]) + 1
        if part is not None:
            lists = [pa.array([k.view(np.int64)], pa.list_(pa.int64())) for k in kept]
            yield pa.RecordBatch.from_arrays([pa.array([part], pa.int32()), *lists], ["part", "s1", "s2"])

    found = sorted_rows.mapInArrow(tails, "part int, s1 array<long>, s2 array<long>").collect()
    tail = {r["part"]: [np.array(r[c], np.int64).view(np.uint64) for c in ("s1", "s2")] for r in found}
    out: dict[int, _Carry] = {}
    parts, none = list(ends), np.zeros(0, np.uint64)
    open_, sums = None, (none, none)
    for part, after in zip(parts, [*parts[1:], None]):
        e = ends[part]
        held = sums if e.first == open_ else (none, none)
        out[part] = _Carry(before[part], held, None if after is None else ends[after].first)
        new = []
        for lane in (0, 1):
            own = tail[part][lane]
            if e.first == e.last and len(held[lane]):
                own = np.concatenate([held[lane], own + held[lane][-1]])[-height:]
            new.append(own)
        open_, sums = e.last, (new[0], new[1])
    return out


_PREFIX = "conv_id long, depth long, a long, b long, words long, is_end boolean, up_a array<long>, up_b array<long>"


def _prefixes(sorted_rows: DataFrame, carries: dict[int, _Carry], height: int) -> DataFrame:
    """Every prefix of every conversation, with the hashes of its ancestors, nearest first: those in
    its band, or for the root of a band (but the top one) the whole band above."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        waiting: pa.RecordBatch | None = None
        state: list = []

        def emit(batch: pa.RecordBatch, next_conv: int | None) -> pa.RecordBatch:
            conv = batch.column("conv_id").to_numpy()
            if not state:
                carry = carries[batch.column("part")[0].as_py()]
                state[:] = [int(conv[0]), carry.rows, *carry.sums]
            last, rows, *held = state
            depth = _places(conv, last, rows)
            if conv[0] != last:
                held = [held[0][:0], held[1][:0]]
            hashes, new = [], []
            for lane in (0, 1):
                sums = _sums(batch.column(f"t{lane + 1}").to_numpy(), depth, LANES[lane], int(held[lane][-1]) if len(held[lane]) else 0)
                every = np.concatenate([held[lane], sums])
                with np.errstate(over="ignore"):
                    depths = np.concatenate([depth[0] - len(held[lane]) + np.arange(len(held[lane])), depth])
                    hashes.append((every * _power(LANES[lane], depths)).view(np.int64))
                new.append(every[-min(height, int(depth[-1]) + 1) :])
            state[:] = [int(conv[-1]), int(depth[-1]) + 1, *new]
            n_held = len(held[0])
            ups = np.where(depth % height, depth % height, np.where(depth > 0, height, 0))
            edges = np.concatenate([[0], np.cumsum(ups)])
            back = np.arange(edges[-1]) - np.repeat(edges[:-1], ups) + 1
            at = np.repeat(np.arange(len(conv)) + n_held, ups) - back
            offsets = pa.array(edges, pa.int32())
            lists = [pa.ListArray.from_arrays(offsets, pa.array(h[at])) for h in hashes]
            ends = np.concatenate([conv[1:] != conv[:-1], [next_conv is None or conv[-1] != next_conv]])
            columns = [pa.array(conv), pa.array(depth), *(pa.array(h[n_held:]) for h in hashes), batch.column("words"), pa.array(ends), *lists]
            return pa.RecordBatch.from_arrays(columns, ["conv_id", "depth", "a", "b", "words", "is_end", "up_a", "up_b"])

        part = None
        for batch in batches:
            if not batch.num_rows:
                continue
            part = batch.column("part")[0].as_py()
            if waiting is not None:
                yield emit(waiting, batch.column("conv_id")[0].as_py())
            waiting = batch
        if waiting is not None:
            yield emit(waiting, carries[part].next_conv)

    return sorted_rows.mapInArrow(scan, _PREFIX)


@dataclass(frozen=True)
class Trie:
    """``nodes``: depth, a, b (the node's name), conv_id, parent_conv_id, n_convs, n_children, n_leaves, saved_tokens.

    ``ends``: depth, a, b and conv_id of every conversation, at its last turn's node.
    """

    nodes: DataFrame
    ends: DataFrame


def build(turns: DataFrame, order: Sequence[str] = ("turn", "role", "text")) -> Trie:
    """Trie of conversations (conv_id, turn, role, text).

    Turns go by ``order``, nulls first; rows that tie wholly are equal turns, and all stay.  A null role or text
    is empty; rows without a conversation go.  Other columns are not read.  A conversation is in the table by its
    rows, so none is without turns here (see ``of_digests``); an empty table has no node.
    """
    texts = [F.coalesce(c, F.lit("")).alias(c) for c in ("role", "text")]
    plain = turns.select("conv_id", *[F.col(c) for c in order if c not in ("role", "text")], *texts)
    rows = numbered(plain, order, turn_digest(F.col("role"), F.col("text")))
    start = rows.filter("place = 1").select("conv_id")
    return of_digests(rows, ["place"], start)


def of_digests(turns: DataFrame, order: Sequence[str], conversations: DataFrame, height: int | None = None) -> Trie:
    """Trie of turns given by ``turn_digest`` (conv_id, t1, t2, words and the columns of ``order``, all of type long, unique in a conversation).

    ``conversations`` has each ``conv_id`` once, also of those without turns; they are members of the root.
    """
    zero = [F.lit(0).cast("long").alias(c) for c in ("t1", "t2", "words")]
    least = [F.lit(None).cast("long").alias(c) for c in order]
    named = [f"_{i}" for i in range(len(order))]
    steps = conversations.select("conv_id", *zero, *least).unionByName(turns.select("conv_id", "t1", "t2", "words", *order))
    steps = steps.withColumnsRenamed(dict(zip(order, named)))
    ordered = _in_order(steps, named, ["t1", "t2", "words"])
    ends = _partition_ends(ordered)
    deepest = _deepest(ordered, ends)
    height = height or max(LEAST_HEIGHT, math.isqrt(deepest) + 1)
    prefixes = written(_prefixes(ordered, _carries(ordered, ends, height), height), "prefixes")
    first = F.min(F.struct("conv_id", "up_a", "up_b"))
    nodes = prefixes.groupBy(*NODE).agg(first.alias("_m"), F.count("*").alias("n_convs"), F.max("words").alias("words"))
    nodes = written(nodes.select(*NODE, "_m.*", "n_convs", "words"), "trie-nodes")
    return Trie(_totals(nodes, deepest - 1, height), prefixes.filter("is_end").select(*NODE, "conv_id"))


def _deepest(ordered: DataFrame, ends: dict[int, _Ends]) -> int:
    """Rows of the longest conversation, with its start."""
    before = _rows_before(ends)

    def longest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        last, rows, most = None, None, 0
        for batch in batches:
            if batch.num_rows:
                conv = batch.column("conv_id").to_numpy()
                if rows is None:
                    last, rows = int(conv[0]), before[batch.column("part")[0].as_py()]
                place = _places(conv, last, rows)
                most = max(most, int(place.max()) + 1)
                last, rows = int(conv[-1]), int(place[-1]) + 1
        yield pa.RecordBatch.from_pydict({"n": pa.array([most], pa.int64())})

    return ordered.select("part", "conv_id").mapInArrow(longest, "n long").agg(F.max("n")).first()[0] or 0


def _explode_up(rows: DataFrame, values: Sequence[str], itself: bool) -> DataFrame:
    """``values`` summed by ancestor in the lists of ``up_a`` and ``up_b``, and by the row's own node."""
    up = F.transform(F.arrays_zip("up_a", "up_b"), lambda x, i: F.struct((F.col("depth") - i - 1).alias("depth"), x["up_a"].alias("a"), x["up_b"].alias("b")))
    own = F.array(F.struct(*NODE))
    every = F.concat(own, F.when(F.col("in_band"), up).otherwise(F.slice(up, 1, 0))) if itself else up
    return rows.select(F.explode(every).alias("n"), *values).groupBy("n.depth", "n.a", "n.b").agg(*(F.sum(v).alias(v) for v in values))


def _totals(nodes: DataFrame, deepest: int, height: int) -> DataFrame:
    values = ["n_leaves", "saved_tokens"]
    parent = [(F.col("depth") - 1).alias("depth"), F.get("up_a", F.lit(0)).alias("a"), F.get("up_b", F.lit(0)).alias("b")]
    below = nodes.filter("depth > 0")
    children = below.select(*parent).groupBy(*NODE).agg(F.count("*").alias("n_children"))
    counted = nodes.join(children, NODE, "left").withColumn("n_children", F.coalesce("n_children", F.lit(0)))
    leaf = (F.col("n_children") == 0).cast("long")
    valued = counted.withColumns({"n_leaves": leaf, "saved_tokens": (F.col("n_convs") - 1) * F.col("words"), "in_band": F.col("depth") % height != 0})
    valued = written(valued, "trie-values")
    totals = _explode_up(valued, values, itself=True)
    if deepest >= height:
        totals = written(totals, "trie-bands")
        roots = valued.filter(~F.col("in_band") & (F.col("depth") > 0)).select(*NODE, "up_a", "up_b").join(totals, NODE)
        roots = cut_lineage(roots)
        done: list[DataFrame] = []
        for band in range(deepest // height, 0, -1):
            now = roots.filter(F.col("depth") == band * height)
            if done:
                over = [(F.col("depth") - height).alias("depth"), F.get("up_a", F.lit(height - 1)).alias("a"), F.get("up_b", F.lit(height - 1)).alias("b")]
                came = done[-1].select(*over, *values).groupBy(*NODE).agg(*(F.sum(v).alias(f"_{v}") for v in values))
                now = now.join(came, NODE, "left").select(*NODE, "up_a", "up_b", *((F.col(v) + F.coalesce(f"_{v}", F.lit(0))).alias(v) for v in values))
            done.append(cut_lineage(now))
        handed = _explode_up(reduce(DataFrame.unionByName, done), values, itself=False)
        totals = totals.unionByName(handed).groupBy(*NODE).agg(*(F.sum(v).alias(v) for v in values))
    kept = valued.select(*NODE, "conv_id", "n_convs", "n_children", *(c.alias(f"p{c_}") for c, c_ in zip(parent, NODE)))
    whole = kept.join(totals, NODE)
    named = valued.filter("n_children > 0").select(*(F.col(c).alias(f"p{c}") for c in NODE), F.col("conv_id").alias("parent_conv_id"))
    # The table of parents grows with the input, so it is never broadcast; hot parents are salted.
    return lookup_join(whole, named, [f"p{c}" for c in NODE], "left", math.inf, ["a", "b"]).drop(*(f"p{c}" for c in NODE))


#: Conversation numbers of one range of so many (a power of two) are joined before they meet at their node.
RANGE_BITS = 10


def end_digests(ends: DataFrame) -> DataFrame:
    """Per node (depth, a, b) ``ends_sha256``: lowercase SHA-256 of its conversations' numbers, ascending, joined by commas.

    Numbers are joined by ranges first, so that a node that a third of all conversations end at has a
    thousandth of its rows in the last step, where the hash runs over the ranges in order and holds one at a time.
    """
    numbers = F.array_join(F.transform(F.array_sort(F.collect_list("conv_id")), lambda c: c.cast("string")), ",")
    ranges = ends.groupBy(*NODE, F.shiftright("conv_id", RANGE_BITS).alias("range")).agg(numbers.alias("numbers"))

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        node, sha = None, hashlib.sha256()
        out: list[tuple] = []
        for batch in batches:
            for *this, numbers in zip(*(batch.column(c).to_pylist() for c in (*NODE, "numbers"))):
                if this != node:
                    if node is not None:
                        out.append((*node, sha.hexdigest()))
                    node, sha = this, hashlib.sha256(numbers.encode())
                else:
                    sha.update(b"," + numbers.encode())
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(c) for c in zip(*out)], [*NODE, "ends_sha256"])
                out = []
        if node is not None:
            yield pa.RecordBatch.from_arrays([pa.array([x]) for x in (*node, sha.hexdigest())], [*NODE, "ends_sha256"])

    in_order = ranges.repartition(*NODE).sortWithinPartitions(*NODE, "range").select(*NODE, "numbers")
    return in_order.mapInArrow(digest, "depth long, a long, b long, ends_sha256 string")
