"""Near-duplicates by bottom-k sketches from one hash function.

1. A text's set of word shingles is hashed; equal sets are one node.  A node keeps the k
   smallest hashes of its set, its sketch.
2. Sketches are inverted: a list per retained value.  Nodes similar enough to be linked
   share at least ``overlap`` retained values, so each files only under its rarest ones,
   the others could not all be shared without one of these.
3. In each list the members are compared to the most central member.  A pair is estimated
   on the sketch of the union (a part of the two sketches), and confirmed by the exact
   Jaccard similarity of the full sets.
4. Members of lists that these links have not joined up go on with their full sets: each
   files under its rarest shingles, as many as a linked set cannot all lack.  Such lists
   hold hardly any pair that is not linked.  Again members are compared to the most
   central one, then the members of what is still apart to each other.
5. Links give components by alternating star contractions.

Full sets are made for candidates only.  Step 2 loses a link only where a sample of k
values strays five standard deviations from its mean; step 4 loses none.
"""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import text_udf, written
from topicloom.session import cut_lineage, fits_broadcast

K = 64
DEVIATIONS = 5.0
_WHITE = np.zeros(256, bool)
_WHITE[[32, 9, 10, 11, 12, 13]] = True
_STEP = np.uint64(0x9E3779B97F4A7C15)


@dataclass(frozen=True)
class Likeness:
    """Shingles of ``words`` words; linked if 100 * common >= ``percent`` * union."""

    words: int = 5
    percent: int = 80
    k: int = K

    @property
    def overlap(self) -> int:
        """Retained values that two sketches of linked sets share, at least."""
        j = self.percent / 100
        return max(1, math.floor(self.k * j - DEVIATIONS * math.sqrt(self.k * j * (1 - j))))

    def filed(self, n: Column) -> Column:
        """Rarest values under which a node files, from its set size.

        A set far smaller than k is its own sketch; so is that of any set linked to it,
        and the values shared follow from the sizes alone.
        """
        shared = F.ceil(n * self.percent / 100)
        whole = n * 100 <= self.k * self.percent
        size = F.least(n, F.lit(self.k))
        return F.greatest(F.lit(1), size + 1 - F.when(whole, shared).otherwise(F.lit(self.overlap)))


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


_BYTES = _mix(np.arange(1, 257, dtype=np.uint64) * _STEP)
_powers = np.ones(1, np.uint64)


def _word_powers(n: int) -> np.ndarray:
    global _powers
    if len(_powers) < n:
        _powers = np.cumprod(np.concatenate((np.ones(1, np.uint64), np.full(2 * n, np.uint64(0xD6E8FEB86659FD93)))), dtype=np.uint64)
    return _powers


def shingles(text: str | None, width: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of a text's shingles, A-Z in lower case.

    Fewer words than ``width`` make one shingle; a text without words has none.
    """
    if not text:
        return np.empty(0, np.int64)
    raw = np.frombuffer(text.encode().lower(), np.uint8)
    at = np.flatnonzero(~_WHITE[raw])
    if not len(at):
        return np.empty(0, np.int64)
    starts = np.concatenate(([0], np.flatnonzero(np.diff(at) > 1) + 1))
    sizes = np.diff(np.append(starts, len(at)))
    place = np.arange(len(at)) - np.repeat(starts, sizes)
    values = _BYTES[raw[at]] * _word_powers(int(sizes.max()))[place]
    words = _mix(np.add.reduceat(values, starts) + sizes.astype(np.uint64) * _STEP)
    width = min(width, len(words))
    total = np.full(len(words) - width + 1, width, np.uint64)
    for i in range(width):
        total = _mix(total * np.uint64(0xA0761D6478BD642F) + words[i : len(words) - width + 1 + i])
    return np.unique(total.view(np.int64))


def _sketches(like: Likeness):
    def kernel(column: pa.Array) -> pa.Array:
        sets = [shingles(t, like.words) for t in column.to_pylist()]
        sums = [(int(s.sum()), int(np.bitwise_xor.reduce(_mix(s.view(np.uint64))).view(np.int64)) if len(s) else 0) for s in sets]
        return pa.StructArray.from_arrays(
            [
                pa.array([len(s) for s in sets], pa.int64()),
                pa.array([a for a, _ in sums], pa.int64()),
                pa.array([b for _, b in sums], pa.int64()),
                pa.array([s[: like.k] for s in sets], pa.list_(pa.int64())),
            ],
            ["n", "s1", "s2", "sketch"],
        )

    return text_udf(kernel, "struct<n: bigint, s1: bigint, s2: bigint, sketch: array<bigint>>")


def _sets(like: Likeness):
    def kernel(column: pa.Array) -> pa.Array:
        return pa.array([shingles(t, like.words) for t in column.to_pylist()], pa.list_(pa.int64()))

    return text_udf(kernel, "array<bigint>")


def _small(df: DataFrame, n_bytes: float) -> DataFrame:
    return F.broadcast(df) if fits_broadcast(df.sparkSession, n_bytes * df.count()) else df


def postings(nodes: DataFrame, values: str, size: Column, filed: Column) -> DataFrame:
    """(v, id, n, central, rest): each node under the ``filed`` rarest of its ``size`` values, as far as others have them too.

    ``central`` is high where a node's values are common ones: the text that copies derive from.
    ``rest`` counts the node's values from this one on, rarest first.
    """
    each = nodes.select("id", "n", F.explode(values).alias("v"))
    shared = each.groupBy("v").agg(F.count("*").alias("f")).filter("f > 1")
    by_node = each.join(shared, "v").groupBy("id", "n").agg(F.array_sort(F.collect_list(F.struct("f", "v"))).alias("values"))
    central = F.aggregate("values", F.lit(0.0), lambda total, x: total + F.ln(x["f"])) / size
    first = F.slice("values", F.lit(1), F.greatest(F.lit(0), filed - (size - F.size("values"))).cast("int"))
    each = by_node.select("id", "n", central.alias("central"), F.size("values").alias("_m"), F.posexplode(first).alias("_i", "e"))
    return each.select(F.col("e.v").alias("v"), "id", "n", "central", (F.col("_m") - F.col("_i")).alias("rest"))


def _near_in_size(a: Column, b: Column, like: Likeness) -> Column:
    return F.least(a, b) * 100 >= F.greatest(a, b) * like.percent


def _estimated(pairs: DataFrame, nodes: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) whose overlap in the sketch of the union is that of linked sets."""
    sketch = nodes.select("id", "sketch")
    both = pairs.join(sketch.toDF("a", "_sa"), "a").join(sketch.toDF("b", "_sb"), "b")
    union = F.slice(F.array_sort(F.array_union("_sa", "_sb")), 1, like.k)
    common = F.size(F.array_intersect(union, F.array_intersect("_sa", "_sb")))
    return both.filter(common * like.k >= F.size(union) * like.overlap).select("a", "b")


def _full_sets(ids: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """(id, n, set) of some documents, written."""
    rows = docs.join(_small(ids.distinct(), 16.0), "id", "left_semi").select("id", _sets(like)("text").alias("set"))
    return written(rows.select("id", F.size("set").cast("long").alias("n"), "set"), "sets")


def _confirmed(pairs: DataFrame, sets: DataFrame, like: Likeness) -> DataFrame:
    """The pairs (a, b) that are linked, by their full sets."""
    full = pairs.join(sets.toDF("a", "_na", "_sa"), "a").join(sets.toDF("b", "_nb", "_sb"), "b")
    full = full.select("a", "b", "_na", "_nb", F.size(F.array_intersect("_sa", "_sb")).alias("_c"))
    return full.filter(F.col("_c") * 100 >= (F.col("_na") + F.col("_nb") - F.col("_c")) * like.percent).select("a", "b").distinct()


def _centres(lists: DataFrame) -> DataFrame:
    best = lists.groupBy("v").agg(F.max(F.struct("central", "n", "id")).alias("c"))
    return best.select("v", F.col("c.id").alias("_hub"), F.col("c.n").alias("_hub_n"))


def _stars(lists: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of each list's centre and its other members, as far as their sizes allow a link."""
    rows = lists.join(_centres(lists), "v").filter("id <> _hub").filter(_near_in_size(F.col("n"), F.col("_hub_n"), like))
    return rows.select(F.least("id", "_hub").alias("a"), F.greatest("id", "_hub").alias("b")).distinct()


def _apart(lists: DataFrame, part: DataFrame) -> DataFrame:
    """``lists`` with components ``c``, without centres, where a list still spans several components."""
    rest = lists.join(_centres(lists), "v").filter("id <> _hub").join(part, "id", "left")
    rest = rest.select("v", "id", "n", "rest", F.coalesce("component", "id").alias("c"))
    mixed = rest.groupBy("v").agg(F.min("c").alias("lo"), F.max("c").alias("hi")).filter("lo < hi").select("v")
    return rest.join(mixed, "v", "left_semi")


def components(links: DataFrame) -> DataFrame:
    """(id, component): smallest id reachable, for every id in ``links(a, b)``.

    Alternating large and small stars; only two totals per round visit the driver.
    """
    edges = cut_lineage(links.filter("a <> b").select(F.greatest("a", "b").alias("u"), F.least("a", "b").alias("v")).distinct())
    before = None
    while True:
        ways = edges.union(edges.select("v", "u"))
        least = ways.groupBy("u").agg(F.least(F.min("v"), F.col("u")).alias("m"))
        large = ways.join(least, "u").filter("v > u AND v <> m").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(least, "u").filter("v <> m").select(F.greatest("v", "m").alias("u"), F.least("v", "m").alias("v"))
        edges = cut_lineage(small.union(least.select("u", F.col("m").alias("v"))).distinct())
        now = edges.agg(F.count("*"), F.sum(F.xxhash64("u", "v").cast("decimal(38,0)"))).first()
        if now == before:
            return edges.toDF("id", "component")
        before = now


def groups(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """(key, n_shingles, component_id, kept), a row per row of ``docs``.

    ``component_id`` is the smallest key reachable over links; ``kept`` is true for it.
    Texts without words (null, empty, white space) have no shingles and no links.  Rows
    with a null key are not linked, have a null component and are kept.  Rows that repeat
    a key with equal texts are all kept or all not; different texts under one key count as
    one document.  An empty table gives an empty table.
    """
    plain = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    made = plain.withColumn("_s", _sketches(like)("text")).select("id", "_s.*")
    rows = written(made, "sketches")
    same = ["n", "s1", "s2"]
    keyed = rows.filter("n > 0 AND id IS NOT NULL")
    nodes = written(
        keyed.groupBy(*same).agg(F.min("id").alias("id"), F.first("sketch").alias("sketch")), "nodes"
    )
    links = _links(nodes, plain, like)
    found = components(links.union(_shared_keys(keyed, nodes, same)))
    of_set = nodes.select(*same, F.col("id").alias("_node")).join(found.toDF("_node", "component"), "_node", "left")
    of_set = of_set.select(*same, F.coalesce("component", "_node").alias("component_id"))
    placed = rows.select("id", *same).join(of_set, same, "left")
    component = F.when(F.col("n") > 0, F.col("component_id")).otherwise(F.col("id"))
    placed = placed.withColumn("component_id", F.when(F.col("id").isNotNull(), component))
    return placed.select(
        F.col("id").alias(key),
        F.col("n").alias("n_shingles"),
        "component_id",
        F.coalesce(F.col("id") == F.col("component_id"), F.lit(True)).alias("kept"),
    )


def _shared_keys(keyed: DataFrame, nodes: DataFrame, same: list[str]) -> DataFrame:
    """Links between the sets that rows of one key have, if a key comes with several texts."""
    several = keyed.groupBy("id").agg(F.min(F.struct(*same)).alias("lo"), F.max(F.struct(*same)).alias("hi")).filter("lo <> hi")
    rows = keyed.join(several.select("id"), "id", "left_semi").select("id", *same).distinct()
    return rows.join(nodes.select(*same, F.col("id").alias("b")), same).select(F.col("id").alias("a"), "b")


def _links(nodes: DataFrame, docs: DataFrame, like: Likeness) -> DataFrame:
    """Links that join up every component of the similarity graph of ``nodes``."""
    size = F.least(F.col("n"), F.lit(like.k))
    lists = written(postings(nodes, "sketch", size, like.filed(F.col("n"))), "postings")
    near = written(_estimated(_stars(lists, like), nodes, like), "pairs")
    sets = _full_sets(near.select(F.explode(F.array("a", "b")).alias("id")), docs, like)
    links = written(_confirmed(near, sets, like), "links")

    sets = _full_sets(_apart(lists, components(links)).select("id"), docs, like)
    needed = F.col("n") + 1 - F.ceil(F.col("n") * like.percent / 100)
    lists = written(postings(sets, "set", F.col("n"), needed), "postings")
    links = written(links.union(_confirmed(_stars(lists, like), sets, like)), "links")

    apart = written(_apart(lists, components(links)), "apart")
    return links.union(_confirmed(_pairs(apart, like), sets, like))


def _pairs(apart: DataFrame, like: Likeness) -> DataFrame:
    """Pairs (a, b) of different components whose overlap can reach that of a link.

    Sets a, b overlap in percent / (100 + percent) of their sizes' sum or more, and the
    first value that they share, rarest first, has the whole overlap at or after it in
    both.  The smaller set needs this with itself in the place of the larger one already.
    """
    reach = lambda rest, sizes: rest * (100 + like.percent) >= sizes * like.percent
    small = apart.filter(reach(F.col("rest"), F.col("n") * 2)).toDF("v", "_id", "_n", "_rest", "_c")
    ordered = (F.col("n") > F.col("_n")) | ((F.col("n") == F.col("_n")) & (F.col("id") > F.col("_id")))
    enough = reach(F.least("rest", "_rest"), F.col("n") + F.col("_n"))
    near = apart.join(small, "v").filter(ordered & (F.col("c") != F.col("_c")) & enough & _near_in_size(F.col("n"), F.col("_n"), like))
    return near.select(F.col("id").alias("a"), F.col("_id").alias("b")).distinct()


def deduplicate(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """The rows of ``docs`` that are the first of their group; rows with a null key stay."""
    gone = groups(docs, key, text, like).filter("NOT kept").select(F.col(key).alias("_gone")).distinct()
    gone = _small(written(gone, "gone"), 16.0)
    return docs.join(gone, docs[key] == gone["_gone"], "left_anti")


def first_rows(docs: DataFrame, key: str = "doc_id", text: str = "text", like: Likeness = Likeness()) -> DataFrame:
    """One row of ``docs`` of each group of rows: that of the smallest key, null last, then the first in the table.

    Rows are linked by their texts alone, whatever their keys.  Rows without words stay.
    """
    rows = written(docs.withColumn("_at", F.monotonically_increasing_id()), "numbered")
    found = groups(rows, "_at", text, like).select("_at", "component_id")
    placed = written(found.join(rows.select("_at", F.col(key).alias("_key")), "_at"), "placed")
    order = F.struct(F.col("_key").isNull().alias("none"), F.col("_key").alias("key"), F.col("_at").alias("at"))
    first = placed.groupBy("component_id").agg(F.min(order)["at"].alias("_at"))
    gone = written(placed.join(first, "_at", "left_anti").select("_at"), "gone")
    return rows.join(_small(gone, 16.0), "_at", "left_anti").select(docs.columns)
