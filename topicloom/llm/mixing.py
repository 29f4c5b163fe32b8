"""Mixing sources to target weights.

Capped water-filling: a source's target is its weight times one water level, clamped at
``max_epochs`` times its size; the excess lifts the level of the others until no target
is above its cap.  A source whose target is e epochs gives every document floor(e) whole
repetitions, and one more to a seeded random part of its documents: those first in the
order of a keyed hash, until the target is filled; rows that share a key are ordered by
their place in a written table.  The one row at the edge gives a part of its words, so a
source's words meet its target.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import WORD, word_count, written
from topicloom.session import cut_lineage, fits_broadcast, with_row_index

#: Documents that share a cell of the hash order, about; the running sums go over cells first.
CELL_ROWS = 10_000
SEED = 7


def cycled_weights(sources: DataFrame, cycle: tuple[float, ...] = (5.0, 2.0, 1.0)) -> DataFrame:
    """(source, weight): the weights of ``cycle`` dealt to the sources in code point order, null last."""
    each = sources.select("source").distinct().withColumn("_null", F.col("source").isNull())
    placed = with_row_index(each, ["_null", "source"], "_at")
    weight = F.element_at(F.array(*[F.lit(float(c)) for c in cycle]), (F.col("_at") % len(cycle) + 1).cast("int"))
    return placed.select("source", weight.alias("weight"))


def water_fill(stats: DataFrame, max_epochs: float, share: float) -> DataFrame:
    """``stats(source_size, weight, ...)`` with ``target``.

    Only sums over the sources visit the driver: a round clamps the sources under the
    level and computes the next one.  The level only rises, so rounds end when no further
    source is clamped.
    """
    cap = F.col("source_size") * F.lit(float(max_epochs))
    total, weights = stats.agg(F.sum("source_size"), F.sum("weight")).first()
    total, level, clamped = share * (total or 0), 0.0, 0
    if weights:
        level = total / weights
        while True:
            under = cap <= F.lit(level) * F.col("weight")
            n, size, rest = stats.agg(
                F.count(F.when(under, 1)),
                F.sum(F.when(under, F.col("source_size"))),
                F.sum(F.when(~under, F.col("weight"))),
            ).first()
            if n == clamped or not rest:
                break
            clamped, level = n, (total - max_epochs * size) / rest
    return stats.withColumn("target", F.least(cap, F.lit(level) * F.col("weight")))


def order_hash(seed: int, key: Column) -> Column:
    """60 bits of an md5 of the seed and the key."""
    text = F.concat_ws("|", F.lit(str(seed)), key.cast("string"))
    return F.conv(F.substring(F.md5(text), 1, 15), 16, 10).cast("long")


def mix(
    docs: DataFrame,
    weights: DataFrame | None = None,
    *,
    size: Column | None = None,
    key: str = "doc_id",
    source: str = "source",
    max_epochs: float = 3.0,
    share: float = 1.0,
    seed: int = SEED,
) -> DataFrame:
    """``docs`` with size, source_size, target and taken.

    ``weights(source, weight)`` defaults to ``cycled_weights``; a source without a weight
    weighs 0.  ``size`` defaults to the words of ``text``.  ``taken`` is the number of
    words the mix takes from the document, repeats counted.

    Null is a source like another.  Null and empty texts have size 0 and give nothing.
    Rows that share a key, or have none, share one place in the hash order and are taken
    row by row there, in the order of a hash of their row number.  Repeated rows count each.
    Input columns named like a result are replaced, other columns may have any name; an
    empty table gives an empty table.
    """
    size = word_count(F.col("text")) if size is None else size
    sized = docs.select(F.struct("*").alias("_row"), F.col(source).alias("source"), size.alias("size"), order_hash(seed, F.col(key)).alias("_h"))
    # Written, so that a row keeps its number in every pass.
    sized = written(sized.withColumn("_r", order_hash(seed, F.monotonically_increasing_id())), "numbered")
    rows = sized.select("source", "size", "_h", "_r")
    stats = cut_lineage(
        rows.groupBy("source").agg(F.sum("size").alias("source_size"), F.count("*").alias("_n"))
    )
    weights = cycled_weights(stats) if weights is None else weights.select("source", "weight")
    stats = _join(stats, weights, "source", "source")
    stats = stats.withColumn("weight", F.coalesce(F.col("weight").cast("double"), F.lit(0.0)))
    plan = cut_lineage(
        water_fill(stats, max_epochs, share)
        .withColumn("_words", F.round("target").cast("long"))
        .withColumn("_whole", F.when(F.col("source_size") > 0, F.expr("_words div source_size")).otherwise(F.lit(0)).cast("long"))
        .withColumn("_left", F.col("_words") - F.col("_whole") * F.col("source_size"))
        .withColumn("_cells", F.ceil(F.col("_n") / F.lit(CELL_ROWS)))
        .select("source", "source_size", "target", "_whole", "_left", "_cells")
    )
    edges = cut_lineage(_edges(rows, plan))
    # The rows at the edge are placed once more, by their numbers.
    at_edge = _join(rows, edges.select("source", "_edge"), "source", "source").filter("_h = _edge")
    cells = F.ceil(F.col("_rows") / F.lit(CELL_ROWS))
    again = edges.select("source", (F.col("_left") - F.col("_before")).alias("_left"), cells.alias("_cells"))
    inner = _edges(at_edge.select("source", "size", F.col("_r").alias("_h")), again)
    inner = inner.select("source", F.col("_edge").alias("_row_edge"), (F.col("_left") - F.col("_before")).alias("_rest"))
    plan = plan.drop("_left", "_cells")
    plan = _join(plan, edges.select("source", "_edge"), "source", "source")
    plan = cut_lineage(_join(plan, inner, "source", "source"))
    found = _join(sized, plan, "source", "source")
    extra = (
        F.when((F.col("_h") < F.col("_edge")) | ((F.col("_h") == F.col("_edge")) & (F.col("_r") < F.col("_row_edge"))), F.col("size"))
        .when((F.col("_h") == F.col("_edge")) & (F.col("_r") == F.col("_row_edge")), F.least("size", "_rest"))
        .otherwise(F.lit(0))
    )
    taken = (F.col("_whole") * F.col("size") + extra).cast("long")
    results = [F.col("size"), F.col("source_size"), F.col("target"), taken.alias("taken")]
    own = [F.col("_row")[c].alias(c) for c in docs.columns if c not in ("size", "source_size", "target", "taken")]
    return found.select(*own, *results)


def _join(left: DataFrame, right: DataFrame, on: str, right_on: str) -> DataFrame:
    """Left join with one row per source, null equal to null.

    Broadcast if it fits the checked limit; otherwise a sort-merge join, where Spark
    splits the partitions of a source that holds a large share of the rows.
    """
    right = right.withColumnRenamed(right_on, "_other")
    if fits_broadcast(left.sparkSession, 200.0 * right.count()):
        right = F.broadcast(right)
    return left.join(right, left[on].eqNullSafe(right["_other"]), "left").drop("_other")


def _edges(rows: DataFrame, plan: DataFrame) -> DataFrame:
    """Per source with a part to fill (``_left``): the hash where the fill ends, the words before it, the rows at it."""
    cell = F.shiftright(F.shiftright("_h", 30) * F.col("_cells"), 30)
    by_source = Window.partitionBy("source")
    some = plan.filter("_left > 0").select("source", "_left", "_cells")
    placed = _join(rows, some, "source", "source").filter("_left > 0").withColumn("_cell", cell)
    running = F.sum("_sum").over(by_source.orderBy("_cell"))
    cells = cut_lineage(
        placed.groupBy("source", "_cell", "_left")
        .agg(F.sum("size").alias("_sum"))
        .withColumn("_base", running - F.col("_sum"))
        .filter("_base <= _left AND _left < _base + _sum")
        .select("source", F.col("_cell").alias("_at"), "_base")
    )
    inside = _join(placed, cells, "source", "source").filter("_cell = _at")
    before = F.sum("_tied").over(by_source.orderBy("_h")) + F.col("_base") - F.col("_tied")
    return (
        inside.groupBy("source", "_left", "_base", "_h")
        .agg(F.sum("size").alias("_tied"), F.count("*").alias("_rows"))
        .withColumn("_before", before)
        .filter("_before <= _left AND _left < _before + _tied")
        .select("source", "_left", F.col("_h").alias("_edge"), "_before", "_rows")
    )


def _copies(mixed: DataFrame, copies: Column, columns: dict[str, Column]) -> DataFrame:
    """Each row of a mix as often as ``copies`` says; ``columns`` are made with the copy's number in ``_copy``."""
    packed = mixed.select(F.struct("*").alias("_row"), F.explode(F.sequence(F.lit(1), copies)).alias("_copy"))
    return packed.select(*(columns.get(c, F.col("_row")[c]).alias(c) for c in mixed.columns))


def repeat(mixed: DataFrame, text: str = "text") -> DataFrame:
    """The rows of a mix, each as often as it is taken; a part of a document is its text up to the last word taken.

    At most one row of a source, that at the edge of its target, is cut.  Rows that nothing is
    taken from, those with a null or empty text among them, go.
    """
    left = F.col("_row.taken") - F.col("_row.size") * (F.col("_copy") - 1)
    spaced = F.regexp_extract_all(F.col("_row")[text], F.lit(rf"[\x20\x09-\x0D]*{WORD}"), F.lit(0))
    cut = F.array_join(F.slice(spaced, F.lit(1), left.cast("int")), "")
    part = F.when(left < F.col("_row.size"), cut).otherwise(F.col("_row")[text])
    return _copies(mixed.filter("taken > 0"), F.ceil(F.col("taken") / F.col("size")), {text: part})


def repeat_whole(mixed: DataFrame) -> DataFrame:
    """``repeat`` with whole rows only: the row at the edge of a target comes once more or not, whichever is nearer."""
    return _copies(mixed.filter("2 * taken >= size AND taken > 0"), F.floor(F.col("taken") / F.col("size") + 0.5), {})
