"""Arrow helpers and model lookups shared by the per-document kernels."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import fits_broadcast, in_batches, parallelism

#: Room for the vectors of a block of documents, where the model is not broadcast; a block has as many tokens as this holds vectors.
BLOCK_BYTES = 64 << 20


def ragged(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """List column -> (offsets starting at 0, flat values)."""
    offsets = column.offsets.to_numpy().astype(np.int64)
    values = column.values.slice(offsets[0], offsets[-1] - offsets[0])
    return offsets - offsets[0], values.to_numpy(zero_copy_only=False)


def to_ragged(offsets: np.ndarray, values: np.ndarray, kind: pa.DataType) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(offsets, pa.int32()), pa.array(values, kind))


def to_rows(matrix: np.ndarray, kind: pa.DataType = pa.float64()) -> pa.Array:
    """Matrix -> list column with one list per row."""
    n, k = matrix.shape
    return to_ragged(np.arange(n + 1) * k, np.ascontiguousarray(matrix).ravel(), kind)


#: Tokens x topics of a block of a sweep.  A step handles the i-th tokens of all of a block's documents, so larger blocks take fewer steps a token.
SWEEP_CELLS = 12_000_000


def spans(offsets: np.ndarray, width: int, cells: int = 400_000) -> Iterator[tuple[int, int]]:
    """Split the documents of a batch so that tokens x width stays near ``cells``."""
    start, n = 0, len(offsets) - 1
    room = max(1, cells // max(1, width))
    while start < n:
        stop = int(np.searchsorted(offsets, offsets[start] + room, side="right")) - 1
        stop = min(n, max(stop, start + 1))
        yield start, stop
        start = stop


def gathered(batches: Iterator[pa.RecordBatch], ids: str, tokens: int) -> Iterator[pa.RecordBatch]:
    """Batches put together until their lists ``ids`` hold about so many tokens."""
    kept, held = [], 0
    for batch in batches:
        kept.append(batch)
        held += len(batch.column(ids).flatten())
        if held >= tokens:
            yield pa.concat_batches(kept)
            kept, held = [], 0
    if kept:
        yield pa.concat_batches(kept)


@dataclass(frozen=True)
class TermColumns:
    """Per-term model vectors as the kernels see them: a broadcast [n_terms, width] matrix.

    Where the model is too large for that ``table`` is ``None``, and the kernels get ``BlockColumns``.
    """

    table: Broadcast | None
    width: int

    @property
    def size(self) -> int:
        return len(self.table.value)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        """Rows of the matrix that terms have."""
        return ids

    def terms(self, rows: np.ndarray) -> np.ndarray:
        """Terms of rows of the matrix."""
        return rows

    def lines(self, rows: np.ndarray) -> np.ndarray:
        """Vectors of rows of the matrix."""
        return self.table.value[rows]

    def of(self, ids: np.ndarray) -> Callable[[int, int], np.ndarray]:
        """Function from a span of tokens to their vectors."""
        table = self.table.value
        return lambda lo, hi: table[ids[lo:hi]]


@dataclass(frozen=True)
class BlockColumns:
    """The vectors of the terms that a block of documents has, terms ascending."""

    term_ids: np.ndarray
    matrix: np.ndarray

    @property
    def width(self) -> int:
        return self.matrix.shape[1]

    @property
    def size(self) -> int:
        return len(self.matrix)

    def rows(self, ids: np.ndarray) -> np.ndarray:
        return np.searchsorted(self.term_ids, ids)

    def terms(self, rows: np.ndarray) -> np.ndarray:
        return self.term_ids[rows]

    def lines(self, rows: np.ndarray) -> np.ndarray:
        return self.matrix[rows]

    def of(self, ids: np.ndarray) -> Callable[[int, int], np.ndarray]:
        at = self.rows(ids)
        return lambda lo, hi: self.matrix[at[lo:hi]]


Kernel = Callable[[Iterator[pa.RecordBatch]], Iterator[pa.RecordBatch]]


def dense_rows(df: DataFrame, vector: str, n_terms: int, width: int) -> np.ndarray:
    """``df(term_id, vector)``, summed by term, as a matrix on the driver, for tables within the broadcast limit; absent terms are zero."""
    dense = np.zeros((n_terms, width))
    found = df.select("term_id", vector).toArrow()
    if found.num_rows:
        at = found.column("term_id").to_numpy()
        flat = np.concatenate([c.flatten().to_numpy() for c in found.column(vector).chunks])
        np.add.at(dense, at, flat.reshape(-1, width))
    return dense


@dataclass(frozen=True)
class TermVectors:
    """``df(term_id, w array<double>)``; terms absent from it count as all zero.

    A model within the broadcast limit is sent once per executor.  Of a larger one each
    block of documents gets the vectors of its own terms, one row per block and term, so
    what is shuffled grows with the distinct terms of the blocks and not with tokens, and
    no task holds more than a block's.
    """

    df: DataFrame | None
    n_bytes: float
    columns: TermColumns

    @classmethod
    def of(cls, df: DataFrame, n_terms: int, width: int) -> "TermVectors":
        spark = df.sparkSession
        n_bytes = 8.0 * n_terms * width
        if not fits_broadcast(spark, n_bytes):
            return cls(df, n_bytes, TermColumns(None, width))
        return cls(df, n_bytes, TermColumns(spark.sparkContext.broadcast(dense_rows(df, "w", n_terms, width)), width))

    @classmethod
    def of_matrix(cls, spark: SparkSession, matrix: np.ndarray) -> "TermVectors":
        """From a matrix within the broadcast limit; there is no table behind it."""
        return cls(None, float(matrix.nbytes), TermColumns(spark.sparkContext.broadcast(matrix), matrix.shape[1]))

    @classmethod
    def of_counts(cls, cells: DataFrame, slot: str, value: str, n_terms: int, width: int) -> "TermVectors":
        """From ``cells(term_id, slot, value)``, one row per non-zero entry; a broadcast holds the counts as small integers."""
        spark = cells.sparkSession
        n_bytes = 8.0 * n_terms * width
        if not fits_broadcast(spark, n_bytes):
            return cls.of(pack_cells(cells, slot, value, width), n_terms, width)
        found = cells.select("term_id", slot, value).toArrow()
        counts = found.column(value).to_numpy()
        dense = np.zeros((n_terms, width), np.int32 if counts.max(initial=0) < 1 << 31 else np.float64)
        dense[found.column("term_id").to_numpy(), found.column(slot).to_numpy()] = counts
        return cls(cells, n_bytes, TermColumns(spark.sparkContext.broadcast(dense), width))

    def run(self, docs: DataFrame, ids: str, kernel: Callable[["TermColumns | BlockColumns"], Kernel], schema: str) -> DataFrame:
        """``kernel(columns)`` over batches of ``docs(doc_id, ...)``, whose terms are in the list ``ids``."""
        if self.columns.table is not None:
            return in_batches(docs).mapInArrow(kernel(self.columns), schema)
        width = self.columns.width
        n_tokens = docs.agg(F.sum(F.size(ids))).first()[0] or 0
        blocks = max(parallelism(docs.sparkSession), -(-n_tokens * 8 * width // BLOCK_BYTES))
        tagged = docs.withColumn("_block", F.pmod(F.xxhash64("doc_id"), F.lit(blocks)))
        wanted = tagged.select(F.col("_block").alias("_of"), F.explode(ids).alias("term_id")).distinct()
        zero = F.array_repeat(F.lit(0.0), width)
        vectors = wanted.join(self.df.select("term_id", "w"), "term_id", "left").select("_of", "term_id", F.coalesce("w", zero).alias("w"))
        names = docs.columns

        def task(block: pa.Table, found: pa.Table) -> pa.Table:
            terms = found.column("term_id").to_numpy()
            flat = [c.flatten().to_numpy() for c in found.column("w").chunks]
            matrix = np.concatenate(flat).reshape(-1, width) if flat else np.zeros((0, width))
            order = np.argsort(terms)
            columns = BlockColumns(terms[order], matrix[order])
            out = list(kernel(columns)(iter(block.select(names).combine_chunks().to_batches())))
            return pa.Table.from_batches(out)

        return tagged.groupBy("_block").cogroup(vectors.groupBy("_of")).applyInArrow(task, schema)

    def release(self) -> None:
        """Drop the executors' copies; the driver keeps its own for recomputation."""
        if self.columns.table is not None:
            self.columns.table.unpersist()


def pack_cells(cells: DataFrame, slot: str, value: str, width: int) -> DataFrame:
    """cells(term_id, slot, value) -> (term_id, w array<double>) with a place per slot."""
    packed = cells.groupBy("term_id").agg(
        F.map_from_entries(F.collect_list(F.struct(slot, value))).alias("m")
    )
    places = F.sequence(F.lit(0), F.lit(width - 1))
    return packed.select(
        "term_id",
        F.transform(
            places, lambda k: F.coalesce(F.try_element_at("m", k).cast("double"), F.lit(0.0))
        ).alias("w"),
    )


def sum_vectors(rows: DataFrame, key: str, vector: str, width: int) -> DataFrame:
    """Element-wise sum of equally long arrays per key, with map-side combine."""
    if width <= 128:
        sums = rows.groupBy(key).agg(*[F.sum(F.get(vector, F.lit(i))).alias(f"_{i}") for i in range(width)])
        return sums.select(key, F.array(*[f"_{i}" for i in range(width)]).alias(vector))
    long = rows.select(key, F.posexplode(vector).alias("i", "v")).groupBy(key, "i").agg(F.sum("v").alias("v"))
    packed = long.groupBy(key).agg(F.array_sort(F.collect_list(F.struct("i", "v"))).alias("e"))
    return packed.select(key, F.col("e.v").alias(vector))
