"""Helpers that several corpus operators share."""

from __future__ import annotations

from collections.abc import Callable, Iterator
from contextlib import contextmanager

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.session import discard, fresh_path

#: A word: a longest run of characters other than ASCII white space.
WORD = r"[^\x20\x09-\x0D]+"
#: Texts a kernel turns into Python objects at once.
SLICE_BYTES = 512 << 10
#: Bytes of rows that Spark hands to a Python worker at once; by default it counts rows only, whatever the length of their texts.
BATCH_BYTES = 8 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def read(spark: SparkSession, sf_dir: str, table: str, *columns: str) -> DataFrame:
    found = spark.read.parquet(f"{sf_dir}/{table}.parquet")
    return found.select(*columns) if columns else found


def word_count(text: Column) -> Column:
    """Words of a text; a null text has none."""
    return F.coalesce(F.regexp_count(text, F.lit(WORD)), F.lit(0)).cast("long")


def slices(column: pa.Array) -> Iterator[pa.Array]:
    """Parts of a text column of about ``SLICE_BYTES`` each, so that a kernel's memory stays bounded."""
    n = len(column)
    if n == 0:
        return
    start, room = 0, max(1, int(SLICE_BYTES * n / max(1, column.nbytes)))
    while start < n:
        yield column.slice(start, room)
        start += room


def bound_batches() -> None:
    """Bound the running session's Arrow batches by bytes."""
    SparkSession.active().conf.set(BATCH_KEY, str(BATCH_BYTES))


def text_udf(kernel: Callable[[pa.Array], pa.Array], kind: str, done: Callable[[], None] | None = None):
    """Arrow UDF over one column.  ``kernel`` gets slices of bounded size; ``done`` ends a task, as its worker stays for others.

    Marked non-deterministic only so that the optimiser never evaluates it twice.
    """

    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        for column in batches:
            for part in slices(column):
                yield kernel(part)
            pa.default_memory_pool().release_unused()
        if done is not None:
            done()

    bound_batches()
    run.__annotations__ = {"batches": Iterator[pa.Array], "return": Iterator[pa.Array]}
    return F.arrow_udf(run, kind).asNondeterministic()


def crc_mod(key: Column, mod: int) -> Column:
    """crc32 of the key's text, modulo ``mod``; null stays null."""
    return F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(mod))


#: Tables written since each ``scratch`` that is open was entered.
_WRITTEN: list[list[str]] = []


def written(df: DataFrame, label: str) -> DataFrame:
    """The frame as a table in the shared folder: computed once, and kept if executors are lost."""
    path = fresh_path(df.sparkSession, label)
    if _WRITTEN:
        _WRITTEN[-1].append(path)
    df.write.parquet(path)
    return df.sparkSession.read.parquet(path)


@contextmanager
def scratch(spark: SparkSession) -> Iterator[None]:
    """Deletes at its end what ``written`` has written inside.  What is made of these tables must be stored by then."""
    _WRITTEN.append([])
    try:
        yield
    finally:
        for path in _WRITTEN.pop():
            discard(spark, path)
