"""Sharding by an external shuffle in two passes.

The first pass scatters the records into buckets by a seeded hash; the number of buckets
follows from the bytes of the table, so that a bucket fits in memory.  The second pass
shuffles each bucket (Spark's seeded ``shuffle`` is a Fisher-Yates shuffle) and writes it.
The buckets one after another are the shuffled table; shards are equal cuts of it, so
their row counts are at most one apart (law ``rows``).
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import written
from topicloom.session import fits_broadcast

BUCKET_BYTES = 32 << 20
#: Repeats of a row are scattered one by one from this part of a bucket on.
HOT_PARTS = 8
SEED = 11


def record_bytes(text: str = "text") -> Column:
    """UTF-8 bytes of the text (null: none) plus 16."""
    return (F.coalesce(F.octet_length(F.col(text)), F.lit(0)) + F.lit(16)).cast("long")


def shuffled(docs: DataFrame, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """The rows of ``docs`` as ``_row``, with ``_bucket`` and ``_pos`` (from 0 in its bucket), read from the written buckets.

    A bucket is one partition, sorted by the hash before it is shuffled, so a lost task
    shuffles alike when it runs again.  Rows that repeat a key and text are scattered row by
    row where together they would fill a bucket to more than one ``HOT_PARTS``th.
    """
    total = docs.agg(F.sum(record_bytes(text))).first()[0] or 0
    n = max(1, -(-total // bucket_bytes))
    # Rows without a key are told apart by their place, else they could all meet in one bucket.
    told = F.coalesce(F.col(key).cast("string"), F.concat(F.lit("row "), F.monotonically_increasing_id().cast("string")))
    crc = F.crc32(F.col(text).cast("binary"))
    hashed = docs.select(
        F.struct("*").alias("_row"),
        F.xxhash64(F.lit(seed), told, crc).alias("_key"),
        record_bytes(text).alias("_bytes"),
        F.monotonically_increasing_id().alias("_place"),
    )
    sums = hashed.groupBy("_key").agg(F.sum("_bytes").alias("_sum"), F.count("*").alias("_n"))
    # At most HOT_PARTS rows per bucket.
    hot = written(sums.filter((F.col("_n") > 1) & (F.col("_sum") * HOT_PARTS > bucket_bytes)).select(F.col("_key").alias("_hot")), "hot")
    hot = F.broadcast(hot) if fits_broadcast(docs.sparkSession, 16.0 * HOT_PARTS * n) else hot
    salted = F.when(F.col("_hot").isNotNull(), F.xxhash64("_key", "_place")).otherwise(F.col("_key"))
    scattered = (
        hashed.join(hot, F.col("_key") == F.col("_hot"), "left")
        .select("_row", salted.alias("_key"))
        .withColumn("_bucket", F.pmod("_key", F.lit(n)).cast("int"))
        .repartitionById(n, "_bucket")
        .sortWithinPartitions("_bucket", "_key")
    )
    buckets = scattered.groupBy("_bucket").agg(F.collect_list("_row").alias("_rows"))
    return written(buckets.select("_bucket", F.posexplode(F.shuffle("_rows", F.lit(seed))).alias("_pos", "_row")), "buckets")


def shard(docs: DataFrame, n_shards: int, key: str = "doc_id", text: str = "text", bucket_bytes: int = BUCKET_BYTES, seed: int = SEED) -> DataFrame:
    """``docs`` in random order: with shard (from 0) and slot (gapless from 0 in its shard).

    Null and empty texts are records of 16 bytes.  Repeated rows are records each; rows
    with a null key, and rows repeated so often that they would fill a bucket, are placed by
    their position, so ``docs`` should be a table read from files.  Input columns named
    shard or slot are replaced; an empty table gives an empty table.
    """
    rows = shuffled(docs.drop("shard", "slot"), key, text, bucket_bytes, seed)
    counts = rows.groupBy("_bucket").agg(F.count("*").alias("_n"))
    # One row per bucket, so at most bytes / bucket_bytes rows.
    upto = F.sum("_n").over(Window.orderBy("_bucket"))
    starts = counts.select("_bucket", (upto - F.col("_n")).alias("_start"))
    n_rows, n_buckets = counts.agg(F.sum("_n"), F.count("*")).first()
    if fits_broadcast(docs.sparkSession, 16.0 * n_buckets):
        starts = F.broadcast(starts)
    n_rows = n_rows or 1
    placed = rows.join(starts, "_bucket").withColumn("_at", F.col("_start") + F.col("_pos"))
    placed = placed.withColumn("_shard", F.expr(f"_at * {n_shards} div {n_rows}"))
    first = F.expr(f"(_shard * {n_rows} + {n_shards - 1}) div {n_shards}")
    return placed.select("_row.*", F.col("_shard").cast("int").alias("shard"), (F.col("_at") - first).alias("slot"))


def write_shards(sharded: DataFrame, path: str) -> None:
    """One folder per shard; rows keep their slots.  Buckets are written where they are, without a shuffle."""
    sharded.sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
