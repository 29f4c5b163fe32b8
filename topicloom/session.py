"""Session helpers: shared folder, lineage cuts, scan spread, size-checked joins."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Sequence

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

BROADCAST_BYTES_KEY = "spark.topicloom.maxBroadcastBytes"
DEFAULT_BROADCAST_BYTES = 256 << 20
#: Rows of one key that a task of a shuffled lookup takes, about.
HOT_ROWS = 1_000_000


def shared_folder(spark: SparkSession) -> str:
    """Folder named by ``spark.checkpoint.dir``; a temporary one only for local masters."""
    sc = spark.sparkContext
    folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
    if folder:
        return folder.rstrip("/")
    current = sc.getCheckpointDir()
    if current:
        return current.rstrip("/")
    if not sc.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    folder = tempfile.mkdtemp(prefix="topicloom-")
    sc.setCheckpointDir(folder)
    return folder


def fresh_path(spark: SparkSession, label: str) -> str:
    """New, unused path for a written table inside the shared folder."""
    return f"{shared_folder(spark)}/{label}-{uuid.uuid4().hex}"


def discard(spark: SparkSession, path: str) -> None:
    """Delete a table that this session has written and no frame reads any more."""
    place = spark._jvm.org.apache.hadoop.fs.Path(path)
    place.getFileSystem(spark._jsc.hadoopConfiguration()).delete(place, True)


class RollingTables:
    """States of an iteration, each written in the shared folder; all but the last two are deleted."""

    def __init__(self, label: str, keep: int = 2):
        self.label, self.keep = label, keep
        self.paths: list[str] = []

    def add(self, df: DataFrame) -> DataFrame:
        """The state as written: lineage ends here, and lost executors do not matter."""
        spark = df.sparkSession
        path = fresh_path(spark, self.label)
        df.write.parquet(path)
        self.paths.append(path)
        while len(self.paths) > self.keep:
            discard(spark, self.paths.pop(0))
        return spark.read.schema(df.schema).parquet(path)

    def clear(self, spark: SparkSession) -> None:
        """Delete the states that are left."""
        while self.paths:
            discard(spark, self.paths.pop())


def drop_shuffles(spark: SparkSession) -> None:
    """Let go of finished shuffles' files, which stay until the driver happens to collect its garbage."""
    spark._jvm.System.gc()


def cut_lineage(df: DataFrame) -> DataFrame:
    """Reliable checkpoint in the shared folder; survives the loss of executors."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_folder(spark))
    return df.checkpoint(eager=True)


#: Bytes of rows that Spark hands to a Python worker at once; by default it counts rows only, whatever their length.
BATCH_BYTES = 16 << 20
BATCH_KEY = "spark.sql.execution.arrow.maxBytesPerBatch"


def in_batches(df: DataFrame) -> DataFrame:
    """The frame as it goes to Python workers, with Arrow batches of the running session bounded by bytes."""
    df.sparkSession.conf.set(BATCH_KEY, str(BATCH_BYTES))
    return df


def hold(df: DataFrame) -> DataFrame:
    """Cache a frame that several jobs read."""
    return df.persist(StorageLevel.MEMORY_AND_DISK)


def parallelism(spark: SparkSession) -> int:
    return spark.sparkContext.defaultParallelism


def spread(df: DataFrame, *keys: str) -> DataFrame:
    """Repartition a scan only if it has fewer splits than the cluster has cores.

    A large table has many splits and passes through untouched; a small one (a
    single row group, say) would otherwise keep all the work in one task.  The
    hash partitioning on ``keys`` also serves later groupings on them.
    """
    n = parallelism(df.sparkSession)
    if df.rdd.getNumPartitions() >= n:
        return df
    return df.repartition(n, *keys)


def broadcast_limit(spark: SparkSession) -> int:
    return int(spark.conf.get(BROADCAST_BYTES_KEY, str(DEFAULT_BROADCAST_BYTES)))


def fits_broadcast(spark: SparkSession, n_bytes: float) -> bool:
    return n_bytes <= broadcast_limit(spark)


def lookup_join(
    big: DataFrame,
    table: DataFrame,
    on: Sequence[str],
    how: str,
    table_bytes: float,
    salt_from: Sequence[str | Column],
) -> DataFrame:
    """Join ``big`` with a lookup table whose size is known.

    Within the session's limit the table is broadcast.  Beyond it both sides shuffle.
    Keys that hold more than ``HOT_ROWS`` rows of ``big`` are counted out first: their
    rows spread over as many salts, taken from ``salt_from``, as keep a salt's share
    under that, and only their table rows are copied.
    """
    if fits_broadcast(big.sparkSession, table_bytes):
        return big.join(F.broadcast(table), list(on), how)
    counts = big.groupBy(*on).agg(F.count("*").alias("_rows")).filter(F.col("_rows") > HOT_ROWS)
    hot = cut_lineage(counts.select(*on, F.ceil(F.col("_rows") / HOT_ROWS).cast("int").alias("_fan")))
    n_hot = hot.count()
    if not n_hot:
        return big.join(table, list(on), how)
    if fits_broadcast(big.sparkSession, 100.0 * n_hot):
        hot = F.broadcast(hot)
    fan = F.coalesce("_fan", F.lit(1))
    salted = big.join(hot, list(on), "left").withColumn("_salt", F.pmod(F.xxhash64(*salt_from), fan).cast("int")).drop("_fan")
    copies = table.join(hot, list(on), "left").withColumn("_salt", F.explode(F.sequence(F.lit(0), fan - 1))).drop("_fan")
    return salted.join(copies, [*on, "_salt"], how).drop("_salt")


def with_row_index(df: DataFrame, order_by: Sequence[str], name: str) -> DataFrame:
    """Global 0-based position in the order of ``order_by`` without a one-task window.

    Rows are range partitioned and sorted; only one count per partition visits
    the driver.  The sorted rows are checkpointed first, so the counts and the
    rows they are applied to come from the same partitioning.
    """
    spark = df.sparkSession
    ranked = cut_lineage(
        df.repartitionByRange(*[F.col(c) for c in order_by])
        .sortWithinPartitions(*order_by)
        .withColumn("_part", F.spark_partition_id())
        .withColumn("_seq", F.monotonically_increasing_id())
    )
    sizes = (
        ranked.groupBy("_part").agg(F.count("*").alias("n"), F.min("_seq").alias("lo")).collect()
    )
    offsets, total = [], 0
    for row in sorted(sizes, key=lambda r: r["_part"]):
        offsets.append((row["_part"], row["lo"] - total))
        total += row["n"]
    shift = spark.createDataFrame(offsets, "_part int, _shift long")
    return (
        ranked.join(F.broadcast(shift), "_part")
        .withColumn(name, F.col("_seq") - F.col("_shift"))
        .drop("_part", "_seq", "_shift")
    )
