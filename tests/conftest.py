import os
import sys

import pytest
from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

from topicloom.operators.counts import BagOfWords, Sequences, pack_counts
from topicloom.session import BROADCAST_BYTES_KEY


@pytest.fixture(scope="session")
def spark():
    session = (
        SparkSession.builder.master("local[8]")
        .appName("topicloom-tests")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", "4")
        .config("spark.default.parallelism", "4")
        .config("spark.driver.memory", "6g")
        .getOrCreate()
    )
    session.sparkContext.setLogLevel("ERROR")
    yield session
    session.stop()


@pytest.fixture
def no_broadcast(spark):
    """Force the join paths that serve models and tables beyond the broadcast limit."""
    spark.conf.set(BROADCAST_BYTES_KEY, "0")
    yield
    spark.conf.unset(BROADCAST_BYTES_KEY)


def block_cells(copies=1):
    """Three planted topics of three terms each: diagonal 3x3 blocks of 3.0."""
    return [
        (d, t, 3.0) for d in range(9 * copies) for t in range(9) if (d % 9) // 3 == t // 3
    ]


@pytest.fixture(scope="session")
def blocks(spark) -> BagOfWords:
    cells = spark.createDataFrame(block_cells(), "doc_id long, term_id int, cnt double")
    bag = pack_counts(cells, 9)
    return BagOfWords(bag.df.repartition(3, "doc_id").persist(), 9)


@pytest.fixture(scope="session")
def planted(spark) -> Sequences:
    rows = [
        (d, [t for t in range((d % 9) // 3 * 3, (d % 9) // 3 * 3 + 3) for _ in range(3)], 0) for d in range(27)
    ]
    df = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, n_unseen long")
    return Sequences(df.repartition(3, "doc_id").persist(), 9)
