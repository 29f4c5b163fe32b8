"""An online step is one job, whatever the corpus has behind it."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators.arrow import dense_rows
from topicloom.operators.counts import BagOfWords
from topicloom.operators.lda import LdaParams, OnlineLda, mini_batches
from topicloom.session import BROADCAST_BYTES_KEY

PARAMS = LdaParams(n_topics=3, alpha=0.1, eta=0.1, tau=16.0, n_docs=100, batch_size=64, seed=2)


@pytest.fixture(scope="module")
def bag(spark):
    ids = F.array(*[(F.col("id") % 3 * 3 + i).cast("int") for i in range(3)])
    rows = spark.range(0, 300, 1, 4).select(F.col("id").alias("doc_id"), ids.alias("ids"), F.array(*[F.lit(3.0)] * 3).alias("cnts"))
    return BagOfWords(rows.persist(), 9)


def test_steps_write_one_table(spark, bag):
    dense = OnlineLda(PARAMS).partial_fit(bag)
    # The start and the end; before, a table per step.
    assert len(dense._tables.paths) == 2 and dense.n_iter == 6
    got = dense_rows(dense.components, "w", 9, 3)
    steps = OnlineLda(PARAMS)
    steps._start(bag)
    for batch, size in mini_batches(bag, PARAMS.batch_size):
        steps.em_step(batch, size).unpersist()
    assert np.allclose(got, dense_rows(steps.components, "w", 9, 3), rtol=1e-9, atol=0)
    spark.conf.set(BROADCAST_BYTES_KEY, "300")
    try:
        summed = OnlineLda(PARAMS).partial_fit(bag)
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert np.allclose(got, dense_rows(summed.components, "w", 9, 3), rtol=1e-9, atol=0)


def test_a_written_table_per_fit(bag, monkeypatch):
    written = []
    add = OnlineLda._set
    monkeypatch.setattr(OnlineLda, "_set", lambda self, df: written.append(1) or add(self, df))
    OnlineLda(PARAMS).partial_fit(bag)
    assert len(written) == 2
