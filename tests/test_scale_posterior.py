"""The posterior over a tree's nodes shuffles no pairs of documents and nodes, and a given state no tokens."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import tree as trees
from topicloom.operators.tree import TopicTree, TreeParams
from topicloom.plans import tree as plans


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(d, [int(t) for t in rng.integers(0, 60, d % 9)], [int(x) for x in rng.integers(0, 3, d % 9)], [0, 1 + d % 2, 3 + d % 4]) for d in range(40)]
    state = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, levels array<int>, path array<int>").persist()
    nodes, terms = trees.tree_tables(state)
    return TopicTree(nodes.persist(), terms.persist(), 60, TreeParams(seed=2)), state


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize("rows", [3, 7, 10_000])
def test_posterior_by_runs(spark, corpus, rows):
    """Runs of a document's rows may go over batches."""
    tree, state = corpus
    weights = trees.path_weights(tree, state, tree.nodes.count(), tree.terms.count())
    want = {(r["doc_id"], r["node_id"]): r["prob"] for r in trees.path_posterior(weights).collect()}
    assert trees.rows_together(tree, tree.nodes.count())
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(rows))
    try:
        out = trees.path_posterior(weights, True)
        got = {(r["doc_id"], r["node_id"]): r["prob"] for r in out.collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert "Window" not in plan(out) and got.keys() == want.keys()
    assert all(got[k] == pytest.approx(want[k], rel=1e-12) for k in want)


def test_no_token_is_shuffled_for_paths(spark):
    state, _ = plans.given_state(spark, "/root/testdata/sf0.001")
    joins = [line for line in plan(state.select(F.size("levels"))).splitlines() if "Join " in line]
    assert joins and not any("Join [doc_id" in line for line in joins)
