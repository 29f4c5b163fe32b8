"""A tree whose words exceed the broadcast limit, but not its nodes, is sampled in one pass over blocks of documents."""

import numpy as np
import pytest

from topicloom.operators import tree as trees
from topicloom.operators import tree_sampler
from topicloom.operators.counts import Sequences
from topicloom.operators.tree import TopicTree, TreeParams
from topicloom.session import BROADCAST_BYTES_KEY


@pytest.fixture(scope="module")
def corpus(spark):
    rng = np.random.default_rng(4)
    rows = [(d, [int(t) for t in rng.integers(0, 60, d % 9)], [int(x) for x in rng.integers(0, 3, d % 9)], [0, 1 + d % 2, 3 + d % 4]) for d in range(40)]
    state = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, levels array<int>, path array<int>").persist()
    nodes, terms = trees.tree_tables(state)
    return TopicTree(nodes.persist(), terms.persist(), 60, TreeParams(seed=2)), state


def rows_of(df):
    return {r["doc_id"]: tuple(r[c] for c in ("levels", "path", "nodes", "shares")) for r in df.collect()}


@pytest.mark.parametrize("train", [False, True])
def test_blocks_of_documents_give_the_same_labels(spark, corpus, monkeypatch, train):
    tree, state = corpus
    plan = tree_sampler.SamplePlan(4, 0 if train else 1, 0, train)
    lines = lambda: trees.ancestors(tree.nodes, 3)
    want = rows_of(tree_sampler.sample(tree, state, plan, tree_sampler.cut_tree(tree, lines)))
    n_nodes = tree.nodes.count()
    spark.conf.set(BROADCAST_BYTES_KEY, str(tree_sampler.NODE_BYTES * n_nodes))
    try:
        blocks = tree_sampler.cut_tree(tree, lines)
        assert blocks.n_blocks > 1
        # Nothing of the tree but its nodes reaches the driver, and no step is a pass of its own.
        monkeypatch.setattr(blocks, "load", None)
        got = rows_of(tree_sampler.sample(tree, state, plan, blocks))
    finally:
        spark.conf.unset(BROADCAST_BYTES_KEY)
    assert got == want and len(got) == 40
