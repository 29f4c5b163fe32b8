"""Documents meet all nodes of a tree without a row per shared word, in whatever way the tree reaches them."""

import pytest

from topicloom.operators import tree as trees
from topicloom.operators.tree import TopicTree, TreeParams
from topicloom.session import BROADCAST_BYTES_KEY


@pytest.fixture(scope="module")
def given(spark):
    rows = [(d, [t % 7 for t in range(d, 2 * d)], [(d + t) % 3 if d != 5 else 0 for t in range(d)], [0, 1 + d % 2, 3 + d % 4]) for d in range(12)]
    state = spark.createDataFrame(rows, "doc_id long, term_ids array<int>, levels array<int>, path array<int>").repartition(3).persist()
    nodes, terms = trees.tree_tables(state)
    return state, TopicTree(nodes.persist(), terms.persist(), 7, TreeParams(gamma=0.5, eta=0.1))


def rows(df, value):
    return {(r["doc_id"], r["node_id"]): r[value] for r in df.collect()}


@pytest.mark.parametrize("likelihood", ["path", "node"])
def test_ways_agree(spark, given, likelihood):
    state, tree = given
    tree = TopicTree(tree.nodes, tree.terms, 7, TreeParams(gamma=0.5, eta=0.1, path_likelihood=likelihood))
    sizes = tree.nodes.count(), tree.terms.count()
    found = []
    # The tree as a broadcast, the nodes alone, nothing.
    for limit in (1 << 28, 96 * sizes[0], 0):
        spark.conf.set(BROADCAST_BYTES_KEY, str(limit))
        try:
            words = trees.node_word_loglik(tree, state, *sizes)
            weights = trees.path_weights(tree, state, *sizes)
            if limit:
                # Neither documents' words nor pairs are dealt out by document.
                plan = words._jdf.queryExecution().executedPlan().toString() + weights._jdf.queryExecution().executedPlan().toString()
                assert "hashpartitioning(doc_id" not in plan
            found.append((rows(words, "loglik"), rows(weights, "log_weight")))
        finally:
            spark.conf.unset(BROADCAST_BYTES_KEY)
    # Document 0 has no words, 5 none below the root.
    assert not [k for k in found[0][0] if k[0] == 0] and {k for k in found[0][0] if k[0] == 5} == {(5, 0)}
    assert len(found[0][1]) == 12 * sizes[0]
    for other in found[1:]:
        assert other[0] == pytest.approx(found[0][0], rel=1e-9, abs=1e-9)
        assert other[1] == pytest.approx(found[0][1], rel=1e-9, abs=1e-9)
