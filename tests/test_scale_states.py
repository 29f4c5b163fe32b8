"""Sweeps keep no cached states, and cells of documents are counted in their rows."""

import numpy as np

from topicloom.operators import gibbs
from topicloom.operators import tree as trees
from topicloom.operators.gibbs import GibbsModel, HdpParams
from topicloom.operators.tree import TreeParams


def cached(spark):
    return set(spark.sparkContext._jsc.getPersistentRDDs().keySet())


def test_a_sweep_caches_counts_only(spark, planted):
    model = GibbsModel.initialise(planted, HdpParams(n_topics=3, gamma=0.0, seed=2)).estimate(2)
    assert not model.state.is_cached and model.state.inputFiles()
    plan = model.state._jdf.queryExecution().withCachedData().toString()
    assert "InMemoryRelation" not in plan
    model.release()
    assert not model._tables.paths


def test_cells_of_documents(spark, planted):
    model = GibbsModel.initialise(planted, HdpParams(n_topics=3, seed=2))
    want = gibbs.labelled_tokens(model.state).groupBy("doc_id", "term_id").count().collect()
    cells = gibbs.doc_term_cells(model.state)
    assert "Exchange" not in cells._jdf.queryExecution().executedPlan().toString()
    assert sorted(map(tuple, cells.collect())) == sorted(map(tuple, want))


def test_a_tree_sweep_lets_go_of_its_tree(spark, planted, monkeypatch):
    """A training state is written, so the tree that was sent for it is not needed again."""
    gone, release = [], trees.Blocks.release
    monkeypatch.setattr(trees.Blocks, "release", lambda self: gone.append(len(self.shared)) or release(self))
    before = cached(spark)
    fit = trees.train_tree(planted, TreeParams(seed=2), 3, None)
    assert gone == [1, 1, 1] and cached(spark) <= before
    assert fit.state.count() == 27
    assert np.isclose(sum(r["n"] for r in fit.tree.terms.collect()), 27 * 9)
