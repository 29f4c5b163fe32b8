"""Long documents are drawn token by token where few are left, and a tree is prepared once for a query."""

import numpy as np
import pyarrow as pa
import pytest

from topicloom.operators import tree_sampler
from topicloom.operators.tree import TreeParams
from topicloom.operators.tree_sampler import DocBlock, TreeBlock
from topicloom.plans import tree as plans


def block_and_docs():
    rng = np.random.default_rng(3)
    nodes = pa.table({"node_id": pa.array(range(4), pa.int32()), "parent_id": pa.array([None, 0, 1, 1], pa.int32()), "level": pa.array([0, 1, 2, 2], pa.int32()), "customers": [30, 30, 12, 18], "total_tokens": [80, 80, 80, 80], "seats": [30, 30, 0, 0], "owned": [True] * 4})
    cells = pa.table({"node_id": pa.array(np.repeat(range(4), 20), pa.int32()), "term_id": pa.array(np.tile(range(20), 4), pa.int32()), "n": rng.integers(1, 8, 80)})
    lengths = [*rng.integers(0, 20, 30), 400, 90]
    offsets = np.concatenate([[0], np.cumsum(lengths)])
    terms, levels = rng.integers(0, 20, offsets[-1]), rng.integers(0, 3, offsets[-1])
    return TreeBlock.of(nodes, cells, 20), DocBlock(TreeParams(seed=4), 20, np.arange(32), offsets, terms, levels, None)


@pytest.mark.parametrize("few", [0, 1, 16, 100])
def test_levels_do_not_depend_on_how_they_are_drawn(monkeypatch, few):
    monkeypatch.setattr(tree_sampler, "FEW_DOCS", few)
    found = []
    b, docs = block_and_docs()
    for step in range(1, 6):
        docs.reset()
        docs.choose(b, 2 * step, False, 4)
        # What stays from step to step is what a new look at the tree finds.
        for at in range(3):
            assert (docs.seen[:, at] == b.counts(b.slots_of(docs.path[:, at])[docs.row_doc], docs.row_term)).all()
        docs.sample_levels(2 * step + 1)
        found.append(docs.levels)
    monkeypatch.setattr(tree_sampler, "FEW_DOCS", 0)
    b, docs = block_and_docs()
    for step in range(1, 6):
        docs.reset()
        docs.choose(b, 2 * step, False, 4)
        docs.sample_levels(2 * step + 1)
        assert (docs.levels == found[step - 1]).all()


def test_one_preparation(spark, monkeypatch):
    """Before, the lines read and prepared the corpus a second time for the levels of nodes."""
    made, build = [], plans.build_vocabulary
    monkeypatch.setattr(plans, "build_vocabulary", lambda docs: made.append(1) or build(docs))
    monkeypatch.setattr(plans, "LONG", {"iterations": 3, "thinning": 1, "burn_in": 1})
    assert plans.tree_infer_lines(spark, "/root/testdata/sf0.001").count() > 0
    assert len(made) == 1
