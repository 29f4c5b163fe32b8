import os

import pytest

from topicloom import session
from topicloom.operators.gibbs import GibbsModel, HdpParams
from topicloom.operators.lda import LdaParams, OnlineLda
from topicloom.operators.tree import TreeParams, fit_tree
from topicloom.session import shared_folder


def tables(spark, label):
    return [d for d in os.listdir(shared_folder(spark).removeprefix("file:")) if d.startswith(label + "-")]


def test_old_states_are_deleted(spark, blocks, planted):
    before = {x: len(tables(spark, x)) for x in ("components", "labels", "tree-state", "batches")}
    OnlineLda(LdaParams(n_topics=3, prex_tol=0.0)).fit(blocks, 5)
    OnlineLda(LdaParams(n_topics=3, batch_size=4)).partial_fit(blocks)
    GibbsModel.initialise(planted, HdpParams(n_topics=3, checkpoint_every=2)).estimate(9)
    fit_tree(planted, TreeParams(checkpoint_every=2), 7)
    left = {x: len(tables(spark, x)) - before[x] for x in before}
    assert left == {"components": 4, "labels": 2, "tree-state": 2, "batches": 0}


@pytest.mark.parametrize("how", ["inner", "left", "left_anti"])
def test_hot_keys_are_salted_by_their_rows(spark, no_broadcast, monkeypatch, how):
    monkeypatch.setattr(session, "HOT_ROWS", 7)
    big = spark.createDataFrame([(i, 0 if i % 3 else i) for i in range(200)] + [(900, None)], "id long, k long")
    table = spark.createDataFrame([(k, f"v{k}") for k in range(0, 150, 2)], "k long, v string")
    plain = sorted(map(tuple, big.join(table, ["k"], how).collect()), key=str)
    assert sorted(map(tuple, session.lookup_join(big, table, ["k"], how, 1.0, ["id"]).collect()), key=str) == plain
