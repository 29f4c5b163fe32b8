import math
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.operators import tree as trees
from topicloom.operators.counts import Sequences
from topicloom.operators.gibbs import StopRule
from topicloom.operators.tree import TopicTree, TreeParams
from topicloom.operators.tree_sampler import DocBlock, SamplePlan, cut_tree
from topicloom.sources.model_store import load_tree, save_tree
from topicloom.sources.reports import distribution_lines, write_distribution, write_table, write_tree_report

PARAMS = TreeParams(alpha=2.0, gamma=1.0, eta=0.5, seed=3)
# Root 0; children 1 and 2; leaves 3, 4 below 1 and 5, 6 below 2.
NODES = [
    (0, None, 0, 10, 12), (1, 0, 1, 6, 8), (2, 0, 1, 4, 5),
    (3, 1, 2, 4, 9), (4, 1, 2, 2, 3), (5, 2, 2, 3, 6), (6, 2, 2, 1, 0),
]
TERMS = [
    (0, 0, 6), (0, 1, 6), (1, 2, 5), (1, 3, 3), (2, 4, 5), (3, 5, 9), (4, 6, 3), (5, 7, 4), (5, 8, 2),
]
STATE = [
    (0, [0, 2, 5, 5, 1], [0, 1, 2, 2, 0], [0, 1, 3]),
    (1, [4, 7, 7, 8, 4], [1, 2, 2, 2, 0], [0, 2, 5]),
    (2, [], [], [0, 1, 4]),
    (3, [6], [1], [0, 1, 4]),
]
SCHEMA = "doc_id long, term_ids array<int>, levels array<int>, path array<int>"


@pytest.fixture(scope="module")
def tree(spark):
    nodes = spark.createDataFrame(
        NODES, "node_id int, parent_id int, level int, customers long, total_tokens long"
    ).persist()
    terms = spark.createDataFrame(TERMS, "node_id int, term_id int, n long").persist()
    return TopicTree(nodes, terms, 9, PARAMS)


@pytest.fixture(scope="module")
def state(spark):
    return spark.createDataFrame(STATE, SCHEMA).persist()


def plain_loglik(words, node, eta=0.5, v=9):
    counts = {t: n for m, t, n in TERMS if m == node}
    total = next((n[4] for n in NODES if n[0] == node), 0)
    score, seen, placed = 0.0, 0, {}
    for w in words:
        score += math.log((eta + counts.get(w, 0) + placed.get(w, 0)) / (v * eta + total + seen))
        placed[w] = placed.get(w, 0) + 1
        seen += 1
    return score


def plain_weights(doc, mode):
    """log weight of every node, word by word."""
    _, terms, levels, _ = doc
    words = [[t for t, l in zip(terms, levels) if l == level] for level in range(3)]
    seats = {n[0]: n[3] for n in NODES}
    out = {}
    for node, parent, level, customers, _ in NODES:
        line = [node]
        while next(n[1] for n in NODES if n[0] == line[0]) is not None:
            line.insert(0, next(n[1] for n in NODES if n[0] == line[0]))
        w = sum(math.log(seats[c] / (seats[p] + 1.0)) for p, c in zip(line, line[1:]))
        if mode == "node" or level < 2:
            w += math.log(1.0 / (customers + 1.0))
        used = line if mode == "path" else [node]
        w += sum(plain_loglik(words[next(n[2] for n in NODES if n[0] == a)], a) for a in used)
        w += sum(plain_loglik(words[below], -1) for below in range(level + 1, 3))
        out[node] = w
    return out


def test_path_prior(tree):
    got = {r["node_id"]: r["log_prior"] for r in trees.path_prior(tree.nodes, PARAMS).collect()}
    assert got[3] == pytest.approx(math.log(6 / 11 * 4 / 7))
    assert got[1] == pytest.approx(math.log(6 / 11 * 1 / 7))
    assert got[0] == pytest.approx(math.log(1 / 11))
    # Taking an existing leaf or branching off somewhere are all the ways down.
    assert sum(math.exp(x) for x in got.values()) == pytest.approx(1.0)
    by_node = trees.path_prior(tree.nodes, replace(PARAMS, path_likelihood="node")).collect()
    assert {r["node_id"]: r["log_prior"] for r in by_node}[3] == pytest.approx(math.log(6 / 11 * 4 / 7 * 1 / 5))


@pytest.mark.parametrize("mode", ["path", "node"])
def test_path_weights(tree, state, mode):
    given = TopicTree(tree.nodes, tree.terms, 9, replace(PARAMS, path_likelihood=mode))
    got = {}
    for r in trees.path_weights(given, state, len(NODES), len(TERMS)).collect():
        got.setdefault(r["doc_id"], {})[r["node_id"]] = r["log_weight"]
    assert len(got) == len(STATE)
    for doc in STATE:
        assert got[doc[0]] == pytest.approx(plain_weights(doc, mode))


def test_path_weights_without_broadcast(tree, state, no_broadcast):
    rows = trees.path_weights(tree, state, len(NODES), len(TERMS)).collect()
    assert len(rows) == len(STATE) * len(NODES)
    for r in rows:
        assert r["log_weight"] == pytest.approx(plain_weights(STATE[r["doc_id"]], "path")[r["node_id"]])


def sampler_block(tree, mode, own, which=range(4)):
    """The kernel's state of some documents, longest first."""
    docs = [STATE[d] for d in which]
    offsets = np.concatenate([[0], np.cumsum([len(s[1]) for s in docs])])
    terms = np.array([t for s in docs for t in s[1]], np.int64)
    levels = np.array([l for s in docs for l in s[2]], np.int64)
    path = np.array([s[3] for s in docs]) if own else None
    return DocBlock(replace(PARAMS, path_likelihood=mode), 9, np.array([s[0] for s in docs]), offsets, terms, levels, path)


def lines_of(tree):
    return lambda: trees.ancestors(tree.nodes, 3)


@pytest.mark.parametrize("mode", ["path", "node"])
def test_sampler_weights(tree, mode):
    """The kernel's weights for documents outside the tree's counts."""
    b = cut_tree(tree, lines_of(tree)).load(0)
    block = sampler_block(tree, mode, own=False)
    got = block.log_weights(b)
    for rank, d in enumerate(block.order):
        np.testing.assert_allclose(got[rank], list(plain_weights(STATE[d], mode).values()))


@pytest.mark.parametrize("mode", ["path", "node"])
def test_sampler_weights_without_own_counts(spark, state, mode):
    """In training a document weighs the tree of all others."""
    def tables(rows):
        df = spark.createDataFrame(rows, SCHEMA)
        nodes, terms = trees.tree_tables(df)
        return TopicTree(nodes, terms, 9, replace(PARAMS, path_likelihood=mode))

    extra = [(9, [0, 2, 5], [0, 1, 2], [0, 1, 3]), (10, [0, 4, 7, 7], [0, 1, 2, 2], [0, 2, 5]), (11, [1, 4], [0, 2], [0, 1, 4])]
    whole = tables([*STATE, *extra])
    b = cut_tree(whole, lines_of(whole)).load(0)
    block = sampler_block(whole, mode, own=True)
    got = block.log_weights(b)
    for rank, d in enumerate(block.order):
        rest = tables([s for s in STATE if s[0] != d] + extra)
        other = cut_tree(rest, lines_of(rest)).load(0)
        alone = sampler_block(rest, mode, own=False, which=[d])
        want = dict(zip(other.node_ids, alone.log_weights(other)[0]))
        for node, weight in zip(b.node_ids, got[rank]):
            if node in want:
                assert weight == pytest.approx(want[node])
            else:
                assert weight == -math.inf


def test_draws_follow_the_weights(tree):
    """Gumbel draws against leaf probabilities, over many steps."""
    b = cut_tree(tree, lines_of(tree)).load(0)
    block = sampler_block(tree, "path", own=False)
    leaves = np.flatnonzero(b.level == 2)
    weights = block.leaf_weights(b, block.log_weights(b), leaves)
    p = np.exp(weights - np.logaddexp.reduce(weights, axis=1)[:, None])
    # A node's weight goes to its leaves by their customers.
    seats = {n[0]: n[3] for n in NODES}
    for rank, d in enumerate(block.order):
        plain = plain_weights(STATE[d], "path")
        e = {n: math.exp(w) for n, w in plain.items()}
        own = {u: e[u] + e[up] * seats[u] / (6 if up == 1 else 4) + e[0] * (seats[up] / 10) * seats[u] / (6 if up == 1 else 4) for u, up in ((3, 1), (4, 1), (5, 2), (6, 2))}
        np.testing.assert_allclose(p[rank], np.array(list(own.values())) / sum(own.values()))
    n, hits = 3000, np.zeros_like(p)
    for step in range(n):
        block.reset()
        block.choose(b, step, False, len(NODES))
        hits[np.arange(4), block.path[:, 2] - 3] += 1
    assert np.abs(hits / n - p).max() < 4 * 0.5 / math.sqrt(n)
    params = [block.log_weights(b), np.zeros_like(b.node_ids, dtype=float)]
    q = np.exp(params[0] - np.logaddexp.reduce(params[0], axis=1)[:, None])
    found = np.zeros_like(q)
    for step in range(n):
        block.reset()
        block.choose(b, step, True, len(NODES))
        code = block.path
        node = np.where(code[:, 1] >= len(NODES), 0, np.where(code[:, 2] >= len(NODES), code[:, 1], code[:, 2]))
        found[np.arange(4), node] += 1
    assert np.abs(found / n - q).max() < 4 * 0.5 / math.sqrt(n)


def test_new_topic_loglik(state):
    rows = trees.level_new_topic_loglik(trees.doc_level_counts(state), 9, 0.5).collect()
    for r in rows:
        words = [t for t, l in zip(STATE[r["doc_id"]][1], STATE[r["doc_id"]][2]) if l == r["level"]]
        assert r["loglik"] == pytest.approx(plain_loglik(words, -1)) and r["n"] == len(words)


def test_posterior_sums_to_one(tree, state):
    post = trees.path_posterior(trees.path_weights(tree, state, len(NODES), len(TERMS)))
    assert all(r["s"] == pytest.approx(1.0) for r in post.groupBy("doc_id").agg(F.sum("prob").alias("s")).collect())


def test_path_distribution(state):
    got = {(r["doc_id"], r["node_id"]): r["share"] for r in trees.path_distribution(state, PARAMS).collect()}
    assert got[0, 0] == pytest.approx(4 / 11) and got[0, 3] == pytest.approx(4 / 11)
    assert got[2, 4] == pytest.approx(1 / 3)


def test_tables_from_state(state):
    nodes, terms = trees.tree_tables(state)
    rows = {r["node_id"]: (r["parent_id"], r["level"], r["customers"], r["total_tokens"]) for r in nodes.collect()}
    assert rows[0] == (None, 0, 4, 3) and rows[4] == (1, 2, 2, 0) and rows[5] == (2, 2, 1, 3)
    assert {(r["node_id"], r["term_id"]): r["n"] for r in terms.collect()}[5, 7] == 2


def run_infer(tree, df, **options):
    return {r["doc_id"]: r for r in trees.infer(tree, Sequences(df, 9), **options).collect()}


def test_inference(tree, state, spark):
    docs = spark.createDataFrame(
        [(10, [5] * 30 + [2] * 10), (11, [7] * 20 + [4] * 10), (12, []), (13, [8])], "doc_id long, term_ids array<int>"
    )
    got = run_infer(tree, docs, iterations=30, thinning=3, burn_in=6)
    assert got[10]["leaf_id"] == 3 and got[11]["leaf_id"] == 5
    parents = {n[0]: n[1] for n in NODES}
    for r in got.values():
        assert sum(r["shares"]) == pytest.approx(1.0)
        assert [parents[x] for x in r["path"]] == [None, *r["path"][:-1]]
        assert len(r["levels"]) == len(docs.filter(F.col("doc_id") == r["doc_id"]).first()["term_ids"])
    last = run_infer(tree, docs, iterations=30)
    assert all(sorted(r["nodes"]) == sorted(r["path"]) for r in last.values())
    assert run_infer(tree, docs.repartition(1), iterations=30) == last
    assert run_infer(tree, docs.repartition(4), iterations=30) == last
    with pytest.raises(ValueError):
        trees.infer(tree, Sequences(docs, 10))


def test_inference_leaves_the_tree_alone(tree, spark):
    """Adding documents to the call changes nobody's result."""
    docs = spark.createDataFrame([(i, [i % 9] * 5) for i in range(12)], "doc_id long, term_ids array<int>")
    alone = run_infer(tree, docs.filter("doc_id = 3"), iterations=5)
    assert run_infer(tree, docs, iterations=5)[3] == alone[3]


@pytest.mark.parametrize("mode", ["path", "node"])
def test_blocks_of_any_size_give_the_same_labels(tree, planted, spark, mode):
    """One block a leaf against one block in all: scoring and training, whole rows."""
    docs = spark.createDataFrame([(i, [(i * j) % 9 for j in range(i % 7)]) for i in range(15)], "doc_id long, term_ids array<int>")
    given = TopicTree(tree.nodes, tree.terms, 9, replace(PARAMS, path_likelihood=mode))
    params = replace(PARAMS, start_branches=2, checkpoint_every=2, path_likelihood=mode)
    one = run_infer(given, docs, iterations=4, thinning=2), trees.fit_tree(planted, params, 2)[1].collect()
    spark.conf.set("spark.topicloom.maxBroadcastBytes", "0")
    try:
        assert cut_tree(given, lines_of(given)).n_blocks == 4
        many = run_infer(given, docs, iterations=4, thinning=2), trees.fit_tree(planted, params, 2)[1].collect()
    finally:
        spark.conf.unset("spark.topicloom.maxBroadcastBytes")
    assert len(many[0]) == 15
    for doc, row in one[0].items():
        other = many[0][doc]
        assert (row["levels"], row["path"], row["nodes"]) == (other["levels"], other["path"], other["nodes"])
        assert row["shares"] == pytest.approx(other["shares"])
    key = lambda r: r["doc_id"]
    assert sorted(one[1], key=key) == sorted(many[1], key=key)


def test_kept_samples():
    assert [i for i in range(1, 11) if SamplePlan(10, 2, 4).keeps(i)] == [6, 8, 10]
    assert [i for i in range(1, 11) if SamplePlan(10).keeps(i)] == [10]


def test_training(planted):
    params = replace(PARAMS, start_branches=2, checkpoint_every=2)
    tree, state = trees.fit_tree(planted, params, 3)
    nodes = {r["node_id"]: r for r in tree.nodes.collect()}
    assert sum(r["total_tokens"] for r in nodes.values()) == 243
    assert nodes[0]["customers"] == 27 and sorted(nodes) == list(range(len(nodes)))
    for r in nodes.values():
        children = [c for c in nodes.values() if c["parent_id"] == r["node_id"]]
        assert sum(c["customers"] for c in children) == (r["customers"] if r["level"] < 2 else 0)
    again = trees.fit_tree(Sequences(planted.df.repartition(1), 9), params, 3)[1]
    assert {r["doc_id"]: (r["levels"], r["path"]) for r in again.collect()} == {
        r["doc_id"]: (r["levels"], r["path"]) for r in state.collect()
    }


def test_reports(tree, state, spark, tmp_path):
    vocab = spark.createDataFrame([(i, f"w{i}") for i in range(9)], "term_id int, term string")
    rows = trees.tree_report(tree, vocab, 1).orderBy("path_key").collect()
    assert [r["node_id"] for r in rows] == [0, 1, 3, 4, 2, 5, 6]
    assert [r["top_words"] for r in rows] == ["w0", "w2", "w5", "w6", "w4", "w7", ""]
    write_tree_report(tree, vocab, str(tmp_path / "tree"), 2)
    lines = [r["value"] for r in spark.read.text(str(tmp_path / "tree")).collect()]
    assert "1,1,8,6,w2 w3" in lines and len(lines) == 7
    names = spark.createDataFrame([(i, f"doc{i}") for i in range(4)], "doc_id long, name string")
    shares = trees.path_distribution(state, PARAMS)
    text = {r["doc_id"]: r["value"] for r in distribution_lines(shares, names).collect()}
    assert text[0].startswith("doc0,nodeID:0,0.36") and text[0].count("nodeID:") == 3
    write_distribution(shares, names, str(tmp_path / "shares"))
    assert spark.read.text(str(tmp_path / "shares")).count() == 4
    write_table(shares, str(tmp_path / "csv"), "csv")
    assert spark.read.option("header", True).csv(str(tmp_path / "csv")).count() == 12


def test_save_and_load(tree, spark, tmp_path):
    save_tree(tree, str(tmp_path / "t"))
    again = load_tree(spark, str(tmp_path / "t"))
    assert again.params == tree.params and again.nodes.count() == 7 and again.terms.count() == len(TERMS)


def test_log_likelihood_equals_a_plain_product(tree, state):
    """Words, levels and seats one after the other."""
    nodes, terms = trees.tree_tables(state)
    grown = TopicTree(nodes, terms, 9, PARAMS)
    total, words, sizes, seats = 0.0, {}, {}, {}
    for _, term_ids, levels, path in STATE:
        for parent, child in zip(path, path[1:]):
            known = seats.setdefault(parent, {})
            weight = known.get(child, 0) or PARAMS.gamma
            total += math.log(weight / (sum(known.values()) + PARAMS.gamma))
            known[child] = known.get(child, 0) + 1
        used = [0] * 3
        for i, (t, level) in enumerate(zip(term_ids, levels)):
            total += math.log((used[level] + PARAMS.alpha) / (i + 3 * PARAMS.alpha))
            node = path[level]
            total += math.log((words.get((node, t), 0) + PARAMS.eta) / (sizes.get(node, 0) + 9 * PARAMS.eta))
            used[level] += 1
            words[node, t] = words.get((node, t), 0) + 1
            sizes[node] = sizes.get(node, 0) + 1
    assert trees.joint_log_lik(grown, state) == pytest.approx(total)


def test_training_ends_by_its_rule(planted):
    fit = trees.train_tree(planted, replace(PARAMS, start_branches=2), 40, StopRule(window=3, tol=5e-3))
    assert 7 <= len(fit.trace) <= 40 and fit.trace[-1] > fit.trace[0]


def test_likely_nodes_and_the_rest(tree, state, spark):
    """Rows equal the posterior's, and sum to 1, in one block and in one block a leaf."""
    want = {}
    for r in trees.path_posterior(trees.path_weights(tree, state, len(NODES), len(TERMS))).collect():
        key = (r["doc_id"], r["node_id"] if r["prob"] >= 0.1 else None)
        want[key] = want.get(key, 0.0) + r["prob"]
    for limit in ("268435456", "0"):
        spark.conf.set("spark.topicloom.maxBroadcastBytes", limit)
        try:
            got = {(r["doc_id"], r["node_id"]): r["prob"] for r in trees.likely_paths(tree, state, 0.1).collect()}
        finally:
            spark.conf.unset("spark.topicloom.maxBroadcastBytes")
        assert got == pytest.approx(want)
