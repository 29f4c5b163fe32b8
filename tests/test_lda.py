import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from topicloom.functions.numeric import np_dirichlet_expectation, np_lgamma
from topicloom.operators.arrow import TermVectors
from topicloom.operators.counts import BagOfWords, dense_to_sparse, pack_counts, unpack_counts
from topicloom.operators.lda import LdaParams, NotFittedError, OnlineLda, estep_once, mini_batches
from topicloom.sources.model_store import load_lda, save_lda

GROUPS = {(0, 1, 2), (3, 4, 5), (6, 7, 8)}
THIRD = dict(n_topics=3, alpha=1 / 3, eta=1 / 3)


def matrix(components, n_terms, k):
    out = np.zeros((k, n_terms))
    for r in components.collect():
        out[:, r["term_id"]] = r["w"]
    return out


def thetas(df, column="theta"):
    return {r["doc_id"]: np.array(r[column]) for r in df.collect()}


def dense(bag):
    out = {}
    for r in bag.df.collect():
        out[r["doc_id"]] = (np.array(r["ids"], dtype=int), np.array(r["cnts"]))
    return out


def brute_estep(lam, docs, p):
    """Document by document, straight from the update equations."""
    beta = np.exp(np_dirichlet_expectation(lam))
    gammas, stats = {}, np.zeros(lam.shape)
    for d, (ids, cnts) in docs.items():
        gamma = np.ones(p.n_topics)
        b = beta[:, ids]
        for _ in range(p.max_gamma_update_iter):
            theta = np.exp(np_dirichlet_expectation(gamma[None, :]))[0]
            phinorm = theta @ b + 1e-100
            fresh = p.alpha + theta * (b @ (cnts / phinorm))
            change = np.abs(fresh - gamma).mean()
            gamma = fresh
            if change < p.mean_change_tol:
                break
        theta = np.exp(np_dirichlet_expectation(gamma[None, :]))[0]
        stats[:, ids] += np.outer(theta, cnts / (theta @ b + 1e-100))
        gammas[d] = gamma
    return gammas, stats * beta


def brute_bound(lam, docs, gammas, p):
    elog = np_dirichlet_expectation(lam)
    score = 0.0
    for d, (ids, cnts) in docs.items():
        g = gammas[d]
        et = np_dirichlet_expectation(g[None, :])[0]
        score += sum(c * math.log(np.exp(et + elog[:, i]).sum()) for i, c in zip(ids, cnts))
        score += ((p.alpha - g) * et).sum() + (np_lgamma(g) - math.lgamma(p.alpha)).sum()
        score += math.lgamma(p.alpha * len(g)) - math.lgamma(g.sum())
    score_model = ((p.eta - lam) * elog).sum() + (np_lgamma(lam) - math.lgamma(p.eta)).sum()
    score_model += sum(math.lgamma(p.eta * lam.shape[1]) - math.lgamma(x) for x in lam.sum(axis=1))
    return score, score_model


@pytest.fixture(scope="module")
def mixed(spark):
    """30 documents over 12 terms, one empty, one with a single word."""
    rng = np.random.default_rng(5)
    cells = [
        (d, t, float(c)) for d in range(30) for t, c in enumerate(rng.integers(0, 4, 12)) if c and d not in (7, 8)
    ] + [(8, 3, 1.0), (7, None, None)]
    bag = pack_counts(spark.createDataFrame(cells, "doc_id long, term_id int, cnt double"), 12)
    return BagOfWords(bag.df.repartition(4, "doc_id").persist(), 12)


def top_groups(model):
    return [tuple(sorted(np.argsort(row)[-3:])) for row in matrix(model.components, 9, 3)]


def test_batch_recovers_planted_topics(blocks):
    model = OnlineLda(seed=1, **THIRD).fit(blocks)
    assert set(top_groups(model)) == GROUPS


def test_online_recovers_planted_topics(blocks):
    model = OnlineLda(tau=30.0, seed=1, **THIRD)
    for _ in range(3):
        model.partial_fit(blocks)
    assert set(top_groups(model)) <= GROUPS and model.n_iter == 4


def test_dense_input(spark):
    rng = np.random.default_rng(0)
    rows = spark.createDataFrame(
        [(i, [float(x) for x in rng.integers(0, 5, 10)]) for i in range(20)], "doc_id long, counts array<double>"
    )
    bag = pack_counts(dense_to_sparse(rows, "doc_id", "counts"), 10)
    out = thetas(OnlineLda(**THIRD).fit_transform(bag, 2))
    assert len(out) == 20 and all((v > 0).any() for v in out.values())


def test_fit_transform_equals_transform_and_rows_sum_to_one(blocks):
    model = OnlineLda(**THIRD)
    fitted, again = thetas(model.fit_transform(blocks, 3)), thetas(model.transform(blocks))
    for d, row in fitted.items():
        np.testing.assert_allclose(row, again[d], atol=1e-4)
        assert row.sum() == pytest.approx(1.0)
    model.params = LdaParams(normalize_doc=False, **THIRD)
    raw = thetas(model.transform(blocks))
    assert raw[0].sum() == pytest.approx(9 + 1.0, rel=1e-6)


def test_errors(blocks):
    wider = BagOfWords(blocks.df, 10)
    with pytest.raises(NotFittedError):
        OnlineLda().transform(blocks)
    with pytest.raises(AttributeError):
        OnlineLda().top_words(blocks.df)
    model = OnlineLda(**THIRD).partial_fit(blocks)
    with pytest.raises(ValueError):
        model.partial_fit(wider)
    with pytest.raises(ValueError):
        model.transform(wider)


def test_perplexity_falls(blocks):
    one, ten = OnlineLda(prex_tol=0.0, **THIRD).fit(blocks, 1), OnlineLda(prex_tol=0.0, **THIRD).fit(blocks, 8)
    first, last = (m.perplexity(blocks, m.posterior(blocks)) for m in (one, ten))
    assert last < first
    assert ten.trace[-1][1] <= ten.trace[0][1]


def test_stop_rule(blocks):
    assert len(OnlineLda(prex_tol=1e9, **THIRD).fit(blocks, 10).trace) == 2


def check_against_brute_force(mixed):
    p = LdaParams(n_topics=4, alpha=0.3, eta=0.2, mean_change_tol=1e-4, prex_tol=0.0, seed=2)
    model = OnlineLda(p)
    model._start(mixed)
    lam, docs = matrix(model.components, 12, 4), dense(mixed)
    trace = []
    for _ in range(2):
        gammas, stats = brute_estep(lam, docs, p)
        lam = p.eta + stats
        score = sum(brute_bound(lam, docs, gammas, p))
        trace.append(math.exp(-score / sum(c.sum() for _, c in docs.values())))
    model.fit(mixed, 2)
    np.testing.assert_allclose(matrix(model.components, 12, 4), lam, rtol=1e-9)
    np.testing.assert_allclose([t[1] for t in model.trace], trace, rtol=1e-9)
    got, want = thetas(model.posterior(mixed), "gamma"), brute_estep(lam, docs, p)[0]
    for d in want:
        np.testing.assert_allclose(got[d], want[d], rtol=1e-9)
    np.testing.assert_allclose(got[7], p.alpha)


def test_against_brute_force(mixed):
    check_against_brute_force(mixed)


def test_against_brute_force_without_broadcast(mixed, no_broadcast):
    check_against_brute_force(mixed)


def test_minibatches_against_brute_force(mixed):
    p = LdaParams(n_topics=3, alpha=0.3, eta=0.2, tau=4.0, n_docs=60, batch_size=13, seed=3)
    model = OnlineLda(p)
    model._start(mixed)
    lam, docs = matrix(model.components, 12, 3), dense(mixed)
    for t, start in enumerate(range(0, 30, 13), start=1):
        part = {d: docs[d] for d in sorted(docs)[start : start + 13]}
        rho = (p.tau + t) ** -p.kappa
        lam = (1 - rho) * lam + rho * (p.eta + p.n_docs / len(part) * brute_estep(lam, part, p)[1])
    model = OnlineLda(p).partial_fit(mixed)
    np.testing.assert_allclose(matrix(model.components, 12, 3), lam, rtol=1e-9)
    assert [size for _, size in mini_batches(mixed, 13)] == [13, 13, 4]


def test_partitioning_does_not_matter(mixed):
    def fit(n):
        bag = BagOfWords(mixed.df.repartition(n, "doc_id"), 12)
        return matrix(OnlineLda(n_topics=3, seed=4).fit(bag, 2).components, 12, 3)

    base = fit(1)
    for n in (3, 8):
        np.testing.assert_allclose(fit(n), base, rtol=1e-9)


def test_sub_sampling_scales_the_document_part(mixed):
    model = OnlineLda(n_topics=3, n_docs=300, seed=4).fit(mixed, 1)
    gamma = model.posterior(mixed).persist()
    docs, part = dense(mixed), matrix(model.components, 12, 3)
    a, b = brute_bound(part, docs, thetas(gamma, "gamma"), model.params)
    assert model.bound(mixed, gamma) == pytest.approx(a + b, rel=1e-9)
    assert model.bound(mixed, gamma, sub_sampling=True) == pytest.approx(10 * a + b, rel=1e-9)
    model.params = LdaParams(n_topics=3, n_docs=30, seed=4)
    assert model.perplexity(mixed, gamma, True) == pytest.approx(model.perplexity(mixed, gamma, False))


def test_empty_corpus_has_no_perplexity(spark, blocks):
    model = OnlineLda(**THIRD).fit(blocks, 1)
    empty = BagOfWords(blocks.df.limit(0), 9)
    assert model.perplexity(empty, model.posterior(empty)) is None


def test_join_form_of_one_pass_equals_kernel(blocks):
    model = OnlineLda(max_gamma_update_iter=1, mean_change_tol=0.0, **THIRD)
    model._start(blocks)
    weights = model.logs.df.withColumn("w", F.transform("w", F.exp))
    share = float(np.exp(np_dirichlet_expectation(np.ones((1, 3)))[0, 0]))
    theta = blocks.df.select("doc_id", F.array_repeat(F.lit(share), 3).alias("t"))
    rows = estep_once(unpack_counts(blocks), TermVectors.of(weights, 9, 3), theta, 1 / 3).collect()
    kernel = thetas(model.posterior(blocks), "gamma")
    for r in rows:
        np.testing.assert_allclose(r["gamma"], kernel[r["doc_id"]])


def test_save_and_load(spark, blocks, tmp_path):
    model = OnlineLda(**THIRD).fit(blocks, 2)
    save_lda(model, str(tmp_path / "m"))
    again = load_lda(spark, str(tmp_path / "m"))
    assert again.params == model.params and again.n_iter == model.n_iter
    a, b = thetas(model.transform(blocks)), thetas(again.transform(blocks))
    for d in a:
        np.testing.assert_allclose(a[d], b[d])
    with pytest.raises(NotFittedError):
        save_lda(OnlineLda(), str(tmp_path / "none"))
