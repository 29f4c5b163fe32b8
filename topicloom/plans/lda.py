"""Registered queries on variational LDA, with the SQL that checks them.

Where a query stops after a fixed number of steps, the step count is a parameter of
the fit and the SQL repeats the steps over the whole corpus.
"""

from __future__ import annotations

import math
from dataclasses import replace

import numpy as np
from pyspark.sql import functions as F

from topicloom.functions.numeric import np_dirichlet_expectation
from topicloom.operators.arrow import TermVectors
from topicloom.operators.counts import BagOfWords, bag_of_words, doc_term_counts, unpack_counts
from topicloom.operators.lda import (
    LdaParams,
    OnlineLda,
    components_long,
    dirichlet_expectation,
    estep,
    estep_once,
    init_components,
    log_weights,
    mstep_batch,
    mstep_online,
    posteriors,
    sufficient_stats,
    top_words,
)
from topicloom.plans import sql, text
from topicloom.session import hold

STEPS = LdaParams(
    n_topics=10, alpha=0.1, eta=0.1, kappa=0.7, tau=512.0, n_docs=1e4,
    mean_change_tol=0.0, max_gamma_update_iter=2, prex_tol=0.0,
)
FULL = LdaParams(n_topics=10, alpha=0.1, eta=0.1, kappa=0.7, tau=512.0, n_docs=1e4, batch_size=256)
#: EM steps of a full fit, if perplexity does not settle before.
FULL_STEPS = 10
N_TOP = 15
ONE_BATCH = 1 << 40


def corpus(spark, sf_dir) -> tuple[BagOfWords, "text.Vocabulary"]:
    docs = text.terms(spark, sf_dir)
    vocab = text.vocabulary(docs)
    bag = bag_of_words(docs, vocab)
    return BagOfWords(hold(bag.df), bag.n_terms), vocab


def started(bag: BagOfWords, params: LdaParams = STEPS) -> OnlineLda:
    model = OnlineLda(params)
    model._start(bag)
    return model


def _long(df, vector, value):
    return df.select("doc_id", F.posexplode(vector).alias("topic_id", value)).withColumn(value, F.round(value, 6))


def _weights(components):
    return components_long(components).select("topic_id", "term_id", F.round("weight", 6).alias("weight"))


def _stats(spark, sf_dir):
    bag, vocab = corpus(spark, sf_dir)
    model = started(bag)
    rows = estep(bag, model.logs, STEPS)
    return bag, vocab, model, sufficient_stats(rows, STEPS.n_topics)


def dirichlet_expectation_query(spark, sf_dir):
    docs = text.terms(spark, sf_dir)
    counts = doc_term_counts(docs, text.vocabulary(docs)).withColumn("weight", F.col("cnt") + F.lit(STEPS.alpha))
    out = dirichlet_expectation(counts, "doc_id", "weight")
    return out.select("doc_id", "term_id", F.round("elog", 6).alias("elog"))


def lda_init(spark, sf_dir):
    vocab = text.vocabulary(text.terms(spark, sf_dir))
    return _weights(init_components(spark, vocab.n_terms, STEPS))


def lda_estep_once(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    model = started(bag)
    weights = log_weights(model.components, model.summary.totals)
    beta = TermVectors.of(weights.withColumn("w", F.transform("w", F.exp)), bag.n_terms, STEPS.n_topics)
    ones = F.array_repeat(F.lit(math.exp(float(np_dirichlet_expectation(np.ones((1, STEPS.n_topics)))[0, 0]))), STEPS.n_topics)
    out = estep_once(unpack_counts(bag), beta, bag.df.select("doc_id", ones.alias("t")), STEPS.alpha)
    return _long(out, "gamma", "gamma")


def lda_estep(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    return _long(started(bag).posterior(bag), "gamma", "gamma")


def lda_sstats(spark, sf_dir):
    *_, stats = _stats(spark, sf_dir)
    rows = stats.select("term_id", F.posexplode("stat").alias("topic_id", "stat"))
    return rows.select("topic_id", "term_id", F.round("stat", 6).alias("stat"))


def lda_mstep_batch(spark, sf_dir):
    _, _, model, stats = _stats(spark, sf_dir)
    return _weights(mstep_batch(model.components, stats, STEPS.eta))


def lda_mstep_online(spark, sf_dir):
    bag, _, model, stats = _stats(spark, sf_dir)
    return _weights(mstep_online(model.components, stats, STEPS, 1, bag.df.count()))


def lda_transform(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    return _long(started(bag).transform(bag), "theta", "theta")


def lda_bound(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    model = started(bag)
    bound = model.bound(bag, model.posterior(bag))
    scaled = model.bound(bag, model.posterior(bag), sub_sampling=True)
    rows = spark.createDataFrame([(bound, scaled)], "bound double, scaled double")
    return rows.select(F.round("bound", 3).alias("bound"), F.round("scaled", 3).alias("scaled"))


def lda_perplexity(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    model = started(bag)
    value = model.perplexity(bag, model.posterior(bag))
    return spark.createDataFrame([(value,)], "perplexity double").select(F.round("perplexity", 4).alias("perplexity"))


def lda_top_words(spark, sf_dir):
    _, vocab, model, stats = _stats(spark, sf_dir)
    out = top_words(mstep_batch(model.components, stats, STEPS.eta), vocab.df, N_TOP)
    return out.withColumn("weight", F.round("weight", 6))


def lda_fit(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    return _weights(OnlineLda(STEPS).fit(bag, 2).components)


def lda_trace(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    model = OnlineLda(STEPS).fit(bag, 2)
    return model.trace_table(spark).withColumn("perplexity", F.round("perplexity", 4))


def lda_fit_converged(spark, sf_dir):
    bag, vocab = corpus(spark, sf_dir)
    return OnlineLda(FULL).fit(bag, FULL_STEPS).top_words(vocab.df, N_TOP)


def lda_partial_fit(spark, sf_dir):
    """The whole corpus as one online step."""
    bag, _ = corpus(spark, sf_dir)
    return _weights(OnlineLda(STEPS, batch_size=ONE_BATCH).partial_fit(bag).components)


def lda_partial_fit_batches(spark, sf_dir):
    bag, vocab = corpus(spark, sf_dir)
    return OnlineLda(FULL).partial_fit(bag).top_words(vocab.df, N_TOP)


def lda_fit_transform(spark, sf_dir):
    bag, _ = corpus(spark, sf_dir)
    return OnlineLda(FULL).fit_transform(bag, FULL_STEPS).select("doc_id", F.posexplode("theta").alias("topic_id", "theta"))


def lda_fit_transform_steps(spark, sf_dir):
    """Two steps of training, then the shares of two E-step passes."""
    bag, _ = corpus(spark, sf_dir)
    return _long(OnlineLda(STEPS).fit_transform(bag, 2), "theta", "theta")


def lda_partial_fit_two(spark, sf_dir):
    """Two online steps, over the first and the second half of the documents."""
    bag, _ = corpus(spark, sf_dir)
    half = -(-bag.df.count() // 2)
    return _weights(OnlineLda(replace(STEPS, batch_size=half)).partial_fit(bag).components)


QUERIES = {
    "dirichlet_expectation": dirichlet_expectation_query,
    "lda_init": lda_init,
    "lda_estep_once": lda_estep_once,
    "lda_estep": lda_estep,
    "lda_sstats": lda_sstats,
    "lda_mstep_batch": lda_mstep_batch,
    "lda_mstep_online": lda_mstep_online,
    "lda_transform": lda_transform,
    "lda_bound": lda_bound,
    "lda_perplexity": lda_perplexity,
    "lda_top_words": lda_top_words,
    "lda_fit": lda_fit,
    "lda_trace": lda_trace,
    "lda_fit_converged": lda_fit_converged,
    "lda_partial_fit": lda_partial_fit,
    "lda_partial_fit_batches": lda_partial_fit_batches,
    "lda_fit_transform": lda_fit_transform,
    "lda_fit_transform_steps": lda_fit_transform_steps,
    "lda_partial_fit_two": lda_partial_fit_two,
}


# -------------------------------------------------------------------------- SQL

K, ALPHA, ETA = STEPS.n_topics, sql.lit(STEPS.alpha), sql.lit(STEPS.eta)


def _model(weights: str, name: str) -> str:
    """CTE with E[log beta] and its exponential for ``weights(topic_id, term_id, w)``."""
    return f"""
    {name}_sum AS (SELECT topic_id, sum(w) AS total FROM {weights} GROUP BY topic_id),
    {name} AS MATERIALIZED (
      SELECT topic_id, term_id, w, {sql.digamma('w')} - {sql.digamma('total')} AS elog,
             exp({sql.digamma('w')} - {sql.digamma('total')}) AS b
      FROM {weights} JOIN {name}_sum USING (topic_id))"""


_INIT = f"""
    lam0 AS MATERIALIZED (
      SELECT topic_id, term_id, {sql.gamma_100(STEPS.seed, 'lda-init', 'topic_id', 'term_id')} AS w
      FROM vocab, (SELECT unnest(range({K}))::INTEGER AS topic_id))"""
_SUFFIX = _model("lam0", "m0")


def _theta(gamma: str, name: str) -> str:
    return f"""
    {name} AS MATERIALIZED (
      SELECT doc_id, topic_id, g, {sql.digamma('g')} - {sql.digamma('total')} AS elog,
             exp({sql.digamma('g')} - {sql.digamma('total')}) AS th
      FROM {gamma} JOIN (SELECT doc_id, sum(g) AS total FROM {gamma} GROUP BY doc_id) USING (doc_id))"""


def _pass(theta: str, model: str, norm: str, out: str, dt: str = "dt") -> str:
    return f"""
    {norm} AS MATERIALIZED (
      SELECT doc_id, term_id, any_value(cnt) AS cnt, sum(th * b) + 1e-100::DOUBLE AS nrm
      FROM {dt} JOIN {model} USING (term_id) JOIN {theta} USING (doc_id, topic_id) GROUP BY doc_id, term_id),
    {out} AS MATERIALIZED (
      SELECT doc_id, topic_id, {ALPHA} + th * coalesce(mass, 0.0::DOUBLE) AS g
      FROM {theta} LEFT JOIN (
        SELECT doc_id, topic_id, sum(cnt / nrm * b) AS mass FROM {norm} JOIN {model} USING (term_id)
        GROUP BY doc_id, topic_id) USING (doc_id, topic_id))"""


def _two_passes(model: str, tag: str, docs: str = "documents", dt: str = "dt") -> str:
    """Two E-step passes from gamma = 1, then the statistics of the end state."""
    return f"""
    {tag}g0 AS (SELECT doc_id, topic_id, 1.0::DOUBLE AS g
                FROM {docs}, (SELECT unnest(range({K}))::INTEGER AS topic_id)),
    {_theta(tag + 'g0', tag + 't0')},{_pass(tag + 't0', model, tag + 'n0', tag + 'g1', dt)},
    {_theta(tag + 'g1', tag + 't1')},{_pass(tag + 't1', model, tag + 'n1', tag + 'g2', dt)},
    {_theta(tag + 'g2', tag + 't2')},
    {tag}n2 AS MATERIALIZED (
      SELECT doc_id, term_id, any_value(cnt) AS cnt, sum(th * b) + 1e-100::DOUBLE AS nrm
      FROM {dt} JOIN {model} USING (term_id) JOIN {tag}t2 USING (doc_id, topic_id) GROUP BY doc_id, term_id),
    {tag}ss AS MATERIALIZED (
      SELECT topic_id, term_id, sum(th * b * cnt / nrm) AS stat
      FROM {tag}n2 JOIN {model} USING (term_id) JOIN {tag}t2 USING (doc_id, topic_id) GROUP BY topic_id, term_id)"""


def _batch(weights: str, tag: str, out: str) -> str:
    return f"""
    {out} AS MATERIALIZED (
      SELECT topic_id, term_id, {ETA} + coalesce(stat, 0.0::DOUBLE) AS w
      FROM {weights} LEFT JOIN {tag}ss USING (topic_id, term_id))"""


def _bound(theta: str, model: str, ratio: str = "1.0::DOUBLE") -> str:
    """Scalar bound of the corpus under a theta and a model CTE."""
    v = "(SELECT count(*) FROM vocab)::DOUBLE"
    k = sql.lit(float(K))
    words = f"""(SELECT sum(cnt * lse) FROM (
        SELECT doc_id, term_id, any_value(cnt) AS cnt, ln(sum(exp(c - top))) + any_value(top) AS lse FROM (
          SELECT doc_id, term_id, cnt, t.elog + m.elog AS c,
                 max(t.elog + m.elog) OVER (PARTITION BY doc_id, term_id) AS top
          FROM dt JOIN {model} m USING (term_id) JOIN {theta} t USING (doc_id, topic_id))
        GROUP BY doc_id, term_id))"""
    theta_part = f"""(SELECT sum(s) FROM (
        SELECT sum(({ALPHA} - g) * elog + {sql.lgamma('g')} - {sql.lgamma(ALPHA)})
               + {sql.lgamma(f'({ALPHA} * {k})')} - {sql.lgamma('sum(g)')} AS s
        FROM {theta} GROUP BY doc_id))"""
    beta_part = f"""(SELECT sum(s) FROM (
        SELECT sum(({ETA} - w) * elog + {sql.lgamma('w')} - {sql.lgamma(ETA)})
               + {sql.lgamma(f'({ETA} * {v})')} - {sql.lgamma('sum(w)')} AS s
        FROM {model} GROUP BY topic_id))"""
    return f"(({words} + {theta_part}) * {ratio} + {beta_part})"


_BASE = f"WITH {text.prepared()},{_INIT},{_SUFFIX}"
_ONE = f"{_BASE},{_two_passes('m0', 'a')}"
_STEP = f"{_ONE},{_batch('lam0', 'a', 'lam1')},{_model('lam1', 'm1')}"
_TWO = f"{_STEP},{_two_passes('m1', 'c')},{_batch('lam1', 'c', 'lam2')},{_model('lam2', 'm2')}"
_RHO = f"pow({sql.lit(STEPS.tau + 1)}, {sql.lit(-STEPS.kappa)})"
_RATIO = f"({sql.lit(STEPS.n_docs)} / (SELECT count(*) FROM documents))"
_WORDS = "(SELECT sum(cnt) FROM dt)"

_ONLINE = f"""{_ONE}, online AS (
          SELECT topic_id, term_id, w * (1.0::DOUBLE - {_RHO})
                 + {_RHO} * ({ETA} + {_RATIO} * coalesce(stat, 0.0::DOUBLE)) AS w
          FROM lam0 LEFT JOIN ass USING (topic_id, term_id))"""


def _online(weights: str, tag: str, out: str, step: int, docs: str) -> str:
    rho = f"pow({sql.lit(STEPS.tau + step)}, {sql.lit(-STEPS.kappa)})"
    return f"""
    {out} AS MATERIALIZED (
      SELECT topic_id, term_id, w * (1.0::DOUBLE - {rho})
             + {rho} * ({ETA} + {sql.lit(STEPS.n_docs)} / (SELECT count(*) FROM {docs}) * coalesce(stat, 0.0::DOUBLE)) AS w
      FROM {weights} LEFT JOIN {tag}ss USING (topic_id, term_id))"""


_HALVES = """
    placed AS MATERIALIZED (
      SELECT doc_id, row_number() OVER (ORDER BY doc_id) <= (count(*) OVER () + 1) // 2 AS early FROM documents),
    half1 AS MATERIALIZED (SELECT doc_id FROM placed WHERE early),
    half2 AS MATERIALIZED (SELECT doc_id FROM placed WHERE NOT early),
    dt1 AS MATERIALIZED (SELECT * FROM dt SEMI JOIN half1 USING (doc_id)),
    dt2 AS MATERIALIZED (SELECT * FROM dt SEMI JOIN half2 USING (doc_id))"""
_ONLINE_TWO = f"""{_BASE},{_HALVES},{_two_passes('m0', 'p', 'half1', 'dt1')},{_online('lam0', 'p', 'on1', 1, 'half1')},
    {_model('on1', 'q1')},{_two_passes('q1', 'q', 'half2', 'dt2')},{_online('on1', 'q', 'on2', 2, 'half2')}"""


def _top(before: str, weights: str, extra: str = "") -> str:
    return f"""{before}, ranked AS (
          SELECT topic_id, term, w, row_number() OVER (PARTITION BY topic_id ORDER BY w DESC, term)::INTEGER AS rank
          FROM {weights} JOIN vocab USING (term_id))
        SELECT {extra} topic_id, rank, term, round(w, 6) AS weight FROM ranked WHERE rank <= {N_TOP}"""


ORACLES = {
    "dirichlet_expectation": f"""
        WITH {text.prepared()}, x AS (
          SELECT doc_id, term_id, cnt + {ALPHA} AS w, sum(cnt + {ALPHA}) OVER (PARTITION BY doc_id) AS total FROM dt)
        SELECT doc_id, term_id, round({sql.digamma('w')} - {sql.digamma('total')}, 6) AS elog FROM x""",
    "lda_init": f"{_BASE} SELECT topic_id, term_id, round(w, 6) AS weight FROM lam0",
    "lda_estep_once": f"{_ONE} SELECT doc_id, topic_id, round(g, 6) AS gamma FROM ag1",
    "lda_estep": f"{_ONE} SELECT doc_id, topic_id, round(g, 6) AS gamma FROM ag2",
    "lda_sstats": f"{_ONE} SELECT topic_id, term_id, round(stat, 6) AS stat FROM ass",
    "lda_mstep_batch": f"{_STEP} SELECT topic_id, term_id, round(w, 6) AS weight FROM lam1",
    "lda_mstep_online": f"{_ONLINE} SELECT topic_id, term_id, round(w, 6) AS weight FROM online",
    "lda_partial_fit": f"{_ONLINE} SELECT topic_id, term_id, round(w, 6) AS weight FROM online",
    "lda_transform": f"""{_ONE}
        SELECT doc_id, topic_id, round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS theta FROM ag2""",
    "lda_bound": f"""{_ONE}
        SELECT round({_bound('at2', 'm0')}, 3) AS bound, round({_bound('at2', 'm0', _RATIO)}, 3) AS scaled""",
    "lda_perplexity": f"{_ONE} SELECT round(exp(-{_bound('at2', 'm0')} / {_WORDS}), 4) AS perplexity",
    "lda_top_words": _top(_STEP, "lam1"),
    "lda_fit_transform_steps": f"""{_TWO},{_two_passes('m2', 'e')}
        SELECT doc_id, topic_id, round(g / sum(g) OVER (PARTITION BY doc_id), 6) AS theta FROM eg2""",
    "lda_partial_fit_two": f"{_ONLINE_TWO} SELECT topic_id, term_id, round(w, 6) AS weight FROM on2",
    "lda_fit": f"{_TWO} SELECT topic_id, term_id, round(w, 6) AS weight FROM lam2",
    "lda_trace": f"""{_TWO}
        SELECT 0::INTEGER AS iteration, round(exp(-{_bound('at2', 'm1')} / {_WORDS}), 4) AS perplexity
        UNION ALL SELECT 1::INTEGER, round(exp(-{_bound('ct2', 'm2')} / {_WORDS}), 4)""",
}
