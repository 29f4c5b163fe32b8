"""Registered queries on Gibbs topic models, with the SQL that checks them.

Operators around the sampler are checked on the random labels a fit starts from.
"""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import functions as F

from topicloom.operators import gibbs
from topicloom.operators.arrow import TermColumns, TermVectors, pack_cells
from topicloom.operators.counts import Sequences, doc_term_counts, feature_sequences
from topicloom.operators.gibbs import GibbsModel, HdpParams, StopRule
from topicloom.operators.tokens import LETTERS_PUNCT
from topicloom.operators.validation import cross_validate
from topicloom.operators.vocabulary import build_vocabulary
from topicloom.plans import sql, text
from topicloom.session import fresh_path, hold
from topicloom.sources.model_store import load_gibbs, save_gibbs

PARAMS = HdpParams(alpha=1.0, beta=0.1, gamma=1.0, n_topics=10, seed=3)
K = PARAMS.n_topics
N_TOP = 6
#: Sweeps of the queries that check what no sweep may change; the fits themselves sweep until the likelihood is level.
SWEEPS = 5
FOLDS = 10
FIXED = HdpParams(alpha=1.0, beta=0.1, gamma=0.0, n_topics=K, seed=3)


def corpus(spark, sf_dir):
    """Sequences over the whole vocabulary, without frequency bounds; a query reads them once, to label them."""
    docs = text.terms(spark, sf_dir, LETTERS_PUNCT)
    vocab = build_vocabulary(docs)
    return feature_sequences(docs, vocab), vocab, docs


def labelled(spark, sf_dir):
    seqs, vocab, docs = corpus(spark, sf_dir)
    state = hold(gibbs.random_topics(seqs.df.select("doc_id", "term_ids"), K, PARAMS.seed))
    return state, seqs, vocab, docs


def totals_of(state):
    rows = gibbs.topic_counts(gibbs.topic_term_counts(state)).collect()
    found = {r["topic_id"]: float(r["n"]) for r in rows}
    return [found.get(k, 0.0) for k in range(K)]


def shares(state, n_terms):
    """Packed topic-term shares of the labels, for joins."""
    packed = pack_cells(gibbs.topic_term_counts(state), "topic_id", "n", K)
    phi = gibbs.smoothed_vectors(packed, n_terms, totals_of(state), PARAMS.beta)
    return TermVectors(phi, 8.0 * n_terms * K, TermColumns(None, K))


def hdp_init(spark, sf_dir):
    return gibbs.labelled_tokens(labelled(spark, sf_dir)[0])


def hdp_active_topics(spark, sf_dir):
    return gibbs.active_topics(gibbs.topic_counts(gibbs.topic_term_counts(labelled(spark, sf_dir)[0])))


def hdp_counts(spark, sf_dir):
    return gibbs.count_tables(labelled(spark, sf_dir)[0]).fillna(-1, ["doc_id", "term_id"])


def hdp_token_conditional(spark, sf_dir):
    state, seqs, *_ = labelled(spark, sf_dir)
    counts = gibbs.topic_term_counts(state)
    vectors = TermVectors(pack_cells(counts, "topic_id", "n", K), 8.0 * seqs.n_terms * K, TermColumns(None, K))
    smoothed = [n + seqs.n_terms * PARAMS.beta for n in totals_of(state)]
    out = gibbs.token_conditional(
        state, vectors, [PARAMS.alpha / K] * K, smoothed, PARAMS.beta, PARAMS.alpha / K / seqs.n_terms
    )
    return out.withColumn("p_stay", F.round("p_stay", 6)).withColumn("p_new", F.round("p_new", 9))


def hdp_table_counts(spark, sf_dir):
    state = labelled(spark, sf_dir)[0]
    return gibbs.table_counts(gibbs.doc_topic_counts_in_row(state), F.lit(PARAMS.alpha / K), PARAMS.seed, "tables")


def hdp_relabel_topics(spark, sf_dir):
    return gibbs.relabel_by_size(gibbs.topic_counts(gibbs.topic_term_counts(labelled(spark, sf_dir)[0])))


def hdp_top_words(spark, sf_dir):
    state, _, vocab, _ = labelled(spark, sf_dir)
    return gibbs.top_words(gibbs.topic_term_counts(state), vocab.df, N_TOP)


def hdp_stored_top_words(spark, sf_dir):
    """``hdp_top_words`` of a model that was saved and loaded again."""
    seqs, vocab, _ = corpus(spark, sf_dir)
    path = fresh_path(spark, "stored-model")
    save_gibbs(GibbsModel.initialise(seqs, PARAMS), path)
    return load_gibbs(spark, path).top_words(vocab.df, N_TOP)


def hdp_topic_share(spark, sf_dir):
    out = gibbs.topic_share(gibbs.topic_counts(gibbs.topic_term_counts(labelled(spark, sf_dir)[0])))
    return out.withColumn("share", F.round("share", 9))


def hdp_summary(spark, sf_dir):
    seqs = corpus(spark, sf_dir)[0]
    return GibbsModel.initialise(seqs, PARAMS).summary()


def hdp_doc_topics(spark, sf_dir):
    return gibbs.doc_topic_table(labelled(spark, sf_dir)[0], K)


def hdp_phi(spark, sf_dir):
    state, seqs, vocab, _ = labelled(spark, sf_dir)
    phi = gibbs.topic_word_shares(
        gibbs.topic_term_counts(state), vocab.df.select("term_id"), seqs.n_terms, totals_of(state), PARAMS.beta
    )
    return phi.withColumn("phi", F.round("phi", 9))


def hdp_hyper_alpha(spark, sf_dir):
    lengths = labelled(spark, sf_dir)[0].select("doc_id", F.size("z").alias("n"))
    out = gibbs.alpha_auxiliaries(lengths, PARAMS.alpha, PARAMS.seed, "hyper")
    return out.withColumn("log_beta", F.round("log_beta", 4))


def hdp_hyper_beta(spark, sf_dir):
    state, seqs, *_ = labelled(spark, sf_dir)
    beta = gibbs.beta_map_step(gibbs.topic_term_counts(state), seqs.n_terms, PARAMS.beta, PARAMS.beta_prior)
    return spark.createDataFrame([(beta,)], "beta double").select(F.round("beta", 6).alias("beta"))


def swept(spark, sf_dir, params=PARAMS, sweeps=SWEEPS):
    return GibbsModel.initialise(corpus(spark, sf_dir)[0], params).estimate(sweeps)


def fitted(spark, sf_dir, params=PARAMS):
    """A model trained until its log likelihood is level, and the vocabulary."""
    seqs, vocab, _ = corpus(spark, sf_dir)
    return GibbsModel.initialise(seqs, params).fit(), vocab


def hdp_log_lik(spark, sf_dir):
    """The likelihood that a fit watches, at the labels it starts from."""
    state, seqs, *_ = labelled(spark, sf_dir)
    value = gibbs.joint_log_lik(state, [PARAMS.alpha / K] * K, PARAMS.alpha / K, seqs.n_terms, PARAMS.beta)
    return spark.createDataFrame([(value,)], "log_lik double").select(F.round("log_lik", 2).alias("log_lik"))


def hdp_sweep(spark, sf_dir):
    return gibbs.labelled_tokens(swept(spark, sf_dir, sweeps=1).state)


def hdp_fit(spark, sf_dir):
    model, vocab = fitted(spark, sf_dir)
    return model.top_words(vocab.df, N_TOP)


def hdp_trace(spark, sf_dir):
    return fitted(spark, sf_dir)[0].trace_table()


def gibbs_lda_fit(spark, sf_dir):
    model, vocab = fitted(spark, sf_dir, FIXED)
    return model.top_words(vocab.df, N_TOP)


def hdp_hyper(spark, sf_dir):
    """Summary after a fit that also resamples its hyperparameters."""
    return fitted(spark, sf_dir, replace(PARAMS, fixed_hyper=False))[0].summary()


def unseen(spark, sf_dir):
    """Sequences of the training folds and of the held-out fold, on the vocabulary of the training folds."""
    train, held_out = text.training_split(text.terms(spark, sf_dir, LETTERS_PUNCT))
    vocab = build_vocabulary(train)
    known, new = feature_sequences(train, vocab), feature_sequences(held_out, vocab)
    return known, Sequences(hold(new.df), vocab.n_terms), vocab, held_out


def hdp_score(spark, sf_dir):
    """Topic shares of documents that the model was not trained on."""
    known, new, *_ = unseen(spark, sf_dir)
    scores = GibbsModel.initialise(known, PARAMS).fit().scorer().score(new)
    return scores.select("doc_id", F.posexplode("theta").alias("topic_id", "theta"))


def hdp_score_sums(spark, sf_dir):
    """Every held-out document is scored, and its shares sum to 1, here after a few sweeps."""
    known, new, *_ = unseen(spark, sf_dir)
    scores = GibbsModel.initialise(known, PARAMS).estimate(2).scorer().score(new, 10)
    rows = scores.select("doc_id", F.explode("theta").alias("theta"))
    return rows.groupBy("doc_id").agg(F.round(F.sum("theta"), 9).alias("total"))


def token_cells(model):
    """What no sweep may change: how often a document has a term."""
    return gibbs.doc_term_cells(model.state)


def hdp_sweep_cells(spark, sf_dir):
    return token_cells(swept(spark, sf_dir, sweeps=1))


def hdp_fit_cells(spark, sf_dir):
    return token_cells(swept(spark, sf_dir))


def gibbs_lda_cells(spark, sf_dir):
    return token_cells(swept(spark, sf_dir, FIXED))


def hdp_trace_check(spark, sf_dir):
    """Tokens per sweep, and whether the last sweep's topics are those that labels name."""
    model = swept(spark, sf_dir)
    named = gibbs.labelled_tokens(model.state).agg(F.count_distinct("topic_id").alias("k")).first()["k"]
    return model.trace_table().agg(
        F.min("n_tokens").alias("least"),
        F.max("n_tokens").alias("most"),
        (F.max_by("n_topics", "sweep") == named).alias("topics_named"),
    )


def hdp_fold_sizes(spark, sf_dir):
    """Documents and terms of the folds, here after a few sweeps."""
    return cross_validate(text.terms(spark, sf_dir, LETTERS_PUNCT), PARAMS, FOLDS, 2, 2).select("fold", "n_docs", "n_terms")


def unseen_states(spark, sf_dir):
    """Random labels of training and held-out documents."""
    known, new, vocab, held_out = unseen(spark, sf_dir)
    state = hold(gibbs.random_topics(known.df.select("doc_id", "term_ids"), K, PARAMS.seed))
    start = hold(gibbs.random_topics(new.df.select("doc_id", "term_ids"), K, PARAMS.seed, "score-init"))
    return state, start, vocab, held_out


def unseen_topic_share(spark, sf_dir):
    start = unseen_states(spark, sf_dir)[1]
    rows = gibbs.doc_topic_share(start, K, PARAMS.alpha).select("doc_id", F.posexplode("theta").alias("topic_id", "theta"))
    return rows.withColumn("theta", F.round("theta", 9))


def unseen_perplexity(spark, sf_dir):
    """Held-out documents under the topics of the training folds."""
    state, start, vocab, held_out = unseen_states(spark, sf_dir)
    theta = gibbs.doc_topic_share(start, K, PARAMS.alpha)
    out = gibbs.heldout_perplexity(doc_term_counts(held_out, vocab), theta, shares(state, vocab.n_terms))
    return out.select("n_tokens", F.round("loglik", 3).alias("loglik"), F.round("perplexity", 4).alias("perplexity"))


def hdp_cross_validate(spark, sf_dir):
    return cross_validate(text.terms(spark, sf_dir, LETTERS_PUNCT), PARAMS, FOLDS, rule=StopRule())


def score_init(spark, sf_dir):
    """Held-out documents on the vocabulary of the training folds, with the labels scoring starts from."""
    train, held_out = text.training_split(text.terms(spark, sf_dir, LETTERS_PUNCT))
    seqs = feature_sequences(held_out, build_vocabulary(train))
    start = gibbs.random_topics(seqs.df.select("doc_id", "term_ids"), K, PARAMS.seed, "score-init")
    return gibbs.labelled_tokens(start)


def score_token_conditional(spark, sf_dir):
    state, seqs, *_ = labelled(spark, sf_dir)
    out = gibbs.token_conditional(state, shares(state, seqs.n_terms), [PARAMS.alpha] * K, None)
    return out.drop("p_new").withColumn("p_stay", F.round("p_stay", 6))


def doc_topic_share(spark, sf_dir):
    out = gibbs.doc_topic_share(labelled(spark, sf_dir)[0], K, PARAMS.alpha)
    rows = out.select("doc_id", F.posexplode("theta").alias("topic_id", "theta"))
    return rows.withColumn("theta", F.round("theta", 9))


def heldout_perplexity(spark, sf_dir):
    state, seqs, vocab, docs = labelled(spark, sf_dir)
    theta = gibbs.doc_topic_share(state, K, PARAMS.alpha)
    out = gibbs.heldout_perplexity(doc_term_counts(docs, vocab), theta, shares(state, seqs.n_terms))
    return out.select("n_tokens", F.round("loglik", 3).alias("loglik"), F.round("perplexity", 4).alias("perplexity"))


QUERIES = {
    "hdp_init": hdp_init,
    "hdp_active_topics": hdp_active_topics,
    "hdp_counts": hdp_counts,
    "hdp_token_conditional": hdp_token_conditional,
    "hdp_table_counts": hdp_table_counts,
    "hdp_relabel_topics": hdp_relabel_topics,
    "hdp_top_words": hdp_top_words,
    "hdp_stored_top_words": hdp_stored_top_words,
    "hdp_topic_share": hdp_topic_share,
    "hdp_summary": hdp_summary,
    "hdp_doc_topics": hdp_doc_topics,
    "hdp_phi": hdp_phi,
    "hdp_hyper_alpha": hdp_hyper_alpha,
    "hdp_hyper_beta": hdp_hyper_beta,
    "hdp_log_lik": hdp_log_lik,
    "hdp_sweep": hdp_sweep,
    "hdp_fit": hdp_fit,
    "hdp_trace": hdp_trace,
    "gibbs_lda_fit": gibbs_lda_fit,
    "hdp_hyper": hdp_hyper,
    "hdp_score": hdp_score,
    "hdp_cross_validate": hdp_cross_validate,
    "score_init": score_init,
    "score_token_conditional": score_token_conditional,
    "doc_topic_share": doc_topic_share,
    "heldout_perplexity": heldout_perplexity,
    "hdp_score_sums": hdp_score_sums,
    "hdp_sweep_cells": hdp_sweep_cells,
    "hdp_fit_cells": hdp_fit_cells,
    "gibbs_lda_cells": gibbs_lda_cells,
    "hdp_trace_check": hdp_trace_check,
    "hdp_fold_sizes": hdp_fold_sizes,
    "unseen_topic_share": unseen_topic_share,
    "unseen_perplexity": unseen_perplexity,
}


# -------------------------------------------------------------------------- SQL

A, B = sql.lit(PARAMS.alpha), sql.lit(PARAMS.beta)
V = "(SELECT count(*) FROM vocab)::DOUBLE"
TOPICS = f"(SELECT unnest(range({K}))::INTEGER AS topic_id)"


def _labels(vocab: str, stage: str) -> str:
    """``lab(doc_id, pos, term_id, topic_id)``; positions count known tokens only."""
    return f"""WITH {sql.tokens(LETTERS_PUNCT)},{vocab},
    seq AS (
      SELECT doc_id, term_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos
      FROM tok JOIN vocab USING (term)),
    lab AS MATERIALIZED (
      SELECT doc_id, pos, term_id,
             floor({sql.uniform(PARAMS.seed, stage, 'doc_id', 'pos')} * {K})::INTEGER AS topic_id FROM seq),
    nkt AS MATERIALIZED (SELECT topic_id, term_id, count(*) AS n FROM lab GROUP BY topic_id, term_id),
    nk AS MATERIALIZED (SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id),
    nmk AS MATERIALIZED (SELECT doc_id, topic_id, count(*) AS n FROM lab GROUP BY doc_id, topic_id)"""


_LAB = _labels(sql.vocabulary(), "topic-init")
_DOC_TOPICS = f"""
    full_nmk AS MATERIALIZED (
      SELECT d.doc_id, k.topic_id, coalesce(nmk.n, 0) AS n
      FROM documents d CROSS JOIN {TOPICS} k LEFT JOIN nmk ON nmk.doc_id = d.doc_id AND nmk.topic_id = k.topic_id)"""
_PHI = f"""
    phi AS MATERIALIZED (
      SELECT k.topic_id, v.term_id,
             (coalesce(nkt.n, 0)::DOUBLE + {B}) / (coalesce(nk.n, 0)::DOUBLE + {V} * {B}) AS phi
      FROM vocab v CROSS JOIN {TOPICS} k
      LEFT JOIN nkt ON nkt.topic_id = k.topic_id AND nkt.term_id = v.term_id
      LEFT JOIN nk ON nk.topic_id = k.topic_id)"""
_SHARE = f"""
    theta AS MATERIALIZED (
      SELECT doc_id, topic_id,
             (n + {A}) / (sum(n) OVER (PARTITION BY doc_id) + {K} * {A}) AS theta FROM full_nmk)"""
_CELLS = """
    cells AS MATERIALIZED (
      SELECT doc_id, term_id, topic_id, count(*) AS n FROM lab GROUP BY doc_id, term_id, topic_id)"""


_HELD_OUT = f"{text.fold('doc_id')} = 0"
_UNSEEN = f"""WITH {sql.tokens(LETTERS_PUNCT)},{text.train_tokens()},{sql.vocabulary(tok="train_tok")},
    seq AS (
      SELECT doc_id, term_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, {_HELD_OUT} AS new
      FROM tok JOIN vocab USING (term)),
    lab AS MATERIALIZED (
      SELECT term_id, floor({sql.uniform(PARAMS.seed, 'topic-init', 'doc_id', 'pos')} * {K})::INTEGER AS topic_id
      FROM seq WHERE NOT new),
    nkt AS MATERIALIZED (SELECT topic_id, term_id, count(*) AS n FROM lab GROUP BY topic_id, term_id),
    nk AS MATERIALIZED (SELECT topic_id, count(*) AS n FROM lab GROUP BY topic_id),
    nmk AS MATERIALIZED (
      SELECT doc_id, floor({sql.uniform(PARAMS.seed, 'score-init', 'doc_id', 'pos')} * {K})::INTEGER AS topic_id, count(*) AS n
      FROM seq WHERE new GROUP BY ALL),
    full_nmk AS MATERIALIZED (
      SELECT d.doc_id, k.topic_id, coalesce(nmk.n, 0) AS n
      FROM (SELECT doc_id FROM documents WHERE {_HELD_OUT}) d CROSS JOIN {TOPICS} k
      LEFT JOIN nmk ON nmk.doc_id = d.doc_id AND nmk.topic_id = k.topic_id)"""
_TOKEN_CELLS = f"""WITH {sql.tokens(LETTERS_PUNCT)},{sql.vocabulary()}
        SELECT doc_id, term_id, count(*) AS n FROM tok JOIN vocab USING (term) GROUP BY doc_id, term_id"""


def _digamma_gain(n: str, base: str) -> str:
    return f"({sql.digamma(f'({n}::DOUBLE + {base})')} - {sql.digamma(base)})"


ORACLES = {
    "hdp_init": f"{_LAB} SELECT doc_id, pos, term_id, topic_id FROM lab",
    "hdp_active_topics": f"""{_LAB}
        SELECT topic_id, (row_number() OVER (ORDER BY topic_id) - 1)::INTEGER AS new_id, n FROM nk WHERE n > 0""",
    "hdp_counts": f"""{_LAB}
        SELECT 'doc_topic' AS kind, doc_id, topic_id, (-1)::INTEGER AS term_id, n FROM nmk
        UNION ALL SELECT 'topic_term', -1, topic_id, term_id, n FROM nkt
        UNION ALL SELECT 'topic', -1, topic_id, -1, n FROM nk""",
    "hdp_token_conditional": f"""{_LAB},{_CELLS},{_DOC_TOPICS}, p AS (
          SELECT c.doc_id, c.term_id, c.topic_id, c.n, m.topic_id AS k,
                 (m.n - (m.topic_id = c.topic_id)::INT + {A} / {K})
                 * (coalesce(nkt.n, 0) - (m.topic_id = c.topic_id)::INT + {B})
                 / (nk.n - (m.topic_id = c.topic_id)::INT + {V} * {B}) AS mass
          FROM cells c JOIN full_nmk m USING (doc_id)
          LEFT JOIN nkt ON nkt.term_id = c.term_id AND nkt.topic_id = m.topic_id
          JOIN nk ON nk.topic_id = m.topic_id)
        SELECT doc_id, term_id, topic_id, any_value(n) AS n,
               round(sum(mass) FILTER (k = topic_id) / (sum(mass) + {A} / {K} / {V}), 6) AS p_stay,
               round({A} / {K} / {V} / (sum(mass) + {A} / {K} / {V}), 9) AS p_new
        FROM p GROUP BY doc_id, term_id, topic_id""",
    "hdp_table_counts": f"""{_LAB}, draws AS (
          SELECT doc_id, topic_id, unnest(range(n)) AS i FROM nmk)
        SELECT topic_id, count(*) FILTER (i = 0 OR {sql.uniform(PARAMS.seed, 'tables', 'doc_id', 'topic_id', 'i')}
               < ({A} / {K}) / ({A} / {K} + i)) AS tables
        FROM draws GROUP BY topic_id""",
    "hdp_relabel_topics": f"""{_LAB}
        SELECT topic_id, (row_number() OVER (ORDER BY n DESC, topic_id) - 1)::INTEGER AS new_id, n FROM nk""",
    "hdp_top_words": f"""{_LAB}, ranked AS (
          SELECT topic_id, term, n, row_number() OVER (PARTITION BY topic_id ORDER BY n DESC, term)::INTEGER AS rank
          FROM nkt JOIN vocab USING (term_id))
        SELECT topic_id, rank, term, n FROM ranked WHERE rank <= {N_TOP}""",
    "hdp_topic_share": f"""{_LAB}
        SELECT topic_id, n, round(n / sum(n) OVER (), 9) AS share, (sum(n) OVER ())::BIGINT AS total FROM nk""",
    "hdp_summary": f"""{_LAB}
        SELECT (SELECT count(*) FROM documents) AS n_docs, (SELECT count(*) FROM nk)::INTEGER AS n_topics,
               (SELECT count(*) FROM lab) AS n_tokens, {A} AS alpha, {B} AS beta, {sql.lit(PARAMS.gamma)} AS gamma""",
    "hdp_doc_topics": f"{_LAB},{_DOC_TOPICS} SELECT doc_id, topic_id, n FROM full_nmk",
    "hdp_phi": f"{_LAB},{_PHI} SELECT topic_id, term_id, round(phi, 9) AS phi FROM phi",
    "hdp_hyper_alpha": f"""{_LAB}, lens AS (SELECT doc_id, count(*) AS n FROM lab GROUP BY doc_id),
        draws AS (SELECT doc_id, unnest(range(n)) AS i FROM lens)
        SELECT (SELECT count(*) FROM lens
                WHERE {sql.uniform(PARAMS.seed, 'hyper:s', 'doc_id')} < n / (n + {A})) AS successes,
               round(sum(ln({sql.uniform(PARAMS.seed, 'hyper:b', 'doc_id', 'i')})
                     / ({A} + 1.0::DOUBLE + i)), 4) AS log_beta FROM draws""",
    "hdp_hyper_beta": f"""{_LAB}
        SELECT round((0.0::DOUBLE + {B} * (SELECT sum({_digamma_gain('n', B)}) FROM nkt))
               / (1.0::DOUBLE + {V} * (SELECT sum({_digamma_gain('n', f'({V} * {B})')}) FROM nk)), 6) AS beta""",
    "hdp_log_lik": f"""{_LAB}, lens AS (SELECT doc_id, count(*) AS n FROM lab GROUP BY doc_id)
        SELECT round((SELECT sum({sql.rising(f'({A} / {K})', 'n::DOUBLE')}) FROM nmk)
               - (SELECT sum({sql.rising(f'({A} / {K} * {K + 1})', 'n::DOUBLE')}) FROM lens)
               + (SELECT sum({sql.rising(B, 'n::DOUBLE')}) FROM nkt)
               - (SELECT sum({sql.rising(f'({V} * {B})', 'n::DOUBLE')}) FROM nk), 2) AS log_lik""",
    "score_init": _labels(f"{text.train_tokens()},{sql.vocabulary(tok='train_tok')}", "score-init")
    + f" SELECT doc_id, pos, term_id, topic_id FROM lab WHERE {text.fold('doc_id')} = 0",
    "score_token_conditional": f"""{_LAB},{_CELLS},{_DOC_TOPICS},{_PHI}, p AS (
          SELECT c.doc_id, c.term_id, c.topic_id, c.n, m.topic_id AS k,
                 (m.n - (m.topic_id = c.topic_id)::INT + {A}) * phi.phi AS mass
          FROM cells c JOIN full_nmk m USING (doc_id)
          JOIN phi ON phi.term_id = c.term_id AND phi.topic_id = m.topic_id)
        SELECT doc_id, term_id, topic_id, any_value(n) AS n,
               round(sum(mass) FILTER (k = topic_id) / sum(mass), 6) AS p_stay
        FROM p GROUP BY doc_id, term_id, topic_id""",
    "doc_topic_share": f"{_LAB},{_DOC_TOPICS},{_SHARE} SELECT doc_id, topic_id, round(theta, 9) AS theta FROM theta",
    "heldout_perplexity": f"""{_LAB},{_DOC_TOPICS},{_PHI},{_SHARE}, dt AS (
          SELECT doc_id, term_id, count(*)::DOUBLE AS cnt FROM seq GROUP BY doc_id, term_id),
        p AS (
          SELECT doc_id, term_id, any_value(cnt) AS cnt, sum(theta * phi) AS p
          FROM dt JOIN phi USING (term_id) JOIN theta USING (doc_id, topic_id) GROUP BY doc_id, term_id)
        SELECT sum(cnt) AS n_tokens, round(sum(cnt * ln(p)), 3) AS loglik,
               round(exp(-sum(cnt * ln(p)) / sum(cnt)), 4) AS perplexity FROM p""",
    "hdp_score_sums": f"SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE {_HELD_OUT}",
    "hdp_sweep_cells": _TOKEN_CELLS,
    "hdp_fit_cells": _TOKEN_CELLS,
    "gibbs_lda_cells": _TOKEN_CELLS,
    "hdp_trace_check": f"""WITH {sql.tokens(LETTERS_PUNCT)}
        SELECT count(*) AS least, count(*) AS most, true AS topics_named FROM tok""",
    "hdp_fold_sizes": f"""WITH {sql.tokens(LETTERS_PUNCT)}, f AS (
          SELECT doc_id, floor({sql.uniform(PARAMS.seed, 'fold', 'doc_id')} * {FOLDS})::INTEGER AS fold FROM documents),
        n AS (SELECT fold, count(*) AS n_docs FROM f GROUP BY fold)
        SELECT n.fold, any_value(n_docs) AS n_docs, count(DISTINCT term) AS n_terms
        FROM n JOIN f ON f.fold <> n.fold JOIN tok USING (doc_id) GROUP BY n.fold""",
    "unseen_topic_share": f"{_UNSEEN},{_SHARE} SELECT doc_id, topic_id, round(theta, 9) AS theta FROM theta",
    "unseen_perplexity": f"""{_UNSEEN},{_PHI},{_SHARE}, dt AS (
          SELECT doc_id, term_id, count(*)::DOUBLE AS cnt FROM seq WHERE new GROUP BY doc_id, term_id),
        p AS (
          SELECT doc_id, term_id, any_value(cnt) AS cnt, sum(theta * phi) AS p
          FROM dt JOIN phi USING (term_id) JOIN theta USING (doc_id, topic_id) GROUP BY doc_id, term_id)
        SELECT sum(cnt) AS n_tokens, round(sum(cnt * ln(p)), 3) AS loglik,
               round(exp(-sum(cnt * ln(p)) / sum(cnt)), 4) AS perplexity FROM p""",
}
ORACLES["hdp_stored_top_words"] = ORACLES["hdp_top_words"]
