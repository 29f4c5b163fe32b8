"""Registered queries on topic trees, with the SQL that checks them.

The checked queries use a tree read off the documents themselves: the root, one
child per language, one leaf per (language, source); token levels are random.
"""

from __future__ import annotations

from pyspark.sql import functions as F

from topicloom.operators import tree as trees
from topicloom.operators.counts import Sequences, feature_sequences
from topicloom.operators.tokens import ALNUM_DASH, drop_stopwords, tokenize
from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.tree import TopicTree, TreeParams
from topicloom.operators.vocabulary import build_vocabulary
from topicloom.plans import sql, text
from topicloom.session import cut_lineage, fresh_path, hold, lookup_join, with_row_index
from topicloom.sources.model_store import load_tree, save_tree
from topicloom.sources.reports import distribution_lines

PARAMS = TreeParams(alpha=10.0, gamma=1.0, eta=0.1, n_levels=3, seed=5)
N_WORDS = 25


def words(spark, sf_dir):
    return drop_stopwords(tokenize(text.documents(spark, sf_dir, "text", "lang", "source"), ALNUM_DASH), ENGLISH)


def corpus(spark, sf_dir):
    """Sequences over the whole vocabulary; a fit reads them once, for its start."""
    docs = words(spark, sf_dir)
    vocab = build_vocabulary(docs)
    return feature_sequences(docs, vocab), vocab, docs


def given_state(spark, sf_dir):
    """Each document on the path of its language and source, at random levels, and the vocabulary.

    Paths come to the documents in their rows, so no tokens are shuffled for them.
    """
    docs = words(spark, sf_dir)
    vocab = build_vocabulary(docs)
    seqs = feature_sequences(docs, vocab, ("lang", "source")).df
    leaves = docs.select("lang", "source").distinct()
    langs = with_row_index(leaves.select("lang").distinct(), ["lang"], "a")
    leaves = with_row_index(leaves, ["lang", "source"], "b")
    n_langs, n_leaves = langs.count(), leaves.count()
    places = leaves.join(langs, "lang").select(
        "lang",
        "source",
        F.array(F.lit(0), (F.col("a") + 1).cast("int"), (F.col("b") + 1 + n_langs).cast("int")).alias("path"),
    )
    state = trees.random_levels(seqs.select("doc_id", "lang", "source", "term_ids"), PARAMS.n_levels, PARAMS.seed)
    state = lookup_join(state, places, ["lang", "source"], "inner", 128.0 * n_leaves, ["doc_id"])
    return hold(state.select("doc_id", "term_ids", "levels", "path")), vocab


def tree_of(state, vocab):
    nodes, terms = trees.tree_tables(state)
    return TopicTree(cut_lineage(nodes), cut_lineage(terms), vocab.n_terms, PARAMS)


def given_tree(spark, sf_dir):
    """The tree of languages and sources with its documents' state."""
    state, vocab = given_state(spark, sf_dir)
    return tree_of(state, vocab), state, vocab


def sizes(tree):
    return tree.nodes.count(), tree.terms.count()


def tree_nodes(spark, sf_dir):
    return given_tree(spark, sf_dir)[0].nodes.fillna(-1, ["parent_id"])


def tree_stored_terms(spark, sf_dir):
    """``tree_terms`` of a tree that was saved and loaded again."""
    path = fresh_path(spark, "stored-tree")
    save_tree(given_tree(spark, sf_dir)[0], path)
    return load_tree(spark, path).terms


def tree_terms(spark, sf_dir):
    return given_tree(spark, sf_dir)[0].terms


def tree_size(spark, sf_dir):
    return given_tree(spark, sf_dir)[0].nodes.agg(F.count("*").alias("n_nodes"))


def tree_path_prior(spark, sf_dir):
    out = trees.path_prior(given_tree(spark, sf_dir)[0].nodes, PARAMS)
    return out.withColumn("log_prior", F.round("log_prior", 6))


def tree_path_prior_by_node(spark, sf_dir):
    params = TreeParams(gamma=PARAMS.gamma, path_likelihood="node")
    out = trees.path_prior(given_tree(spark, sf_dir)[0].nodes, params)
    return out.withColumn("log_prior", F.round("log_prior", 6))


def doc_level_counts(spark, sf_dir):
    return trees.doc_level_counts(given_tree(spark, sf_dir)[1])


def level_new_topic_loglik(spark, sf_dir):
    tree, state, _ = given_tree(spark, sf_dir)
    out = trees.level_new_topic_loglik(trees.doc_level_counts(state), tree.n_terms, PARAMS.eta)
    return out.select("doc_id", "level", "n", F.round("loglik", 5).alias("loglik"))


def node_word_loglik(spark, sf_dir):
    tree, state, _ = given_tree(spark, sf_dir)
    out = trees.node_word_loglik(tree, state, *sizes(tree))
    return out.withColumn("loglik", F.round("loglik", 5))


def path_weights(spark, sf_dir):
    tree, state, _ = given_tree(spark, sf_dir)
    out = trees.path_weights(tree, state, *sizes(tree))
    return out.withColumn("log_weight", F.round("log_weight", 3))


def path_posterior(spark, sf_dir):
    tree, state, _ = given_tree(spark, sf_dir)
    n_nodes, n_cells = sizes(tree)
    out = trees.path_posterior(trees.path_weights(tree, state, n_nodes, n_cells), trees.rows_together(tree, n_nodes))
    return out.withColumn("prob", F.round("prob", 6))


def path_posterior_likely(spark, sf_dir):
    """Nodes of a hundredth or more of a document's posterior, -1 for all others together."""
    tree, state, _ = given_tree(spark, sf_dir)
    out = trees.likely_paths(tree, state, 0.01)
    return out.select("doc_id", F.coalesce("node_id", F.lit(-1)).alias("node_id"), F.round("prob", 6).alias("prob"))


def tree_doc_distribution(spark, sf_dir):
    out = trees.path_distribution(given_tree(spark, sf_dir)[1], PARAMS)
    return out.withColumn("share", F.round("share", 9))


def tree_train_distribution(spark, sf_dir):
    """One text line per document, shares as whole millionths so that both sides print alike."""
    state = given_tree(spark, sf_dir)[1]
    shares = trees.path_distribution(state, PARAMS).withColumn("share", F.round(F.col("share") * 1e6).cast("long"))
    names = text.documents(spark, sf_dir, "lang").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"))
    return distribution_lines(shares, names)


def tree_report(spark, sf_dir):
    tree, _, vocab = given_tree(spark, sf_dir)
    return trees.tree_report(tree, vocab.df, N_WORDS)


def held_out(spark, sf_dir):
    """The tree of the training folds, and held-out documents."""
    state, vocab = given_state(spark, sf_dir)
    train, rest = text.training_split(state)
    tree = tree_of(train, vocab)
    return tree, Sequences(rest.select("doc_id", "term_ids"), tree.n_terms)


def placed(spark, sf_dir, **steps):
    """The tree of the training folds, and held-out documents in it."""
    tree, seqs = held_out(spark, sf_dir)
    return tree, trees.infer(tree, seqs, **steps)


#: Every tenth of 300 steps after the first 100.
LONG = {"iterations": 300, "thinning": 10, "burn_in": 100}


def tree_infer(spark, sf_dir):
    """Path shares of held-out documents, averaged over every tenth of 300 steps after the first 100."""
    return trees.infer_distribution(placed(spark, sf_dir, **LONG)[1])


def tree_infer_lines(spark, sf_dir):
    """The same as text lines, one per held-out document."""
    tree, inferred = placed(spark, sf_dir, **LONG)
    names = text.documents(spark, sf_dir, "lang").select("doc_id", F.concat(F.lit("doc"), "doc_id").alias("name"))
    rows = trees.infer_distribution(inferred).join(tree.nodes.select("node_id", "level"), "node_id")
    return distribution_lines(rows.withColumn("share", F.round(F.col("share") * 1e6).cast("long")), names)


def tree_infer_sums(spark, sf_dir):
    """Every held-out document is placed, and its shares sum to 1, here after a few steps."""
    rows = trees.infer_distribution(placed(spark, sf_dir, iterations=10, thinning=2, burn_in=4)[1])
    return rows.groupBy("doc_id").agg(F.round(F.sum("share"), 9).alias("total"))


def tree_log_lik(spark, sf_dir):
    """The likelihood that a fit watches, at the labels of the given tree."""
    tree, state, _ = given_tree(spark, sf_dir)
    value = trees.joint_log_lik(tree, state)
    return spark.createDataFrame([(value,)], "log_lik double").select(F.round("log_lik", 2).alias("log_lik"))


def fitted(spark, sf_dir):
    """A tree after a few sweeps, for what no sweep may change."""
    return trees.fit_tree(corpus(spark, sf_dir)[0], PARAMS, 3)[0]


def tree_fit(spark, sf_dir):
    """A tree trained until its log likelihood is level."""
    seqs, vocab, _ = corpus(spark, sf_dir)
    return trees.tree_report(trees.train_tree(seqs, PARAMS).tree, vocab.df, N_WORDS)


def tree_fit_seats(spark, sf_dir):
    """Per level of a fitted tree its customers, and how many of its nodes have other customers than their children."""
    nodes = fitted(spark, sf_dir).nodes
    below = nodes.groupBy("parent_id").agg(F.sum("customers").alias("below"))
    joined = nodes.join(below.withColumnRenamed("parent_id", "node_id"), "node_id", "left")
    odd = (F.col("level") < PARAMS.n_levels - 1) & ~F.col("customers").eqNullSafe(F.col("below"))
    return joined.groupBy("level").agg(F.sum("customers").alias("customers"), F.count_if(odd).alias("odd"))


def tree_fit_tokens(spark, sf_dir):
    """How often a fitted tree has each term, over all nodes."""
    return fitted(spark, sf_dir).terms.groupBy("term_id").agg(F.sum("n").alias("n"))


QUERIES = {
    "tree_nodes": tree_nodes,
    "tree_terms": tree_terms,
    "tree_stored_terms": tree_stored_terms,
    "tree_size": tree_size,
    "tree_path_prior": tree_path_prior,
    "tree_path_prior_by_node": tree_path_prior_by_node,
    "doc_level_counts": doc_level_counts,
    "level_new_topic_loglik": level_new_topic_loglik,
    "node_word_loglik": node_word_loglik,
    "path_weights": path_weights,
    "path_posterior": path_posterior,
    "path_posterior_likely": path_posterior_likely,
    "tree_doc_distribution": tree_doc_distribution,
    "tree_train_distribution": tree_train_distribution,
    "tree_report": tree_report,
    "tree_infer": tree_infer,
    "tree_infer_lines": tree_infer_lines,
    "tree_log_lik": tree_log_lik,
    "tree_fit": tree_fit,
    "tree_infer_sums": tree_infer_sums,
    "tree_fit_seats": tree_fit_seats,
    "tree_fit_tokens": tree_fit_tokens,
}


# -------------------------------------------------------------------------- SQL

A, G, E = sql.lit(PARAMS.alpha), sql.lit(PARAMS.gamma), sql.lit(PARAMS.eta)
V = "(SELECT count(*) FROM vocab)::DOUBLE"
LEVELS = "(SELECT unnest(range(3))::INTEGER AS level)"

_STATE = f"""WITH {sql.tokens(ALNUM_DASH)},{sql.vocabulary()},
    seq AS (
      SELECT doc_id, term_id, row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1 AS pos
      FROM tok JOIN vocab USING (term)),
    lab AS MATERIALIZED (
      SELECT doc_id, term_id, floor({sql.uniform(PARAMS.seed, 'level', 'doc_id', 'pos')} * 3)::INTEGER AS level FROM seq),
    place AS MATERIALIZED (
      SELECT doc_id, dense_rank() OVER (ORDER BY lang) AS a,
             dense_rank() OVER (ORDER BY lang, source) + (SELECT count(DISTINCT lang) FROM documents) AS b
      FROM documents),
    path AS MATERIALIZED (
      SELECT doc_id, 0::INTEGER AS level, 0::INTEGER AS node_id, (-1)::INTEGER AS parent_id FROM place
      UNION ALL SELECT doc_id, 1, a, 0 FROM place UNION ALL SELECT doc_id, 2, b, a FROM place),
    tterm AS MATERIALIZED (
      SELECT node_id::INTEGER AS node_id, term_id, count(*) AS n
      FROM lab JOIN path USING (doc_id, level) GROUP BY node_id, term_id),
    node AS MATERIALIZED (
      SELECT node_id::INTEGER AS node_id, parent_id::INTEGER AS parent_id, level, customers,
             coalesce(t.total, 0)::BIGINT AS total_tokens
      FROM (SELECT node_id, parent_id, level, count(*) AS customers FROM path GROUP BY node_id, parent_id, level)
      LEFT JOIN (SELECT node_id, sum(n) AS total FROM tterm GROUP BY node_id) t USING (node_id)),
    dlc AS MATERIALIZED (SELECT doc_id, level, term_id, count(*) AS n FROM lab GROUP BY doc_id, level, term_id)"""


def _prior(leaf_branch: bool) -> str:
    inner = "TRUE" if leaf_branch else "n0.level < 2"
    return f"""
    prior AS MATERIALIZED (
      SELECT n0.node_id, n0.level,
             coalesce(ln(n0.customers / (n1.customers + {G})), 0.0::DOUBLE)
             + coalesce(ln(n1.customers / (n2.customers + {G})), 0.0::DOUBLE)
             + CASE WHEN {inner} THEN ln({G} / (n0.customers + {G})) ELSE 0.0::DOUBLE END AS log_prior
      FROM node n0 LEFT JOIN node n1 ON n1.node_id = n0.parent_id LEFT JOIN node n2 ON n2.node_id = n1.parent_id)"""


_NEW = f"""
    fresh AS MATERIALIZED (
      SELECT doc_id, level, sum(n)::BIGINT AS n,
             sum({sql.rising(E, 'n::DOUBLE')}) - {sql.rising(f'({E} * {V})', 'sum(n)::DOUBLE')} AS loglik
      FROM dlc GROUP BY doc_id, level)"""
_OWN = f"""
    own AS MATERIALIZED (
      SELECT d.doc_id, o.node_id,
             sum({sql.rising(f'(coalesce(t.n, 0)::DOUBLE + {E})', 'd.n::DOUBLE')})
             - {sql.rising(f'(any_value(o.total_tokens)::DOUBLE + {E} * {V})', 'sum(d.n)::DOUBLE')} AS loglik
      FROM dlc d JOIN node o USING (level)
      LEFT JOIN tterm t ON t.node_id = o.node_id AND t.term_id = d.term_id
      GROUP BY d.doc_id, o.node_id)"""
_WEIGHTS = f"""{_prior(False)},{_NEW},{_OWN},
    line AS (
      SELECT node_id, node_id AS up FROM node
      UNION ALL SELECT n0.node_id, n1.node_id FROM node n0 JOIN node n1 ON n1.node_id = n0.parent_id
      UNION ALL SELECT n0.node_id, n1.parent_id FROM node n0 JOIN node n1 ON n1.node_id = n0.parent_id
      WHERE n1.level > 0),
    parts AS (
      SELECT doc_id, line.node_id, loglik FROM own JOIN line ON own.node_id = line.up
      UNION ALL SELECT doc_id, node_id, loglik FROM fresh f JOIN node o ON f.level > o.level),
    words AS (SELECT doc_id, node_id, sum(loglik) AS loglik FROM parts GROUP BY doc_id, node_id),
    weight AS MATERIALIZED (
      SELECT d.doc_id, p.node_id, p.log_prior + coalesce(w.loglik, 0.0::DOUBLE) AS w
      FROM documents d CROSS JOIN prior p
      LEFT JOIN words w ON w.doc_id = d.doc_id AND w.node_id = p.node_id)"""
_DIST = f"""
    dist AS MATERIALIZED (
      SELECT p.doc_id, p.level, p.node_id::INTEGER AS node_id,
             ({A} + count(l.term_id)) / sum({A} + count(l.term_id)) OVER (PARTITION BY p.doc_id) AS share
      FROM path p LEFT JOIN lab l ON l.doc_id = p.doc_id AND l.level = p.level
      GROUP BY p.doc_id, p.level, p.node_id)"""

ORACLES = {
    "tree_nodes": f"{_STATE} SELECT node_id, parent_id, level, customers, total_tokens FROM node",
    "tree_terms": f"{_STATE} SELECT node_id, term_id, n FROM tterm",
    "tree_size": f"{_STATE} SELECT count(*) AS n_nodes FROM node",
    "tree_path_prior": f"""{_STATE},{_prior(False)}
        SELECT node_id, level, round(log_prior, 6) AS log_prior FROM prior""",
    "tree_path_prior_by_node": f"""{_STATE},{_prior(True)}
        SELECT node_id, level, round(log_prior, 6) AS log_prior FROM prior""",
    "doc_level_counts": f"{_STATE} SELECT doc_id, level, term_id, n FROM dlc",
    "level_new_topic_loglik": f"{_STATE},{_NEW} SELECT doc_id, level, n, round(loglik, 5) AS loglik FROM fresh",
    "node_word_loglik": f"{_STATE},{_OWN} SELECT doc_id, node_id, round(loglik, 5) AS loglik FROM own",
    "path_weights": f"{_STATE},{_WEIGHTS} SELECT doc_id, node_id, round(w, 3) AS log_weight FROM weight",
    "path_posterior": f"""{_STATE},{_WEIGHTS}, e AS (
          SELECT doc_id, node_id, exp(w - max(w) OVER (PARTITION BY doc_id)) AS e FROM weight)
        SELECT doc_id, node_id, round(e / sum(e) OVER (PARTITION BY doc_id), 6) AS prob FROM e""",
    "path_posterior_likely": f"""{_STATE},{_WEIGHTS}, e AS (
          SELECT doc_id, node_id, exp(w - max(w) OVER (PARTITION BY doc_id)) AS e FROM weight),
        p AS (SELECT doc_id, node_id, e / sum(e) OVER (PARTITION BY doc_id) AS prob FROM e)
        SELECT doc_id, CASE WHEN prob >= 0.01 THEN node_id ELSE -1 END::INTEGER AS node_id, round(sum(prob), 6) AS prob
        FROM p GROUP BY ALL""",
    "tree_doc_distribution": f"{_STATE},{_DIST} SELECT doc_id, level, node_id, round(share, 9) AS share FROM dist",
    "tree_train_distribution": f"""{_STATE},{_DIST}
        SELECT doc_id, 'doc' || doc_id || ',' || string_agg(
                 'nodeID:' || node_id || ',' || round(share * 1e6)::BIGINT || ',', '' ORDER BY level) AS value
        FROM dist GROUP BY doc_id""",
    "tree_report": f"""{_STATE}, ranked AS (
          SELECT node_id, term, row_number() OVER (PARTITION BY node_id ORDER BY n DESC, term) AS rank
          FROM tterm JOIN vocab USING (term_id)),
        words AS (SELECT node_id, string_agg(term, ' ' ORDER BY rank) AS w FROM ranked WHERE rank <= {N_WORDS} GROUP BY node_id)
        SELECT CASE n0.level WHEN 0 THEN '' WHEN 1 THEN lpad(n1.node_id::VARCHAR, 10, '0') || '/'
               ELSE lpad(n1.parent_id::VARCHAR, 10, '0') || '/' || lpad(n1.node_id::VARCHAR, 10, '0') || '/' END
               || lpad(n0.node_id::VARCHAR, 10, '0') AS path_key,
               n0.level, n0.node_id, n0.total_tokens, n0.customers, coalesce(w, '') AS top_words
        FROM node n0 LEFT JOIN node n1 ON n1.node_id = n0.parent_id LEFT JOIN words ON words.node_id = n0.node_id""",
    "tree_log_lik": f"""{_STATE}, lens AS (SELECT doc_id, count(*) AS n FROM lab GROUP BY doc_id),
        dl AS (SELECT doc_id, level, count(*) AS n FROM lab GROUP BY doc_id, level)
        SELECT round((SELECT sum({sql.rising(E, 'n::DOUBLE')}) FROM tterm)
               - (SELECT sum({sql.rising(f'({E} * {V})', 'total_tokens::DOUBLE')}) FROM node WHERE total_tokens > 0)
               + (SELECT sum(ln({G}) + {sql.lgamma('customers::DOUBLE')}) FROM node WHERE level > 0)
               - (SELECT sum({sql.rising(G, 'customers::DOUBLE')}) FROM node WHERE level < {PARAMS.n_levels - 1})
               + (SELECT sum({sql.rising(A, 'n::DOUBLE')}) FROM dl)
               - (SELECT sum({sql.rising(f'({A} * {PARAMS.n_levels})', 'n::DOUBLE')}) FROM lens), 2) AS log_lik""",
    "tree_infer_sums": f"SELECT doc_id, 1.0::DOUBLE AS total FROM documents WHERE {text.fold('doc_id')} = 0",
    "tree_fit_seats": f"""
        SELECT level, (SELECT count(*) FROM documents) AS customers, 0::BIGINT AS odd
        FROM (SELECT unnest(range({PARAMS.n_levels}))::INTEGER AS level)""",
    "tree_fit_tokens": f"""WITH {sql.tokens(ALNUM_DASH)},{sql.vocabulary()}
        SELECT term_id, count(*) AS n FROM tok JOIN vocab USING (term) GROUP BY term_id""",
}
ORACLES["tree_stored_terms"] = ORACLES["tree_terms"]
