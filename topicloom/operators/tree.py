"""Topic trees under a nested Chinese restaurant process.

A tree is two tables, ``nodes(node_id, parent_id, level, customers, total_tokens)``
and ``terms(node_id, term_id, n)``; the root is at level 0 and all leaves are at the
last level.  A document sits on one root-to-leaf path and each of its tokens on a
level of that path.  Priors, likelihoods and reports are joins and aggregates; the
per-document sampler (``tree_sampler``) runs in ``mapInArrow`` and serves scoring (the
tree stays as it is) and training (each document first takes its own counts out).
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.functions.draws import hash_uniform
from topicloom.functions.numeric import lgamma
from topicloom.operators.counts import Sequences
from topicloom.operators.gibbs import StopRule, rising
from topicloom.operators.tokens import unnest
from topicloom.operators.tree_sampler import NODE_BYTES, TOKENS_AT_ONCE, Blocks, SamplePlan, cut_tree, likely_nodes, sample, word_gains
from topicloom.session import RollingTables, cut_lineage, drop_shuffles, fits_broadcast, hold, in_batches, lookup_join, parallelism, with_row_index

NODE_ROW_BYTES = 64
#: Nodes that a document row is paired with at a time where the node table is joined.
NODES_A_BLOCK = 1000
#: With as many steps documents are dealt out anew for them.
STEPS_OF_BLOCKS = 10


@dataclass(frozen=True)
class TreeParams:
    """``path_likelihood='path'`` adds the ancestors' words to a node's weight and the
    new-branch factor to inner nodes only; ``'node'`` uses the node's own words and the
    factor everywhere."""

    alpha: float = 10.0
    gamma: float = 1.0
    eta: float = 0.1
    n_levels: int = 3
    path_likelihood: str = "path"
    seed: int = 0
    start_branches: int = 4
    checkpoint_every: int = 10


@dataclass(frozen=True)
class TopicTree:
    nodes: DataFrame
    terms: DataFrame
    n_terms: int
    params: TreeParams


# ---------------------------------------------------------- building the tables


def tree_tables(state: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Node and term tables of ``state(doc_id, term_ids, levels, path)``.

    ``path`` lists node ids from the root down; all counts combine in the map tasks.
    """
    visits = unnest(state, ["path"], "path", "node_id", "level").select(
        "node_id", "level", F.when(F.col("level") > 0, F.get("path", F.col("level") - 1)).alias("parent_id")
    )
    customers = visits.groupBy("node_id", "parent_id", "level").agg(F.count("*").alias("customers"))
    terms = (
        unnest(state, ["path"], F.arrays_zip("term_ids", "levels"), "e")
        .groupBy(F.get("path", F.col("e.levels")).alias("node_id"), F.col("e.term_ids").alias("term_id"))
        .agg(F.count("*").alias("n"))
    )
    totals = terms.groupBy("node_id").agg(F.sum("n").alias("total_tokens"))
    nodes = customers.join(totals, "node_id", "left").select(
        "node_id", "parent_id", "level", "customers", F.coalesce("total_tokens", F.lit(0)).alias("total_tokens")
    )
    return nodes, terms


def random_levels(seqs: DataFrame, n_levels: int, seed: int) -> DataFrame:
    """Add ``levels``: a uniform level for each token."""
    return seqs.withColumn(
        "levels",
        F.transform(
            "term_ids",
            lambda _, i: F.floor(hash_uniform(seed, "level", F.col("doc_id"), i) * n_levels).cast("int"),
        ),
    )


# -------------------------------------------------------- priors and likelihoods


def ancestors(nodes: DataFrame, n_levels: int) -> DataFrame:
    """(node_id, ancestor_id) including the node itself: one self-join per level."""
    step = nodes.select("node_id", F.col("node_id").alias("ancestor_id"), F.col("parent_id").alias("up"))
    parents = nodes.select(F.col("node_id").alias("up"), F.col("parent_id").alias("next_up"))
    steps = [step]
    for _ in range(n_levels - 1):
        step = step.join(parents, "up").select("node_id", F.col("up").alias("ancestor_id"), F.col("next_up").alias("up"))
        steps.append(step)
    return reduce(DataFrame.unionByName, [s.select("node_id", "ancestor_id") for s in steps])


def path_prior(nodes: DataFrame, params: TreeParams) -> DataFrame:
    """(node_id, level, log_prior): log probability of reaching each node, or of
    branching off below it."""
    gamma = F.lit(params.gamma)
    parents = nodes.select(F.col("node_id").alias("parent_id"), F.col("customers").alias("_seats"))
    steps = nodes.join(parents, "parent_id", "left").select(
        F.col("node_id").alias("ancestor_id"),
        F.coalesce(F.ln(F.col("customers") / (F.col("_seats") + gamma)), F.lit(0.0)).alias("step"),
    )
    reach = (
        ancestors(nodes, params.n_levels)
        .join(steps, "ancestor_id")
        .groupBy("node_id")
        .agg(F.sum("step").alias("reach"))
    )
    branch = F.ln(gamma / (F.col("customers") + gamma))
    if params.path_likelihood == "path":
        branch = F.when(F.col("level") < params.n_levels - 1, branch).otherwise(F.lit(0.0))
    return nodes.join(reach, "node_id").select(
        "node_id", "level", (F.col("reach") + branch).alias("log_prior")
    )


def doc_level_counts(state: DataFrame) -> DataFrame:
    """(doc_id, level, term_id, n): a document's word counts per level."""
    return (
        unnest(state, ["doc_id"], F.arrays_zip("term_ids", "levels"), "e")
        .groupBy("doc_id", F.col("e.levels").alias("level"), F.col("e.term_ids").alias("term_id"))
        .agg(F.count("*").alias("n"))
    )


def _rising(start: Column, count: Column) -> Column:
    """ln of start (start + 1) ... (start + count - 1)."""
    return lgamma(start + count) - lgamma(start)


def level_new_topic_loglik(counts: DataFrame, n_terms: int, eta: float) -> DataFrame:
    """(doc_id, level, n, words, loglik): log likelihood of a level's words under an empty topic.

    ``words`` is the part without the normaliser.
    """
    n = F.col("n").cast("double")
    parts = counts.withColumn("_w", _rising(F.lit(eta), n)).groupBy("doc_id", "level").agg(
        F.sum("_w").alias("words"), F.sum("n").alias("n")
    )
    return parts.select(
        "doc_id",
        "level",
        "n",
        "words",
        (F.col("words") - _rising(F.lit(eta * n_terms), n)).alias("loglik"),
    )


def node_word_loglik(tree: TopicTree, state: DataFrame, n_nodes: int, n_cells: int) -> DataFrame:
    """(doc_id, node_id, loglik): log likelihood of a document's words of a level under
    each node of that level; levels without words have no rows and count as zero.

    A word the node has never seen contributes what it would under an empty topic, so
    only words shared by document and node count, as corrections.
    """
    level = F.col("level")
    pairs = _pairs(tree, state, n_nodes, n_cells, False, tree.nodes.select("node_id", "level", F.col("total_tokens").cast("double").alias("total")))
    n = F.get("_n", level)
    loglik = F.get("_words", level) + F.col("_g") - _rising(F.col("total") + F.lit(tree.n_terms * tree.params.eta), n)
    return pairs.filter(n > 0).select("doc_id", "node_id", loglik.alias("loglik"))


def _pairs(tree: TopicTree, state: DataFrame, n_nodes: int, n_cells: int, along: bool, nodes: DataFrame) -> DataFrame:
    """Every document with every row of ``nodes(node_id, ...)``: the document's ``_n`` and ``_words`` by level, and in ``_g`` what
    words shared with the node add, with those of the nodes above it if ``along``."""
    blocks = max(1, -(-n_nodes // NODES_A_BLOCK))
    in_row = fits_broadcast(state.sparkSession, float(NODE_BYTES * n_nodes))
    if in_row:
        docs, slots = word_gains(tree, state, n_cells, along)
        nodes = nodes.join(slots, "node_id")
    else:
        docs = _level_arrays(state, tree)
    nodes = nodes.withColumn("_b", F.pmod("node_id", F.lit(blocks)))
    docs = docs.withColumn("_b", F.explode(F.sequence(F.lit(0), F.lit(blocks - 1)))) if blocks > 1 else docs.withColumn("_b", F.lit(0))
    pairs = lookup_join(docs, nodes, ["_b"], "inner", 2.0 * NODE_ROW_BYTES * n_nodes * tree.params.n_levels, ["doc_id"])
    if in_row:
        return pairs.withColumn("_g", F.get("_gain", F.col("slot")))
    gains = _shared_gains(tree, doc_level_counts(state), n_nodes, n_cells)
    if along:
        gains = lookup_join(
            gains.withColumnRenamed("node_id", "ancestor_id"), ancestors(tree.nodes, tree.params.n_levels), ["ancestor_id"], "inner",
            NODE_ROW_BYTES * n_nodes * tree.params.n_levels, ["doc_id"],
        ).groupBy("doc_id", "node_id").agg(F.sum("gain").alias("gain"))
    return pairs.join(gains, ["doc_id", "node_id"], "left").withColumn("_g", F.coalesce("gain", F.lit(0.0)))


def _shared_gains(tree: TopicTree, counts: DataFrame, n_nodes: int, n_cells: int) -> DataFrame:
    """(doc_id, node_id, gain): what words seen by a node add to the likelihood under an empty topic."""
    eta = F.lit(tree.params.eta)
    levels = tree.nodes.select("node_id", "level")
    by_term = lookup_join(
        tree.terms.withColumnRenamed("n", "m"), levels, ["node_id"], "inner", NODE_ROW_BYTES * n_nodes, ["term_id"]
    )
    n, m = F.col("n").cast("double"), F.col("m").cast("double")
    shared = lookup_join(counts, by_term, ["level", "term_id"], "inner", NODE_ROW_BYTES * n_cells, ["doc_id"])
    gains = shared.withColumn("_c", _rising(m + eta, n) - _rising(eta, n))
    return gains.groupBy("doc_id", "node_id").agg(F.sum("_c").alias("gain"))


def _level_arrays(state: DataFrame, tree: TopicTree) -> DataFrame:
    """(doc_id, _n, _words), one row per document: per level its tokens and their log likelihood
    under an empty topic, without the normaliser; 0 where it has none."""
    by_level = level_new_topic_loglik(doc_level_counts(state), tree.n_terms, tree.params.eta)
    packed = by_level.groupBy("doc_id").agg(
        F.map_from_entries(F.collect_list(F.struct("level", F.struct("n", "words")))).alias("_m")
    )
    places = F.sequence(F.lit(0), F.lit(tree.params.n_levels - 1))
    at = lambda field: F.transform(
        places, lambda i: F.coalesce(F.try_element_at("_m", i)[field].cast("double"), F.lit(0.0))
    )
    return state.select("doc_id").join(packed, "doc_id", "left").select(
        "doc_id", at("n").alias("_n"), at("words").alias("_words")
    )


def path_weights(tree: TopicTree, state: DataFrame, n_nodes: int, n_cells: int) -> DataFrame:
    """(doc_id, node_id, log_weight) for every document and node: prior plus words along the
    path plus new topics below.  Levels without words add nothing.

    What a document's words weigh under empty topics follows from its counts per level and
    the totals of a node's path; words that a node has seen come in as corrections.
    """
    p = tree.params
    v_eta = F.lit(p.eta * tree.n_terms)
    lines = ancestors(tree.nodes, p.n_levels)
    above = tree.nodes.select(F.col("node_id").alias("ancestor_id"), F.col("level").alias("_l"), "total_tokens")
    totals = lines.join(above, "ancestor_id").groupBy("node_id").agg(
        F.array_sort(F.collect_list(F.struct("_l", "total_tokens"))).alias("_path")
    )
    nodes = path_prior(tree.nodes, p).join(totals, "node_id")
    pairs = _pairs(tree, state, n_nodes, n_cells, p.path_likelihood == "path", nodes)
    weight = F.col("log_prior")
    for level in range(p.n_levels):
        n, words = F.get("_n", F.lit(level)), F.get("_words", F.lit(level))
        total = F.coalesce(F.get("_path.total_tokens", F.lit(level)).cast("double"), F.lit(0.0)) + v_eta
        on_path = F.col("level") >= level if p.path_likelihood == "path" else F.col("level") == level
        below = words - _rising(v_eta, n) if level else F.lit(0.0)
        own = F.when(on_path, words - _rising(total, n)).when(F.col("level") < level, below).otherwise(F.lit(0.0))
        weight = weight + own
    return pairs.select("doc_id", "node_id", (weight + F.col("_g")).alias("log_weight"))


def rows_together(tree: TopicTree, n_nodes: int) -> bool:
    """Whether a document's rows of ``path_weights`` follow one another in a partition: its nodes come by a broadcast."""
    spark = tree.nodes.sparkSession
    return fits_broadcast(spark, float(NODE_BYTES * n_nodes)) and fits_broadcast(spark, 2.0 * NODE_ROW_BYTES * n_nodes * tree.params.n_levels)


def path_posterior(weights: DataFrame, together: bool = False) -> DataFrame:
    """(doc_id, node_id, prob): softmax of the log weights of each document.

    ``together``: a document's rows follow one another in a partition, so the pairs are not shuffled.
    """
    if together:
        return in_batches(weights).mapInArrow(_softmax_batches, "doc_id long, node_id int, prob double")
    doc = Window.partitionBy("doc_id")
    shifted = weights.withColumn("_e", F.exp(F.col("log_weight") - F.max("log_weight").over(doc)))
    return shifted.select("doc_id", "node_id", (F.col("_e") / F.sum("_e").over(doc)).alias("prob"))


def _softmax_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Softmax over runs of a document's rows; the last run of a batch may go on in the next."""
    held: list[pa.RecordBatch] = []
    for batch in batches:
        ids = batch.column("doc_id").to_numpy()
        ends = np.flatnonzero(ids[1:] != ids[:-1]) + 1
        if held and len(ids) and held[-1].column("doc_id")[0].as_py() != ids[0]:
            yield _softmax(held)
            held = []
        if len(ends):
            yield _softmax([*held, batch.slice(0, ends[-1])])
            held, batch = [], batch.slice(ends[-1])
        if batch.num_rows:
            held.append(batch)
    if held:
        yield _softmax(held)


def _softmax(parts: list[pa.RecordBatch]) -> pa.RecordBatch:
    rows = pa.concat_batches(parts)
    ids, weights = rows.column("doc_id").to_numpy(), rows.column("log_weight").to_numpy()
    starts = np.concatenate([[0], np.flatnonzero(ids[1:] != ids[:-1]) + 1])
    times = np.diff(np.append(starts, len(ids)))
    mass = np.exp(weights - np.repeat(np.maximum.reduceat(weights, starts), times))
    prob = mass / np.repeat(np.add.reduceat(mass, starts), times)
    return pa.RecordBatch.from_arrays([rows.column("doc_id"), rows.column("node_id"), pa.array(prob)], ["doc_id", "node_id", "prob"])


def likely_paths(tree: TopicTree, state: DataFrame, least: float = 1e-3) -> DataFrame:
    """``path_posterior`` without all pairs: nodes of ``least`` or more, and one row without a node for the rest of a document."""
    return likely_nodes(tree, state, cut_tree(tree, lambda: ancestors(tree.nodes, tree.params.n_levels)), least)


def path_distribution(state: DataFrame, params: TreeParams) -> DataFrame:
    """(doc_id, level, node_id, share): (alpha + n_level) / sum, one row per path node."""
    n_levels, alpha = params.n_levels, F.lit(params.alpha)
    counts = F.transform(
        F.sequence(F.lit(0), F.lit(n_levels - 1)),
        lambda level: F.size(F.filter("levels", lambda x: x == level)),
    )
    rows = state.select("doc_id", "path", F.size("levels").alias("_n"), F.posexplode(counts).alias("level", "n"))
    return rows.select(
        "doc_id",
        "level",
        F.get("path", F.col("level")).alias("node_id"),
        ((alpha + F.col("n")) / (alpha * n_levels + F.col("_n"))).alias("share"),
    )


# -------------------------------------------------------------------- reports


def tree_report(tree: TopicTree, vocab: DataFrame, n_words: int = 25) -> DataFrame:
    """(path_key, level, node_id, total_tokens, customers, top_words).

    Sorting by ``path_key`` lists the tree in pre-order.
    """
    named = tree.terms.join(vocab.select("term_id", "term"), "term_id")
    order = Window.partitionBy("node_id").orderBy(F.desc("n"), "term")
    words = (
        named.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n_words)
        .groupBy("node_id")
        .agg(F.array_sort(F.collect_list(F.struct("rank", "term"))).alias("w"))
        .select("node_id", F.array_join("w.term", " ").alias("top_words"))
    )
    levels = tree.nodes.select(F.col("node_id").alias("ancestor_id"), F.col("level").alias("_l"))
    keys = (
        ancestors(tree.nodes, tree.params.n_levels)
        .join(levels, "ancestor_id")
        .groupBy("node_id")
        .agg(F.array_sort(F.collect_list(F.struct("_l", "ancestor_id"))).alias("p"))
        .select(
            "node_id",
            F.array_join(F.transform("p.ancestor_id", lambda x: F.lpad(x.cast("string"), 10, "0")), "/").alias("path_key"),
        )
    )
    return (
        tree.nodes.join(keys, "node_id")
        .join(words, "node_id", "left")
        .select(
            "path_key", "level", "node_id", "total_tokens", "customers",
            F.coalesce("top_words", F.lit("")).alias("top_words"),
        )
    )


# ----------------------------------------------------------------- the sampler


def in_blocks(docs: DataFrame, steps: int) -> DataFrame:
    """The documents in as few tasks as fill the cores and a kernel's room, if many steps are worth a shuffle: a step costs a
    task the same for few documents as for many."""
    if steps < STEPS_OF_BLOCKS:
        return docs
    n_tokens = docs.agg(F.sum(F.size("term_ids").cast("long"))).first()[0] or 0
    return docs.repartition(max(parallelism(docs.sparkSession), -(-n_tokens // TOKENS_AT_ONCE)), "doc_id")


def infer(tree: TopicTree, seqs: Sequences, iterations: int = 300, thinning: int = 0, burn_in: int = 0) -> DataFrame:
    """Place unseen documents in the tree, which stays unchanged.

    (doc_id, leaf_id, levels, path, nodes, shares): the last sample's path and levels and
    the path distribution of the kept samples.
    """
    if seqs.n_terms != tree.n_terms:
        raise ValueError(f"vocabulary size {seqs.n_terms} does not match the tree's {tree.n_terms}")
    p = tree.params
    # The first step draws a path from the levels alone, so any start will do.
    start = random_levels(in_blocks(seqs.df.select("doc_id", "term_ids"), iterations), p.n_levels, p.seed).withColumn(
        "path", F.array_repeat(F.lit(0), p.n_levels)
    )
    blocks = cut_tree(tree, lambda: ancestors(tree.nodes, p.n_levels))
    rows = sample(tree, start, SamplePlan(iterations, thinning, burn_in), blocks)
    return rows.select(
        "doc_id", F.get("path", F.lit(p.n_levels - 1)).alias("leaf_id"), "levels", "path", "nodes", "shares"
    )


def infer_distribution(inferred: DataFrame) -> DataFrame:
    """(doc_id, node_id, share) rows of :func:`infer`."""
    return unnest(inferred, ["doc_id"], F.arrays_zip("nodes", "shares"), "e").select(
        "doc_id", F.col("e.nodes").alias("node_id"), F.col("e.shares").alias("share")
    )


def start_state(seqs: Sequences, params: TreeParams) -> DataFrame:
    """Random levels and a random path in a full tree of ``start_branches`` per node."""
    b = params.start_branches
    firsts = [sum(b**i for i in range(level)) for level in range(params.n_levels)]
    draw = [
        F.floor(hash_uniform(params.seed, f"path-{level}", "doc_id") * b).cast("int")
        for level in range(1, params.n_levels)
    ]
    nodes, inside = [F.lit(0)], F.lit(0)
    for level, choice in enumerate(draw, start=1):
        inside = inside * b + choice
        nodes.append((F.lit(firsts[level]) + inside).cast("int"))
    return random_levels(seqs.df.select("doc_id", "term_ids"), params.n_levels, params.seed).withColumn(
        "path", F.array(*nodes)
    )


def _renumbered(state: DataFrame, n_levels: int) -> DataFrame:
    """The state with dense node ids, in the order of the codes that its paths hold."""
    codes = with_row_index(unnest(state, [], "path", "node_id").select("node_id").distinct(), ["node_id"], "new")
    n_bytes = float(NODE_ROW_BYTES * codes.count())
    for level in range(n_levels):
        table = codes.select(F.col("node_id").alias(f"_c{level}"), F.col("new").cast("int").alias(f"_n{level}"))
        coded = state.withColumn(f"_c{level}", F.get("path", F.lit(level)))
        state = lookup_join(coded, table, [f"_c{level}"], "inner", n_bytes, ["doc_id"])
    path = F.array(*[f"_n{level}" for level in range(n_levels)])
    return state.select("doc_id", "term_ids", "levels", path.alias("path"))


def joint_log_lik(tree: TopicTree, state: DataFrame) -> float:
    """ln p(words, levels, paths) of a labelled state, the nodes' word shares summed out.

    Words by node, levels by document, and the seating of documents at each inner node.
    """
    p = tree.params
    words = tree.terms.agg(F.sum(rising(F.lit(p.eta), F.col("n")))).first()[0] or 0.0
    seats = F.col("customers").cast("double")
    seated = F.when(F.col("level") > 0, F.lit(math.log(p.gamma)) + lgamma(seats)).otherwise(F.lit(0.0))
    split = F.when(F.col("level") < p.n_levels - 1, rising(F.lit(p.gamma), seats)).otherwise(F.lit(0.0))
    by_node = tree.nodes.agg(F.sum(seated - split - rising(F.lit(p.eta * tree.n_terms), F.col("total_tokens")))).first()[0] or 0.0
    counts = F.transform(F.sequence(F.lit(0), F.lit(p.n_levels - 1)), lambda level: F.size(F.filter("levels", lambda x: x == level)))
    own = F.aggregate(counts, F.lit(0.0), lambda total, n: total + rising(F.lit(p.alpha), n))
    by_doc = state.agg(F.sum(own - rising(F.lit(p.alpha * p.n_levels), F.size("levels")))).first()[0] or 0.0
    return words + by_node + by_doc


@dataclass(frozen=True)
class TreeFit:
    """``state(doc_id, term_ids, levels, path)`` after the sweeps, and the log likelihood before each of them."""

    tree: TopicTree
    state: DataFrame
    trace: list[float]


def fit_tree(seqs: Sequences, params: TreeParams, sweeps: int) -> tuple[TopicTree, DataFrame]:
    """``train_tree`` for a fixed number of sweeps, without looking at the likelihood."""
    fit = train_tree(seqs, params, sweeps, None)
    return fit.tree, fit.state


def train_tree(seqs: Sequences, params: TreeParams, max_sweeps: int = 3000, rule: StopRule | None = StopRule()) -> TreeFit:
    """Train a tree by snapshot sweeps until the rule finds the log likelihood level.

    In a sweep each document is resampled against the tree of the sweep's start without
    its own counts.  Documents that branch off below the same node in the same sweep
    share the new child.
    """
    trace: list[float] = []
    states = RollingTables("tree-state")
    state = states.add(start_state(seqs, params))
    for sweep in range(max_sweeps):
        nodes, terms = tree_tables(state)
        tree = TopicTree(hold(nodes), hold(terms), seqs.n_terms, params)
        if rule is not None:
            trace.append(joint_log_lik(tree, state))
            if rule.done(trace[1:]):
                tree.nodes.unpersist()
                tree.terms.unpersist()
                break
        blocks = cut_tree(tree, lambda tree=tree: ancestors(tree.nodes, params.n_levels))
        raw = sample(tree, state, SamplePlan(1, train=True, first=sweep), blocks).select("doc_id", "term_ids", "levels", "path")
        # Written, where a cache would take several times the input and keep the tree that was sent.
        raw = states.add(raw)
        tree.nodes.unpersist()
        tree.terms.unpersist()
        blocks.release()
        drop_shuffles(raw.sparkSession)
        state = _renumbered(raw, params.n_levels)
    state = states.add(state)
    nodes, terms = tree_tables(state)
    return TreeFit(TopicTree(cut_lineage(nodes), cut_lineage(terms), seqs.n_terms, params), state, trace)
