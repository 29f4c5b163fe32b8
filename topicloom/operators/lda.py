"""Latent Dirichlet allocation by variational Bayes, batch and online.

The model is a table ``(term_id, w array<double>)``: one weight per topic and term.
Documents are packed counts (``BagOfWords``).  The E-step runs per document inside
``mapInArrow``; merging, M-steps and the model part of the bound are aggregates.
"""

from __future__ import annotations

import math
from collections.abc import Iterator, Sequence
from dataclasses import dataclass, replace

import numpy as np
import pyarrow as pa
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from topicloom.functions.draws import hash_gamma_100
from topicloom.functions.numeric import digamma, lgamma, np_digamma, np_dirichlet_expectation, np_lgamma
from topicloom.operators.arrow import TermColumns, TermVectors, dense_rows, ragged, spans, sum_vectors, to_ragged, to_rows
from topicloom.operators.counts import BagOfWords, assign_batches
from topicloom.session import RollingTables, discard, fits_broadcast, fresh_path, hold, lookup_join, parallelism, with_row_index

TINY = 1e-100


class NotFittedError(PySparkException, ValueError, AttributeError):
    """The model has no components yet."""


@dataclass(frozen=True)
class LdaParams:
    n_topics: int = 10
    alpha: float = 0.1
    eta: float = 0.1
    kappa: float = 0.7
    tau: float = 1000.0
    batch_size: int = 128
    n_docs: float = 1e6
    normalize_doc: bool = True
    prex_tol: float = 1e-1
    mean_change_tol: float = 1e-3
    max_gamma_update_iter: int = 100
    seed: int = 0


# ---------------------------------------------------------------- model tables


def init_components(spark: SparkSession, n_terms: int, params: LdaParams) -> DataFrame:
    """Starting weights ~ Gamma(100, 1/100), a function of (seed, topic, term)."""
    topics = F.sequence(F.lit(0), F.lit(params.n_topics - 1))
    return spark.range(n_terms).select(
        F.col("id").cast("int").alias("term_id"),
        F.transform(
            topics, lambda k: hash_gamma_100(params.seed, "lda-init", k, F.col("id"))
        ).alias("w"),
    )


@dataclass(frozen=True)
class ModelSummary:
    """Per-topic totals and the model part of the bound."""

    totals: tuple[float, ...]
    score: float


def summarise_model(components: DataFrame, n_terms: int, params: LdaParams) -> ModelSummary:
    """One aggregate over the model table.

    E[log p(beta | eta)] - E[log q(beta | w)] is a sum over cells that needs no
    topic total, plus terms in the totals alone.
    """
    k, eta = params.n_topics, params.eta
    v = F.col("v")
    rows = (
        components.select(F.posexplode("w").alias("k", "v"))
        .groupBy("k")
        .agg(F.sum("v").alias("total"), F.sum((F.lit(eta) - v) * digamma(v) + lgamma(v)).alias("cells"))
        .orderBy("k")
        .collect()
    )
    totals = np.array([r["total"] for r in rows])
    score = sum(r["cells"] for r in rows) - k * n_terms * float(np_lgamma(np.array([eta]))[0])
    score -= float((np_digamma(totals) * (eta * n_terms - totals)).sum())
    score += k * float(np_lgamma(np.array([eta * n_terms]))[0]) - float(np_lgamma(totals).sum())
    return ModelSummary(tuple(totals), score)


def log_weights(components: DataFrame, totals: Sequence[float]) -> DataFrame:
    """Expected log topic-term probability, digamma(w) - digamma(sum w)."""
    shift = F.array(*[F.lit(float(v)) for v in np_digamma(np.asarray(totals))])
    return components.select(
        "term_id", F.transform("w", lambda x, k: digamma(x) - F.get(shift, k)).alias("w")
    )


def components_long(components: DataFrame) -> DataFrame:
    """(topic_id, term_id, weight) rows."""
    return components.select("term_id", F.posexplode("w").alias("topic_id", "weight")).select(
        "topic_id", "term_id", "weight"
    )


def dirichlet_expectation(rows: DataFrame, key: str, weight: str, out: str = "elog") -> DataFrame:
    """Long-form expectation: digamma(weight) - digamma(sum of the key's weights).

    The key's total comes from a separate, map-side combined aggregate, so a key
    with very many rows is never gathered into one window frame; totals are broadcast
    if they fit, else a key's rows spread over salts.
    """
    totals = hold(rows.groupBy(key).agg(F.sum(weight).alias("_total")))
    joined = lookup_join(rows, totals, [key], "inner", 64.0 * totals.count(), [weight])
    return joined.withColumn(out, digamma(F.col(weight)) - digamma(F.col("_total"))).drop("_total")


# ------------------------------------------------------------------ the E-step


def length_groups(lengths: np.ndarray) -> Iterator[np.ndarray]:
    """Non-empty documents in groups of similar length (padding stays near a quarter)."""
    order = np.argsort(lengths, kind="stable")
    order = order[lengths[order] > 0]
    start = 0
    while start < len(order):
        limit = lengths[order[start]] * 1.25 + 4
        stop = int(np.searchsorted(lengths[order], limit, side="right"))
        yield order[start:stop]
        start = stop


def iterate_gamma(block, cnts, alpha, max_iter, tol):
    """Gamma of equally wide documents: ``block`` [docs, width, topics] holds
    exp(E[log beta]), ``cnts`` [docs, width] the counts, both padded with zeros.

    Documents that meet ``tol`` are frozen; the block shrinks when a quarter of it is.
    """
    gamma = np.ones((len(cnts), block.shape[2]))
    live = np.arange(len(cnts))
    theta = np.exp(np_dirichlet_expectation(gamma))
    frozen = np.zeros(len(live), dtype=bool)
    for _ in range(max_iter):
        norm = np.matmul(block, theta[:, :, None])[:, :, 0] + TINY
        fresh = alpha + theta * np.matmul((cnts / norm)[:, None, :], block)[:, 0, :]
        change = np.abs(fresh - gamma[live]).mean(axis=1)
        moving = ~frozen
        gamma[live[moving]] = fresh[moving]
        frozen |= change < tol
        if frozen.all():
            break
        if frozen.mean() > 0.25:
            kept = ~frozen
            live, block, cnts = live[kept], block[kept], cnts[kept]
            frozen = np.zeros(len(live), dtype=bool)
        theta = np.exp(np_dirichlet_expectation(gamma[live]))
    return gamma


def estep_kernel(offsets, cnts, cols, alpha, max_iter, tol):
    """Gamma of a run of documents and each token row's share of the statistics."""
    n, k = len(offsets) - 1, cols.shape[1]
    lengths = np.diff(offsets)
    gamma = np.full((n, k), alpha)
    for docs in length_groups(lengths):
        place = np.arange(lengths[docs[-1]])
        inside = place < lengths[docs][:, None]
        at = np.where(inside, offsets[docs][:, None] + place, 0)
        block = cols[at]
        block[~inside] = 0.0
        gamma[docs] = iterate_gamma(block, np.where(inside, cnts[at], 0.0), alpha, max_iter, tol)
    doc_of = np.repeat(np.arange(n), lengths)
    stat = np.exp(np_dirichlet_expectation(gamma))[doc_of] * cols
    stat *= (cnts / (stat.sum(axis=1) + TINY))[:, None]
    return gamma, stat


ESTEP_SCHEMA = (
    "doc_id long, gamma array<double>, ids array<int>, cnts array<double>, term_id int, stat array<double>"
)


def _estep_batches(columns: TermColumns, alpha, max_iter, tol, want_stats):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["doc_id", "gamma", "ids", "cnts", "term_id", "stat"]
        total, seen = None, None
        for batch in batches:
            offsets, ids = ragged(batch.column("ids"))
            _, cnts = ragged(batch.column("cnts"))
            doc_ids = batch.column("doc_id").to_numpy()
            vectors = columns.of(ids)
            for a, b in spans(offsets, columns.width, 4_000_000):
                lo, hi = offsets[a], offsets[b]
                block = np.exp(vectors(lo, hi))
                gamma, stat = estep_kernel(offsets[a : b + 1] - lo, cnts[lo:hi], block, alpha, max_iter, tol)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(doc_ids[a:b], pa.int64()),
                        to_rows(gamma),
                        to_ragged(offsets[a : b + 1] - lo, ids[lo:hi], pa.int32()) if want_stats else pa.nulls(b - a, pa.list_(pa.int32())),
                        to_ragged(offsets[a : b + 1] - lo, cnts[lo:hi], pa.float64()) if want_stats else pa.nulls(b - a, pa.list_(pa.float64())),
                        pa.nulls(b - a, pa.int32()),
                        pa.nulls(b - a, pa.list_(pa.float64())),
                    ],
                    names=names,
                )
                if not want_stats or hi == lo:
                    continue
                order = np.argsort(ids[lo:hi], kind="stable")
                terms, first = np.unique(ids[lo:hi][order], return_index=True)
                part = np.add.reduceat(stat[order], first, axis=0)
                if total is None:
                    total = np.zeros((columns.size, columns.width))
                    seen = np.zeros(len(total), dtype=bool)
                at = columns.rows(terms)
                total[at] += part
                seen[at] = True
        if total is not None:
            rows = np.flatnonzero(seen)
            for i in range(0, len(rows), 10_000):
                at = rows[i : i + 10_000]
                yield _stat_rows(names, columns.terms(at), total[at])

    return run


def _stat_rows(names, terms, part) -> pa.RecordBatch:
    n = len(terms)
    return pa.RecordBatch.from_arrays(
        [
            pa.nulls(n, pa.int64()),
            pa.nulls(n, pa.list_(pa.float64())),
            pa.nulls(n, pa.list_(pa.int32())),
            pa.nulls(n, pa.list_(pa.float64())),
            pa.array(terms, pa.int32()),
            to_rows(part),
        ],
        names=names,
    )


#: Tasks of an E-step with statistics, per core.
STAT_TASKS = 4


def few_tasks(docs: DataFrame) -> DataFrame:
    """The documents in a few partitions per core at most.

    Every task hands on one sum per term, so their number, and not that of the corpus's splits,
    decides how much of the statistics is shuffled.
    """
    most = STAT_TASKS * parallelism(docs.sparkSession)
    return docs.coalesce(most) if docs.rdd.getNumPartitions() > most else docs


def estep(bow: BagOfWords, logs: TermVectors, params: LdaParams, want_stats: bool = True) -> DataFrame:
    """Document posteriors (rows with ``doc_id``) and partial statistics (rows with ``term_id``).

    With statistics, document rows also carry their counts, so that the bound needs no join.
    """
    settings = params.alpha, params.max_gamma_update_iter, params.mean_change_tol, want_stats
    docs = few_tasks(bow.df) if want_stats else bow.df
    return logs.run(docs, "ids", lambda columns: _estep_batches(columns, *settings), ESTEP_SCHEMA)


def posteriors(estep_rows: DataFrame) -> DataFrame:
    return estep_rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "gamma")


def judged_documents(estep_rows: DataFrame) -> DataFrame:
    """(doc_id, ids, cnts, gamma) of E-step rows that were made with statistics."""
    return estep_rows.filter(F.col("doc_id").isNotNull()).select("doc_id", "ids", "cnts", "gamma")


def sufficient_stats(estep_rows: DataFrame, n_topics: int) -> DataFrame:
    """Sum of the partial statistics: (term_id, stat)."""
    return sum_vectors(
        estep_rows.filter(F.col("term_id").isNotNull()).select("term_id", "stat"), "term_id", "stat", n_topics
    )


def batch_stats(bow: BagOfWords, logs: TermVectors, params: LdaParams) -> DataFrame:
    """(term_id, stat): the statistics of a mini-batch as one partial sum per task and term, without its documents."""
    settings = params.alpha, params.max_gamma_update_iter, params.mean_change_tol, True

    def kernel(columns):
        estep_rows = _estep_batches(columns, *settings)
        return lambda batches: (b.select(["term_id", "stat"]) for b in estep_rows(batches) if not b.column("term_id").null_count)

    return logs.run(bow.df, "ids", kernel, "term_id int, stat array<double>")


def estep_once(doc_terms: DataFrame, beta: TermVectors, theta: DataFrame, alpha: float) -> DataFrame:
    """One E-step pass as joins: (doc_id, gamma array<double>).

    ``doc_terms(doc_id, term_id, cnt)``, ``beta`` with w = exp(E[log beta]) and
    ``theta(doc_id, t array<double>)`` in the same form.  Topics stay packed, so the
    pass has one row per count and one map-side combined sum per document.
    """
    k = beta.columns.width
    cells = lookup_join(
        doc_terms, beta.df.select("term_id", "w"), ["term_id"], "inner", beta.n_bytes, ["doc_id"]
    ).join(theta, "doc_id")
    dot = F.aggregate(F.zip_with("t", "w", lambda t, w: t * w), F.lit(0.0), lambda acc, x: acc + x)
    shares = cells.withColumn("_r", F.col("cnt") / (dot + F.lit(TINY))).select(
        "doc_id", F.transform("w", lambda w: w * F.col("_r")).alias("mass")
    )
    return theta.join(sum_vectors(shares, "doc_id", "mass", k), "doc_id", "left").select(
        "doc_id",
        F.transform(
            "t", lambda t, i: F.lit(alpha) + t * F.coalesce(F.get("mass", i), F.lit(0.0))
        ).alias("gamma"),
    )


# ------------------------------------------------------------------ the M-step


def mstep_batch(components: DataFrame, stats: DataFrame, eta: float) -> DataFrame:
    """w = eta + stat for every term of the model."""
    return components.join(stats, "term_id", "left").select(
        "term_id",
        F.transform(
            "w", lambda _, k: F.lit(eta) + F.coalesce(F.get("stat", k), F.lit(0.0))
        ).alias("w"),
    )


def mstep_online(
    components: DataFrame, stats: DataFrame, params: LdaParams, n_iter: int, batch_docs: int
) -> DataFrame:
    """w = (1 - rho) w + rho (eta + D / batch * stat), rho = (tau + t) ^ -kappa."""
    rho = math.pow(params.tau + n_iter, -params.kappa)
    ratio = float(params.n_docs) / batch_docs
    return components.join(stats, "term_id", "left").select(
        "term_id",
        F.transform(
            "w",
            lambda x, k: x * F.lit(1.0 - rho)
            + F.lit(rho) * (F.lit(params.eta) + F.lit(ratio) * F.coalesce(F.get("stat", k), F.lit(0.0))),
        ).alias("w"),
    )


# --------------------------------------------------------- bound and perplexity


def _bound_batches(columns: TermColumns, alpha):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            offsets, ids = ragged(batch.column("ids"))
            _, cnts = ragged(batch.column("cnts"))
            k = columns.width
            gamma = batch.column("gamma").flatten().to_numpy().reshape(-1, k)
            log_theta = np_dirichlet_expectation(gamma)
            score = float(((alpha - gamma) * log_theta).sum() + np_lgamma(gamma).sum())
            score -= float(np_lgamma(gamma.sum(axis=1)).sum())
            score += len(gamma) * float(np_lgamma(np.array([alpha * k]))[0] - k * np_lgamma(np.array([alpha]))[0])
            vectors = columns.of(ids)
            for a, b in spans(offsets, k):
                lo, hi = offsets[a], offsets[b]
                cell = vectors(lo, hi) + log_theta[np.repeat(np.arange(a, b), np.diff(offsets[a : b + 1]))]
                top = cell.max(axis=1) if hi > lo else np.empty(0)
                logs = np.log(np.exp(cell - top[:, None]).sum(axis=1)) + top
                score += float((cnts[lo:hi] * logs).sum())
            yield pa.RecordBatch.from_arrays(
                [pa.array([score]), pa.array([float(cnts.sum())]), pa.array([len(gamma)], pa.int64())],
                names=["score", "words", "docs"],
            )

    return run


@dataclass(frozen=True)
class Bound:
    """Variational bound split in its document and model parts."""

    docs: float
    model: float
    words: float
    n_docs: int

    def total(self, doc_ratio: float = 1.0) -> float:
        return self.docs * doc_ratio + self.model


def approx_bound(docs: DataFrame, model_score: float, logs: TermVectors, alpha: float) -> Bound:
    """Bound of ``docs(doc_id, ids, cnts, gamma)``; the weights gamma must not be normalised."""
    kept = docs.select("doc_id", "ids", "cnts", "gamma")
    parts = logs.run(kept, "ids", lambda columns: _bound_batches(columns, alpha), "score double, words double, docs long")
    row = parts.agg(F.sum("score"), F.sum("words"), F.sum("docs")).first()
    return Bound(float(row[0] or 0.0), model_score, float(row[1] or 0.0), int(row[2] or 0))


# ------------------------------------------------------------------- reporting


def top_words(components: DataFrame, vocab: DataFrame, n: int) -> DataFrame:
    """(topic_id, rank, term, weight): the n heaviest terms, ties by term."""
    named = components_long(components).join(vocab.select("term_id", "term"), "term_id")
    order = Window.partitionBy("topic_id").orderBy(F.desc("weight"), "term")
    return (
        named.withColumn("rank", F.row_number().over(order))
        .filter(F.col("rank") <= n)
        .select("topic_id", "rank", "term", "weight")
    )


# ------------------------------------------------------------------- the model


class OnlineLda:
    """LDA whose state is a components table, an iteration counter and parameters."""

    def __init__(self, params: LdaParams = LdaParams(), **changes):
        self.params = replace(params, **changes)
        self.components: DataFrame | None = None
        self.n_terms: int | None = None
        self.n_iter = 1
        self._tables = RollingTables("components")
        self.trace: list[tuple[int, float]] = []
        self._summary: ModelSummary | None = None
        self._logs: TermVectors | None = None

    # Training -------------------------------------------------------------

    def _set(self, components: DataFrame) -> None:
        """Adopt a new components table; views of the old one are released."""
        if self._logs is not None:
            self._logs.release()
        self.components = self._tables.add(components)
        self._summary = self._logs = None

    def _start(self, bow: BagOfWords) -> None:
        self.n_iter = 1
        self.n_terms = bow.n_terms
        self._set(init_components(bow.df.sparkSession, bow.n_terms, self.params))

    def _check(self, bow: BagOfWords) -> None:
        if self.components is None:
            raise NotFittedError("the model has no components; fit it first")
        if bow.n_terms != self.n_terms:
            raise ValueError(f"vocabulary size {bow.n_terms} does not match the model's {self.n_terms}")

    @property
    def summary(self) -> ModelSummary:
        if self._summary is None:
            self._summary = summarise_model(self.components, self.n_terms, self.params)
        return self._summary

    @property
    def logs(self) -> TermVectors:
        """E[log beta] per term, prepared once per state of the model."""
        if self._logs is None:
            table = log_weights(self.components, self.summary.totals)
            self._logs = TermVectors.of(table, self.n_terms, self.params.n_topics)
        return self._logs

    def em_step(self, bow: BagOfWords, batch_docs: int | None = None) -> DataFrame:
        """One EM step; returns the held E-step rows.  ``batch_docs`` asks for the online update."""
        rows = hold(estep(bow, self.logs, self.params))
        stats = sufficient_stats(rows, self.params.n_topics)
        if batch_docs is None:
            fresh = mstep_batch(self.components, stats, self.params.eta)
        else:
            fresh = mstep_online(self.components, stats, self.params, self.n_iter, batch_docs)
        self._set(fresh)
        self.n_iter += 1
        return rows

    def fit(self, bow: BagOfWords, max_iters: int = 10) -> "OnlineLda":
        """Batch training from a fresh start; stops when perplexity settles.

        As each step is judged right after its M-step, the perplexity combines the
        step's document posteriors with the updated components.
        """
        self._start(bow)
        self.trace = []
        held = bow.df.is_cached
        docs = bow if held else BagOfWords(hold(bow.df), bow.n_terms)
        last = None
        for i in range(max_iters):
            rows = self.em_step(docs)
            perplexity = self._perplexity(judged_documents(rows))
            rows.unpersist()
            self.trace.append((i, perplexity))
            if last is not None and perplexity is not None and abs(last - perplexity) < self.params.prex_tol:
                break
            last = perplexity
        if not held:
            docs.df.unpersist()
        return self

    def partial_fit(self, bow: BagOfWords) -> "OnlineLda":
        """Online training over contiguous mini-batches, going on from the current model."""
        if self.components is None:
            self._start(bow)
        self._check(bow)
        if fits_broadcast(bow.df.sparkSession, 8.0 * self.n_terms * self.params.n_topics):
            return self._dense_steps(bow)
        for batch, size in mini_batches(bow, self.params.batch_size):
            self.em_step(batch, size).unpersist()
        return self

    def _dense_steps(self, bow: BagOfWords) -> "OnlineLda":
        """Online steps of a model within the broadcast limit: one job a step, which sums the statistics of its mini-batch.

        The model is on the driver to be broadcast anyway, so its update is made there; its table is written after the
        last step.  Where the sums of a mini-batch's few tasks are within the limit together, they are added up there too.
        """
        p, spark = self.params, bow.df.sparkSession
        weights, started = dense_rows(self.components, "w", self.n_terms, p.n_topics), self.n_iter
        small = fits_broadcast(spark, 2.0 * weights.nbytes * parallelism(spark))
        for batch, size in mini_batches(bow, p.batch_size):
            logs = TermVectors.of_matrix(spark, np_digamma(weights) - np_digamma(weights.sum(axis=0)))
            if small and batch is not bow:
                stats = batch_stats(batch, logs, p)
            else:
                stats = sufficient_stats(estep(batch, logs, p), p.n_topics)
            found = dense_rows(stats, "stat", self.n_terms, p.n_topics)
            logs.columns.table.destroy()
            rho, ratio = math.pow(p.tau + self.n_iter, -p.kappa), float(p.n_docs) / size
            weights = weights * (1.0 - rho) + rho * (p.eta + ratio * found)
            self.n_iter += 1
        if self.n_iter > started:
            rows = pa.Table.from_arrays([pa.array(np.arange(self.n_terms), pa.int32()), to_rows(weights)], ["term_id", "w"])
            self._set(spark.createDataFrame(rows, "term_id int, w array<double>"))
        return self

    def fit_transform(self, bow: BagOfWords, max_iters: int = 10) -> DataFrame:
        return self.fit(bow, max_iters).transform(bow)

    # Scoring --------------------------------------------------------------

    def posterior(self, bow: BagOfWords) -> DataFrame:
        """(doc_id, gamma): unnormalised document weights under the fixed model."""
        self._check(bow)
        return posteriors(estep(bow, self.logs, self.params, want_stats=False))

    def transform(self, bow: BagOfWords) -> DataFrame:
        """(doc_id, theta): document-topic weights, shares unless ``normalize_doc`` is off."""
        gamma = self.posterior(bow)
        if not self.params.normalize_doc:
            return gamma.withColumnRenamed("gamma", "theta")
        total = F.aggregate("gamma", F.lit(0.0), lambda acc, x: acc + x)
        return gamma.withColumn("total", total).select(
            "doc_id", F.transform("gamma", lambda x: x / F.col("total")).alias("theta")
        )

    def bound(self, bow: BagOfWords, gamma: DataFrame, sub_sampling: bool = False) -> float:
        self._check(bow)
        parts = approx_bound(bow.df.join(gamma, "doc_id"), self.summary.score, self.logs, self.params.alpha)
        ratio = self.params.n_docs / parts.n_docs if sub_sampling and parts.n_docs else 1.0
        return parts.total(ratio)

    def perplexity(self, bow: BagOfWords, gamma: DataFrame, sub_sampling: bool = False) -> float | None:
        """exp(-bound / words); ``None`` for a corpus without words."""
        self._check(bow)
        return self._perplexity(bow.df.join(gamma, "doc_id"), sub_sampling)

    def _perplexity(self, docs: DataFrame, sub_sampling: bool = False) -> float | None:
        parts = approx_bound(docs, self.summary.score, self.logs, self.params.alpha)
        if not parts.words:
            return None
        ratio = self.params.n_docs / parts.n_docs if sub_sampling else 1.0
        return math.exp(-parts.total(ratio) / (parts.words * ratio))

    # Reports --------------------------------------------------------------

    def top_words(self, vocab: DataFrame, n: int = 15) -> DataFrame:
        if self.components is None:
            raise NotFittedError("the model has no components; fit it first")
        return top_words(self.components, vocab, n)

    def trace_table(self, spark: SparkSession) -> DataFrame:
        """(iteration, perplexity) of the last batch fit: one row per EM step."""
        return spark.createDataFrame(self.trace, "iteration int, perplexity double")


#: Mini-batches that share files, and the size of the files' row groups.
GROUP = 64
ROW_GROUP_BYTES = 1 << 20


def mini_batches(bow: BagOfWords, batch_size: int) -> Iterator[tuple[BagOfWords, int]]:
    """Contiguous mini-batches in id order, with their sizes.

    The corpus is numbered and written once, into files that each hold a slice of ``GROUP`` batches, sorted by
    batch in small row groups, in a folder per ``GROUP`` batches: a step opens the files of its own folder only and reads
    the row groups of its own batch, over as many tasks as there are slices.
    The files are deleted when the last batch is done.
    """
    spark = bow.df.sparkSession
    n_docs = bow.df.count()
    if n_docs <= batch_size:
        if n_docs:
            yield bow, n_docs
        return
    n_batches = -(-n_docs // batch_size)
    slices = max(1, min(parallelism(spark), batch_size // 64))
    placed = with_row_index(bow.df.select("doc_id", "ids", "cnts"), ["doc_id"], "_row")
    tagged = placed.withColumn("batch_id", F.expr(f"_row div {batch_size}")).drop("_row")
    tagged = tagged.withColumn("batches", F.expr(f"batch_id div {GROUP}"))
    path = fresh_path(spark, "batches")
    spread = tagged.repartition(slices * -(-n_batches // GROUP), "batches", F.pmod(F.xxhash64("doc_id"), F.lit(slices)))
    spread = spread.sortWithinPartitions("batches", "batch_id")
    spread.write.partitionBy("batches").option("parquet.block.size", ROW_GROUP_BYTES).parquet(path)
    table = spark.read.schema("doc_id long, ids array<int>, cnts array<double>, batch_id long, batches long").parquet(path)
    for b in range(n_batches):
        size = batch_size if b < n_batches - 1 else n_docs - batch_size * (n_batches - 1)
        part = table.filter((F.col("batches") == b // GROUP) & (F.col("batch_id") == b)).drop("batch_id", "batches")
        yield BagOfWords(part, bow.n_terms), size
    discard(spark, path)
