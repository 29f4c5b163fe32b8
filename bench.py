"""Headline timings: prints one JSON line.

BENCH_SF_DIR names the table folder, BENCH_CPUS the local cores.  Each figure is one
job from its inputs to a result on the driver; corpora and models a figure starts
from are built and held before its clock runs.
"""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.counts import BagOfWords, Sequences, bag_of_words, feature_sequences
from topicloom.operators.gibbs import GibbsModel, HdpParams
from topicloom.operators.lda import OnlineLda
from topicloom.operators.tokens import ALNUM_DASH, LETTERS_PUNCT, WORDS, drop_stopwords, tokenize
from topicloom.operators.tree import TreeParams, fit_tree, infer
from topicloom.operators.vocabulary import build_vocabulary
from topicloom.session import hold
from topicloom.sources.documents import read_documents

SF_DIR = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
LDA_TERMS, LDA_TOPICS = 20_000, 20


def session() -> SparkSession:
    return (
        SparkSession.builder.master(f"local[{CPUS}]")
        .appName("topicloom-bench")
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.shuffle.partitions", CPUS)
        .getOrCreate()
    )


def run(df: DataFrame) -> None:
    """Compute every row and column without moving them to the driver."""
    df.write.format("noop").mode("overwrite").save()


def main() -> None:
    spark = session()
    spark.sparkContext.setLogLevel("ERROR")
    times: dict[str, float] = {}

    def clock(name, work, repeat=1):
        start = time.time()
        out = work()
        times[name] = round((time.time() - start) / repeat, 3)
        return out

    path = f"{SF_DIR}/documents.parquet"

    def terms(pattern):
        return drop_stopwords(tokenize(read_documents(spark, path), pattern), ENGLISH)

    run(terms(WORDS))  # Starts the JVM's code paths; not measured.

    # Text to counts.
    clock("tokenize", lambda: run(terms(WORDS)))

    def counts():
        docs = terms(WORDS)
        vocab = build_vocabulary(docs, 3, 0.8, LDA_TERMS)
        bag = BagOfWords(hold(bag_of_words(docs, vocab).df), vocab.n_terms)
        return vocab, bag, bag.df.count()

    vocab, bag, n_docs = clock("vocabulary_and_counts", counts)

    # Variational LDA.
    OnlineLda(n_topics=LDA_TOPICS, prex_tol=0.0).fit(bag, 1)
    model = clock("lda_em_iteration", lambda: OnlineLda(n_topics=LDA_TOPICS, prex_tol=0.0).fit(bag, 5), 5)
    clock("lda_score", lambda: run(model.transform(bag)))
    clock("lda_top_words", lambda: run(model.top_words(vocab.df, 15)))

    def small():
        docs = terms(WORDS)
        picked = build_vocabulary(docs, 3, 0.8, 1000)
        part = BagOfWords(hold(bag_of_words(docs, picked).df), picked.n_terms)
        return OnlineLda(n_topics=10, prex_tol=0.0).fit(part, 10).top_words(picked.df, 15).collect()

    clock("lda_batch_text_to_topics", small)
    clock("lda_online_pass", lambda: OnlineLda(n_topics=10, tau=512.0, n_docs=1e4, batch_size=2000).partial_fit(bag))

    # Gibbs sampling over the whole vocabulary.
    docs = terms(LETTERS_PUNCT)
    words = build_vocabulary(docs)
    seqs = feature_sequences(docs, words)
    seqs = Sequences(hold(seqs.df), seqs.n_terms)
    n_tokens = seqs.df.agg(F.sum(F.size("term_ids"))).first()[0]
    hdp = GibbsModel.initialise(seqs, HdpParams(alpha=1.0, beta=0.1, gamma=1.0, n_topics=10))
    hdp.estimate(1)
    clock("hdp_sweep", lambda: hdp.estimate(3), 3)
    scorer = hdp.scorer()
    clock("hdp_score_10_sweeps", lambda: run(scorer.score(seqs, 10)))

    # Topic trees.
    docs = terms(ALNUM_DASH)
    words = build_vocabulary(docs)
    leaves = feature_sequences(docs, words)
    leaves = Sequences(hold(leaves.df), leaves.n_terms)
    leaves.df.count()
    tree, _ = fit_tree(leaves, TreeParams(), 1)
    tree, _ = clock("tree_fit_2_sweeps", lambda: fit_tree(leaves, TreeParams(), 2))
    clock("tree_score_10_sweeps", lambda: run(infer(tree, leaves, 10)))

    print(
        json.dumps(
            {
                "metric": "topicloom_total",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(SF_DIR.rstrip("/")).removeprefix("sf"),
                "docs": n_docs,
                "tokens": n_tokens,
                "cpus": CPUS,
            }
        )
    )


if __name__ == "__main__":
    main()
