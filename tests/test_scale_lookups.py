"""Vocabularies are looked up by hash, in workers' tables or by blocks of documents."""

import pytest

from topicloom.operators.counts import bag_of_words, doc_term_counts, feature_sequences, unpack_counts
from topicloom.operators.tokens import WORDS, tokenize
from topicloom.operators.vocabulary import build_vocabulary, given_vocabulary

TEXTS = ["aa bb cc aa", "bb bb dd", "", "ee aa zz", "cc"]


def plan(df) -> str:
    return df._jdf.queryExecution().toString()


@pytest.fixture(scope="module")
def docs(spark):
    rows = spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")
    return tokenize(rows, WORDS).persist()


@pytest.mark.parametrize("limit", ["268435456", "0"])
def test_lookups_by_hash(spark, docs, limit):
    spark.conf.set("spark.topicloom.maxBroadcastBytes", limit)
    try:
        vocab = build_vocabulary(docs.filter("doc_id <> 3"))
        seqs, bag = feature_sequences(docs, vocab), bag_of_words(docs, vocab)
        # Neither strings nor a row per token leave the documents' rows.
        assert "posexplode" not in plan(seqs.df) and "xxhash64" in plan(seqs.df)
        got = {r["doc_id"]: (list(r["term_ids"]), r["n_unseen"]) for r in seqs.df.collect()}
        assert got == {0: ([0, 1, 2, 0], 0), 1: ([1, 1, 3], 0), 2: ([], 0), 3: ([0], 2), 4: ([2], 0)}
        assert bag.df.count() == len(TEXTS)
        assert doc_term_counts(docs, vocab).count() == unpack_counts(bag).count() == 7
    finally:
        spark.conf.unset("spark.topicloom.maxBroadcastBytes")


@pytest.mark.parametrize("limit", ["268435456", "0"])
def test_terms_of_one_hash_are_joined(spark, docs, limit):
    spark.conf.set("spark.topicloom.maxBroadcastBytes", limit)
    try:
        twice = given_vocabulary(spark.createDataFrame([(0, "dd"), (1, "dd"), (2, "ee")], "term_id int, term string"))
        rows = {(r["doc_id"], r["term_id"]) for r in doc_term_counts(docs, twice).collect()}
        assert rows == {(1, 0), (1, 1), (3, 2)}
    finally:
        spark.conf.unset("spark.topicloom.maxBroadcastBytes")
