import math
from collections import Counter

import numpy as np
import pytest
from hypothesis import given, settings
from hypothesis import strategies as st
from pyspark.ml.feature import StopWordsRemover
from pyspark.sql import functions as F

from topicloom.functions.draws import hash_gamma_100, hash_uniform, np_uniform
from topicloom.functions.numeric import digamma, lgamma, np_digamma, np_lgamma
from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.counts import (
    assign_batches,
    assign_folds,
    bag_of_words,
    dense_to_sparse,
    doc_term_counts,
    feature_sequences,
    sequence_counts,
    unpack_counts,
)
from topicloom.operators.tokens import (
    ALNUM_DASH,
    LETTERS_PUNCT,
    WORDS,
    drop_digit_led,
    drop_stopwords,
    explode_tokens,
    ngrams,
    tokenize,
    with_runs,
)
from topicloom.operators.vocabulary import Vocabulary, build_vocabulary, corpus_size, given_vocabulary, term_stats
from topicloom.session import shared_folder, with_row_index
from topicloom.sources.documents import read_lines, split_lines

TEXTS = [
    "The cat's cat-flap, a 2nd flap; cats!",
    "",
    "cat dog dog 42 9lives snake_case",
    "Ünïcode straße naïve dog",
]


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(list(enumerate(TEXTS)), "doc_id long, text string")


def lists(df):
    return [r["terms"] for r in df.orderBy("doc_id").collect()]


def test_patterns(docs):
    assert lists(tokenize(docs, LETTERS_PUNCT))[0] == ["the", "cat's", "cat-flap", "flap", "cats"]
    assert lists(tokenize(docs, ALNUM_DASH))[0] == ["the", "cat", "cat-flap", "flap", "cats"]
    assert lists(tokenize(docs, WORDS))[2] == ["cat", "dog", "dog", "42", "9lives", "snake_case"]
    assert lists(drop_digit_led(tokenize(docs, WORDS)))[2] == ["cat", "dog", "dog", "snake_case"]
    assert lists(tokenize(docs, WORDS))[3] == ["ünïcode", "straße", "naïve", "dog"]


def test_stopwords_and_ngrams(docs):
    kept = drop_stopwords(tokenize(docs, WORDS), ("the", "dog"))
    assert lists(kept)[2] == ["cat", "42", "9lives", "snake_case"]
    assert lists(ngrams(kept, (2,)))[2] == ["cat_42", "42_9lives", "9lives_snake_case"]
    assert lists(ngrams(kept, (1, 2)))[2][:3] == ["cat", "cat_42", "42"]
    assert lists(ngrams(kept, (2,)))[1] == []


def test_stopword_list_is_sparks(spark):
    assert set(ENGLISH) == set(StopWordsRemover.loadDefaultStopWords("english"))


@settings(max_examples=5, deadline=None)
@given(st.lists(st.lists(st.sampled_from("abcde"), max_size=12), min_size=1, max_size=6))
def test_counting_in_the_row(spark, texts):
    rows = spark.createDataFrame(list(enumerate(texts)), "doc_id long, terms array<string>")
    for r in with_runs(rows, "terms").collect():
        assert {e["v"]: e["cnt"] for e in r["runs"]} == Counter(texts[r["doc_id"]])
    stats = {r["term"]: (r["df"], r["tf"]) for r in term_stats(rows).collect()}
    assert stats == {
        t: (sum(t in x for x in texts), sum(x.count(t) for x in texts)) for t in {w for x in texts for w in x}
    }


def test_vocabulary_bounds(docs):
    terms = tokenize(docs, WORDS)
    vocab = build_vocabulary(terms, min_df=2)
    assert [(r["term_id"], r["term"], r["df"], r["tf"]) for r in vocab.df.orderBy("term_id").collect()] == [
        (0, "cat", 2, 3), (1, "dog", 2, 3)
    ]
    capped = build_vocabulary(terms, max_features=1)
    assert capped.n_terms == 1
    assert build_vocabulary(terms, max_df=0.25).df.filter("term = 'dog'").count() == 0
    assert {r["term"] for r in build_vocabulary(terms, min_df=0.5).df.collect()} == {"cat", "dog"}


def brute_counts(texts, vocab):
    import regex

    out = {}
    for d, t in enumerate(texts):
        for w in regex.findall(r"[\p{L}\p{N}_]{2,}", t.lower()):
            if w in vocab:
                out[d, vocab[w]] = out.get((d, vocab[w]), 0) + 1.0
    return out


def check_counts(docs):
    terms = tokenize(docs, WORDS)
    vocab = build_vocabulary(terms)
    ids = {r["term"]: r["term_id"] for r in vocab.df.collect()}
    assert list(ids) and sorted(ids, key=ids.get) == sorted(ids)
    want = brute_counts(TEXTS, ids)
    got = {(r["doc_id"], r["term_id"]): r["cnt"] for r in doc_term_counts(terms, vocab).collect()}
    assert got == want
    bag = bag_of_words(terms, vocab)
    assert bag.df.count() == len(TEXTS)
    assert {(r["doc_id"], r["term_id"]): r["cnt"] for r in unpack_counts(bag).collect()} == want
    seqs = feature_sequences(terms, vocab)
    assert {(r["doc_id"], r["term_id"]): r["cnt"] for r in unpack_counts(sequence_counts(seqs)).collect()} == want


def test_counts(docs):
    check_counts(docs)


def test_counts_without_broadcast(docs, no_broadcast):
    check_counts(docs)


def test_unseen_terms(spark, docs):
    table = spark.createDataFrame([(0, "dog"), (1, "cat")], "term_id int, term string")
    seqs = feature_sequences(tokenize(docs, WORDS), given_vocabulary(table))
    rows = {r["doc_id"]: (r["term_ids"], r["n_unseen"]) for r in seqs.df.collect()}
    assert rows[2] == ([1, 0, 0], 3) and rows[1] == ([], 0) and rows[3] == ([0], 3)


def test_corpus_size(docs):
    row = corpus_size(tokenize(docs, WORDS)).first()
    assert (row["n_docs"], row["n_tokens"]) == (4, sum(len(x) for x in lists(tokenize(docs, WORDS))))


def test_dense_to_sparse(spark):
    rows = spark.createDataFrame([(0, [0.0, 2.0, 0.0]), (1, [1.0, 0.0, 3.0])], "id long, v array<double>")
    assert sorted(tuple(r) for r in dense_to_sparse(rows, "id", "v").collect()) == [(0, 1, 2.0), (1, 0, 1.0), (1, 2, 3.0)]


def test_row_index_and_batches(spark):
    df = spark.range(0, 1000, 7, 5).select((F.col("id") * 37 % 1009).alias("doc_id"))
    ordered = sorted(r["doc_id"] for r in df.collect())
    assert {r["doc_id"]: r["i"] for r in with_row_index(df, ["doc_id"], "i").collect()} == {
        d: i for i, d in enumerate(ordered)
    }
    batches = {r["doc_id"]: r["batch_id"] for r in assign_batches(df, 10).collect()}
    assert batches == {d: i // 10 for i, d in enumerate(ordered)}


def test_folds_cover(spark):
    rows = assign_folds(spark.range(500).withColumnRenamed("id", "doc_id"), 5, 1).groupBy("fold").count().collect()
    assert {r["fold"] for r in rows} == set(range(5)) and sum(r["count"] for r in rows) == 500


def test_delimited_lines(spark, tmp_path):
    path = tmp_path / "docs.txt"
    path.write_text("d1 news, The first text.\nd2, sport Another, one\nd3\n")
    rows = sorted(tuple(r) for r in read_lines(spark, str(path)).collect())
    # Names and labels run to the next white space, so a comma right behind stays with them.
    assert rows == [("d1", "news,", "The first text."), ("d2,", "sport", "Another, one"), ("d3", "", "")]
    assert split_lines(spark.createDataFrame([(1, "x")], "k int, value string")).columns == ["k", "name", "label", "text"]


def test_numeric_functions(spark):
    xs = [1e-3, 0.1, 0.5, 1.0, 2.5, 10.0, 123.4, 1e4]
    df = spark.createDataFrame([(x,) for x in xs], "x double")
    rows = df.select("x", digamma(F.col("x")).alias("d"), lgamma(F.col("x")).alias("g")).collect()
    for r in rows:
        x = r["x"]
        assert r["g"] == pytest.approx(math.lgamma(x), rel=1e-9, abs=1e-9)
        slope = (math.lgamma(x * (1 + 1e-6)) - math.lgamma(x * (1 - 1e-6))) / (2e-6 * x)
        assert r["d"] == pytest.approx(slope, rel=1e-5, abs=1e-5)
        assert r["d"] == pytest.approx(float(np_digamma(np.array(x))), rel=1e-12)
        assert r["g"] == pytest.approx(float(np_lgamma(np.array(x))), rel=1e-12, abs=1e-12)


def test_draws(spark):
    df = spark.range(4000)
    row = df.select(hash_uniform(0, "a", "id").alias("u"), hash_gamma_100(0, "a", "id").alias("g")).agg(
        F.avg("u"), F.stddev("u"), F.avg("g"), F.stddev("g")
    ).first()
    assert row[0] == pytest.approx(0.5, abs=0.02) and row[1] == pytest.approx(12**-0.5, abs=0.01)
    assert row[2] == pytest.approx(1.0, abs=0.01) and row[3] == pytest.approx(0.1, abs=0.01)
    u = np_uniform(1, 2, np.arange(20000), np.arange(20000) % 7)
    assert u.mean() == pytest.approx(0.5, abs=0.01) and u.std() == pytest.approx(12**-0.5, abs=0.01)
    assert abs(np.corrcoef(u[:-1], u[1:])[0, 1]) < 0.03


def test_shared_folder_is_the_sessions(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if named:
        assert shared_folder(spark) == named.rstrip("/")
