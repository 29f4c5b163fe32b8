"""Registered queries on text preparation, with the SQL that checks them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.functions.stopwords import ENGLISH
from topicloom.operators.counts import (
    assign_batches,
    assign_folds,
    bag_of_words,
    dense_to_sparse,
    doc_term_counts,
    feature_sequences,
    unpack_counts,
)
from topicloom.operators.tokens import (
    ALNUM_DASH,
    LETTERS_PUNCT,
    LETTERS_PUNCT_DIGITS,
    WORDS,
    drop_digit_led,
    drop_stopword_table,
    drop_stopwords,
    explode_tokens,
    ngrams,
    tokenize,
)
from topicloom.operators.vocabulary import Vocabulary, build_vocabulary, corpus_size, given_vocabulary
from topicloom.plans import sql
from topicloom.session import spread, with_row_index
from topicloom.sources.documents import head_sample, read_documents, split_lines

MIN_DF, MAX_DF, MAX_FEATURES = 3, 0.8, 1000
SAMPLE_DOCS = 4000
BATCH_SIZE = 128
N_FOLDS, FOLD_SEED = 10, 7


def documents(spark: SparkSession, sf_dir: str, *columns: str) -> DataFrame:
    return read_documents(spark, f"{sf_dir}/documents.parquet", columns=("doc_id", *(columns or ("text",))))


def terms(spark: SparkSession, sf_dir: str, pattern: str = WORDS) -> DataFrame:
    return drop_stopwords(tokenize(documents(spark, sf_dir), pattern), ENGLISH)


def vocabulary(docs: DataFrame) -> Vocabulary:
    return build_vocabulary(docs, MIN_DF, MAX_DF, MAX_FEATURES)


# ---------------------------------------------------------------------- queries


def read_delimited_docs(spark, sf_dir):
    docs = documents(spark, sf_dir, "text", "lang")
    flat = F.translate("text", "\n\r", "  ")
    lines = docs.select("doc_id", F.concat(F.lit("doc"), "doc_id", F.lit(", "), "lang", F.lit(", "), flat).alias("value"))
    return split_lines(lines)


def corpus_sample(spark, sf_dir):
    return head_sample(documents(spark, sf_dir, "lang", "source", "n_chars"), SAMPLE_DOCS)


def tokenizer(pattern):
    return lambda spark, sf_dir: explode_tokens(tokenize(documents(spark, sf_dir), pattern))


def tokenize_nondigit(spark, sf_dir):
    return explode_tokens(drop_digit_led(tokenize(documents(spark, sf_dir), WORDS)))


def remove_stopwords(spark, sf_dir):
    return explode_tokens(terms(spark, sf_dir, LETTERS_PUNCT))


def remove_stopwords_by_table(spark, sf_dir):
    """Stop list as a table; positions stay those of the full token sequence."""
    tokens = explode_tokens(tokenize(documents(spark, sf_dir), LETTERS_PUNCT))
    table = spark.createDataFrame([(w,) for w in ENGLISH], "term string")
    return drop_stopword_table(tokens, table, sum(len(w) + 64 for w in ENGLISH))


def token_bigrams(spark, sf_dir):
    return explode_tokens(ngrams(terms(spark, sf_dir, LETTERS_PUNCT), (2,)))


def feature_sequence(spark, sf_dir):
    docs = terms(spark, sf_dir, LETTERS_PUNCT)
    seqs = feature_sequences(docs, build_vocabulary(docs))
    return seqs.df.select("doc_id", F.posexplode_outer("term_ids").alias("pos", "term_id")).filter("pos is not null")


def vocabulary_query(spark, sf_dir):
    return vocabulary(terms(spark, sf_dir)).df


def fixed_vocab_counts(spark, sf_dir):
    """Counts against a caller's vocabulary: here the words of the benchmark items."""
    items = spread(spark.read.parquet(f"{sf_dir}/benchmark.parquet"), "item_id")
    words = tokenize(items.select("item_id", "text"), WORDS).select(F.explode_outer("terms").alias("term"))
    table = with_row_index(words.filter("term is not null").distinct(), ["term"], "term_id")
    docs = drop_digit_led(tokenize(documents(spark, sf_dir), WORDS))
    return doc_term_counts(docs, given_vocabulary(table))


def doc_term_counts_query(spark, sf_dir):
    docs = terms(spark, sf_dir)
    return doc_term_counts(docs, vocabulary(docs))


def packed_counts(spark, sf_dir):
    docs = terms(spark, sf_dir)
    return unpack_counts(bag_of_words(docs, vocabulary(docs)))


def transform_with_vocab(spark, sf_dir):
    """Vocabulary from the documents, counts of the conversations; unseen terms drop out."""
    vocab = vocabulary(terms(spark, sf_dir))
    talks = spark.read.parquet(f"{sf_dir}/conversations.parquet")
    turns = spread(talks.select(F.concat_ws("/", "conv_id", "turn").alias("doc_id"), "text"), "doc_id")
    return doc_term_counts(drop_stopwords(tokenize(turns, WORDS), ENGLISH), vocab)


def dense_to_sparse_query(spark, sf_dir):
    vectors = spread(spark.read.parquet(f"{sf_dir}/embeddings.parquet").select("vec_id", "embedding"), "vec_id")
    return dense_to_sparse(vectors, "vec_id", "embedding").select("vec_id", "term_id", F.round("cnt", 6).alias("cnt"))


def training_split(docs: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Documents of the training folds, and of the fold held out."""
    folds = assign_folds(docs, N_FOLDS, FOLD_SEED)
    return folds.filter("fold <> 0").drop("fold"), folds.filter("fold = 0").drop("fold")


def oov_profile(spark, sf_dir):
    """Known and unseen tokens of held-out documents under the vocabulary of the training folds."""
    train, held_out = training_split(terms(spark, sf_dir, LETTERS_PUNCT))
    seqs = feature_sequences(held_out, build_vocabulary(train))
    return seqs.df.select("doc_id", F.size("term_ids").cast("long").alias("n_known"), "n_unseen")


def corpus_stats(spark, sf_dir):
    return corpus_size(terms(spark, sf_dir, LETTERS_PUNCT))


def minibatch_assign(spark, sf_dir):
    return assign_batches(documents(spark, sf_dir, "n_chars"), BATCH_SIZE)


def kfold_assign(spark, sf_dir):
    return assign_folds(documents(spark, sf_dir, "n_chars").select("doc_id"), N_FOLDS, FOLD_SEED)


QUERIES = {
    "read_delimited_docs": read_delimited_docs,
    "corpus_sample": corpus_sample,
    "tokenize_letters_punct": tokenizer(LETTERS_PUNCT),
    "tokenize_alnum_dash": tokenizer(ALNUM_DASH),
    "tokenize_letters_punct_digits": tokenizer(LETTERS_PUNCT_DIGITS),
    "tokenize_words": tokenizer(WORDS),
    "tokenize_nondigit": tokenize_nondigit,
    "remove_stopwords": remove_stopwords,
    "remove_stopwords_by_table": remove_stopwords_by_table,
    "token_bigrams": token_bigrams,
    "feature_sequence": feature_sequence,
    "build_vocab": vocabulary_query,
    "fixed_vocab_counts": fixed_vocab_counts,
    "doc_term_counts": doc_term_counts_query,
    "packed_counts": packed_counts,
    "transform_with_vocab": transform_with_vocab,
    "dense_to_sparse": dense_to_sparse_query,
    "oov_profile": oov_profile,
    "corpus_stats": corpus_stats,
    "minibatch_assign": minibatch_assign,
    "kfold_assign": kfold_assign,
}


# -------------------------------------------------------------------------- SQL


def _tokens(pattern: str) -> str:
    return f"WITH {sql.tokens(pattern, stopwords=False)} SELECT doc_id, pos, term FROM tok"


def prepared(pattern: str = WORDS) -> str:
    """Tokens, the standard vocabulary and the document-term counts."""
    return f"{sql.tokens(pattern)},{sql.vocabulary(MIN_DF, MAX_DF, MAX_FEATURES)},{sql.doc_terms()}"


def fold(doc_id: str) -> str:
    return f"floor({sql.uniform(FOLD_SEED, 'fold', doc_id)} * {N_FOLDS})::INTEGER"


def train_tokens() -> str:
    return f"train_tok AS MATERIALIZED (SELECT * FROM tok WHERE {fold('doc_id')} <> 0)"


_LINE = "'doc' || doc_id || ', ' || lang || ', ' || translate(text, chr(10) || chr(13), '  ')"
_PATTERN = r"^(\S*)[\s,]*(\S*)[\s,]*(.*)$"

ORACLES = {
    "read_delimited_docs": f"""
        WITH l AS (SELECT doc_id, {_LINE} AS v FROM documents)
        SELECT doc_id, regexp_extract(v, '{_PATTERN}', 1) AS name, regexp_extract(v, '{_PATTERN}', 2) AS label,
               regexp_extract(v, '{_PATTERN}', 3) AS text FROM l""",
    "corpus_sample": f"SELECT doc_id, lang, source, n_chars FROM documents ORDER BY doc_id LIMIT {SAMPLE_DOCS}",
    "tokenize_letters_punct": _tokens(LETTERS_PUNCT),
    "tokenize_alnum_dash": _tokens(ALNUM_DASH),
    "tokenize_letters_punct_digits": _tokens(LETTERS_PUNCT_DIGITS),
    "tokenize_words": _tokens(WORDS),
    "tokenize_nondigit": f"""
        WITH {sql.tokens(WORDS, stopwords=False)}, kept AS (
          SELECT doc_id, pos, term FROM tok WHERE NOT regexp_matches(term, '^\\p{{Nd}}'))
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, term FROM kept""",
    "remove_stopwords": f"WITH {sql.tokens(LETTERS_PUNCT)} SELECT doc_id, pos, term FROM tok",
    "remove_stopwords_by_table": f"""
        WITH {sql.tokens(LETTERS_PUNCT, stopwords=False)}
        SELECT doc_id, pos, term FROM tok WHERE term NOT IN ({sql.stop_list()})""",
    "token_bigrams": f"""
        WITH {sql.tokens(LETTERS_PUNCT)}, pairs AS (
          SELECT doc_id, pos, term, lead(term) OVER (PARTITION BY doc_id ORDER BY pos) AS next FROM tok)
        SELECT doc_id, pos, term || '_' || next AS term FROM pairs WHERE next IS NOT NULL""",
    "feature_sequence": f"""
        WITH {sql.tokens(LETTERS_PUNCT)},{sql.vocabulary()}
        SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY pos) - 1)::INTEGER AS pos, term_id
        FROM tok JOIN vocab USING (term)""",
    "build_vocab": f"WITH {prepared()} SELECT term_id, term, df, tf FROM vocab",
    "fixed_vocab_counts": f"""
        WITH words AS (SELECT DISTINCT unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM benchmark),
        vocab AS (SELECT (row_number() OVER (ORDER BY term) - 1)::INTEGER AS term_id, term FROM words),
        {sql.tokens(WORDS, stopwords=False)}
        SELECT doc_id, term_id, count(*)::DOUBLE AS cnt FROM tok JOIN vocab USING (term)
        WHERE NOT regexp_matches(term, '^\\p{{Nd}}') GROUP BY doc_id, term_id""",
    "doc_term_counts": f"WITH {prepared()} SELECT doc_id, term_id, cnt FROM dt",
    "packed_counts": f"WITH {prepared()} SELECT doc_id, term_id, cnt FROM dt",
    "transform_with_vocab": f"""
        WITH {prepared()}, turns AS (
          SELECT conv_id::VARCHAR || '/' || turn::VARCHAR AS doc_id,
                 unnest(regexp_extract_all(lower(text), '{WORDS}')) AS term FROM conversations)
        SELECT doc_id, term_id, count(*)::DOUBLE AS cnt FROM turns JOIN vocab USING (term) GROUP BY doc_id, term_id""",
    "dense_to_sparse": """
        WITH cells AS (
          SELECT vec_id, (generate_subscripts(embedding, 1) - 1)::INTEGER AS term_id, unnest(embedding) AS v FROM embeddings)
        SELECT vec_id, term_id, round(v::DOUBLE, 6) AS cnt FROM cells WHERE v <> 0""",
    "oov_profile": f"""
        WITH {sql.tokens(LETTERS_PUNCT)},{train_tokens()},{sql.vocabulary(tok="train_tok")}
        SELECT d.doc_id, count(v.term_id) AS n_known, count(t.term) - count(v.term_id) AS n_unseen
        FROM documents d LEFT JOIN tok t USING (doc_id) LEFT JOIN vocab v ON t.term = v.term
        WHERE {fold('d.doc_id')} = 0 GROUP BY d.doc_id""",
    "corpus_stats": f"""
        WITH {sql.tokens(LETTERS_PUNCT)}
        SELECT (SELECT count(*) FROM documents) AS n_docs, count(DISTINCT term) AS n_terms, count(*) AS n_tokens FROM tok""",
    "minibatch_assign": f"""
        SELECT doc_id, (row_number() OVER (ORDER BY doc_id) - 1) // {BATCH_SIZE} AS batch_id FROM documents""",
    "kfold_assign": f"SELECT doc_id, {fold('doc_id')} AS fold FROM documents",
}
