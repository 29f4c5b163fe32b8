"""Raw documents to tokens: the corpus operators applied in order."""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from topicloom.llm import bpe, language_id, mixing, near_dup, quality_rules
from topicloom.llm.catalogue import WORD_BPE
from topicloom.llm.common import scratch
from topicloom.session import discard, fresh_path


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass every rule but the one on few words: a short clean text is kept.

    Row by row; null and empty texts pass, as no other rule speaks of them (the next stage drops them).
    """
    return quality_rules.keep(docs, "short-1")


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in a language that the corpus names; a document without a language gets the one found.

    A text must be as like its language as the corpus's own documents of its length are.  Null and empty
    texts, and texts without letters, go; repeated rows and null keys are judged row by row.
    """
    profiles = language_id.learn(docs)
    kept = language_id.in_language(docs, profiles, language_id.least_scores(docs, profiles))
    return kept.select(F.col("row").withField("lang", F.coalesce("row.lang", "lang_pred")).alias("row")).select("row.*")


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The first row of each group; five-word shingles, similarity 0.8.

    Rows are grouped by their texts, whatever their keys; the row of the smallest key stays, null last.
    Texts without words are like no other and stay.
    """
    return near_dup.first_rows(docs)


def mix(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Whole documents as often as the mix takes them, at most three times.

    A null source is a source like another; rows without words are not taken.
    """
    return mixing.repeat_whole(mixing.mix(docs)).select(docs.columns)


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every row, little-endian unsigned 32-bit integers, and the decoded text's hash; a null text counts as empty."""
    path = public_tokenizers.path(WORD_BPE)
    coded = bpe.round_trip(docs.select("doc_id", "lang", "source", "text"), path)
    n_tokens = (F.octet_length("ids") / 4).cast("long")
    return coded.select(
        "doc_id", "lang", "source", n_tokens.alias("n_tokens"), "ids", F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256")
    )


STAGES = [
    ("quality rules", quality),
    ("language", language),
    ("near duplicates", near_duplicates),
    ("source mix", mix),
    ("tokens", tokens),
]

#: Rank-order profiles and byte-pair merges have no SQL form; a plain version in the tests checks the rows.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The last stage's rows; each stage's result is written, and the next one reads it.

    What a stage writes on its way is deleted when its result is there, a result when the next one is.
    """
    docs, before = spark.read.parquet(f"{sf_dir}/documents.parquet"), None
    for name, stage in STAGES:
        path = fresh_path(spark, name.replace(" ", "-"))
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(path)
        if before is not None:
            discard(spark, before)
        docs, before = spark.read.parquet(path), path
    return docs
