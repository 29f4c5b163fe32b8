"""Corpus sources: delimited text lines and document tables."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from topicloom.session import spread

# Fixed value: name, label and data as groups 1, 2 and 3 of one line.
LINE_PATTERN = r"^(\S*)[\s,]*(\S*)[\s,]*(.*)$"

DOCUMENT_SCHEMA = T.StructType(
    [
        T.StructField("doc_id", T.LongType()),
        T.StructField("text", T.StringType()),
        T.StructField("lang", T.StringType()),
        T.StructField("source", T.StringType()),
        T.StructField("n_chars", T.LongType()),
    ]
)


def split_lines(lines: DataFrame, pattern: str = LINE_PATTERN, groups: Sequence[int] = (1, 2, 3)) -> DataFrame:
    """(value, ...) -> (name, label, text, ...): one document per line."""
    name, label, data = groups
    rest = [c for c in lines.columns if c != "value"]
    return lines.select(
        *rest,
        F.regexp_extract("value", pattern, name).alias("name"),
        F.regexp_extract("value", pattern, label).alias("label"),
        F.regexp_extract("value", pattern, data).alias("text"),
    )


def read_lines(spark: SparkSession, path: str) -> DataFrame:
    """Read text files of ``name label text`` lines as (name, label, text)."""
    return split_lines(spark.read.text(path))


def read_documents(
    spark: SparkSession,
    path: str,
    langs: Sequence[str] | None = None,
    columns: Sequence[str] = ("doc_id", "text"),
) -> DataFrame:
    """Read a Parquet document table; ``langs`` becomes a pushed-down scan filter."""
    docs = spark.read.schema(DOCUMENT_SCHEMA).parquet(path)
    if langs is not None:
        docs = docs.filter(F.col("lang").isin(*langs))
    return spread(docs.select(*columns), "doc_id")


def head_sample(docs: DataFrame, n: int) -> DataFrame:
    """The first ``n`` documents by id."""
    return docs.orderBy("doc_id").limit(n)
