"""Vocabulary building and size reports."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.operators.tokens import unnest
from topicloom.session import hold, in_batches, with_row_index


@dataclass(frozen=True)
class Vocabulary:
    """``df(term_id, term, df, tf)`` with its measured size."""

    df: DataFrame
    n_terms: int
    n_bytes: int

    @classmethod
    def of(cls, df: DataFrame) -> "Vocabulary":
        size = df.agg(
            F.count("*").alias("n"), F.coalesce(F.sum(F.octet_length("term") + 64), F.lit(0)).alias("b")
        ).first()
        return cls(df, size["n"], int(size["b"]))


def _batch_stats(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Per batch its terms with their documents and occurrences, and a row without a term for its documents."""
    for batch in batches:
        offsets, flat = batch.column("terms").offsets.to_numpy(), batch.column("terms").values
        flat = flat.slice(offsets[0], offsets[-1] - offsets[0]).dictionary_encode()
        at, n = flat.indices.to_numpy(), len(flat.dictionary)
        docs = np.repeat(np.arange(len(offsets) - 1), np.diff(offsets))
        once = np.unique(docs * np.int64(n) + at) % n if n else at
        terms = pa.concat_arrays([flat.dictionary.cast(pa.string()), pa.nulls(1, pa.string())])
        df = np.append(np.bincount(once, minlength=n), batch.num_rows)
        yield pa.RecordBatch.from_arrays([terms, pa.array(df), pa.array(np.append(np.bincount(at, minlength=n), 0))], ["term", "df", "tf"])


def _counted(docs: DataFrame) -> DataFrame:
    """``term_stats`` with one more row, without a term, whose ``df`` is the number of documents."""
    rows = docs.select(F.coalesce("terms", F.array().cast("array<string>")).alias("terms"))
    rows = in_batches(rows).mapInArrow(_batch_stats, "term string, df long, tf long")
    return rows.groupBy("term").agg(F.sum("df").alias("df"), F.sum("tf").alias("tf"))


def term_stats(docs: DataFrame) -> DataFrame:
    """(term, df, tf) in one scan; a task hands on one row per term and batch of documents."""
    return _counted(docs).filter("term IS NOT NULL")


def build_vocabulary(
    docs: DataFrame,
    min_df: float = 1,
    max_df: float = 1.0,
    max_features: int | None = None,
    n_docs: int | None = None,
) -> Vocabulary:
    """Terms within the document-frequency bounds, ids in alphabetical order.

    Integer bounds are document counts, float bounds are shares of the documents.
    ``max_features`` keeps the most frequent terms, ties by term.  The documents are read
    once: all that follows works on the held counts.
    """
    counted = hold(_counted(docs))
    stats = counted.filter("term IS NOT NULL")
    if n_docs is None and (isinstance(min_df, float) or isinstance(max_df, float)):
        row = counted.filter("term IS NULL").first()
        n_docs = row["df"] if row else 0
    low = min_df * n_docs if isinstance(min_df, float) else min_df
    high = max_df * n_docs if isinstance(max_df, float) else max_df
    kept = stats.filter((F.col("df") >= F.lit(low)) & (F.col("df") <= F.lit(high)))
    if max_features is not None:
        kept = kept.orderBy(F.desc("tf"), "term").limit(max_features)
    indexed = with_row_index(kept, ["term"], "term_id")
    vocab = Vocabulary.of(
        hold(indexed.select(F.col("term_id").cast("int").alias("term_id"), "term", "df", "tf"))
    )
    counted.unpersist()
    return vocab


def given_vocabulary(terms: DataFrame) -> Vocabulary:
    """A caller's own ``(term_id, term)`` table."""
    return Vocabulary.of(
        terms.select(
            F.col("term_id").cast("int").alias("term_id"),
            "term",
            F.lit(None).cast("long").alias("df"),
            F.lit(None).cast("long").alias("tf"),
        )
    )


def corpus_size(docs: DataFrame) -> DataFrame:
    """One row: documents, distinct terms, tokens."""
    none = F.lit(0).cast("long")
    by_doc = docs.agg(F.count("*").alias("n_docs"), none.alias("n_terms"), none.alias("n_tokens"))
    by_term = (
        unnest(docs, [], "terms", "term")
        .groupBy("term")
        .agg(F.count("*").alias("n"))
        .agg(none.alias("n_docs"), F.count("*").alias("n_terms"), F.sum("n").alias("n_tokens"))
    )
    return by_doc.unionByName(by_term).agg(
        *[F.coalesce(F.sum(c), none).alias(c) for c in ("n_docs", "n_terms", "n_tokens")]
    )
