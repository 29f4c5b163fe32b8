"""Tokenising and token filters, all inside the document's own row.

A document's tokens stay an array until a join needs rows, so none of these
steps shuffles.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from topicloom.session import lookup_join

# The token patterns.
LETTERS_PUNCT = r"\p{L}[\p{L}\p{P}]+\p{L}"
LETTERS_PUNCT_DIGITS = r"\p{L}[\p{L}\p{P}\p{N}]+[\p{L}\p{N}]"
ALNUM_DASH = r"\p{L}[\p{L}\p{N}_-]+[\p{L}\p{N}]"
WORDS = r"[\p{L}\p{N}_]{2,}"
LEADING_DIGIT = r"^\p{Nd}"


def tokenize(docs: DataFrame, pattern: str = LETTERS_PUNCT, text: str = "text", lowercase: bool = True) -> DataFrame:
    """Replace ``text`` by ``terms``, the pattern's matches in order."""
    value = F.lower(text) if lowercase else F.col(text)
    rest = [c for c in docs.columns if c != text]
    return docs.select(*rest, F.regexp_extract_all(value, F.lit(pattern), F.lit(0)).alias("terms"))


def drop_digit_led(docs: DataFrame) -> DataFrame:
    """Keep tokens that do not start with a decimal digit."""
    return docs.withColumn("terms", F.filter("terms", lambda t: ~F.rlike(t, F.lit(LEADING_DIGIT))))


def drop_stopwords(docs: DataFrame, words: Sequence[str]) -> DataFrame:
    """Drop listed words; later positions close up."""
    return docs.withColumn("terms", F.filter("terms", lambda t: ~t.isin(*words)))


def drop_stopword_table(tokens: DataFrame, stopwords: DataFrame, table_bytes: float) -> DataFrame:
    """Anti join of exploded tokens with a ``stopwords(term)`` table of known size."""
    return lookup_join(tokens, stopwords.select("term"), ["term"], "left_anti", table_bytes, ["doc_id", "pos"])


def ngrams(docs: DataFrame, sizes: Sequence[int] = (2,), separator: str = "_") -> DataFrame:
    """Replace tokens by the n-grams of the given sizes, position by position."""

    def grams_at(_: Column, i: Column) -> Column:
        options = [
            F.when(i + size <= F.size("terms"), F.array_join(F.slice("terms", i + 1, F.lit(size)), separator))
            for size in sizes
        ]
        return F.array_compact(F.array(*options))

    return docs.withColumn("terms", F.flatten(F.transform("terms", grams_at)))


def unnest(df: DataFrame, keep: Sequence[str], array: str | Column, value: str, pos: str = "_at") -> DataFrame:
    """One row per array entry: (keep..., pos, value).

    The outer form with a filter behind it, because for the inner form the
    optimizer pushes a test of the array's size below the steps that compute the
    array, which then run twice.
    """
    return df.select(*keep, F.posexplode_outer(array).alias(pos, value)).filter(F.col(pos).isNotNull())


def explode_tokens(docs: DataFrame) -> DataFrame:
    """(doc_id, terms) -> (doc_id, pos, term)."""
    return unnest(docs, ["doc_id"], "terms", "term", "pos")


def with_runs(docs: DataFrame, column: str, out: str = "runs") -> DataFrame:
    """Replace an array by its distinct values with counts: array<struct<v, cnt>>.

    Sorting puts equal values side by side; the positions where the value changes
    give each run's length, so counting within a document needs no shuffle.  Each
    step is a projection of its own, so that no lambda repeats the sort.
    """
    ordered = docs.withColumn("_sorted", F.sort_array(column)).drop(column)
    starts = ordered.withColumn(
        "_starts",
        F.filter(
            F.transform(
                "_sorted",
                lambda v, i: F.when((i == 0) | (v != F.get("_sorted", i - 1)), i).otherwise(F.lit(-1)),
            ),
            lambda i: i >= 0,
        ),
    )
    return starts.withColumn(
        out,
        F.transform(
            "_starts",
            lambda i, j: F.struct(
                F.get("_sorted", i).alias("v"),
                (F.coalesce(F.get("_starts", j + 1), F.size("_sorted")) - i).alias("cnt"),
            ),
        ),
    ).drop("_sorted", "_starts")
