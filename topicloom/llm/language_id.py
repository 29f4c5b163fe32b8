"""Language identification by rank-order profiles.

A profile is the list of the most frequent letter n-grams (one to three letters, with one
blank for whatever stands between letters).  Language profiles are counted over all
learning documents; a document's own profile is compared to each by the out-of-place
distance: the sum over its n-grams of the difference of ranks, or the largest difference
where the language lacks the n-gram.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import bound_batches, slices, text_udf

PROFILE = 400
UNKNOWN = "und"
#: Distinct n-grams of a language that a counting task holds before it hands them on.
HELD = 1_000_000
BLANK = 32
#: Share of a language's own documents that may fall under its least score, and by how much that is lowered.
STRAY = 0.002
MARGIN = 0.03


@lru_cache(maxsize=1)
def _lower_letters() -> np.ndarray:
    """Code point -> its lower-case letter, or ``BLANK`` if it is not a letter."""
    table = np.full(0x110000, BLANK, np.uint32)
    for c in range(0x110000):
        if (x := chr(c)).isalpha():
            low = x.lower()
            table[c] = ord(low) if len(low) == 1 else c
    return table


def ngrams(text: str | None) -> np.ndarray:
    """Keys of a text's n-grams: up to three code points of 21 bits each."""
    if not text:
        return np.empty(0, np.int64)
    # A lone half of a surrogate pair cannot be in a text that Arrow hands over.
    s = _lower_letters()[np.frombuffer(text.encode("utf-32-le"), "<u4")]
    s = np.concatenate(([BLANK], s, [BLANK])).astype(np.int64)
    s = s[np.concatenate(([True], (s[1:] != BLANK) | (s[:-1] != BLANK)))]
    if len(s) < 3:
        return np.empty(0, np.int64)
    inner = s[1:-1] != BLANK
    pairs = s[:-1] << 21 | s[1:]
    return np.concatenate([s[s != BLANK], pairs, (pairs[:-1] << 21 | s[2:])[inner]])


def counted(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    found = pa.array(keys).value_counts()
    return found.field(0).to_numpy(), found.field(1).to_numpy()


def ranked(keys: np.ndarray, counts: np.ndarray, size: int = PROFILE) -> np.ndarray:
    """The most frequent keys, most frequent first, ties by key."""
    return keys[np.lexsort((keys, -counts))[:size]]


@dataclass(frozen=True)
class Profiles:
    """n-grams of all languages, sorted, and their rank in each language (-1: not in its profile)."""

    languages: list[str]
    grams: np.ndarray
    ranks: np.ndarray
    size: int

    @classmethod
    def of(cls, rows: list[tuple[str, int, int]], size: int = PROFILE) -> "Profiles":
        languages = sorted({r[0] for r in rows})
        grams = np.unique(np.array([r[1] for r in rows], np.int64))
        ranks = np.full((len(grams), len(languages)), -1, np.int32)
        for lang, gram, rank in rows:
            ranks[np.searchsorted(grams, gram), languages.index(lang)] = rank
        return cls(languages, grams, ranks, size)

    def distances(self, text: str | None) -> np.ndarray | None:
        """Out-of-place distance to each language, 0 to 1; None for a text without letters."""
        keys = ngrams(text)
        if not len(keys):
            return None
        own = ranked(*counted(keys), self.size)
        at = np.searchsorted(self.grams, own)
        at[at == len(self.grams)] = 0
        ranks = self.ranks[at]
        out = np.abs(ranks - np.arange(len(own))[:, None])
        out[(ranks < 0) | (self.grams[at] != own)[:, None]] = self.size
        return out.sum(0) / (len(own) * self.size)

    def judge(self, text: str | None) -> tuple[str, float]:
        far = self.distances(text) if self.languages else None
        if far is None:
            return UNKNOWN, 0.0
        best = int(np.argmin(far))
        return self.languages[best], float(1.0 - min(1.0, far[best]))


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held: dict[str, list[tuple[np.ndarray, np.ndarray]]] = {}
    waiting: dict[str, list[np.ndarray]] = {}

    def fold(lang: str) -> int:
        parts = held.setdefault(lang, [])
        if waiting.get(lang):
            parts.append(counted(np.concatenate(waiting.pop(lang))))
        if len(parts) > 1:
            keys, back = np.unique(np.concatenate([k for k, _ in parts]), return_inverse=True)
            sums = np.bincount(back, np.concatenate([c for _, c in parts]))
            held[lang] = [(keys, sums.astype(np.int64))]
        return len(held[lang][0][0]) if held[lang] else 0

    def give(lang: str) -> Iterator[pa.RecordBatch]:
        for keys, counts in held.pop(lang, []):
            names = pa.array([lang] * len(keys), pa.string())
            yield pa.RecordBatch.from_arrays([names, pa.array(keys), pa.array(counts, pa.int64())], ["lang", "gram", "n"])

    for batch in batches:
        at = 0
        for part in slices(batch.column("text")):
            langs = batch.column("lang").slice(at, len(part)).to_pylist()
            at += len(part)
            for lang, text in zip(langs, part.to_pylist()):
                waiting.setdefault(lang, []).append(ngrams(text))
            for lang in list(waiting):
                if fold(lang) > HELD:
                    yield from give(lang)
    for lang in list(held):
        fold(lang)
        yield from give(lang)


def learn(docs: DataFrame, text: str = "text", lang: str = "lang", size: int = PROFILE) -> Profiles:
    """Profiles from all rows whose language is not null.

    Tasks add up their own counts, so one row per n-gram, language and task is shuffled.
    The profiles, ``size`` rows a language, are what the driver gets.
    """
    bound_batches()
    rows = docs.select(F.col(lang).alias("lang"), F.col(text).alias("text")).filter("lang IS NOT NULL AND text IS NOT NULL")
    counts = rows.mapInArrow(_count, "lang string, gram long, n long").groupBy("lang", "gram").agg(F.sum("n").alias("n"))
    # Filtered by the row number itself, so that each task keeps its own first rows before the shuffle.
    place = F.row_number().over(Window.partitionBy("lang").orderBy(F.desc("n"), "gram"))
    top = counts.withColumn("place", place).filter(F.col("place") <= size).select("lang", "gram", "place").collect()
    return Profiles.of([(lang, gram, place - 1) for lang, gram, place in top], size)


def identify(docs: DataFrame, profiles: Profiles, text: str = "text") -> DataFrame:
    """``docs`` with lang_pred and score (1 less the distance to the language chosen).

    ``und`` and 0 where the text is null or has no letter, or no language was learned.
    Equal distances go to the language first in code point order.  Row by row: repeated
    rows and null keys pass through, input columns named like a result are replaced.
    """
    own = [F.col("row")[c].alias(c) for c in docs.columns if c not in ("lang_pred", "score")]
    return _judged(docs, profiles, text).select(*own, "judged.lang_pred", "judged.score")


def _judged(docs: DataFrame, profiles: Profiles, text: str) -> DataFrame:
    """Rows as ``row``, their language and score as ``judged``, and their class of length."""
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(profiles)

    def kernel(column: pa.Array) -> pa.Array:
        found = [shared.value.judge(t) for t in column.to_pylist()]
        langs, scores = pa.array([f[0] for f in found], pa.string()), pa.array([f[1] for f in found], pa.float64())
        return pa.StructArray.from_arrays([langs, scores], ["lang_pred", "score"])

    judged = text_udf(kernel, "struct<lang_pred: string, score: double>")(F.col(text))
    return docs.select(F.struct("*").alias("row"), judged.alias("judged"), _length_class(F.col(text)).alias("length"))


def _length_class(text: Column) -> Column:
    """Texts of about the same length: each class goes up to twice the characters of the one before, up to long texts."""
    return F.least(F.floor(F.log2(F.length(text) + 1)), F.lit(12)).cast("int")


def least_scores(docs: DataFrame, profiles: Profiles, text: str = "text", lang: str = "lang", share: float = STRAY, margin: float = MARGIN) -> DataFrame:
    """(lang_pred, length, least): what documents of a language and length class score at least, all but a ``share`` of them.

    Learned from all documents whose given language is the one found.  Short texts score lower, so each length
    class has its own least score, lowered by ``margin``.  Counts by thousandths of a score are what is shuffled.
    """
    judged = _judged(docs.filter(F.col(lang).isNotNull()), profiles, text)
    right = judged.filter(F.col("row")[lang] == F.col("judged.lang_pred"))
    cells = right.groupBy(F.col("judged.lang_pred").alias("lang_pred"), "length", F.floor(F.col("judged.score") * 1000).alias("cell")).agg(F.count("*").alias("n"))
    own = Window.partitionBy("lang_pred", "length")
    upto = F.sum("n").over(own.orderBy("cell"))
    kept = cells.withColumn("upto", upto).withColumn("all", F.sum("n").over(own)).filter(F.col("upto") > F.col("all") * share)
    return kept.groupBy("lang_pred", "length").agg((F.min("cell") / 1000 - margin).alias("least"))


def in_language(docs: DataFrame, profiles: Profiles, least: DataFrame, text: str = "text") -> DataFrame:
    """The rows (as ``row``, with ``lang_pred``) whose text is at least as like its language as ``least`` says of its length.

    A length that the language has no document of is judged by the nearest shorter one that it has, or else the shortest.
    Texts of no language (null, empty, without letters) go.
    """
    table: dict[str, list[tuple[int, float]]] = {}
    # At most one row for a language and length class.
    for r in least.collect():
        table.setdefault(r["lang_pred"], []).append((r["length"], r["least"]))
    bound = F.lit(None).cast("double")
    for name, classes in table.items():
        classes.sort()
        of = F.lit(classes[0][1])
        for length, score in classes:
            of = F.when(F.col("length") >= length, F.lit(score)).otherwise(of)
        bound = F.when(F.col("judged.lang_pred") == name, of).otherwise(bound)
    fits = (F.col("judged.lang_pred") != UNKNOWN) & (F.col("judged.score") >= bound)
    return _judged(docs, profiles, text).filter(fits).select("row", "judged.lang_pred")
