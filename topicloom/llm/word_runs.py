"""Runs: stretches of words that repeat with a period three times or more.

Two words are a match of period p if they are p apart and equal.  A run of period p and length n is
a longest interval of n - p neighbouring matches.  Periods are taken by octave, [2^k, 2^(k+1)).  A
run long enough to count covers a multiple of the octave's stride, so a document is exploded into
overlapping tiles around these multiples, and a tile need only tell how far the matches of each
period reach to the left and right of its own multiple: two Z-functions.  Tiles are solved on their
own, anywhere; their intervals are shuffled by document and period and stitched where they touch.

Only tiles whose multiple begins or ends eight matches in a row of a period of the octave are made
at all; every interval that counts has sixteen or more, so none is lost.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from topicloom.llm.common import slices, text_udf, written

#: A run has at least so many words, and three periods.
LEAST = 24
PERIODS = 3
#: Words in a row that any counting interval has beside its multiple, on one side or the other.
GRAM = 8


def stride(octave: int) -> int:
    """Distance of an octave's multiples: no counting interval of its periods is shorter.

    An interval has max(24, 3p) - p matches or more, that is 17 for p < 8 and 2p from there on.
    """
    return max(16, 2 << octave)


def words_of(text: str | None) -> list[bytes]:
    # Bytes are split at ASCII white space only.
    return (text or "").encode().split()


def word_ids(texts: list[str | None]) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of all words, and where each text's words begin."""
    known: dict[bytes, int] = {}
    ids: list[int] = []
    first = [0]
    for text in texts:
        ids += [known.setdefault(w, len(known)) for w in words_of(text)]
        first.append(len(ids))
    return np.array(ids, np.int64), np.array(first, np.int64)


def _grams(ids: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """A number for every eight words in a row within a text, by equality; -1 where a text has no eight words left.  Also each word's text."""
    owner = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = len(ids)
    mixed = np.zeros(n, np.uint64)
    with np.errstate(over="ignore"):
        letters = (ids.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
        letters ^= letters >> np.uint64(29)
        for i in range(GRAM):
            mixed[: max(0, n - i)] += letters[i:] * np.uint64(pow(0xD6E8FEB86659FD93, i + 1, 1 << 64))
        mixed += owner.astype(np.uint64) * np.uint64(0xBF58476D1CE4E5B9)
    whole = np.arange(n) + GRAM <= first[owner + 1]
    _, names = np.unique(mixed, return_inverse=True)
    return np.where(whole, names, -1), owner


def _candidates(ids: np.ndarray, first: np.ndarray, only: bool = False) -> tuple[np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
    """Texts with a candidate multiple; and by octave the (text, multiple) that need a tile."""
    n = len(ids)
    grams, owner = _grams(ids, first)
    # Grams that a text has once cannot match: most texts end here.
    times = np.bincount(grams[grams >= 0], minlength=1)
    again = (grams >= 0) & (times[grams] > 1)
    live = np.zeros(len(first) - 1, bool)
    live[owner[again]] = True
    found: list[tuple[np.ndarray, np.ndarray]] = []
    hit = np.zeros(len(first) - 1, bool)
    if not live.any():
        return hit, found
    at = np.flatnonzero(again)
    key = np.sort(grams[at] * n + at)
    longest = int(np.diff(first)[live].max())
    octave = 0
    while PERIODS << octave <= longest:
        step, low, high = stride(octave), 1 << octave, 2 << octave
        spots = [np.arange(0, first[d + 1] - first[d], step) + first[d] for d in np.flatnonzero(live)]
        spots = np.concatenate(spots)
        needed = np.zeros(len(spots), bool)
        for shift in (0, GRAM):
            start = spots - shift
            inside = (start >= first[owner[spots]]) & (start >= 0)
            inside[inside] &= again[start[inside]]
            begin = start[inside]
            base = grams[begin] * n
            # The next places of the same gram, low to high - 1 words on.
            top = np.minimum(begin + high, n)
            needed[inside] |= np.searchsorted(key, base + top) > np.searchsorted(key, base + np.minimum(begin + low, n))
        spots = spots[needed]
        hit[owner[spots]] = True
        found.append((owner[spots], spots - first[owner[spots]]))
        octave += 1
    return hit, found


def z_function(x: list[int]) -> list[int]:
    """For each place how many letters from there equal those from the start."""
    n = len(x)
    z = [0] * n
    if n:
        z[0] = n
    left = right = 0
    for i in range(1, n):
        k = min(right - i, z[i - left]) if i < right else 0
        while i + k < n and x[k] == x[i + k]:
            k += 1
        z[i] = k
        if i + k > right:
            left, right = i, i + k
    return z


def solve_tile(words: list[int], at: int, octave: int, begin: int) -> list[tuple[int, int, int]]:
    """(period, lo, hi): the matches of each period around place ``at`` of the tile, numbered from ``begin``.

    The words reach one stride to both sides, and the octave's largest period beyond that.  An interval
    that ends inside the tile and is too short for a run is left out.
    """
    step, low, high = stride(octave), 1 << octave, 2 << octave
    ahead = z_function(words[at : at + step + high])
    reach = min(step, at)
    # Left of the multiple, backwards: the words before it, then all words up to the largest period after it.
    behind = words[at - reach : at][::-1]
    before = z_function([*behind, -1, *words[at - reach : at + high][::-1]])
    end = min(at + high, len(words))
    found = []
    for p in range(low, min(high, len(words) - at)):
        right = min(ahead[p], step)
        left = min(before[reach + 1 + end - at - p], reach) if at + p <= end else 0
        if left + right and (right == step or left == step or left + right >= max(LEAST, PERIODS * p) - p):
            found.append((p, begin + at - left, begin + at + right))
    return found


_TILE = "row long, octave int, at long, begin long, words array<int>"
_PIECE = "row long, period long, lo long, hi long"


def _tiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Rows (row, text) to the tiles of their documents."""
    for batch in batches:
        done = 0
        for part in slices(batch.column(1)):
            ids, first = word_ids(part.to_pylist())
            rows = batch.column(0).slice(done, len(part)).to_numpy()
            done += len(part)
            _, found = _candidates(ids, first)
            for octave, (texts, spots) in enumerate(found):
                step, high = stride(octave), 2 << octave
                # As many tiles at once as some megabytes hold.
                room = max(1, (1 << 20) // (2 * step + high))
                for cut in range(0, len(texts), room):
                    docs, places = texts[cut : cut + room], spots[cut : cut + room]
                    begin = np.maximum(places - step, 0)
                    end = np.minimum(places + step + high, first[docs + 1] - first[docs])
                    edges = np.concatenate([[0], np.cumsum(end - begin)])
                    inner = np.arange(edges[-1]) - np.repeat(edges[:-1], end - begin) + np.repeat(begin + first[docs], end - begin)
                    words = pa.ListArray.from_arrays(pa.array(edges, pa.int32()), pa.array(ids[inner], pa.int32()))
                    columns = [pa.array(rows[docs]), pa.array(np.full(len(docs), octave, np.int32)), pa.array(places - begin), pa.array(begin), words]
                    yield pa.RecordBatch.from_arrays(columns, ["row", "octave", "at", "begin", "words"])


def _pieces(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Tiles to intervals of matches."""
    for batch in batches:
        out: list[tuple[int, int, int, int]] = []
        lists = batch.column("words")
        for i, (row, octave, at, begin) in enumerate(zip(*(batch.column(c).to_pylist() for c in ("row", "octave", "at", "begin")))):
            out += [(row, *piece) for piece in solve_tile(lists[i].as_py(), at, octave, begin)]
            if len(out) > 100_000:
                yield _piece_batch(out)
                out = []
        if out:
            yield _piece_batch(out)


def _piece_batch(out: list[tuple[int, int, int, int]]) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*out)], ["row", "period", "lo", "hi"])


def stitch(pieces: DataFrame) -> DataFrame:
    """Intervals (row, period, lo, hi) of matches to runs (row, start, length, period).

    Intervals that overlap or touch are one.  A run of a multiple of its smallest period covers the same
    words, so of equal stretches the smallest period stays.
    """
    by = Window.partitionBy("row", "period").orderBy("lo", "hi")
    before = F.max("hi").over(by.rowsBetween(Window.unboundedPreceding, -1))
    marked = pieces.withColumn("_new", F.coalesce(F.col("lo") > before, F.lit(True)).cast("int"))
    whole = marked.withColumn("_run", F.sum("_new").over(by.rowsBetween(Window.unboundedPreceding, 0)))
    whole = whole.groupBy("row", "period", "_run").agg(F.min("lo").alias("start"), (F.max("hi") - F.min("lo") + F.col("period")).alias("length"))
    whole = whole.filter(F.col("length") >= F.greatest(F.lit(LEAST), PERIODS * F.col("period")))
    return whole.groupBy("row", "start", "length").agg(F.min("period").alias("period"))


def _has_candidate(text: Column) -> Column:
    def kernel(column: pa.Array) -> pa.Array:
        return pa.array(_candidates(*word_ids(column.to_pylist()))[0])

    return text_udf(kernel, "boolean")(text)


RUNS = "array<struct<start: bigint, period: bigint, length: bigint>>"


def _collapse(texts: list[str | None], runs: list[list[dict] | None]) -> list[str]:
    out = []
    for text, found in zip(texts, runs):
        words = words_of(text)
        if found:
            change = np.zeros(len(words) + 1, np.int64)
            for r in found:
                change[r["start"] + r["period"]] += 1
                change[r["start"] + r["length"]] -= 1
            words = [words[i] for i in np.flatnonzero(np.cumsum(change[:-1]) == 0)]
        out.append(b" ".join(words).decode())
    return out


def collapse(docs: DataFrame, text: str = "text", runs: str = "runs", out: str = "collapsed") -> DataFrame:
    """``docs`` with the runs of each text, by start and period, and the text without their repetitions.

    Words are longest stretches without ASCII white space, numbered from 0, and stand with one space between
    them in the result.  A word goes if any run has it after the run's first period.  Null and empty texts have
    no runs and an empty result.  Row by row: repeated rows and null keys keep their rows, other columns
    pass through, columns named like the results are replaced.

    Texts without a candidate tile are done where they are read.  The others are written once, with a
    number each; their runs come back by that number.
    """
    given = docs.select(F.struct("*").alias("row"), F.col(text).alias("text"))
    marked = given.withColumn("open", _has_candidate(F.col("text")))
    numbered = marked.filter("open").select(F.monotonically_increasing_id().alias("id"), "row", "text")
    candidates = written(numbered, "run-candidates")
    tiles = candidates.select(F.col("id").alias("row"), "text").mapInArrow(_tiles, _TILE)
    # Spread by number of tile: a long document's tiles go to many tasks.
    spread = tiles.repartition("row", "octave", "begin")
    found = stitch(spread.mapInArrow(_pieces, _PIECE))
    listed = found.groupBy("row").agg(F.array_sort(F.collect_list(F.struct("start", "period", "length"))).alias("_runs"))
    joined = candidates.join(listed.withColumnRenamed("row", "id"), "id", "left").select("row", "text", F.coalesce("_runs", F.array().cast(RUNS)).alias("runs"))
    rest = marked.filter("NOT open").select("row", "text", F.array().cast(RUNS).alias("runs"))

    def kernel(batches: Iterator[tuple[pa.Array, pa.Array]]) -> Iterator[pa.Array]:
        for texts, found in batches:
            done = 0
            for part in slices(texts):
                yield pa.array(_collapse(part.to_pylist(), found.slice(done, len(part)).to_pylist()), pa.string())
                done += len(part)
            pa.default_memory_pool().release_unused()

    kernel.__annotations__ = {"batches": Iterator[tuple[pa.Array, pa.Array]], "return": Iterator[pa.Array]}
    cleaned = F.arrow_udf(kernel, "string").asNondeterministic()
    every = joined.unionByName(rest).select("row", "runs", cleaned("text", "runs").alias("collapsed"))
    kept = [F.col("row")[c].alias(c) for c in docs.columns if c not in (runs, out)]
    return every.select(*kept, F.col("runs").alias(runs), F.col("collapsed").alias(out))
