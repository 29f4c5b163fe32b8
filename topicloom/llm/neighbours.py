"""Approximate nearest neighbours by multi-index hashing.

Vectors get binary codes: principal axes, rotated so that the signs lose least (iterative
quantisation), learned on a bounded sample.  A code is split into m substrings about as wide
as the logarithm of the number of vectors, and each substring is indexed.  If two codes differ
in at most r bits, they differ in at most r // m bits in one of m substrings (more exactly: in
the first r % m + 1 substrings in at most r // m bits, or in a later one in at most r // m - 1),
so probing these balls retrieves every code within the radius.  A query's radius grows bit by bit
until k codes lie within it, and then by a learned margin; what lies within is ranked by the
distance of the vectors themselves.  Where the next balls have more cells than there are vectors,
the codes are gone through instead, which retrieves the same.

Every task indexes the vectors it reads, some ten megabytes of them at a time, and answers all queries
of a block from it; only its best candidates leave it.  Vectors are never shuffled, and a code
that many vectors share is spread over the tasks that hold them.  Blocks of queries go one by one.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from topicloom.llm.common import written
from topicloom.operators.arrow import ragged

MOST_BITS = 64
#: Widest substring: an index has two to its power cells.
MOST_WIDE = 16
#: Vectors that codes and margin are learned on, at most: those first by a hash of their id.
SAMPLE = 10_000
#: Sampled vectors whose true neighbours in the sample set the margin, and the share of them it must hold.
PROBED, HELD = 300, 0.99
#: Queries broadcast at once, at most, and bytes of vectors in one index.
QUERY_BLOCK = 20_000
INDEX_BYTES = 32 << 20


@dataclass(frozen=True)
class Codes:
    """Learned codes; ``axes`` has one column per bit.  ``margin``: bits that neighbours differ in beyond the k-th nearest code."""

    mean: np.ndarray
    axes: np.ndarray
    margin: int

    @property
    def bits(self) -> int:
        return self.axes.shape[1]

    def encode(self, vectors: np.ndarray) -> np.ndarray:
        """Codes as 64-bit integers, the first bit lowest."""
        signs = (vectors - self.mean) @ self.axes > 0
        packed = np.zeros((len(vectors), 8), np.uint8)
        found = np.packbits(signs, axis=1, bitorder="little")
        packed[:, : found.shape[1]] = found
        return packed.view("<u8").ravel()

    @classmethod
    def learn(cls, sample: np.ndarray, k: int, rounds: int = 30) -> "Codes":
        mean = sample.mean(0)
        centred = sample - mean
        bits = min(MOST_BITS, sample.shape[1])
        _, vectors = np.linalg.eigh(centred.T @ centred)
        main = vectors[:, ::-1][:, :bits]
        flat = centred @ main
        turn = np.linalg.qr(np.random.default_rng(5).standard_normal((bits, bits)))[0]
        for _ in range(rounds):
            u, _, v = np.linalg.svd(np.where(flat @ turn > 0, 1.0, -1.0).T @ flat)
            turn = (u @ v).T
        codes = cls(mean, main @ turn, bits)
        return cls(mean, codes.axes, codes._margin(sample, k))

    def _margin(self, sample: np.ndarray, k: int) -> int:
        """Bits beyond the k-th nearest code that hold ``HELD`` of the true neighbours of sampled vectors."""
        if len(sample) <= k + 1:
            return self.bits
        own = self.encode(sample)
        norms, over = (sample**2).sum(1), []
        for i in range(min(PROBED, len(sample))):
            squares = norms - 2 * sample @ sample[i]
            squares[i] = np.inf
            far = np.bitwise_count(own ^ own[i]).astype(int)
            near = np.argpartition(squares, k)[:k]
            far[i] = self.bits + 1
            over.append(far[near] - np.partition(far, k - 1)[k - 1])
        return max(0, int(np.quantile(np.concatenate(over), HELD, method="higher")))


def _masks(width: int) -> list[np.ndarray]:
    """Numbers of ``width`` bits by how many are set."""
    every = np.arange(1 << width)
    ones = np.bitwise_count(every.astype(np.uint64))
    return [every[ones == e] for e in range(width + 1)]


class Index:
    """Codes of some vectors, filed under each of their substrings."""

    def __init__(self, own: np.ndarray, bits: int):
        self.own, self.n, self.bits = own, len(own), bits
        wide = min(MOST_WIDE, max(1, int(np.log2(max(2, self.n)))))
        self.m = -(-bits // wide)
        edges = [bits * j // self.m for j in range(self.m + 1)]
        self.parts = [(np.uint64(a), np.uint64((1 << (b - a)) - 1), b - a) for a, b in zip(edges, edges[1:])]
        self.masks = {w: _masks(w) for _, _, w in self.parts}
        self.filed = []
        for shift, mask, width in self.parts:
            key = (own >> shift & mask).astype(np.int64)
            order = np.argsort(key, kind="stable")
            self.filed.append((order, np.searchsorted(key[order], np.arange((1 << width) + 1))))

    def within(self, code: np.uint64, k: int, margin: int) -> np.ndarray:
        """Rows whose codes lie within the radius that holds k of them, and ``margin`` bits more."""
        seen = np.zeros(self.n, bool)
        rows, far = np.zeros(0, np.int64), np.zeros(0, np.int64)
        cost, last = 0, None
        for r in range(self.bits + 1):
            j, flips = r % self.m, r // self.m
            shift, mask, width = self.parts[j]
            if flips <= width:
                cells = int(code >> shift & mask) ^ self.masks[width][flips]
                cost += len(cells) + 16
                if cost > self.n:
                    return self._all_within(code, k, margin)
                order, ends = self.filed[j]
                a, b = ends[cells], ends[cells + 1]
                some = b > a
                found = [order[x:y] for x, y in zip(a[some], b[some])]
                if found:
                    new = np.concatenate(found)
                    new = new[~seen[new]]
                    seen[new] = True
                    cost += len(new)
                    rows = np.concatenate([rows, new])
                    far = np.concatenate([far, np.bitwise_count(self.own[new] ^ code).astype(np.int64)])
            # All codes that differ in r bits or fewer have been met by now.
            if last is None and (far <= r).sum() >= k:
                last = r + margin
            if last is not None and r >= last:
                return rows[far <= last]
        return rows

    def _all_within(self, code: np.uint64, k: int, margin: int) -> np.ndarray:
        far = np.bitwise_count(self.own ^ code)
        last = int(np.partition(far, k - 1)[k - 1]) + margin if self.n >= k else self.bits
        return np.flatnonzero(far <= last)


def takes_part(vector: Column) -> Column:
    """Not null, not empty, all components finite, not all zero."""
    big = F.lit(float("inf"))
    odd = F.exists(vector, lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == big))
    return F.coalesce(~odd & F.exists(vector, lambda x: x != 0), F.lit(False))


def _best(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k nearest of different ids, ties to smaller ids."""
    if len(scores) > 4 * k:
        near = scores <= np.partition(scores, k - 1)[k - 1]
        if np.unique(ids[near]).size >= k:
            ids, scores = ids[near], scores[near]
    order = np.lexsort((ids, scores))
    ids, scores = ids[order], scores[order]
    first = np.sort(np.unique(ids, return_index=True)[1])[:k]
    return ids[first], scores[first]


def _answer(codes: Codes, k: int, shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        query_ids, queries = shared.value
        asked = codes.encode(queries)
        found: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(query_ids)

        def search(ids: np.ndarray, vectors: np.ndarray) -> None:
            index = Index(codes.encode(vectors), codes.bits)
            for q, code in enumerate(asked):
                # The query itself may be among them.
                rows = index.within(code, k + 1, codes.margin)
                rows = rows[ids[rows] != query_ids[q]]
                if len(rows) < len(ids) - 1 and np.unique(ids[rows]).size < k:
                    rows = np.flatnonzero(ids != query_ids[q])
                if not len(rows):
                    continue
                scores = np.sqrt(((vectors[rows].astype(np.float64) - queries[q]) ** 2).sum(1))
                near = ids[rows]
                if found[q] is not None:
                    near, scores = np.concatenate((found[q][0], near)), np.concatenate((found[q][1], scores))
                found[q] = _best(near, scores, k)

        held: list[tuple[np.ndarray, np.ndarray]] = []
        for batch in batches:
            if not batch.num_rows:
                continue
            ids = batch.column("vec_id").to_numpy()
            held.append((ids, ragged(batch.column("vector"))[1].reshape(len(ids), -1)))
            if sum(v.nbytes for _, v in held) >= INDEX_BYTES:
                search(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
                held = []
        if held:
            search(np.concatenate([i for i, _ in held]), np.concatenate([v for _, v in held]))
        some = [(i, f) for i, f in zip(query_ids, found) if f is not None]
        if some:
            yield pa.RecordBatch.from_arrays(
                [
                    pa.array(np.concatenate([np.full(len(f[0]), i) for i, f in some]), pa.int64()),
                    pa.array(np.concatenate([f[0] for _, f in some]), pa.int64()),
                    pa.array(np.concatenate([f[1] for _, f in some]), pa.float64()),
                ],
                ["query_id", "vec_id", "score"],
            )

    return run


def _search(queries: DataFrame, base: DataFrame, codes: Codes, k: int) -> DataFrame:
    """The k nearest found, (query_id, rank, vec_id, score).  One block of queries of bounded size is out at a time; its result is written."""
    spark = base.sparkSession
    n_blocks = max(1, -(-queries.count() // QUERY_BLOCK))
    parts = []
    for block in range(n_blocks):
        mine = queries.filter(F.pmod(F.xxhash64("vec_id"), F.lit(n_blocks)) == block).select("vec_id", "vector").toArrow()
        vectors = [c.flatten().to_numpy() for c in mine.column("vector").chunks]
        matrix = np.concatenate(vectors).reshape(mine.num_rows, -1) if mine.num_rows else np.zeros((0, len(codes.mean)))
        shared = spark.sparkContext.broadcast((mine.column("vec_id").to_numpy(), matrix.astype(np.float64)))
        near = base.mapInArrow(_answer(codes, k, shared), "query_id long, vec_id long, score double")
        near = near.groupBy("query_id", "vec_id").agg(F.min("score").alias("score"))
        place = F.row_number().over(Window.partitionBy("query_id").orderBy("score", "vec_id"))
        best = near.withColumn("rank", place).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
        parts.append(written(best, "neighbours"))
        shared.destroy()
    return reduce(DataFrame.unionByName, parts)


def nearest(vectors: DataFrame, is_query: Column, k: int = 10, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """(query_id, rank, vec_id, score): Euclidean distance of the k nearest found of each query to all other rows.

    A task whose radius holds fewer than k ids goes through all its vectors, so every query gets
    k neighbours, or all candidates if they are fewer.  Vectors that are null, empty, all zero or hold null or
    non-finite components take no part, nor do rows with a null id or of another length
    than most vectors have (of equally common lengths, the smallest).  Rows that repeat an
    id are one candidate, and one query, with the smallest distance.  Equal distances go
    to smaller ids.  Without queries or candidates the result is empty.
    """
    valid = vectors.filter(F.col(key).isNotNull() & takes_part(F.col(vector)))
    length = valid.groupBy(F.size(vector).alias("d")).count().orderBy(F.desc("count"), "d").first()
    valid = valid.filter(F.size(vector) == (length["d"] if length else 0))
    base = valid.select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    queries = valid.filter(is_query).select(F.col(key).cast("long").alias("vec_id"), F.col(vector).alias("vector"))
    sample = base.orderBy(F.xxhash64("vec_id"), "vec_id").limit(SAMPLE).select("vector").toArrow().column("vector")
    if length is None:
        return queries.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    flat = np.concatenate([c.flatten().to_numpy() for c in sample.chunks]).astype(np.float64)
    codes = Codes.learn(flat.reshape(len(sample), -1), k)
    return _search(queries, base, codes, k)
