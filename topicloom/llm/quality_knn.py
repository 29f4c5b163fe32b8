"""Quality by votes of the nearest labelled documents in a latent-semantic space.

A document is a bag of hashed byte trigrams and a few terms for its shape.  A bounded
sample of labelled documents gives the term weights, the latent space (truncated singular
value decomposition) and the labelled vectors; these are broadcast.  Every document is
projected, compared to all labelled vectors by exact cosine products in blocks, and scored
by its nearest neighbours' labels, weighted by similarity.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import Broadcast
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from topicloom.llm.common import text_udf

GRAMS = 1024
LATENT = 48
#: Labelled documents in the sample, at most: those first by a hash of their key.
LABELLED = 5000
NEIGHBOURS = 15
BLOCK = 256
#: Steps of each shape measure; a document has one term per measure.
SHAPES = {"symbols": 8, "upper": 8, "marks": 8, "distinct": 10, "repeats": 10}
TERMS = GRAMS + sum(SHAPES.values())


def _steps(share: float, n: int) -> int:
    return min(n - 1, int(share * n))


def shape(raw: bytes) -> list[int]:
    """The term of each shape measure."""
    words = raw.split()
    n, size = max(1, len(words)), max(1, len(raw))
    letters = np.frombuffer(raw, np.uint8)
    symbols = sum(map(raw.count, (b"#", b"*", b"$", b"%", b"&", b"|", b"<", b">")))
    upper = int(np.count_nonzero((letters >= 65) & (letters <= 90)))
    marks = raw.count(b"!") + raw.count(b"?")
    pairs = list(zip(words, words[1:]))
    shares = {
        "symbols": 4 * symbols / n,
        "upper": 4 * upper / size,
        "marks": 2 * marks / n,
        "distinct": len(set(words)) / n,
        "repeats": 1 - len(set(pairs)) / max(1, len(pairs)),
    }
    at, out = GRAMS, []
    for name, steps in SHAPES.items():
        out.append(at + _steps(shares[name], steps))
        at += steps
    return out


def features(texts: list[str | None]) -> np.ndarray:
    """One row of raw term weights per text; null and empty texts are zero."""
    out = np.zeros((len(texts), TERMS), np.float32)
    for i, text in enumerate(texts):
        if not text:
            continue
        raw = text.encode()
        b = np.frombuffer(raw, np.uint8).astype(np.uint32)
        if len(b) > 2:
            keys = (b[:-2] * np.uint32(0x9E3779B1) + b[1:-1] * np.uint32(0x85EBCA6B) + b[2:] * np.uint32(0xC2B2AE35)) >> np.uint32(22)
            row = np.log1p(np.bincount(keys, minlength=GRAMS)).astype(np.float32)
            out[i, :GRAMS] = row / max(1e-9, float(np.linalg.norm(row)))
        out[i, shape(raw)] = 0.5
    return out


@dataclass(frozen=True)
class Voters:
    """Term weights, projection, labelled unit vectors and their labels."""

    weights: np.ndarray
    axes: np.ndarray
    vectors: np.ndarray
    labels: np.ndarray
    prior: float

    @classmethod
    def of(cls, rows: np.ndarray, labels: np.ndarray, latent: int = LATENT) -> "Voters":
        n = len(rows)
        if n == 0:
            return cls(np.zeros(TERMS, np.float32), np.zeros((TERMS, 1), np.float32), np.zeros((0, 1), np.float32), labels, 0.5)
        seen = np.count_nonzero(rows, axis=0)
        weights = np.log((1 + n) / (1 + seen)).astype(np.float32) + np.float32(0.1)
        weighted = rows * weights
        # Truncated decomposition by power iterations from a seeded start.
        basis = np.random.default_rng(0).standard_normal((TERMS, min(latent + 12, n)))
        for _ in range(5):
            basis, _ = np.linalg.qr(weighted.T @ (weighted @ basis))
        small = np.linalg.svd(weighted @ basis, full_matrices=False)[2]
        axes = (basis @ small[:latent].T).astype(np.float32)
        return cls(weights, axes, cls._unit(weighted @ axes), labels.astype(np.float32), float(labels.mean()))

    @staticmethod
    def _unit(rows: np.ndarray) -> np.ndarray:
        return (rows / np.maximum(np.linalg.norm(rows, axis=1, keepdims=True), 1e-9)).astype(np.float32)

    def scores(self, texts: list[str | None], k: int = NEIGHBOURS) -> np.ndarray:
        """Share of label 1 among the neighbours' similarities; the prior without a text or a neighbour."""
        out = np.full(len(texts), self.prior)
        k = min(k, len(self.labels))
        if k == 0:
            return out
        for start in range(0, len(texts), BLOCK):
            rows = features(texts[start : start + BLOCK])
            cosines = self._unit((rows * self.weights) @ self.axes) @ self.vectors.T
            near = np.argpartition(-cosines, k - 1, axis=1)[:, :k]
            votes = np.maximum(np.take_along_axis(cosines, near, 1), 0).astype(np.float64)
            total = votes.sum(1)
            found = (votes * self.labels[near]).sum(1) / np.maximum(total, 1e-12)
            some = (total > 0) & rows.any(1)
            out[start : start + BLOCK][some] = np.clip(found[some], 0, 1)
        return out


def _features_udf():
    def kernel(column: pa.Array) -> pa.Array:
        rows = features(column.to_pylist())
        return pa.array(list(rows.astype("<f4")), pa.list_(pa.float32())) if len(rows) else pa.array([], pa.list_(pa.float32()))

    return text_udf(kernel, "array<float>")


def learn(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", most: int = LABELLED) -> Voters:
    """From at most ``most`` documents with a label in ``labels(key, label)``, those first by a hash of the key.

    The labels are cut to ``most`` first, so only that many rows are broadcast and no text
    is shuffled.  Null labels do not count; a repeated key counts with each of its texts,
    up to ``most`` in all.  The driver gets ``most`` x ``TERMS`` floats.
    """
    first = [F.xxhash64(F.lit(3), F.col(key)), F.col(key)]
    picked = labels.filter("label IS NOT NULL").select(key, "label").orderBy(*first, "label").limit(most)
    rows = docs.select(key, F.col(text).alias("text")).join(F.broadcast(picked), key)
    rows = rows.orderBy(*first, "label", "text").limit(most).withColumn("terms", _features_udf()(F.col("text")))
    found = rows.select("terms", "label").toArrow()
    flat = [c.flatten().to_numpy() for c in found.column("terms").chunks]
    matrix = np.concatenate(flat).reshape(-1, TERMS) if found.num_rows else np.zeros((0, TERMS), np.float32)
    return Voters.of(matrix, found.column("label").to_numpy().astype(np.float64))


def score(docs: DataFrame, voters: Voters, text: str = "text", out: str = "score") -> DataFrame:
    """``docs`` with a score from 0 to 1, higher where label 1 is likelier.

    Whole texts.  Null and empty texts, and all texts if nothing was learned, get the share
    of label 1 among the learned labels (0.5 if none).  Row by row: repeated rows and null
    keys pass through, an input column named like the result is replaced.
    """
    shared: Broadcast = docs.sparkSession.sparkContext.broadcast(voters)

    def kernel(column: pa.Array) -> pa.Array:
        return pa.array(shared.value.scores(column.to_pylist()), pa.float64())

    return docs.withColumn(out, text_udf(kernel, "double")(F.col(text)))
