"""Random draws as functions of (seed, stage, row keys), never of partitioning."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

TWO_32 = 4294967296.0


def hash_uniform(seed: int, stage: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from an md5 of the seed, the stage and the row keys."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    text = F.concat_ws("|", F.lit(f"{seed}|{stage}"), *[c.cast("string") for c in cols])
    word = F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("double")
    return (word + F.lit(0.5)) / F.lit(TWO_32)


def quick_uniform(seed: int, stage: str, *keys: Column | str) -> Column:
    """Uniform in (0, 1) from Spark's 64-bit hash: cheaper, for draws made once per token and sweep."""
    cols = [F.col(k) if isinstance(k, str) else k for k in keys]
    word = F.shiftrightunsigned(F.xxhash64(F.lit(f"{seed}|{stage}"), *cols), 11).cast("double")
    return (word + F.lit(0.5)) * F.lit(2.0**-53)


def hash_gamma_100(seed: int, stage: str, *keys: Column | str) -> Column:
    """Gamma(100, 1/100) draw: Wilson-Hilferty cube of a Box-Muller normal."""
    u1 = hash_uniform(seed, stage + ":a", *keys)
    u2 = hash_uniform(seed, stage + ":b", *keys)
    normal = F.sqrt(F.lit(-2.0) * F.ln(u1)) * F.cos(F.lit(2.0 * math.pi) * u2)
    root = F.lit(1.0 - 1.0 / 900.0) + normal / F.lit(30.0)
    return root * root * root


def _mix(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def np_uniform(seed: int, stage: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Counter-based uniforms in (0, 1) for kernels, keyed by (seed, stage, a, b)."""
    with np.errstate(over="ignore"):
        step = np.uint64(0x9E3779B97F4A7C15)
        head = _mix(np.full(1, (seed * 1000003 + stage) % (1 << 64), dtype=np.uint64) + step)
        x = _mix(head + np.asarray(a).astype(np.int64).view(np.uint64) * step)
        x = _mix(x + np.asarray(b).astype(np.int64).view(np.uint64) * step + step)
    return ((x >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53


def driver_generator(seed: int, *stage: int) -> np.random.Generator:
    """Generator for the few scalar draws a training loop makes on the driver."""
    return np.random.default_rng([seed, *stage])
