"""Digamma and log-gamma as Column expressions and as NumPy functions.

Both shift the argument up by six and use the asymptotic series, so a column and
a kernel agree to the last few bits.
"""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

SHIFT = 6
HALF_LOG_TWO_PI = 0.5 * math.log(2.0 * math.pi)


def digamma(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    r = F.lit(1.0) / (y * y)
    series = r * (
        F.lit(1.0 / 12)
        - r * (F.lit(1.0 / 120) - r * (F.lit(1.0 / 252) - r * (F.lit(1.0 / 240) - r * F.lit(1.0 / 132))))
    )
    out = F.ln(y) - F.lit(0.5) / y - series
    for i in range(SHIFT):
        out = out - F.lit(1.0) / (x + F.lit(float(i)))
    return out


def lgamma(x: Column) -> Column:
    y = x + F.lit(float(SHIFT))
    r = F.lit(1.0) / (y * y)
    series = (F.lit(1.0 / 12) - r * (F.lit(1.0 / 360) - r * (F.lit(1.0 / 1260) - r * F.lit(1.0 / 1680)))) / y
    product = x
    for i in range(1, SHIFT):
        product = product * (x + F.lit(float(i)))
    return (y - F.lit(0.5)) * F.ln(y) - y + F.lit(HALF_LOG_TWO_PI) + series - F.ln(product)


def np_digamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    y = x + SHIFT
    r = 1.0 / (y * y)
    series = r * (1 / 12 - r * (1 / 120 - r * (1 / 252 - r * (1 / 240 - r / 132))))
    out = np.log(y) - 0.5 / y - series
    for i in range(SHIFT):
        out -= 1.0 / (x + i)
    return out


def np_lgamma(x: np.ndarray) -> np.ndarray:
    x = np.asarray(x, dtype=np.float64)
    y = x + SHIFT
    r = 1.0 / (y * y)
    series = (1 / 12 - r * (1 / 360 - r * (1 / 1260 - r / 1680))) / y
    product = x.copy()
    for i in range(1, SHIFT):
        product *= x + i
    return (y - 0.5) * np.log(y) - y + HALF_LOG_TWO_PI + series - np.log(product)


def np_dirichlet_expectation(a: np.ndarray) -> np.ndarray:
    """Row-wise digamma(a) - digamma(sum a)."""
    return np_digamma(a) - np_digamma(a.sum(axis=1))[:, None]
