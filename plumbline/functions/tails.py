"""Tail probabilities for result rows; no statistics package is needed."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T

from plumbline.fixed_values import (
    UNIT_ROOT_LARGE_P,
    UNIT_ROOT_MAX,
    UNIT_ROOT_MIN,
    UNIT_ROOT_SMALL_P,
    UNIT_ROOT_SPLIT,
)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta by its continued fraction, all elements at once."""
    a, b, x = (np.asarray(v, dtype=float) for v in (a, b, x))
    mirrored = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(mirrored, b, a), np.where(mirrored, a, b), np.where(mirrored, 1 - x, x)
    z = np.clip(z, 0.0, 1.0)
    lgamma = np.vectorize(math.lgamma, otypes=[float])
    with np.errstate(divide="ignore"):
        front = np.exp(
            lgamma(p + q) - lgamma(p) - lgamma(q) + p * np.log(z) + q * np.log1p(-z)
        ) / p
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    h = d.copy()
    for m in range(1, 400):
        for top in (
            m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)),
            -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1)),
        ):
            d = 1 + top * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + top / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            h = h * d * c
        if np.all(np.abs(d * c - 1) < 1e-14):
            break
    value = front * h
    return np.clip(np.where(mirrored, 1 - value, value), 0.0, 1.0)


def student_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    """P(|T| ≥ |t|) with ``df`` degrees of freedom; nan where df ≤ 0."""
    t, df = np.asarray(t, dtype=float), np.asarray(df, dtype=float)
    ok = (df > 0) & ~np.isnan(t)
    safe = np.where(ok, df, 1.0)
    finite = np.where(ok & np.isfinite(t), t, 0.0)
    tail = incomplete_beta(safe / 2, np.full_like(safe, 0.5), safe / (safe + finite * finite))
    return np.where(ok, np.where(np.isinf(t), 0.0, tail), np.nan)


def normal_cdf(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


def unit_root_p(t: float) -> float:
    """Asymptotic p-value of the unit-root t statistic with a constant."""
    if t > UNIT_ROOT_MAX:
        return 1.0
    if t < UNIT_ROOT_MIN:
        return 0.0
    coefficients = UNIT_ROOT_SMALL_P if t <= UNIT_ROOT_SPLIT else UNIT_ROOT_LARGE_P
    return normal_cdf(sum(c * t**i for i, c in enumerate(coefficients)))


@F.pandas_udf(T.DoubleType())
def _root_p(t: pd.Series) -> pd.Series:
    return t.map(lambda v: 1.0 if pd.isna(v) else unit_root_p(float(v))).astype(float)


def root_p(t: Column) -> Column:
    """p-value column of the unit-root statistic, 1 where there is none; for result rows."""
    return _root_p(t.cast("double"))


@F.pandas_udf(T.DoubleType())
def _student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    p = pd.Series(student_two_sided(t.to_numpy(dtype=float), df.to_numpy(dtype=float)))
    return p.where(p.notna(), None)


def student_p(t: Column, df: Column) -> Column:
    """Two-sided p-value column; meant for result rows, not for facts."""
    return _student_p(t.cast("double"), df.cast("double"))


def correlation_p(r: Column, n: Column) -> Column:
    """p-value of a correlation over n pairs."""
    r = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), r))
    rest = 1 - r * r
    t = F.when(rest > 0, r * F.sqrt((n - 2) / F.nullif(rest, F.lit(0.0)))).otherwise(F.lit(float("inf")))
    return student_p(F.when(n > 2, t), F.when(n > 2, n - 2))
