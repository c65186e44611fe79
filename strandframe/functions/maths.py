"""Scaling, interval distance, and the special functions that Spark lacks."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType


def _over(by: list[str] | None):
    return Window.partitionBy(*(by or []))


def min_max(c: str, by: list[str] | None = None, top: float = 1.0) -> Column:
    """(x - min) / (max - min) * top within groups; zeros where all are equal."""
    low, high = F.min(c).over(_over(by)), F.max(c).over(_over(by))
    return F.when(F.col(c).isNotNull(), F.coalesce(F.try_divide(F.col(c) - low, high - low), F.lit(0.0))) * top


def linear(m, x, b) -> Column:
    return F.lit(m) * x + F.lit(b) if not isinstance(m, Column) else m * x + b


def exponential(x: Column, a: float, b: float, c: float) -> Column:
    """a * e**(-b x) + c."""
    return F.lit(a) * F.exp(-F.lit(b) * x) + F.lit(c)


def shortest_distance(s1, e1, s2, e2) -> Column:
    """0 for intervals that touch or overlap, else the gap between them."""
    s1, e1, s2, e2 = (F.col(x) if isinstance(x, str) else x for x in (s1, e1, s2, e2))
    return F.when((e1 >= s2) & (e2 >= s1), F.lit(0)).otherwise(F.least(F.abs(s1 - e2), F.abs(s2 - e1)))


def log2_ratio(a: Column, b: Column) -> Column:
    return F.log2(F.try_divide(a, b))


# ---- special functions, vectorised ---------------------------------------------------------------------


def _log_gamma(x: np.ndarray) -> np.ndarray:
    return np.vectorize(math.lgamma, otypes=[float])(x)


def incomplete_beta(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by its continued fraction (Lentz)."""
    a, b, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(b, float), np.asarray(x, float))
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    tiny = 1e-300
    c = np.ones_like(z)
    d = 1 - (p + q) * z / (p + 1)
    d = 1 / np.where(np.abs(d) < tiny, tiny, d)
    f = d.copy()
    for m in range(1, 300):
        for num in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / np.where(np.abs(d) < tiny, tiny, d)
            c = 1 + num / c
            c = np.where(np.abs(c) < tiny, tiny, c)
            f = f * c * d
    with np.errstate(divide="ignore", invalid="ignore"):
        front = np.exp(_log_gamma(p + q) - _log_gamma(p) - _log_gamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
    out = np.where(z <= 0, 0.0, front * f)
    return np.clip(np.where(swap, 1 - out, out), 0, 1)


def upper_gamma(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function: a series below a + 1, a continued fraction above."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    out = np.ones(x.shape)
    low = (x > 0) & (x < a + 1)
    if low.any():
        p, z = a[low], x[low]
        term = 1 / p
        total = term.copy()
        for n in range(1, 500):
            term = term * z / (p + n)
            total = total + term
        out[low] = 1 - total * np.exp(-z + p * np.log(z) - _log_gamma(p))
    high = x >= a + 1
    if high.any():
        p, z = a[high], x[high]
        b = z + 1 - p
        c = np.full_like(z, 1e300)
        d = 1 / b
        h = d.copy()
        for i in range(1, 500):
            k = -i * (i - p)
            b = b + 2
            d = k * d + b
            d = 1 / np.where(np.abs(d) < 1e-300, 1e-300, d)
            c = b + k / c
            c = np.where(np.abs(c) < 1e-300, 1e-300, c)
            h = h * d * c
        out[high] = np.exp(-z + p * np.log(z) - _log_gamma(p)) * h
    return np.clip(out, 0, 1)


@F.pandas_udf(DoubleType())
def student_t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(|T| >= |t|); null where t or df is missing or df is not positive."""
    v, n = t.to_numpy(float), df.to_numpy(float)
    ok = ~np.isnan(v) & (n > 0)
    out = np.full(len(v), np.nan)
    if ok.any():
        with np.errstate(over="ignore"):
            out[ok] = incomplete_beta(n[ok] / 2, 0.5, n[ok] / (n[ok] + np.minimum(np.abs(v[ok]), 1e150) ** 2))
    return pd.Series(out).astype(object).where(ok, None)


@F.pandas_udf(DoubleType())
def chi_square_upper(x: pd.Series, df: pd.Series) -> pd.Series:
    """P(X >= x) of a chi-square variable."""
    v, n = x.to_numpy(float), df.to_numpy(float)
    ok = ~np.isnan(v) & (n > 0)
    out = np.full(len(v), np.nan)
    if ok.any():
        out[ok] = upper_gamma(n[ok] / 2, v[ok] / 2)
    return pd.Series(out).astype(object).where(ok, None)
