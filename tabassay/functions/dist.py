"""Distribution functions without SciPy: vectorised, and as Arrow-batched column functions."""

from __future__ import annotations

import math
from functools import lru_cache

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType

_lgamma = np.vectorize(math.lgamma, otypes=[float])


def betainc(a: np.ndarray, b: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised incomplete beta function by Lentz's continued fraction."""
    a, b, x = np.broadcast_arrays(*(np.asarray(v, float) for v in (a, b, x)))
    x = np.clip(x, 0, 1)
    swap = x > (a + 1) / (a + b + 2)
    p, q, z = np.where(swap, b, a), np.where(swap, a, b), np.where(swap, 1 - x, x)
    with np.errstate(all="ignore"):
        front = np.exp(_lgamma(p + q) - _lgamma(p) - _lgamma(q) + p * np.log(z) + q * np.log1p(-z)) / p
        tiny = 1e-300
        c = np.ones_like(z)
        d = 1 - (p + q) * z / (p + 1)
        d = 1 / np.where(np.abs(d) < tiny, tiny, d)
        f = d.copy()
        for m in range(1, 300):
            for step in (m * (q - m) * z / ((p + 2 * m - 1) * (p + 2 * m)), -(p + m) * (p + q + m) * z / ((p + 2 * m) * (p + 2 * m + 1))):
                d = 1 + step * d
                d = 1 / np.where(np.abs(d) < tiny, tiny, d)
                c = 1 + step / c
                c = np.where(np.abs(c) < tiny, tiny, c)
                f = f * c * d
            if np.all(np.abs(c * d - 1) < 1e-15):
                break
        out = np.where(z <= 0, 0.0, front * f)
    return np.where(swap, 1 - out, out)


def gammaincc(a: np.ndarray, x: np.ndarray) -> np.ndarray:
    """Regularised upper incomplete gamma function."""
    a, x = np.broadcast_arrays(np.asarray(a, float), np.asarray(x, float))
    with np.errstate(all="ignore"):
        lead = np.exp(a * np.log(x) - x - _lgamma(a))
        term = total = 1 / a
        for k in range(1, 500):
            term = term * x / (a + k)
            total = total + term
        low = 1 - lead * total
        frac = np.zeros_like(x)
        for k in range(200, 0, -1):
            frac = k * (k - a) / (x + 2 * k + 1 - a - frac)
        high = lead / (x + 1 - a - frac)
    return np.where(x <= 0, 1.0, np.where(x < a + 1, low, high))


def t_two_sided(t: np.ndarray, df: np.ndarray) -> np.ndarray:
    t, df = np.asarray(t, float), np.asarray(df, float)
    return betainc(df / 2, 0.5, df / (df + t * t))


def f_upper(f: np.ndarray, d1: np.ndarray, d2: np.ndarray) -> np.ndarray:
    f, d1, d2 = (np.asarray(v, float) for v in (f, d1, d2))
    return betainc(d2 / 2, d1 / 2, d2 / (d2 + d1 * f))


def chi2_upper(x: np.ndarray, df: np.ndarray) -> np.ndarray:
    return gammaincc(np.asarray(df, float) / 2, np.asarray(x, float) / 2)


def normal_upper(z: np.ndarray) -> np.ndarray:
    return np.vectorize(lambda v: 0.5 * math.erfc(v / math.sqrt(2)), otypes=[float])(np.asarray(z, float))


@lru_cache(maxsize=4096)
def t_quantile(p: float, df: float) -> float:
    """Quantile of Student's t by bisection on the two-sided tail; p at least one half."""
    lo, hi = 0.0, 1e7
    for _ in range(200):
        mid = (lo + hi) / 2
        if float(t_two_sided(mid, df)) / 2 > 1 - p:
            lo = mid
        else:
            hi = mid
    return (lo + hi) / 2


@lru_cache(maxsize=4096)
def _u_counts(n1: int, n2: int) -> tuple[float, ...]:
    """Number of arrangements with each rank-sum statistic, by the recurrence over the largest observation."""
    if n1 == 0 or n2 == 0:
        return (1.0,)
    out = np.zeros(n1 * n2 + 1)
    a, b = _u_counts(n1 - 1, n2), _u_counts(n1, n2 - 1)
    out[n2 : n2 + len(a)] += a
    out[: len(b)] += b
    return tuple(out)


def mann_whitney_p(u: float, n1: int, n2: int, ties: float) -> float:
    """Two-sided p: exact without ties if a sample has at most 8, else normal with tie and continuity correction.

    ties is the sum of t**3 - t over the pooled groups of equal values.
    """
    most = max(u, n1 * n2 - u)
    if ties == 0 and min(n1, n2) <= 8:
        counts = _u_counts(n1, n2)
        return float(min(1.0, 2 * sum(counts[math.ceil(most) :]) / sum(counts)))
    n = n1 + n2
    var = n1 * n2 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return float(min(1.0, 2 * normal_upper((most - n1 * n2 / 2 - 0.5) / math.sqrt(var))))


@F.pandas_udf(DoubleType())
def p_t(t: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(t_two_sided(t, df)).where(t.notna() & (df > 0))


@F.pandas_udf(DoubleType())
def p_f(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return pd.Series(f_upper(f, d1, d2)).where(f.notna() & (d2 > 0))


@F.pandas_udf(DoubleType())
def p_chi2(x: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series(chi2_upper(x, df)).where(x.notna() & (df > 0))


@F.pandas_udf(DoubleType())
def t_critical(p: pd.Series, df: pd.Series) -> pd.Series:
    return pd.Series([t_quantile(float(a), float(b)) if b > 0 else None for a, b in zip(p, df, strict=True)], dtype=float)


@F.pandas_udf(DoubleType())
def p_mann_whitney(u: pd.Series, n1: pd.Series, n2: pd.Series, ties: pd.Series) -> pd.Series:
    return pd.Series([mann_whitney_p(*x) for x in zip(u, n1.astype(int), n2.astype(int), ties, strict=True)], dtype=float)


def _poly(coefficients: tuple[float, ...], x: float) -> float:
    return sum(c * x**i for i, c in enumerate(coefficients))


def normal_quantile(p: float) -> float:
    lo, hi = -40.0, 40.0
    for _ in range(200):
        mid = (lo + hi) / 2
        lo, hi = (mid, hi) if float(normal_upper(mid)) > 1 - p else (lo, mid)
    return (lo + hi) / 2


# Polynomial coefficients of Royston (1995), Applied Statistics 44, algorithm AS R94, lowest power first.
_A_LAST = (0.0, 0.221157, -0.147981, -2.071190, 4.434685, -2.706056)
_A_NEXT = (0.0, 0.042981, -0.293762, -1.752461, 5.682633, -3.582633)
_SMALL_MEAN = (0.5440, -0.39978, 0.025054, -6.714e-4)
_SMALL_SD = (1.3822, -0.77857, 0.062767, -0.0020322)
_LARGE_MEAN = (-1.5861, -0.31082, -0.083751, 0.0038915)
_LARGE_SD = (-0.4803, -0.082676, 0.0030302)
_GAMMA = (-2.273, 0.459)


def shapiro_wilk(values: np.ndarray) -> tuple[float, float]:
    """W and its p-value for 3 or more values; a constant sample has W 1 and p 1."""
    x = np.sort(np.asarray(values, float))
    n = len(x)
    if n < 3:
        raise ValueError("at least 3 values are needed")
    if x[-1] == x[0]:
        return 1.0, 1.0
    m = np.array([normal_quantile((i - 0.375) / (n + 0.25)) for i in range(1, n + 1)])
    if n == 3:
        a = np.array([-math.sqrt(0.5), 0.0, math.sqrt(0.5)])
    else:
        u, mm = 1 / math.sqrt(n), float(m @ m)
        a = m / math.sqrt(mm)
        last = a[-1] + _poly(_A_LAST, u)
        if n <= 5:
            rest = math.sqrt((mm - 2 * m[-1] ** 2) / (1 - 2 * last**2))
            a = m / rest
        else:
            nxt = a[-2] + _poly(_A_NEXT, u)
            rest = math.sqrt((mm - 2 * m[-1] ** 2 - 2 * m[-2] ** 2) / (1 - 2 * last**2 - 2 * nxt**2))
            a = m / rest
            a[-2], a[1] = nxt, -nxt
        a[-1], a[0] = last, -last
    w = min(1.0, float(a @ x) ** 2 / float(((x - x.mean()) ** 2).sum()))
    if n == 3:
        return w, max(0.0, min(1.0, 6 / math.pi * (math.asin(math.sqrt(w)) - math.asin(math.sqrt(0.75)))))
    if w == 1.0:
        return w, 1.0
    y = math.log(1 - w)
    if n <= 11:
        gamma = _poly(_GAMMA, n)
        if y >= gamma:
            return w, 0.0
        y, mean, sd = -math.log(gamma - y), _poly(_SMALL_MEAN, n), math.exp(_poly(_SMALL_SD, n))
    else:
        k = math.log(n)
        mean, sd = _poly(_LARGE_MEAN, k), math.exp(_poly(_LARGE_SD, k))
    return w, float(normal_upper((y - mean) / sd))
