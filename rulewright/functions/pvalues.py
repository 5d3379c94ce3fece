"""Survival functions for the per-feature results (B12): a row for each feature, so Arrow UDFs over a tiny table."""

from __future__ import annotations

import math
from functools import lru_cache

import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Largest smaller sample of the exact Mann-Whitney count; the other sample may have any size.
EXACT_SAMPLE = 8


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1 - (a + b) * x / (a + 1)
    d = 1 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 500):
        for num in (m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)), -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1))):
            d = 1 + num * d
            d = 1 / (d if abs(d) > tiny else tiny)
            c = 1 + num / c
            c = c if abs(c) > tiny else tiny
            h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return h


def beta_inc(a: float, b: float, x: float) -> float:
    """Regularised incomplete beta function."""
    if x <= 0 or x >= 1:
        return float(x >= 1)
    front = math.exp(math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x))
    return front * _beta_fraction(a, b, x) / a if x < (a + 1) / (a + b + 2) else 1 - front * _beta_fraction(b, a, 1 - x) / b


def gamma_sf(a: float, x: float) -> float:
    """Regularised upper incomplete gamma function."""
    if x <= 0:
        return 1.0
    front = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1:
        term = total = 1 / a
        n = a
        while abs(term) > abs(total) * 1e-17:
            n += 1
            term *= x / n
            total += term
        return 1 - total * front
    tiny = 1e-300
    b, c = x + 1 - a, 1 / tiny
    d = 1 / b
    h = d
    for i in range(1, 10_000):
        num = -i * (i - a)
        b += 2
        d = num * d + b
        d = 1 / (d if abs(d) > tiny else tiny)
        c = b + num / c
        c = c if abs(c) > tiny else tiny
        h *= d * c
        if abs(d * c - 1) < 1e-16:
            break
    return front * h


def chi2_sf(stat: float, df: float) -> float:
    return math.erfc(math.sqrt(stat / 2)) if df == 1 else gamma_sf(df / 2, stat / 2)


def pearson_p(r: float, n: int) -> float | None:
    """Two-sided p of a correlation; 1 for two rows, none for fewer or for an undefined r."""
    if n < 2 or r is None or math.isnan(r):
        return None
    if n == 2:
        return 1.0
    r = max(-1.0, min(1.0, r))
    # r has a beta law on (-1, 1) under independence; the tail beyond |r| on either side
    return beta_inc(n / 2 - 1, 0.5, 1 - r * r)


@lru_cache(EXACT_SAMPLE)
def _partition_numerator(m: int) -> tuple[int, list[int]]:
    """(L, N) with sum over k of (number of partitions of at most k into at most m parts) q^k = N(q) / (1 - q^L)^(m + 1)."""
    period = math.lcm(*range(1, m + 1))
    poly = [1] + [0] * ((m + 1) * period)
    for part in (1, *range(1, m + 1)):  # times (1 - q^L) / (1 - q^part)
        for k in range(len(poly) - 1, period - 1, -1):
            poly[k] -= poly[k - period]
        for k in range(part, len(poly)):
            poly[k] += poly[k - part]
    return period, poly


def _partitions(k: int, m: int) -> int:
    """Number of partitions of the numbers 0 to k into at most m parts, for any k."""
    period, poly = _partition_numerator(m)
    return sum(poly[j] * math.comb((k - j) // period + m, m) for j in range(k % period, min(k, len(poly) - 1) + 1, period)) if k >= 0 else 0


def mwu_orders(u: int, m: int, n: int) -> int:
    """Number of orders of m and n untied values whose U is at most u.

    They are the partitions of 0 to u into at most m parts of at most n, whose generating function is that of unbounded parts times
    (1 - q^(n + 1)) .. (1 - q^(n + m)); so the time depends on m alone and all is in whole numbers.
    """
    shifts = {0: 1}
    for i in range(1, m + 1):
        for at, sign in list(shifts.items()):
            shifts[at + n + i] = shifts.get(at + n + i, 0) - sign
    return sum(sign * _partitions(u - at, m) for at, sign in shifts.items() if sign)


def mwu_p(u1: float, n1: int, n0: int, ties: float) -> float | None:
    """Two-sided p of Mann-Whitney's U; ``ties`` is the sum of t^3 - t over groups of equal values.

    Exact when a sample has at most 8 values and nothing is tied, whatever the other's size, else normal with tie and continuity correction.
    """
    if not n1 or not n0:
        return None
    u = max(u1, n1 * n0 - u1)
    if min(n1, n0) <= EXACT_SAMPLE and not ties:
        m, n = sorted((n1, n0))
        return min(1.0, 2 * mwu_orders(m * n - math.ceil(u), m, n) / math.comb(m + n, m))
    n = n1 + n0
    var = n1 * n0 / 12 * (n + 1 - ties / (n * (n - 1)))
    if var <= 0:
        return 1.0
    return min(1.0, math.erfc((u - n1 * n0 / 2 - 0.5) / math.sqrt(var) / math.sqrt(2)))


def _each(f, *cols: pd.Series) -> pd.Series:
    return pd.Series([None if any(pd.isna(v) for v in row) else f(*row) for row in zip(*cols)], dtype="float64")


@F.pandas_udf(T.DoubleType())
def pearson_p_value(r: pd.Series, n: pd.Series) -> pd.Series:
    return _each(lambda a, b: pearson_p(a, int(b)), r, n)


@F.pandas_udf(T.DoubleType())
def mwu_p_value(u: pd.Series, n1: pd.Series, n0: pd.Series, ties: pd.Series) -> pd.Series:
    return _each(lambda a, b, c, d: mwu_p(a, int(b), int(c), d), u, n1, n0, ties)


@F.pandas_udf(T.DoubleType())
def chi2_p_value(stat: pd.Series, df: pd.Series) -> pd.Series:
    return _each(chi2_sf, stat, df)
