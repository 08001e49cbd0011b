"""Tail probabilities as vectorised UDFs for rows that are already aggregated.

There is one row per test, not per observation, so the Python cost does not grow with
the data behind a test. Textbook forms: complementary error function, and the continued
fractions of the regularised incomplete beta and gamma functions.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql.functions import pandas_udf
from pyspark.sql.types import DoubleType

_TINY = 1e-300
# Far beyond what the fractions need (about the root of the largest parameter); nothing is returned unsettled.
_ROUNDS = 5_000_000


def _each(fn, *series: pd.Series) -> pd.Series:
    cols = [np.asarray(s, dtype=float) for s in series]
    out = [fn(*row) if all(map(math.isfinite, row)) else math.nan for row in zip(*cols)]
    return pd.Series([None if math.isnan(x) else x for x in out], dtype="float64")


def beta_regularised(a: float, b: float, x: float) -> float:
    """I_x(a, b) by Lentz's evaluation of the continued fraction."""
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1.0) / (a + b + 2.0):
        return 1.0 - beta_regularised(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)) / a
    c, d = 1.0, 1.0 / (1.0 - (a + b) * x / (a + 1.0))
    total = d
    for m in range(1, _ROUNDS):
        before = total
        for step in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + step * d
            d = 1.0 / (d if abs(d) > _TINY else _TINY)
            c = 1.0 + step / c
            c = c if abs(c) > _TINY else _TINY
            total *= c * d
        if abs(total - before) <= 1e-16 * abs(total):
            return front * total
    return math.nan


def gamma_upper(a: float, x: float) -> float:
    """Q(a, x): series below a + 1, continued fraction above."""
    if x <= 0.0:
        return 1.0
    scale = math.exp(a * math.log(x) - x - math.lgamma(a))
    if x < a + 1.0:
        term = total = 1.0 / a
        for k in range(1, _ROUNDS):
            term *= x / (a + k)
            total += term
            if term < total * 1e-17:
                return 1.0 - scale * total
        return math.nan
    b = x + 1.0 - a
    c, d = 1.0 / _TINY, 1.0 / b
    total = d
    for k in range(1, _ROUNDS):
        before = total
        step = -k * (k - a)
        b += 2.0
        d = step * d + b
        d = 1.0 / (d if abs(d) > _TINY else _TINY)
        c = b + step / c
        c = c if abs(c) > _TINY else _TINY
        total *= d * c
        if abs(total - before) <= 1e-16 * abs(total):
            return scale * total
    return math.nan


def t_upper(t: float, df: float) -> float:
    if df <= 0:
        return math.nan
    half = 0.5 * beta_regularised(df / 2.0, 0.5, df / (df + t * t))
    return half if t >= 0 else 1.0 - half


def exact_u_upper(u: float, n1: float, n2: float) -> float:
    """P(U >= u) without ties.

    The chances of U are the coefficients of the Gaussian binomial, built factor by factor
    over the shorter tail only (the distribution is symmetric): the factor ``(1 - x^(large +
    i)) / (1 - x^i)`` is a difference and a running sum along each residue, divided by its
    share of the number of outcomes so that no entry leaves the range of a double.
    """
    small, large = sorted((int(n1), int(n2)))
    top = small * large
    least = max(0, math.ceil(u - 1e-9))
    if least == 0:
        return 1.0
    if least > top:
        return 0.0
    lower = least > top - least + 1  # P(U >= least) = P(U <= top - least)
    size = (top - least if lower else least - 1) + 1
    chance = np.zeros(size)
    chance[0] = 1.0
    for i in range(1, small + 1):
        if large + i < size:
            chance[large + i:] -= chance[:size - large - i].copy()
        rows = -(-size // i)
        padded = np.zeros(rows * i)
        padded[:size] = chance
        chance = padded.reshape(rows, i).cumsum(axis=0).ravel()[:size] * (i / (large + i))
    tail = min(1.0, max(0.0, float(chance.sum())))
    return tail if lower else 1.0 - tail


@pandas_udf(DoubleType())
def normal_sf(z: pd.Series) -> pd.Series:
    """P(Z > z)."""
    return _each(lambda v: 0.5 * math.erfc(v / math.sqrt(2.0)), z)


@pandas_udf(DoubleType())
def t_sf(t: pd.Series, df: pd.Series) -> pd.Series:
    """P(T > t) with ``df`` degrees of freedom."""
    return _each(t_upper, t, df)


@pandas_udf(DoubleType())
def t_two_sided(t: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda v, d: beta_regularised(d / 2.0, 0.5, d / (d + v * v)) if d > 0 else math.nan, t, df)


@pandas_udf(DoubleType())
def f_sf(f: pd.Series, d1: pd.Series, d2: pd.Series) -> pd.Series:
    return _each(lambda v, a, b: beta_regularised(b / 2.0, a / 2.0, b / (b + a * v)) if min(a, b) > 0 else math.nan, f, d1, d2)


@pandas_udf(DoubleType())
def chi2_sf(x: pd.Series, df: pd.Series) -> pd.Series:
    return _each(lambda v, d: gamma_upper(d / 2.0, v / 2.0) if d > 0 else math.nan, x, df)


@pandas_udf(DoubleType())
def u_exact_sf(u: pd.Series, n1: pd.Series, n2: pd.Series) -> pd.Series:
    """Exact upper tail of the U statistic for small groups without ties."""
    return _each(exact_u_upper, u, n1, n2)
