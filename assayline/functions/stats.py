"""Tail probabilities for the paired tests.

Everything up to the test statistic is computed with Spark aggregates. Only the tail
probability needs Python, on one row per (suite, evaluator).
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F
from pyspark.sql import types as T


def _beta_fraction(a: float, b: float, x: float) -> float:
    """Continued fraction of the incomplete beta function (modified Lentz)."""
    tiny = 1e-300
    c, d = 1.0, 1.0 - (a + b) * x / (a + 1.0)
    d = 1.0 / (d if abs(d) > tiny else tiny)
    h = d
    for m in range(1, 10_000):
        for numerator in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 + numerator * d
            d = 1.0 / (d if abs(d) > tiny else tiny)
            c = 1.0 + numerator / c
            c = c if abs(c) > tiny else tiny
            step = c * d
            h *= step
        if abs(step - 1.0) < 1e-15:
            break
    return h


def regularized_beta(x: float, a: float, b: float) -> float:
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b)
        + a * math.log(x) + b * math.log1p(-x)
    )
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


def t_two_sided(t: float, freedom: float) -> float:
    """P(|T| >= |t|) of Student's t."""
    if math.isnan(t):
        return math.nan
    if math.isinf(t):
        return 0.0
    return regularized_beta(freedom / (freedom + t * t), freedom / 2.0, 0.5)


def normal_two_sided(z: float) -> float:
    return math.erfc(abs(z) / math.sqrt(2.0))


def signed_rank_tail(n: int) -> np.ndarray:
    """P(W <= w) for w = 0 .. n(n+1)/2 under the null, without ties."""
    counts = np.zeros(n * (n + 1) // 2 + 1)
    counts[0] = 1.0
    for rank in range(1, n + 1):
        counts[rank:] += counts[:-rank].copy()
    return np.cumsum(counts) / 2.0**n


def signed_rank_two_sided(
    w: float, n: int, tie_term: float, tails: dict[int, np.ndarray] | None = None
) -> float:
    """Exact when no |difference| is tied, else the normal approximation.

    ``tails`` keeps the distributions that a caller has needed so far.
    """
    if tie_term == 0:
        tails = {} if tails is None else tails
        if n not in tails:
            tails[n] = signed_rank_tail(n)
        return min(1.0, 2.0 * float(tails[n][int(w)]))
    mean = n * (n + 1) / 4.0
    variance = (n * (n + 1) * (2 * n + 1) - tie_term / 2.0) / 24.0
    return normal_two_sided((w - mean) / math.sqrt(variance))


def paired_p_value(
    is_t_test: Column, t: Column, freedom: Column, w: Column, n: Column, tie_term: Column
) -> Column:
    """p-value of whichever test applies to the row, in one Python call per batch."""

    @F.pandas_udf(T.DoubleType())
    def p_value(
        use_t: pd.Series, t: pd.Series, freedom: pd.Series,
        w: pd.Series, n: pd.Series, tie: pd.Series,
    ) -> pd.Series:
        tails: dict[int, np.ndarray] = {}
        out = [
            t_two_sided(t_, f_) if u
            else (signed_rank_two_sided(w_, int(n_), tie_, tails) if n_ >= 2 else 1.0)
            for u, t_, f_, w_, n_, tie_ in zip(use_t, t, freedom, w, n, tie)
        ]
        return pd.Series(out, dtype="float64")

    return p_value(is_t_test, t, freedom, w, n, tie_term)
