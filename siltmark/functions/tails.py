"""Tail probabilities that Spark has no built-in for, over small tables of comparisons."""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import functions as F
from pyspark.sql import types as T

EXACT_MAX_N = 50  # larger samples, ties and zeros use the normal tail


def signed_rank_exact(w: float, n: int) -> float:
    """Two-sided p of a signed-rank sum without ties: subsets of 1..n counted by their sum."""
    ways = np.zeros(n * (n + 1) // 2 + 1)
    ways[0] = 1.0
    for r in range(1, n + 1):
        ways[r:] = ways[r:] + ways[:-r].copy()
    low = ways[: int(min(w, n * (n + 1) / 2 - w)) + 1].sum() / 2.0**n
    return min(1.0, 2.0 * low)


def signed_rank_normal(w: float, n: int, ties: float) -> float:
    spread = math.sqrt(n * (n + 1) * (2 * n + 1) / 24.0 - ties / 48.0)
    if spread == 0:
        return 1.0
    return math.erfc(abs(w - n * (n + 1) / 4.0) / spread / math.sqrt(2.0))


def _beta_fraction(a: float, b: float, x: float) -> float:
    # modified Lentz evaluation of the incomplete-beta continued fraction
    tiny, c, d = 1e-300, 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1.0), 1e-300)
    out = d
    for m in range(1, 300):
        for num in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + num * d or tiny)
            c = 1.0 + num / c or tiny
            out *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return out


def student_two_sided(t: float, df: float) -> float:
    """P(|T| >= |t|) = I_x(df/2, 1/2) at x = df / (df + t^2)."""
    if not math.isfinite(t):
        return 0.0
    x, a, b = df / (df + t * t), df / 2.0, 0.5
    if x >= 1.0:
        return 1.0
    front = math.exp(a * math.log(x) + b * math.log1p(-x) + math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b))
    if x < (a + 1.0) / (a + b + 2.0):
        return front * _beta_fraction(a, b, x) / a
    return 1.0 - front * _beta_fraction(b, a, 1.0 - x) / b


@F.pandas_udf(T.DoubleType())
def wilcoxon_p(w_plus: pd.Series, n: pd.Series, ties: pd.Series, zeros: pd.Series) -> pd.Series:
    out = []
    for w, count, tie, zero in zip(w_plus, n, ties, zeros):
        if not count or count != count:
            out.append(1.0)
        elif count <= EXACT_MAX_N and tie == 0 and zero == 0:
            out.append(signed_rank_exact(w, int(count)))
        else:
            out.append(signed_rank_normal(w, int(count), tie))
    return pd.Series(out, dtype="float64")


@F.pandas_udf(T.DoubleType())
def student_p(t: pd.Series, df: pd.Series) -> pd.Series:
    ok = t.notna() & df.notna()
    return pd.Series([student_two_sided(x, d) if k else 1.0 for x, d, k in zip(t, df, ok)], dtype="float64")
