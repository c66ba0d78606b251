"""Tail probabilities for result rows.

Spark has no t, F, normal or rank-statistic distribution.  A test result is one
row per test, so these run as Arrow-batched UDFs after all aggregation is done.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

_TINY = 1e-300


def regularised_beta(a: float, b: float, x: float) -> float:
    """I_x(a, b) by the modified Lentz continued fraction."""
    if not (math.isfinite(a) and math.isfinite(b) and math.isfinite(x)) or a <= 0 or b <= 0:
        return math.nan
    if x <= 0.0:
        return 0.0
    if x >= 1.0:
        return 1.0
    if x > (a + 1) / (a + b + 2):
        return 1.0 - regularised_beta(b, a, 1.0 - x)
    front = math.exp(
        math.lgamma(a + b) - math.lgamma(a) - math.lgamma(b) + a * math.log(x) + b * math.log1p(-x)
    )
    c, d = 1.0, 1.0 / max(1.0 - (a + b) * x / (a + 1), _TINY)
    value = d
    for m in range(1, 10_000):
        for term in (
            m * (b - m) * x / ((a + 2 * m - 1) * (a + 2 * m)),
            -(a + m) * (a + b + m) * x / ((a + 2 * m) * (a + 2 * m + 1)),
        ):
            d = 1.0 / (1.0 + term * d or _TINY)
            c = 1.0 + term / c or _TINY
            value *= c * d
        if abs(c * d - 1.0) < 1e-15:
            break
    return front * value / a


def t_tail(t: float, df: float) -> float:
    """Two-sided probability of Student's t."""
    if math.isinf(t):
        return 0.0
    return regularised_beta(df / 2, 0.5, df / (df + t * t))


def f_tail(f: float, df1: float, df2: float) -> float:
    """Upper probability of Fisher's F."""
    if math.isinf(f):
        return 0.0
    return regularised_beta(df2 / 2, df1 / 2, df2 / (df2 + df1 * f))


def normal_tail(z: float) -> float:
    """Two-sided probability of the standard normal."""
    return math.erfc(abs(z) / math.sqrt(2.0))


def kendall_tail(concordant: float, n: int) -> float:
    """Two-sided exact probability of the number of concordant pairs, no ties.

    The counts of permutations by inversions come from multiplying the
    polynomials 1 + q + ... + q^(i-1), i = 1..n.
    """
    counts = np.ones(1)
    for i in range(2, n + 1):
        counts = np.convolve(counts, np.ones(i) / i)
    middle = n * (n - 1) / 4
    low = min(concordant, 2 * middle - concordant)
    return float(min(1.0, 2.0 * counts[: int(round(low)) + 1].sum()))


def _per_row(function, *columns: pd.Series) -> pd.Series:
    frame = np.column_stack([c.to_numpy(dtype="float64", na_value=np.nan) for c in columns])
    return pd.Series(
        [None if np.isnan(row).any() else function(*row) for row in frame], dtype="float64"
    )


def t_p_value(t: Column | str, df: Column | str) -> Column:
    @F.pandas_udf("double")
    def p(t: pd.Series, df: pd.Series) -> pd.Series:
        return _per_row(t_tail, t, df)

    return F.nanvl(p(t, df), F.lit(None))


def f_p_value(f: Column | str, df1: Column | str, df2: Column | str) -> Column:
    @F.pandas_udf("double")
    def p(f: pd.Series, df1: pd.Series, df2: pd.Series) -> pd.Series:
        return _per_row(f_tail, f, df1, df2)

    return F.nanvl(p(f, df1, df2), F.lit(None))


def normal_p_value(z: Column | str) -> Column:
    @F.pandas_udf("double")
    def p(z: pd.Series) -> pd.Series:
        return _per_row(normal_tail, z)

    return F.nanvl(p(z), F.lit(None))


def kendall_exact_p_value(concordant: Column | str, n: Column | str) -> Column:
    @F.pandas_udf("double")
    def p(concordant: pd.Series, n: pd.Series) -> pd.Series:
        return _per_row(lambda c, m: kendall_tail(c, int(m)), concordant, n)

    return F.nanvl(p(concordant, n), F.lit(None))
