"""Least squares from group sums: many regressions, ANOVA tables and trend lines.

Every fit needs only counts, means and centred cross-products per group, which
Spark combines before the shuffle.  Solving the p x p system happens on result
rows, one per regression.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.functions import probability as prob
from quadrat.operators.joins import null_safe_join

_FIT = (
    "struct<estimates:array<double>,errors:array<double>,t_values:array<double>,"
    "partial_r2:array<double>,sse:double,sst:double,sigma:double>"
)
_FIT_FIELDS = ["estimates", "errors", "t_values", "partial_r2", "sse", "sst", "sigma"]


def _solve(n: float, means: np.ndarray, cross: np.ndarray) -> dict | None:
    """Fit one regression from its sums; the response is the last variable."""
    k = len(means) - 1
    df = n - k - 1
    sxx, sxy, sst = cross[:k, :k], cross[:k, k], cross[k, k]
    scale = np.sqrt(np.diag(sxx))
    if df < 0 or not np.isfinite(cross).all() or (scale == 0).any():
        return None
    standard = sxx / np.outer(scale, scale)
    if np.linalg.matrix_rank(standard, tol=1e-7) < k:
        return None
    inverse = np.linalg.inv(standard) / np.outer(scale, scale)
    slopes = inverse @ sxy
    sse = max(float(sst - slopes @ sxy), 0.0)
    estimates = np.concatenate([[means[k] - slopes @ means[:k]], slopes])
    unit = np.concatenate([[1 / n + means[:k] @ inverse @ means[:k]], np.diag(inverse)])
    with np.errstate(divide="ignore", invalid="ignore"):
        sigma2 = sse / df if df > 0 else np.nan
        errors = np.sqrt(sigma2 * unit)
        t_values = estimates / errors
        # An exact fit leaves nothing to a term but what it explains.
        partial = np.where(np.isinf(t_values), 1.0, t_values**2 / (t_values**2 + df))
    partial[0] = np.nan
    return {
        "estimates": estimates,
        "errors": errors,
        "t_values": t_values,
        "partial_r2": partial,
        "sse": sse,
        "sst": float(sst),
        "sigma": float(np.sqrt(sigma2)),
    }


def _fit(n: pd.Series, means: pd.Series, cross: pd.Series) -> pd.DataFrame:
    rows = []
    for count, mean, upper in zip(n, means, cross):
        size = len(mean)
        matrix = np.zeros((size, size))
        matrix[np.triu_indices(size)] = upper
        matrix = matrix + np.triu(matrix, 1).T
        fit = _solve(float(count), np.asarray(mean, dtype=float), matrix)
        rows.append(fit or dict.fromkeys(_FIT_FIELDS))
    return pd.DataFrame(rows, columns=_FIT_FIELDS)


def _fits(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str]) -> DataFrame:
    """One row per group with the solved fit; incomplete rows are dropped."""
    names = [*xs, y]
    cells = [F.col(c).cast("double") for c in names]
    complete = df.select(*by, *[c.alias(f"v{i}") for i, c in enumerate(cells)]).na.drop(
        subset=[f"v{i}" for i in range(len(cells))]
    )
    variables = [F.col(f"v{i}") for i in range(len(cells))]
    cross = [
        F.covar_pop(variables[i], variables[j]) * F.count(F.lit(1))
        for i in range(len(variables))
        for j in range(i, len(variables))
    ]
    sums = complete.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.array(*[F.avg(v) for v in variables]).alias("means"),
        F.array(*cross).alias("cross"),
    )
    solve = F.pandas_udf(_fit, _FIT)
    return sums.where("n > 0").select(*by, "n", solve("n", "means", "cross").alias("fit"))


def _f_ratio(gain: Column, error: Column) -> Column:
    """Mean squares over their error: infinite for an exact fit, missing for 0 / 0."""
    exact = (error == 0) & (gain > 0)
    return F.when(exact, F.lit(float("inf"))).otherwise(F.try_divide(gain, error))


def ols_coefficients(
    df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()
) -> DataFrame:
    """One row per regression and term: estimate, error, t, p and partial R2."""
    terms = ["(intercept)", *xs]
    fit = _fits(df, y, xs, by)
    long = fit.select(
        *by,
        "n",
        F.posexplode(
            F.arrays_zip(
                F.array(*map(F.lit, terms)).alias("term"),
                F.col("fit.estimates").alias("estimate"),
                F.col("fit.errors").alias("std_error"),
                F.col("fit.t_values").alias("t"),
                F.col("fit.partial_r2").alias("partial_r2"),
            )
        ),
    )
    number = lambda c: F.nanvl(F.col(f"col.{c}"), F.lit(None)).alias(c)
    return long.select(
        *by,
        F.col("col.term").alias("term"),
        number("estimate"),
        number("std_error"),
        number("t"),
        (F.col("n") - len(terms)).alias("df"),
        number("partial_r2"),
    ).withColumn("p_value", prob.t_p_value("t", "df"))


def ols_fit(df: DataFrame, y: str, xs: Sequence[str], by: Sequence[str] = ()) -> DataFrame:
    """One row per regression: n, R2, adjusted R2, residual error, overall F and p."""
    k = len(xs)
    sse, sst, n = F.col("fit.sse"), F.col("fit.sst"), F.col("n")
    r2 = 1 - F.try_divide(sse, sst)
    df_within = n - k - 1
    return (
        _fits(df, y, xs, by)
        .select(
            *by,
            "n",
            r2.alias("r2"),
            (1 - F.try_divide(F.try_divide(sse, df_within), F.try_divide(sst, n - 1))).alias(
                "adj_r2"
            ),
            F.nanvl(F.col("fit.sigma"), F.lit(None)).alias("sigma"),
            F.lit(k).alias("df_model"),
            df_within.alias("df_residual"),
            _f_ratio((sst - sse) / k, F.try_divide(sse, df_within)).alias("f"),
        )
        .withColumn("p_value", prob.f_p_value("f", "df_model", "df_residual"))
    )


def _group_lines(
    df: DataFrame, y: str, x: str, group: str, by: Sequence[str]
) -> DataFrame:
    """Sums of a straight-line fit per (by, group)."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    n = F.count(F.lit(1))
    return (
        df.where(a.isNotNull() & b.isNotNull() & F.col(group).isNotNull())
        .groupBy(*by, group)
        .agg(
            n.alias("n"),
            F.avg(a).alias("mx"),
            F.avg(b).alias("my"),
            (F.var_pop(a) * n).alias("sxx"),
            (F.var_pop(b) * n).alias("syy"),
            (F.covar_pop(a, b) * n).alias("sxy"),
        )
    )


def _interaction_sums(lines: DataFrame, by: Sequence[str]) -> DataFrame:
    """Sums of squares gained by x, then groups, then separate slopes.

    Each gain is a sum of squares of its own, not a difference of large sums: the
    group term is what the overall line leaves in the group means plus what the
    common slope adds inside the groups; the interaction is the spread of the
    group slopes around the common one.
    """
    own = W.partitionBy(*by) if by else W.partitionBy(F.lit(1))
    total = F.sum("n").over(own)
    centred = lines.withColumns(
        {
            "gx": F.col("mx") - F.sum(F.col("n") * F.col("mx")).over(own) / total,
            "gy": F.col("my") - F.sum(F.col("n") * F.col("my")).over(own) / total,
            "wxx": F.sum("sxx").over(own),
            "wxy": F.sum("sxy").over(own),
        }
    )
    n = F.col("n")
    sloped = centred.withColumns(
        {
            "own": F.coalesce(F.try_divide("sxy", "sxx"), F.lit(0.0)),
            "common": F.coalesce(F.try_divide("wxy", "wxx"), F.lit(0.0)),
            "all_xx": F.col("wxx") + F.sum(n * F.col("gx") * F.col("gx")).over(own),
            "all_xy": F.col("wxy") + F.sum(n * F.col("gx") * F.col("gy")).over(own),
        }
    ).withColumn("overall", F.coalesce(F.try_divide("all_xy", "all_xx"), F.lit(0.0)))
    left = F.col("gy") - F.col("overall") * F.col("gx")
    shift = F.col("overall") - F.col("common")
    turn = F.col("own") - F.col("common")
    return sloped.groupBy(*by).agg(
        F.sum("n").alias("n"),
        F.count(F.lit(1)).alias("k"),
        F.count_if(F.col("sxx") > 0).alias("slopes"),
        F.max(F.col("overall") * F.col("all_xy")).alias("ss_x"),
        (F.sum(n * left * left) + F.max(shift * shift * F.col("wxx"))).alias("ss_g"),
        F.sum(F.col("sxx") * turn * turn).alias("ss_xg"),
        F.sum(F.col("syy") - F.col("own") * F.col("sxy")).alias("sse_full"),
    )


def interaction_anova(
    df: DataFrame, y: str, x: str, group: str, by: Sequence[str] = ()
) -> DataFrame:
    """Sequential (Type I) table of y ~ x * group: one row per term and residuals.

    With one line per group the four nested models need only group sums, for any
    number of groups.
    """
    sums = _interaction_sums(_group_lines(df, y, x, group, by), by)
    residual_df = F.col("n") - F.col("k") - F.col("slopes")
    terms = [
        (x, F.lit(1).cast("bigint"), F.col("ss_x")),
        (group, F.col("k") - 1, F.col("ss_g")),
        (f"{x}:{group}", F.col("slopes") - 1, F.col("ss_xg")),
        ("residuals", residual_df, F.col("sse_full")),
    ]
    rows = F.array(
        *[
            F.struct(
                F.lit(i + 1).alias("position"),
                F.lit(term).alias("term"),
                df.alias("df"),
                ss.alias("ss"),
            )
            for i, (term, df, ss) in enumerate(terms)
        ]
    )
    error = F.try_divide(F.col("sse_full"), residual_df)
    table = sums.select(
        *by, error.alias("error"), residual_df.alias("df_residual"), F.inline(rows)
    )
    tested = F.col("position") < 4
    return (
        table.withColumn("ms", F.try_divide("ss", "df"))
        .withColumn("f", F.when(tested, _f_ratio(F.col("ms"), F.col("error"))))
        .withColumn("p_value", prob.f_p_value("f", "df", "df_residual"))
        .select(*by, "position", "term", "df", "ss", "ms", "f", "p_value")
    )


def interaction_coefficients(
    df: DataFrame, y: str, x: str, group: str, reference: str, by: Sequence[str] = ()
) -> DataFrame:
    """Coefficients of y ~ x * group against the ``reference`` level.

    The reference line gives the intercept and slope; every other group adds the
    difference of its own line from it.  A fit without the reference level is an error.
    """
    lines = _group_lines(df, y, x, group, by)
    sums = _interaction_sums(lines, by)
    residual_df = F.col("n") - F.col("k") - F.col("slopes")
    slope = F.try_divide("sxy", "sxx")
    fitted = lines.select(
        *by,
        F.col(group).alias("level"),
        slope.alias("b"),
        (F.col("my") - slope * F.col("mx")).alias("a"),
        F.try_divide(F.lit(1.0), F.col("sxx")).alias("vb"),
        (1 / F.col("n") + F.try_divide(F.col("mx") * F.col("mx"), F.col("sxx"))).alias("va"),
    )
    base = fitted.where(F.col("level") == reference).select(
        *by, F.lit(True).alias("found"), *[F.col(c).alias(f"{c}0") for c in ("a", "b", "va", "vb")]
    )
    error = sums.select(
        *by, F.try_divide(F.col("sse_full"), residual_df).alias("error"), residual_df.alias("df")
    )
    one = list(by) or ["__one"]
    if not by:
        fitted, base, error = (f.withColumn("__one", F.lit(1)) for f in (fitted, base, error))
    is_base = F.col("level") == reference
    pick = lambda c, plus: F.when(is_base, F.col(c)).otherwise(
        F.col(c) + F.col(f"{c}0") if plus else F.col(c) - F.col(f"{c}0")
    )

    def term(own: str, label: str, estimate: str, unit: str) -> Column:
        return F.struct(
            F.when(is_base, F.lit(own)).otherwise(F.concat(F.lit(label), "level")).alias("term"),
            pick(estimate, False).alias("estimate"),
            pick(unit, True).alias("unit"),
        )

    terms = F.array(term("(intercept)", group, "a", "va"), term(x, f"{x}:{group}", "b", "vb"))
    lacking = F.raise_error(F.lit(f"no level {reference!r} of {group} to compare with"))
    joined = null_safe_join(null_safe_join(fitted, base, one, "left"), error, one, "left")
    return (
        joined.withColumn("error", F.when(F.col("found"), F.col("error")).otherwise(lacking.cast("double")))
        .select(*by, "error", "df", F.inline(terms))
        .withColumn("std_error", F.sqrt(F.col("unit") * F.col("error")))
        .withColumn("t", F.try_divide("estimate", "std_error"))
        .withColumn("p_value", prob.t_p_value("t", "df"))
        .select(*by, "term", "estimate", "std_error", "t", "df", "p_value")
    )


def trend_lines(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    x_limits: tuple[float, float] | None = None,
    y_limits: tuple[float, float] | None = None,
) -> DataFrame:
    """Straight line per group; rows outside the axis limits are dropped first."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    rows = df.where(a.isNotNull() & b.isNotNull())
    if x_limits:
        rows = rows.where(a.between(*x_limits))
    if y_limits:
        rows = rows.where(b.between(*y_limits))
    return rows.groupBy(*by).agg(
        F.count(F.lit(1)).alias("n"),
        F.regr_slope(b, a).alias("slope"),
        F.regr_intercept(b, a).alias("intercept"),
        F.min(a).alias("x_from"),
        F.max(a).alias("x_to"),
    )
