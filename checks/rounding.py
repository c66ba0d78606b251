"""Rounding applied alike to a query's result and to the SQL it is compared with."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

DIGITS = 6
# Means of exact decimals often end in a 5 just past the last digit kept, where the
# order of summation decides the rounding; a small shift moves them off the tie.
SHIFT = "3e-8"


def fixed(df: DataFrame, significant: tuple[str, ...] = ()) -> DataFrame:
    """Six decimals for every double, eight significant digits for the named ones.

    Adding 0 turns -0.0 into 0.0.
    """

    def cell(name: str, kind: str) -> Column:
        x = F.col(f"`{name}`")
        if kind != "double":
            return x
        if name in significant:
            digits = F.format_string("%.7e", x).cast("double")
            return F.when(x.isNotNull(), digits).alias(name)
        return (F.round(x + F.lit(float(SHIFT)), DIGITS) + F.lit(0.0)).alias(name)

    return df.select(*[cell(name, kind) for name, kind in df.dtypes])


def sql_fixed(expression: str) -> str:
    return f"(round({expression} + CAST({SHIFT} AS DOUBLE), {DIGITS}) + 0.0)"


def sql_significant(expression: str) -> str:
    return f"CAST(printf('%.7e', {expression}) AS DOUBLE)"
