"""Aggregates and scalars with statistical-package missing-value rules.

Survey tools treat a missing value in three different ways, and the right one
differs by column: *strict* (one missing value makes the result missing),
*lenient* (missing values are skipped) and *gated* (lenient only if a second
column has any value in the group).  SQL knows only a variant of the second, so
each rule is spelled out here as a plain column expression.  All aggregates are
algebraic: Spark combines them before the shuffle, whatever the group size.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

NUMBER = r"^\s*[+-]?(\d+\.?\d*|\.\d+)([eE][+-]?\d+)?\s*$"  # fixed value: decimal number


def _column(x: Column | str) -> Column:
    return F.col(x) if isinstance(x, str) else x


def rows() -> Column:
    """Number of rows, missing or not."""
    return F.count(F.lit(1))


def present(x: Column | str) -> Column:
    """Number of non-missing values."""
    return F.count(_column(x))


def _if_complete(x: Column, aggregate: Column) -> Column:
    return F.when(F.count(x) == F.count(F.lit(1)), aggregate)


def strict_sum(x: Column | str) -> Column:
    x = _column(x)
    return _if_complete(x, F.sum(x))


def strict_mean(x: Column | str) -> Column:
    x = _column(x)
    return _if_complete(x, F.avg(x))


def strict_sd(x: Column | str) -> Column:
    x = _column(x)
    return _if_complete(x, F.stddev_samp(x))


def lenient_sum(x: Column | str) -> Column:
    """Sum of the present values; a group without any gives 0, not missing."""
    return F.coalesce(F.sum(_column(x)), F.lit(0.0))


def lenient_mean(x: Column | str) -> Column:
    return F.avg(_column(x))


def lenient_sd(x: Column | str) -> Column:
    return F.stddev_samp(_column(x))


def lenient_var(x: Column | str) -> Column:
    return F.var_samp(_column(x))


def gated_sum(x: Column | str, gate: Column | str) -> Column:
    """Lenient if the group holds any value of ``gate``, strict otherwise."""
    return F.when(F.count(_column(gate)) > 0, lenient_sum(x)).otherwise(strict_sum(x))


def distinct_with_missing(x: Column | str) -> Column:
    """Distinct values, where "missing" counts as one more value."""
    x = _column(x)
    return F.count_distinct(x) + F.max(x.isNull().cast("int"))


def distinct_traits(x: Column | str) -> Column:
    """Distinct values other than the blanked code ``"0"``; missing counts once."""
    x = _column(x)
    return F.count_distinct(F.when(x != "0", x)) + F.max(x.isNull().cast("int"))


def choose(condition: Column, yes: Column, no: Column) -> Column:
    """Conditional value that stays missing when the condition is missing."""
    return F.when(condition, yes).when(~condition, no)


def paste(*columns: Column | str, sep: str = " ") -> Column:
    """Join text with ``sep``; a missing part becomes the text ``NA``."""
    parts: list[Column] = []
    for column in columns:
        if parts:
            parts.append(F.lit(sep))
        parts.append(F.coalesce(_column(column).cast("string"), F.lit("NA")))
    return F.concat(*parts)


def row_mean(*columns: Column | str) -> Column:
    """Mean over the columns present in a row; missing if none is."""
    cells = [_column(c) for c in columns]
    total = sum((F.coalesce(c, F.lit(0.0)) for c in cells[1:]), F.coalesce(cells[0], F.lit(0.0)))
    count = sum((c.isNotNull().cast("int") for c in cells[1:]), cells[0].isNotNull().cast("int"))
    return F.try_divide(total, count)


def ratio(numerator: Column | str, denominator: Column | str) -> Column:
    """Quotient that is missing, not an error, when the denominator is 0."""
    return F.try_divide(_column(numerator), _column(denominator))


def standard_error(sd: Column | str, n: Column | str) -> Column:
    return F.try_divide(_column(sd), F.sqrt(_column(n)))


def recode(x: Column | str, mapping: Mapping[str, str]) -> Column:
    """Replace the listed values; others pass through."""
    x = _column(x)
    pairs = [F.lit(v) for pair in mapping.items() for v in pair]
    return F.coalesce(F.create_map(*pairs)[x], x)


def level_rank(x: Column | str, levels: Sequence[str]) -> Column:
    """1-based position in an ordered category; unlisted values are missing."""
    return F.nullif(F.array_position(F.array(*map(F.lit, levels)), _column(x)), F.lit(0)).cast("int")


def level_label(x: Column | str, levels: Sequence[str]) -> Column:
    """The value itself if the ordered category lists it, else missing."""
    x = _column(x)
    return F.when(x.isin(list(levels)), x)


def to_number(text: Column | str) -> Column:
    """Number from text; anything that is not a number is missing.

    The pattern is tested first because a failing cast costs an exception per
    row, and because the cast also reads ``NaN`` and Java's ``1d`` / ``1f``.
    """
    text = _column(text)
    return F.when(text.rlike(NUMBER), text.try_cast("double"))


def number_text(x: Column | str) -> Column:
    """Shortest text of a number; whole numbers carry no decimal point."""
    x = _column(x)
    whole = (x == F.floor(x)) & (F.abs(x) < 1e15)
    return F.when(whole, x.cast("bigint").cast("string")).otherwise(x.cast("string"))
