"""Wide to long and long to wide."""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def lengthen(
    df: DataFrame,
    ids: Sequence[str],
    values: Sequence[str] | Mapping[str, str],
    name: str = "variable",
    value: str = "value",
) -> DataFrame:
    """One row per id and value column; a mapping also renames the labels.

    The value columns must share a type; columns of mixed type are unpivoted as text.
    """
    columns = list(values)
    labels = dict(values) if isinstance(values, Mapping) else {c: c for c in columns}
    types = {df.schema[c].dataType for c in columns}
    cells = [
        (F.col(c) if len(types) == 1 else F.col(c).cast("string")).alias(labels[c]) for c in columns
    ]
    return df.select(*ids, *cells).unpivot(list(ids), [labels[c] for c in columns], name, value)


def widen(
    df: DataFrame,
    ids: Sequence[str],
    name: str,
    value: str,
    values: Sequence[str] | None = None,
    limit: int | None = None,
) -> DataFrame:
    """One column per label, missing cells 0.

    The long form is the working form; this one is for output.  Without
    ``values`` the labels are read first; each is a column of the plan, so a caller may
    state a ``limit`` beyond which to raise.  A label that ``values`` lacks is an error
    rather than a narrower table, and so is a repeated (id, label).
    """
    if values is None:
        labels = df.select(name).where(F.col(name).isNotNull()).distinct()
        found = (labels if limit is None else labels.limit(limit + 1)).collect()
        if limit is not None and len(found) > limit:
            raise ValueError(f"more than {limit} distinct values of {name}: keep the long form")
        values = sorted(row[0] for row in found)
    else:
        listed = F.col(name).isNull() | F.col(name).isin(list(values))
        lacking = F.raise_error(F.concat(F.lit(f"{name} not listed: "), F.col(name).cast("string")))
        df = df.withColumn(name, F.when(listed, F.col(name)).otherwise(lacking))
    cell = F.when(F.count(F.lit(1)) <= 1, F.first(value)).otherwise(
        F.raise_error(F.lit(f"repeated {name} within {', '.join(ids)}")).cast("double")
    )
    return df.groupBy(*ids).pivot(name, list(values)).agg(cell).na.fill(0, list(values))
