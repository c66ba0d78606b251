"""Joins with survey semantics: explicit keys, missing matches missing, zero fill.

No join here carries a broadcast hint.  Spark broadcasts a side only when its
statistics, or its measured size at run time, are under
``spark.sql.autoBroadcastJoinThreshold``; above that the join is a sort-merge
join whose hot partitions adaptive execution splits.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def attach(left: DataFrame, lookup: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Left join onto a lookup whose key is never missing.

    A missing key on the left cannot match then, so a plain equi-join is enough.
    Columns of the lookup that would collide with the left side are left out.
    """
    extra = [c for c in lookup.columns if c not in keys and c not in left.columns]
    return left.join(lookup.select(*keys, *extra), list(keys), "left")


def null_safe_join(left: DataFrame, right: DataFrame, keys: Sequence[str], how: str) -> DataFrame:
    """Join in which a missing key equals a missing key; one copy of each key."""
    renamed = right.withColumnsRenamed({k: f"__right_{k}" for k in keys})
    condition = None
    for key in keys:
        match = left[key].eqNullSafe(renamed[f"__right_{key}"])
        condition = match if condition is None else condition & match
    source = {
        "left": lambda k: F.col(k),
        "right": lambda k: F.col(f"__right_{k}"),
        "full": lambda k: F.coalesce(F.col(k), F.col(f"__right_{k}")),
    }[how]
    joined = left.join(renamed, condition, how)
    values = [c for c in left.columns + right.columns if c not in keys]
    return joined.select(*[source(k).alias(k) for k in keys], *values)


def zero_fill(df: DataFrame) -> DataFrame:
    """Put 0 into every missing cell, text columns included."""
    return df.na.fill(0).na.fill("0")


def outer_zero_fill(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Full outer join; a site seen on one side only gets 0 on the other."""
    return zero_fill(null_safe_join(left, right, keys, "full"))


def right_zero_fill(left: DataFrame, right: DataFrame, keys: Sequence[str]) -> DataFrame:
    """Right join; a site without measurements on the left gets 0."""
    return zero_fill(null_safe_join(left, right, keys, "right"))
