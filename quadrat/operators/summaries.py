"""Group summaries: mean with standard error, and shares split over labels."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quadrat.functions import missing as m


def mean_se(
    df: DataFrame,
    keys: Sequence[str],
    value: str,
    mean: str = "mean",
    *,
    strict: bool = True,
    n: Column | None = None,
    sd: str = "sd",
    count: str = "n",
    se: str = "se",
) -> DataFrame:
    """Mean, sample standard deviation, count and standard error per group.

    ``n`` is what the standard error divides by: all rows unless the caller
    passes ``present(value)``.
    """
    average, spread = (m.strict_mean, m.strict_sd) if strict else (m.lenient_mean, m.lenient_sd)
    summary = df.groupBy(*keys).agg(
        average(value).alias(mean),
        spread(value).alias(sd),
        (m.rows() if n is None else n).alias(count),
    )
    return summary.withColumn(se, m.standard_error(sd, count))


def trait_counts(
    df: DataFrame, keys: Sequence[str], traits: dict[str, str], blank: str
) -> DataFrame:
    """Distinct values per group of several text columns; ``traits`` maps column to result.

    The blank code is not counted, missing counts as one value.  A row moves once, to
    its group, with all its traits.  There the columns are stacked and duplicates
    removed, which needs no further shuffle and holds the rows of one part of the
    groups only; counting what is left needs no distinct.  The number of parts is
    given, because adaptive execution would merge them until one fills a task's memory.
    """
    here = df.select(*keys, *traits)
    parts = int(df.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    grouped = here.repartition(parts, *keys) if keys else here
    # Not ``lengthen``: after an unpivot Spark no longer knows that groups lie together.
    cells = [F.struct(F.lit(c).alias("trait"), F.col(c).alias("value")) for c in traits]
    stacked = grouped.select(*keys, F.inline(F.array(*cells))).distinct()
    seen = F.col("value").isNull() | (F.col("value") != blank)
    return stacked.groupBy(*keys).agg(
        *[F.count_if((F.col("trait") == c) & seen).alias(name) for c, name in traits.items()]
    )


def error_bounds(df: DataFrame, mean: str, se: str, lower: str, upper: str) -> DataFrame:
    """Ends of the error bar around a mean."""
    return df.withColumns({lower: F.col(mean) - F.col(se), upper: F.col(mean) + F.col(se)})


def split_share(
    df: DataFrame, keys: Sequence[str], first: str, second: str, amount: str, label: str = "value"
) -> DataFrame:
    """Split each row's amount over its one or two labels and sum per label.

    A row with a second label gives half to each, otherwise all to the first.
    Blank labels are dropped.  Rows with a missing second label have no defined
    share: their amount is missing and adds nothing.
    """
    share = m.choose(F.col(second) != "", 0.5 * F.col(amount), 1.0 * F.col(amount))
    rows = df.select(*keys, share.alias("__share"), first, second)
    long = rows.unpivot([*keys, "__share"], [first, second], "__slot", label)
    return (
        long.where(F.col(label) != "")
        .groupBy(*keys, label)
        .agg(m.lenient_sum("__share").alias(amount))
    )
