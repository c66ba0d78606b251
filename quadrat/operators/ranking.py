"""Order-preserving integer codes without a single global sort window."""

from __future__ import annotations

import itertools
import math

from pyspark.ml.feature import Bucketizer
from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.session import materialise


def order_codes(
    df: DataFrame, column: str, code: str, *, range_size: int = 4096, ranges: int = 256
) -> tuple[DataFrame, int]:
    """Add ``code``: the 0-based rank of ``column`` among its distinct values.

    Up to ``range_size`` distinct values are ranked in one window.  More are cut
    at approximate quantiles into ``ranges`` (distinct values cannot be skewed),
    ranked inside each range, and shifted by the sizes of the ranges below.  The
    cut points only spread the work; the ranks are exact.  Also returns the
    number of distinct values.
    """
    distinct = df.select(F.col(column).alias("v")).where(F.col(column).isNotNull()).distinct()
    values = materialise(distinct, "distinct-values")
    size = values.count()
    place = F.row_number().over(W.partitionBy("range").orderBy("v")) - 1
    if size <= range_size:
        ranged, offset = values.withColumn("range", F.lit(0.0)), F.lit(0)
    else:
        shares = [i / ranges for i in range(1, ranges)]
        cuts = {v for v in values.approxQuantile("v", shares, 1e-3) if math.isfinite(v)}
        edges = [-math.inf, *sorted(cuts), math.inf]
        ranged = Bucketizer(splits=edges, inputCol="v", outputCol="range").transform(values)
        counts = ranged.groupBy("range").agg(F.count(F.lit(1)).alias("n")).sort("range").collect()
        starts = itertools.accumulate((row["n"] for row in counts), initial=0)
        pairs = [F.lit(v) for row, start in zip(counts, starts) for v in (row["range"], start)]
        offset = F.element_at(F.create_map(*pairs), F.col("range"))
    codes = ranged.select(F.col("v").alias(column), (place + offset).cast("bigint").alias(code))
    return df.join(codes, column), size
