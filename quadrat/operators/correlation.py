"""Pearson and Kendall correlation tests, one row per group."""

from __future__ import annotations

import functools
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import probability as prob
from quadrat.operators.joins import null_safe_join
from quadrat.session import materialise

NORMAL_975 = 1.959963984540054  # fixed value: 97.5 % point of the standard normal


def pearson(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """r, t, df, p and 95 % interval; rows missing either value are dropped."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    sums = (
        df.where(a.isNotNull() & b.isNotNull())
        .groupBy(*by)
        .agg(
            F.count(F.lit(1)).alias("n"),
            F.try_divide(F.covar_samp(a, b), F.stddev_samp(a) * F.stddev_samp(b)).alias("r"),
        )
    )
    # Rounding may push r past its limits; on a straight line t is infinite.
    r = F.when(F.abs("r") >= 1, F.signum("r")).otherwise(F.col("r"))
    sums = sums.withColumn("r", r)
    r, n = F.col("r"), F.col("n")
    endless = F.signum(r) * F.lit(float("inf"))
    t = F.when(F.abs(r) == 1, endless).otherwise(r * F.sqrt(F.try_divide(n - 2, 1 - r * r)))
    reach = F.when(n > 3, NORMAL_975 / F.sqrt(n - 3))
    fitted = sums.withColumns({"t": F.when(n > 2, t), "df": F.when(n > 2, n - 2)})
    return fitted.withColumns(
        {
            "p_value": prob.t_p_value("t", "df"),
            "conf_low": F.tanh(F.atanh(r) - reach),
            "conf_high": F.tanh(F.atanh(r) + reach),
        }
    )


def _cells(df: DataFrame, x: str, y: str, by: Sequence[str]) -> DataFrame:
    """Distinct (x, y) with counts: everything after this depends on cells, not rows."""
    a, b = F.col(x).cast("double"), F.col(y).cast("double")
    return (
        df.where(a.isNotNull() & b.isNotNull())
        .groupBy(*by, a.alias("x"), b.alias("y"))
        .agg(F.count(F.lit(1)).alias("w"))
    )


def _score(cells: DataFrame, by: list[str], bits: int, y_size: int, y_block: int) -> DataFrame:
    """Concordant minus discordant pairs per group, without forming pairs.

    Two x codes differ first at one bit: above it they share a prefix, at it the
    smaller has 0 and the larger 1.  So for each bit and prefix it is enough to
    know, for each y, how many 0-cells lie below and above it.  A cell appears
    once per bit, so this is for the grid of blocks, not for all cells.  With more than ``y_block`` y codes the running counts are cut
    into blocks, so no window holds more than one block of one prefix.
    """
    strand = [*by, "bit", "prefix"]
    levels = (
        cells.withColumn("bit", F.explode(F.sequence(F.lit(0), F.lit(bits - 1))))
        .withColumn("prefix", F.expr("shiftright(xc, bit + 1)"))
        .withColumn("high", F.expr("shiftright(xc, bit) & 1"))
        .groupBy(*strand, "yc")
        .agg(
            F.sum(F.when(F.col("high") == 0, F.col("w")).otherwise(0)).alias("zeros"),
            F.sum(F.when(F.col("high") == 1, F.col("w")).otherwise(0)).alias("ones"),
        )
    )

    def sum_before(x: str, order: W) -> Column:
        return F.coalesce(F.sum(x).over(order.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))

    if y_size <= y_block:
        whole = W.partitionBy(*strand)
        counted = levels.withColumns(
            {
                "below": sum_before("zeros", whole.orderBy("yc")),
                "all_zeros": F.sum("zeros").over(whole),
            }
        )
    else:
        levels = levels.withColumn("block", F.floor(F.col("yc") / y_block))
        blocks = levels.groupBy(*strand, "block").agg(F.sum("zeros").alias("block_zeros"))
        offsets = blocks.select(
            *strand,
            "block",
            sum_before("block_zeros", W.partitionBy(*strand).orderBy("block")).alias("earlier"),
            F.sum("block_zeros").over(W.partitionBy(*strand)).alias("all_zeros"),
        )
        local = sum_before("zeros", W.partitionBy(*strand, "block").orderBy("yc"))
        counted = (
            null_safe_join(levels.withColumn("local", local), offsets, [*strand, "block"], "left")
            .withColumn("below", F.col("earlier") + F.col("local"))
        )
    above = F.col("all_zeros") - F.col("below") - F.col("zeros")
    score = F.col("ones").cast("decimal(38,0)") * (F.col("below") - above)
    return counted.groupBy(*by).agg(F.sum(score).cast("double").alias("s"))


def _signed_pairs(x: np.ndarray, y: np.ndarray, w: np.ndarray) -> int:
    """Concordant minus discordant pairs of weighted cells, exactly; ties of either count nothing."""
    # Products of counts may pass 64 bits only if all rows together pass 31.
    w = w.astype(np.int64 if sum(map(int, w)) < 1 << 31 else object)
    xc = np.unique(x, return_inverse=True)[1]
    yc = np.unique(y, return_inverse=True)[1]
    order = np.argsort(yc, kind="stable")
    total = 0
    for bit in range(int(xc.max()).bit_length() - 1, -1, -1):
        # Cells in order of the bits above this one, then of y.
        code, level, count = xc[order], yc[order], w[order]
        prefix, high = code >> (bit + 1), (code >> bit & 1).astype(bool)
        sums = np.concatenate([np.zeros(1, dtype=w.dtype), np.cumsum(np.where(high, 0, count))])
        part = np.flatnonzero(np.diff(prefix, prepend=-1))
        run = np.flatnonzero((np.diff(prefix, prepend=-1) != 0) | (np.diff(level, prepend=-1) != 0))
        part_of = np.searchsorted(part, np.arange(len(code)), "right") - 1
        run_of = np.searchsorted(run, np.arange(len(code)), "right") - 1
        below = sums[run[run_of]] - sums[part[part_of]]
        above = sums[np.append(part[1:], len(code))[part_of]] - sums[np.append(run[1:], len(code))[run_of]]
        total += int(np.where(high, count * (below - above), 0).sum())
        order = order[np.argsort(code >> bit, kind="stable")]
    return total


def _unit_scores(cells: DataFrame, by: list[str], unit: str, x: str) -> DataFrame:
    """The score of each (group, unit) by itself, a unit in memory at a time."""

    def run(key: tuple, unit_cells: pa.Table) -> pa.Table:
        held = [unit_cells.column(c).to_numpy() for c in (x, "y", "w")]
        score = pa.array([str(_signed_pairs(*held))])
        names = [pa.array([k.as_py()], k.type) for k in key[:-1]]
        return pa.Table.from_arrays([*names, score], names=[*by, "score"])

    kinds = T.StructType([*[cells.schema[k] for k in by], T.StructField("score", T.StringType())])
    columns = dict.fromkeys([*by, unit, x, "y", "w"])
    scores = cells.select(*columns).groupBy(*by, unit).applyInArrow(run, kinds)
    return scores.select(*by, F.col("score").cast("decimal(38,0)").alias("s"))


def _group_scores(cells: DataFrame, by: list[str], unit: int, y_block: int) -> DataFrame:
    """Concordant minus discordant pairs per group; a cell moves twice at most.

    A group of more than ``unit`` cells is cut along x and along y at approximate quantiles of
    its own.  A quantile is a block of its own, without pairs inside, so that ties cannot make
    a block larger than planned.  Pairs in one x block are counted there; pairs in one y block
    but in two x blocks there; all others follow from the counts of the (x block, y block) grid.
    The cuts only spread the work; the score is exact.
    """
    sizes = cells.groupBy(*by).agg(F.count(F.lit(1)).alias("__cells"))
    largest = sizes.agg(F.max("__cells")).first()[0] or 0
    if largest <= unit:
        return _unit_scores(cells.withColumn("xb", F.lit(0)), by, "xb", "x")
    parts = -(-largest // unit)
    shares = [i / parts for i in range(1, parts)]
    cuts = cells.groupBy(*by).agg(
        F.count(F.lit(1)).alias("__cells"),
        *[
            F.array_sort(F.array_distinct(F.percentile_approx(c, shares, max(10000, 8 * parts)))).alias(f"{c}_cuts")
            for c in ("x", "y")
        ],
    )
    # Only groups that are cut: fewer than cells / unit.
    cuts = materialise(cuts.where(F.col("__cells") > unit).drop("__cells"), "cuts")

    def block(c: str) -> Column:
        at = F.col(f"{c}_cuts")
        place = 2 * F.size(F.filter(at, lambda cut: cut < F.col(c))) + F.array_contains(at, F.col(c)).cast("int")
        return F.when(at.isNotNull(), place).otherwise(0)

    dealt = null_safe_join(cells, cuts, by, "left").withColumns(
        {"xb": block("x"), "yb": block("y"), "cut": F.col("x_cuts").isNotNull()}
    )
    grid = (
        dealt.where("cut").groupBy(*by, F.col("xb").alias("xc"), F.col("yb").alias("yc")).agg(F.sum("w").alias("w"))
    )
    side = 2 * parts - 1
    scores = [
        _unit_scores(dealt.where("xb % 2 = 0"), by, "xb", "x"),
        _unit_scores(dealt.where("cut AND yb % 2 = 0"), by, "yb", "xb"),
        _score(grid, by, max(1, (side - 1).bit_length()), side, y_block).select(
            *by, F.col("s").cast("decimal(38,0)").alias("s")
        ),
    ]
    every = functools.reduce(DataFrame.unionByName, scores)
    return every.groupBy(*by).agg(F.sum("s").cast("double").alias("s"))


def _ties(cells: DataFrame, by: list[str]) -> DataFrame:
    """Rows n and the tie sums of both variables, in one pass over the margins."""
    t = F.col("t").cast("double")
    margins = (
        cells.select(
            *by,
            "w",
            F.inline(
                F.array(
                    F.struct(F.lit("x").alias("side"), F.col("x").alias("value")),
                    F.struct(F.lit("y").alias("side"), F.col("y").alias("value")),
                )
            ),
        )
        .groupBy(*by, "side", "value")
        .agg(F.sum("w").alias("t"))
    )

    def total(side: str, x: Column) -> Column:
        return F.sum(F.when(F.col("side") == side, x))

    return margins.groupBy(*by).agg(
        total("x", F.col("t")).alias("n"),
        *[
            total(side, x).alias(f"{side}_{name}")
            for side in ("x", "y")
            for name, x in (
                ("pairs", t * (t - 1)),
                ("var", t * (t - 1) * (2 * t + 5)),
                ("triples", t * (t - 1) * (t - 2)),
            )
        ],
    )


def kendall(
    df: DataFrame,
    x: str,
    y: str,
    by: Sequence[str] = (),
    *,
    y_block: int = 4096,
    unit: int = 1 << 19,
) -> DataFrame:
    """Kendall's tau-b with its test, one row per group.

    A task holds about ``unit`` cells of a group at a time.

    With ties, or from 50 rows on, p is the normal approximation; otherwise it
    is exact and ``z`` is missing.
    """
    by = list(by)
    keys = by or ["__all"]
    source = df if by else df.withColumn("__all", F.lit(1))
    cells = materialise(_cells(source, x, y, keys), "cells")
    scores = _group_scores(cells, keys, unit, y_block).withColumn("s", F.col("s").cast("double"))
    sums = null_safe_join(_ties(cells, keys), scores, keys, "left")
    n = F.col("n").cast("double")
    pairs = n * (n - 1)
    variance = (
        (pairs * (2 * n + 5) - F.col("x_var") - F.col("y_var")) / 18
        + F.coalesce(F.try_divide(F.col("x_pairs") * F.col("y_pairs"), 2 * pairs), F.lit(0.0))
        + F.coalesce(
            F.try_divide(F.col("x_triples") * F.col("y_triples"), 9 * pairs * (n - 2)), F.lit(0.0)
        )
    )
    free = F.sqrt((pairs - F.col("x_pairs")) * (pairs - F.col("y_pairs"))) / 2
    exact = (F.col("x_pairs") == 0) & (F.col("y_pairs") == 0) & (F.col("n") < 50)
    concordant = (F.col("s") + pairs / 2) / 2
    result = sums.select(
        *keys,
        "n",
        "s",
        F.try_divide(F.col("s"), free).alias("tau"),
        F.when(~exact, F.try_divide(F.col("s"), F.sqrt(variance))).alias("z"),
        F.when(exact & (F.col("n") > 1), concordant).alias("__concordant"),
    )
    p = F.coalesce(prob.normal_p_value("z"), prob.kendall_exact_p_value("__concordant", "n"))
    return result.withColumn("p_value", p).drop("__concordant", *([] if by else ["__all"]))
