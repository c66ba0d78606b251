"""The data tables behind the study's figures; drawing is left to the caller."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators.joins import null_safe_join
from quadrat.operators.regression import trend_lines
from quadrat.operators.summaries import error_bounds
from quadrat.plans import survey
from quadrat.session import materialise

Limits = tuple[float, float] | None

# Axis limits of the panels.
SCORE_LIMITS = (0.0, 3.0)
COLOR_LIMITS = (0.0, 10.0)
GENERA_LIMITS = (0.0, 15.0)
COLOR_AXIS_LIMITS = (0.0, 9.0)
INFLORESCENCE_LIMITS = (0.0, 6.0)
LAYER_LIMITS = (0.0, 15.0)
TYPE_LIMITS = (0.0, 7.5)
SIDE_RICHNESS_LIMITS = (0.0, 10.0)
SIDE_COLOR_LIMITS = (0.0, 7.5)
ORDINATION_X_LIMITS = (-0.95, 0.6)
ORDINATION_Y_LIMITS = (-0.8, 0.95)
SCATTER_LIMITS = {
    "color_num_f": (0.0, 21.0),
    "rich_flowers": (0.0, 35.0),
    "natives_rich_f": (0.0, 9.0),
    "water_wghtd_avg": (0.0, 3.5),
}
WATER_ATTITUDE_LIMITS = (0.0, 3.0)


def within(df: DataFrame, column: str, limits: Limits) -> DataFrame:
    """Rows inside the axis limits; rows without a value are not drawn either."""
    rows = df.where(F.col(column).isNotNull())
    return rows.where(F.col(column).between(*limits)) if limits else rows


def importance_bars(
    importance: DataFrame, items: Sequence[str], limits: Limits = SCORE_LIMITS
) -> DataFrame:
    """Bars with error bounds for some survey items, shortest first."""
    labels = [survey.ITEM_LABELS[i] for i in items]
    bars = within(importance.where(F.col("variable").isin(labels)), "importance", limits)
    return error_bounds(bars, "importance", "se", "lower", "upper").orderBy("importance")


def points(
    df: DataFrame,
    x: str,
    y: str,
    se: str,
    x_limits: Limits = None,
    y_limits: Limits = None,
    group: str | None = None,
) -> DataFrame:
    """Points with error bounds."""
    shown = within(within(df, x, x_limits), y, y_limits)
    columns = [F.col(x).alias("x"), F.col(y).alias("y"), F.col(se).alias("se")]
    if group:
        columns.insert(0, F.col(group).alias("series"))
    return error_bounds(shown.select(*columns), "y", "se", "lower", "upper")


def points_with_trend(
    df: DataFrame,
    x: str,
    y: str,
    se: str,
    x_limits: Limits = None,
    y_limits: Limits = None,
    group: str | None = None,
) -> DataFrame:
    """Points with error bounds, next to the straight line of their series.

    Points outside the limits are dropped before the line is fitted.  The points are written once:
    both they and the line would otherwise be computed from the observations.
    """
    shown = materialise(points(df, x, y, se, x_limits, y_limits, group), "figure-points")
    if group is None:
        line = trend_lines(shown, "x", "y").select(F.struct("slope", "intercept")).scalar()
        fitted = shown.withColumn("line", line)
        return fitted.select(F.lit("all").alias("series"), *shown.columns, "line.*")
    lines = trend_lines(shown, "x", "y", ["series"]).select("series", "slope", "intercept")
    return null_safe_join(shown, lines, ["series"], "left")


def centroid_crosses(
    centroids: DataFrame,
    x_limits: Limits = ORDINATION_X_LIMITS,
    y_limits: Limits = ORDINATION_Y_LIMITS,
) -> DataFrame:
    """Ordination centroids with error bounds on both axes."""
    shown = within(within(centroids, "m1", x_limits), "m2", y_limits)
    across = error_bounds(shown, "m1", "se1", "lower1", "upper1")
    return error_bounds(across, "m2", "se2", "lower2", "upper2")


def preference_scatter(
    direct_house: DataFrame, x: str, y: str, x_limits: Limits = None, y_limits: Limits = None
) -> DataFrame:
    """Stated preference against yard measure, one row per house, without jitter."""
    shown = within(within(direct_house, x, x_limits), y, y_limits)
    return shown.select(F.col(x).alias("x"), F.col(y).alias("y"))
