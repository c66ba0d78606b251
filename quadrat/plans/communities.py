"""Site x taxon communities of flowers and lawns, their tests and ordination."""

from __future__ import annotations

import functools
import operator
from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import missing as m
from quadrat.operators.joins import attach
from quadrat.operators.reshape import lengthen, widen
from quadrat.plans import lawn as lawn_plans

FLORAL_ATTRIBUTES = ("nb_age", "nb_inc", "city", "ann_precip", "ave_elev")
LAWN_ATTRIBUTES = ("nb_inc", "nb_age")
INCOME_LABELS = {"low": "Low", "mid": "Middle", "high": "High"}
INCOME_LEVELS = ("Low", "Middle", "High")


def site_name():
    """One text key per block of a neighbourhood."""
    return m.paste("nb", "block", sep="_")


def floral_community(rows: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Plants per block and genus, zeros and missing sums dropped, long form.

    The neighbourhood's attributes depend on ``nb`` alone, so they are attached
    to the sums rather than to the observations.
    """
    sums = (
        rows.groupBy("nb", "block", m.paste("family", "genus", sep="_").alias("taxon"))
        .agg(m.strict_sum("num_plants").alias("abundance"))
        .where(F.col("abundance") != 0)
    )
    return attach(sums, nb_info.select("nb", *FLORAL_ATTRIBUTES), ["nb"]).withColumn(
        "site", site_name()
    )


def lawn_community(
    lawn: DataFrame,
    nb_info: DataFrame,
    exclude: Sequence[str] = lawn_plans.EXTRA_HOUSES,
    exclude_species: Sequence[str] = (lawn_plans.NO_LAWN,),
) -> DataFrame:
    """Mean cover per block and species over all present plots, long form.

    Summing the four plots within the row first gives the mean of the unpivoted
    plots without multiplying the rows.
    """
    rows = lawn_plans.sampled(lawn, exclude).where(~F.col("species").isin(list(exclude_species)))
    plots = [F.col(c) for c in lawn_plans.PLOTS]
    cover = functools.reduce(operator.add, [F.coalesce(c, F.lit(0.0)) for c in plots])
    counted = functools.reduce(operator.add, [c.isNotNull().cast("int") for c in plots])
    means = rows.groupBy("nb", "block", F.col("species").alias("taxon")).agg(
        m.ratio(F.sum(cover), F.sum(counted)).alias("abundance")
    )
    return attach(means, nb_info.select("nb", *LAWN_ATTRIBUTES), ["nb"]).withColumn(
        "site", site_name()
    )


def plot_covers(
    lawn: DataFrame, exclude: Sequence[str] = lawn_plans.EXTRA_HOUSES
) -> DataFrame:
    """One row per lawn plot and species."""
    return lengthen(
        lawn_plans.sampled(lawn, exclude),
        ["nb", "block", "house_id", "species"],
        list(lawn_plans.PLOTS),
        "plot",
        "cover",
    )


def community_matrix(
    community: DataFrame, attributes: Sequence[str], taxa: Sequence[str] | None = None
) -> DataFrame:
    """Wide site x taxon table with zeros, for output."""
    return widen(community, ["nb", "block", *attributes], "taxon", "abundance", taxa)


def present_taxa(community: DataFrame) -> DataFrame:
    """The cells distances are computed from: present taxa only."""
    return community.where(F.col("abundance") > 0).select("site", "taxon", "abundance")


def community_sites(community: DataFrame, factors: Sequence[str]) -> DataFrame:
    """One row per site of the table with its factor values."""
    return community.select("site", "nb", *factors).distinct()


def score_centroids(scores: DataFrame, sites: DataFrame) -> DataFrame:
    """Mean and standard error of both ordination axes per neighbourhood."""
    located = scores.join(sites, "site")
    both = located.groupBy("nb", "nb_inc").agg(
        m.strict_mean("axis1").alias("m1"),
        m.strict_mean("axis2").alias("m2"),
        m.strict_sd("axis1").alias("sd1"),
        m.strict_sd("axis2").alias("sd2"),
        m.rows().alias("n"),
    )
    income = m.recode("nb_inc", INCOME_LABELS)
    return both.withColumns(
        {
            "se1": m.standard_error("sd1", "n"),
            "se2": m.standard_error("sd2", "n"),
            "nb_inc": m.level_label(income, INCOME_LEVELS),
            "income_rank": m.level_rank(income, INCOME_LEVELS),
        }
    )
