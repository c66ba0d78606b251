"""Lawn plots: cover, richness, native species and summaries per house."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import missing as m
from quadrat.operators.diversity import community_structure
from quadrat.operators.joins import attach

# Codes of the field protocol.
EXTRA_HOUSES = ("387_11_4", "651_1_4")
NO_LAWN = "NO LAWN"
NOT_COLLECTED = "Not collected"
NOT_APPLICABLE = "n/a"
TYPE_LABELS = {"Lawn": "Turfgrasses", "Weed": "Weeds", "Seedling": "Weeds"}
PLOTS = ("f1", "f2", "b1", "b2")


def sampled(lawn: DataFrame, exclude: Sequence[str] = EXTRA_HOUSES) -> DataFrame:
    return lawn.where(~F.col("house_id").isin(list(exclude)))


def species_cover(
    lawn: DataFrame, native_lawn: DataFrame, exclude: Sequence[str] = EXTRA_HOUSES
) -> DataFrame:
    """Mean cover of each species row, front, back and overall.

    A yard side needs both of its plots; the overall cover is the mean of the
    sides that have one.  Species are few and some hold a large share of the
    rows: pass a lookup whose size Spark knows (a file), so that it is broadcast
    without shuffling the rows by species.
    """
    rows = sampled(lawn, exclude).where(
        (F.col("species") != NO_LAWN) & (F.col("species") != NOT_COLLECTED)
    )
    sides = rows.withColumns(
        {
            "ave_cov_f": (F.col("f1") + F.col("f2")) / 2,
            "ave_cov_b": (F.col("b1") + F.col("b2")) / 2,
        }
    ).withColumn("ave_cov_all", m.row_mean("ave_cov_b", "ave_cov_f"))
    return attach(sides, native_lawn, ["species"])


def house_richness(cover: DataFrame) -> DataFrame:
    """Distinct species per house."""
    return cover.groupBy("nb", "house_id").agg(
        m.distinct_with_missing("species").alias("lawn_richness")
    )


def type_richness(
    cover: DataFrame, link: DataFrame, nb_info: DataFrame, by: str = "med_inc_short"
) -> DataFrame:
    """Turf grass and weed richness against income.

    Grouping is by the income value itself, so neighbourhoods of equal income
    merge, and houses of unknown neighbourhood form a group of their own.
    """
    per_house = (
        cover.withColumn("type", m.recode("type", TYPE_LABELS))
        .groupBy("house_id", "type")
        .agg(m.distinct_with_missing("species").alias("type_sum"))
    )
    located = attach(attach(per_house, link, ["house_id"]), nb_info.drop("type"), ["nb"])
    return (
        located.groupBy(by, "type")
        .agg(
            m.strict_mean("type_sum").alias("type_mean"),
            m.strict_sd("type_sum").alias("sd"),
            m.rows().alias("n"),
        )
        .withColumn("se", m.standard_error("sd", "n"))
    )


def house_diversity(cover: DataFrame) -> DataFrame:
    """Richness and evenness per house; each row is a taxon."""
    return (
        community_structure(cover, "house_id", "ave_cov_all")
        .groupBy("house_id")
        .agg(
            m.strict_mean("richness").alias("l_richness"),
            m.lenient_mean("evar").alias("l_evenness"),
        )
    )


def neighbourhood_diversity(cover: DataFrame, link: DataFrame, nb_info: DataFrame) -> DataFrame:
    houses = community_structure(cover, "house_id", "ave_cov_all")
    means = (
        attach(houses, link, ["house_id"])
        .groupBy("nb")
        .agg(
            m.strict_mean("richness").alias("l_richness"),
            m.lenient_mean("evar").alias("l_evenness"),
        )
    )
    return attach(means, nb_info, ["nb"])


def house_natives(cover: DataFrame) -> DataFrame:
    """Native cover and native species per house; unclassified species are left out."""
    return (
        cover.where(F.col("native_merge") != NOT_APPLICABLE)
        .withColumn("native", m.to_number("native_merge"))
        .groupBy("nb", "house_id")
        .agg(
            m.strict_sum(F.col("native") * F.col("ave_cov_all")).alias("native_cover"),
            m.strict_sum("native").alias("native_rich"),
        )
    )


def native_species(cover: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Neighbourhood means of the house values."""
    means = (
        house_natives(cover)
        .groupBy("nb")
        .agg(
            m.strict_mean("native_rich").alias("nat_rich_mer"),
            m.strict_mean("native_cover").alias("nat_cover_mer"),
        )
    )
    return attach(means, nb_info, ["nb"])


def house_summary(cover: DataFrame) -> DataFrame:
    """Nitrogen fixers, native species and native cover per house."""
    native = m.to_number("native_merge")
    return cover.groupBy("house_id").agg(
        m.strict_sum(m.to_number("n_fixer")).alias("sum_nitrogen"),
        m.lenient_sum(native).alias("sum_native_sp"),
        m.lenient_sum(native * F.col("ave_cov_all")).alias("sum_native_cover"),
    )


def cover_by_type(cover: DataFrame) -> DataFrame:
    """Mean over houses of the summed cover of each species type."""
    return (
        cover.groupBy("nb", "house_id", "type")
        .agg(m.strict_sum("ave_cov_all").alias("cover"))
        .groupBy("type")
        .agg(m.strict_mean("cover").alias("avg_cover"))
    )
