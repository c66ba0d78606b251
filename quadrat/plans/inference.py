"""The study's tests: regressions, ANOVAs, correlations and community tests."""

from __future__ import annotations

import functools
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.operators import community as cm
from quadrat.operators.correlation import kendall, pearson
from quadrat.operators.distance import bray_curtis
from quadrat.operators.regression import (
    interaction_anova,
    interaction_coefficients,
    ols_coefficients,
    ols_fit,
)
from quadrat.operators.reshape import lengthen
from quadrat.plans import communities, floral, lawn, survey
from quadrat.session import materialise
from quadrat.sources.study import Study

PREDICTORS = ("med_inc", "yr_built", "ave_elev")

# The fitted responses, by the table that holds them.
RESPONSES = {
    "diversity": ("flow_rich", "flow_even"),
    "totals": (
        "flowers", "plants", "m_sd_size", "m_var_size", "area", "natives_abun", "m_water",
    ),
    "traits": ("m_cols", "m_inflor", "m_sym", "m_sd"),
    "natives": ("natf_rich",),
    "lawn": ("l_richness", "l_evenness"),
    "lawn_natives": ("nat_rich_mer", "nat_cover_mer"),
}

# Preference item and yard measure of each direct comparison.
PREFERENCE_PAIRS = (
    ("a902", "color_num_f"),
    ("a8", "rich_flowers"),
    ("a6", "natives_rich_f"),
    ("watercons", "water_wghtd_avg"),
    ("a6", "native_cover_l"),
)


@dataclass(frozen=True)
class Prepared:
    """A study with its row-level tables computed once.

    Most tables of the study start from the same cleaned rows; writing them once
    spares each of them the raw scan and its joins.
    """

    study: Study
    rows: DataFrame
    cover: DataFrame
    link: DataFrame
    nb_info: DataFrame


def prepare(study: Study) -> Prepared:
    lookup = materialise(study.native_lawn, "native-lawn")
    unused = ("num_plants_water", "photo_id", "notes")
    rows = materialise(floral.clean_rows(study.floral).drop(*unused), "clean-rows")
    return Prepared(
        study=study,
        rows=rows,
        cover=materialise(lawn.species_cover(study.lawn, lookup), "species-cover"),
        link=rows.select("nb", "house_id").distinct(),
        nb_info=materialise(study.nb_info, "nb-info"),
    )


def response_table(data: Prepared) -> DataFrame:
    """Long ``(response, nb, y, predictors)`` of all neighbourhood-level responses."""
    info = data.nb_info
    tables = {
        "diversity": floral.neighbourhood_diversity(data.rows, data.link, info),
        "totals": floral.neighbourhood_totals(floral.house_totals(data.rows), info),
        "traits": floral.neighbourhood_traits(floral.house_traits(data.rows), info),
        "natives": floral.native_richness(data.rows, data.link, info),
        "lawn": lawn.neighbourhood_diversity(data.cover, data.link, info),
        "lawn_natives": lawn.native_species(data.cover, info),
    }
    long = [
        lengthen(tables[name], ["nb", *PREDICTORS], list(columns), "response", "y")
        for name, columns in RESPONSES.items()
    ]
    return functools.reduce(DataFrame.unionByName, long)


def regression_terms(responses: DataFrame) -> DataFrame:
    return ols_coefficients(responses, "y", PREDICTORS, ["response"])


def regression_fits(responses: DataFrame) -> DataFrame:
    return ols_fit(responses, "y", PREDICTORS, ["response"])


def interaction_inputs(data: Prepared) -> DataFrame:
    """Long ``(comparison, income, grouping, y)`` of the four income x group models."""
    info = data.nb_info
    layers = floral.layer_richness(data.rows, lawn.house_richness(data.cover), data.link, info)
    types = lawn.type_richness(data.cover, data.link, info)
    sides = floral.front_back(data.rows, info)

    def model(name, df, income, group, y):
        return df.select(
            F.lit(name).alias("comparison"),
            F.col(income).alias("income"),
            F.col(group).alias("grouping"),
            F.col(y).alias("y"),
        )

    return functools.reduce(
        DataFrame.unionByName,
        [
            model("layer richness", layers, "med_inc", "variable", "num_species"),
            model("lawn type richness", types, "med_inc_short", "type", "type_mean"),
            model("yard side richness", sides, "med_inc", "front_back", "richness"),
            model("yard side colours", sides, "med_inc", "front_back", "m_cols"),
        ],
    )


# Reference level of each comparison's grouping.
REFERENCE_LEVELS = {
    "layer richness": "Lawn species",
    "lawn type richness": "Turfgrasses",
    "yard side richness": "Back",
    "yard side colours": "Back",
}


def interaction_tables(inputs: DataFrame) -> DataFrame:
    return interaction_anova(inputs, "y", "income", "grouping", ["comparison"])


def interaction_terms(inputs: DataFrame) -> DataFrame:
    return functools.reduce(
        DataFrame.unionByName,
        [
            interaction_coefficients(
                inputs.where(F.col("comparison") == name),
                "y", "income", "grouping", level, ["comparison"],
            )
            for name, level in REFERENCE_LEVELS.items()
        ],
    )


def income_correlations(study: Study) -> DataFrame:
    """Pearson tests of two attitudes against income."""
    tests = [
        survey.attitude_by_neighbourhood(
            study.survey_parcel, study.nb_info, item, count_missing=count_missing
        ).select(F.lit(item).alias("item"), F.col(f"mean_{item}").alias("x"), "med_inc")
        for item, count_missing in (("a8", False), ("a902", True))
    ]
    return pearson(functools.reduce(DataFrame.unionByName, tests), "x", "med_inc", ["item"])


def preference_correlations(direct_house: DataFrame) -> DataFrame:
    """Kendall tests of stated preference against yard measure."""
    pairs = F.array(
        *[
            F.struct(
                F.lit(f"{x} ~ {y}").alias("comparison"),
                F.col(x).cast("double").alias("x"),
                F.col(y).cast("double").alias("y"),
            )
            for x, y in PREFERENCE_PAIRS
        ]
    )
    return kendall(direct_house.select(F.inline(pairs)), "x", "y", ["comparison"])


@dataclass(frozen=True)
class Community:
    """Sites, their factors, and the pair table every community test shares."""

    sites: DataFrame
    labels: DataFrame
    pairs: DataFrame


def community_pairs(community: DataFrame, factors: Sequence[str]) -> Community:
    """Pair table of a long community; both tables are written once and reused."""
    cells = materialise(
        community.where(F.col("abundance") > 0).select(
            "site", "taxon", "abundance", "nb", *[f for f in factors if f != "nb"]
        ),
        "community",
    )
    sites = communities.community_sites(cells, [f for f in factors if f != "nb"])
    return Community(
        sites=sites,
        labels=materialise(cm.site_labels(sites, "site", list(factors)), "site-labels"),
        pairs=materialise(bray_curtis(cells, "site", "taxon", "abundance"), "site-pairs"),
    )


CENTROID_FACTORS = ("nb", "nb_age", "nb_inc")
DISPERSION_FACTORS = ("nb_inc", "nb_age")


def centroid_tests(community: Community, permutations: int = 999) -> DataFrame:
    return cm.permanova_test(community.pairs, community.labels, permutations)


def dispersion_distances(community: Community) -> DataFrame:
    labels = community.labels.where(F.col("factor").isin(list(DISPERSION_FACTORS)))
    return cm.dispersion(community.pairs, labels)


def dispersion_tests(community: Community, permutations: int = 999) -> DataFrame:
    distances = materialise(dispersion_distances(community), "centroid-distances")
    return cm.dispersion_test(distances, permutations)
