"""``queries()``: every table, test and figure of the study over one table folder."""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from checks.oracles import lawn_taxa, taxa
from checks.rounding import fixed
from quadrat.functions import missing as m
from quadrat.operators import community as cm
from quadrat.operators.correlation import kendall, pearson
from quadrat.operators.diversity import community_structure
from quadrat.operators.joins import attach, outer_zero_fill
from quadrat.operators.ordination import half_change, monotone_fit, nmds
from quadrat.operators.regression import interaction_anova, ols_coefficients, trend_lines
from quadrat.plans import communities, figures, floral, inference, lawn, survey
from quadrat.session import materialise
from quadrat.sources import star

Query = Callable[[SparkSession, str], DataFrame]
PERMUTATIONS = 999
NMDS_STARTS = 8

_shared: dict[tuple, object] = {}


def forget() -> None:
    """Drop the shared intermediate tables, so that the next query starts cold."""
    _shared.clear()


def _once(spark: SparkSession, folder: str, what: str, make: Callable[[], object]):
    """Intermediate tables several queries start from are written once per session."""
    key = (spark.sparkContext.applicationId, folder, what)
    if key not in _shared:
        _shared[key] = make()
    return _shared[key]


class Data:
    """Lazily built inputs of one query."""

    def __init__(self, spark: SparkSession, folder: str):
        self.spark, self.folder = spark, folder
        self.study = star.study(spark, folder)

    @functools.cached_property
    def rows(self) -> DataFrame:
        return floral.clean_rows(self.study.floral)

    @functools.cached_property
    def link(self) -> DataFrame:
        return floral.house_neighbourhoods(self.study.floral)

    @functools.cached_property
    def cover(self) -> DataFrame:
        lookup = _once(
            self.spark,
            self.folder,
            "native lawn",
            lambda: materialise(self.study.native_lawn, "native-lawn"),
        )
        return lawn.species_cover(self.study.lawn, lookup)

    @property
    def info(self) -> DataFrame:
        return self.study.nb_info

    @property
    def prepared(self) -> inference.Prepared:
        return _once(
            self.spark, self.folder, "prepared", lambda: inference.prepare(self.study)
        )

    @property
    def direct(self) -> DataFrame:
        shared = self.prepared
        return star.direct_house(self.study.survey_parcel, shared.rows, shared.cover)

    def community(self, which: str) -> inference.Community:
        return _once(
            self.spark,
            self.folder,
            f"{which} pairs",
            lambda: inference.community_pairs(
                self.long(which), inference.CENTROID_FACTORS
            ),
        )

    def long(self, which: str) -> DataFrame:
        if which == "floral":
            return communities.floral_community(self.rows, self.info)
        return communities.lawn_community(self.study.lawn, self.info)

    def distances(self, which: str) -> DataFrame:
        return inference.dispersion_distances(self.community(which))

    def ordination(self, which: str) -> tuple[DataFrame, DataFrame]:
        return _once(
            self.spark,
            self.folder,
            f"{which} ordination",
            lambda: nmds(self.community(which).pairs, most_starts=NMDS_STARTS),
        )


def _table(name: str, spark: SparkSession, folder: str) -> DataFrame:
    return star.table(spark, folder, name)


# ---------------------------------------------------------------- summaries


def _house_totals(d: Data) -> DataFrame:
    return floral.house_totals(d.rows)


def _nb_summary(d: Data) -> DataFrame:
    return floral.neighbourhood_totals(floral.house_totals(d.rows), d.info)


def _traits(d: Data) -> DataFrame:
    return floral.neighbourhood_traits(floral.house_traits(d.rows), d.info)


def _layers(d: Data) -> DataFrame:
    return floral.layer_richness(d.rows, lawn.house_richness(d.cover), d.link, d.info)


def _both_layers(d: Data) -> DataFrame:
    flowers = attach(floral.house_diversity(d.rows).drop("evar"), d.link, ["house_id"])
    return outer_zero_fill(lawn.house_richness(d.cover), flowers, ["nb", "house_id"])


def _types(d: Data) -> DataFrame:
    return lawn.type_richness(d.cover, d.link, d.info)


def _sides(d: Data) -> DataFrame:
    return floral.front_back(d.rows, d.info)


def _attitude(d: Data, item: str, count_missing: bool) -> DataFrame:
    return survey.attitude_by_neighbourhood(
        d.study.survey_parcel, d.info, item, count_missing=count_missing
    )


def _importance(d: Data) -> DataFrame:
    return survey.item_importance(d.study.survey_parcel)


SUMMARIES: dict[str, Callable[[Data], DataFrame]] = {
    "clean_rows": lambda d: d.rows,
    "house_neighbourhoods": lambda d: d.link,
    "house_totals": _house_totals,
    "nb_summary": _nb_summary,
    "richness_evenness_house": lambda d: floral.house_diversity(d.rows),
    "richness_evenness": lambda d: floral.neighbourhood_diversity(d.rows, d.link, d.info),
    "distinct_traits_house": lambda d: floral.house_traits(d.rows),
    "distinct_traits": _traits,
    "row_mean_cover": lambda d: d.cover,
    "item_importance": _importance,
    "floral_taxon_long": lambda d: d.long("floral"),
    "lawn_taxon_long": lambda d: d.long("lawn"),
    "floral_taxon_wide": lambda d: communities.community_matrix(
        d.long("floral"), communities.FLORAL_ATTRIBUTES, taxa()
    ),
    "lawn_taxon_wide": lambda d: communities.community_matrix(
        d.long("lawn"), communities.LAWN_ATTRIBUTES, lawn_taxa()
    ),
    "plot_cover_long": lambda d: communities.plot_covers(d.study.lawn),
    "color_area": lambda d: floral.color_area(d.rows, d.info),
    "outer_zero_fill": _both_layers,
    "layer_richness": _layers,
    "type_richness_by_income": _types,
    "front_back": _sides,
    "right_zero_fill": lambda d: floral.house_native_richness(d.rows, d.link),
    "native_richness": lambda d: floral.native_richness(d.rows, d.link, d.info),
    "lawn_richness_evenness_house": lambda d: lawn.house_diversity(d.cover),
    "lawn_richness_evenness": lambda d: lawn.neighbourhood_diversity(d.cover, d.link, d.info),
    "native_cover": lambda d: lawn.native_species(d.cover, d.info),
    "flower_labels": lambda d: floral.labelled_rows(d.rows).select(
        "house_id", "photo_id", "color_combo", "taxon"
    ),
    "water_need": lambda d: floral.water_need(d.rows),
    "lawn_per_house": lambda d: lawn.house_summary(d.cover),
    "cover_by_type": lambda d: lawn.cover_by_type(d.cover),
    "direct_house": lambda d: d.direct,
    "pearson_income": lambda d: inference.income_correlations(d.study),
    "pearson_colors_genera": lambda d: pearson(
        _traits(d).withColumn("comparison", F.lit("m_cols ~ m_genera")),
        "m_cols",
        "m_genera",
        ["comparison"],
    ),
    "kendall": lambda d: inference.preference_correlations(d.direct),
}

# ---------------------------------------------------------------- models


def _terms(d: Data) -> DataFrame:
    return inference.regression_terms(inference.response_table(d.prepared))


MODELS: dict[str, tuple[tuple[str, ...], Callable[[Data], DataFrame]]] = {
    "ols_table": (("estimate", "std_error"), _terms),
    "ols_fits": (
        ("sigma",),
        lambda d: inference.regression_fits(inference.response_table(d.prepared)),
    ),
    "partial_r2": (
        (),
        lambda d: _terms(d)
        .where(F.col("term") != "(intercept)")
        .select("response", "term", "partial_r2"),
    ),
    "anova_interaction": (
        ("ss", "ms", "f"),
        lambda d: inference.interaction_tables(inference.interaction_inputs(d.prepared)),
    ),
    "interaction_coefficients": (
        ("estimate", "std_error"),
        lambda d: inference.interaction_terms(
            materialise(inference.interaction_inputs(d.prepared), "interaction-inputs")
        ),
    ),
}

# ---------------------------------------------------------------- communities


def _community_queries(which: str) -> dict[str, Callable[[Data], DataFrame]]:
    return {
        f"{which}_bray_curtis": lambda d: d.community(which).pairs,
        f"{which}_permanova_stat": lambda d: cm.permanova(
            d.community(which).pairs, d.community(which).labels
        ),
        f"{which}_permanova_perm": lambda d: inference.centroid_tests(
            d.community(which), PERMUTATIONS
        ),
        f"{which}_dispersion": lambda d: d.distances(which),
        f"{which}_dispersion_groups": lambda d: cm.group_dispersion(d.distances(which)),
        f"{which}_dispersion_perm": lambda d: inference.dispersion_tests(
            d.community(which), PERMUTATIONS
        ),
        f"{which}_nmds_scores": lambda d: d.ordination(which)[0],
        f"{which}_nmds_stress": lambda d: d.ordination(which)[1],
        f"{which}_nmds_centroids": lambda d: _centroids(d, which),
        f"{which}_nmds_checks": lambda d: _nmds_checks(d, which),
    }


def _nmds_checks(d: Data, which: str) -> DataFrame:
    """How often an ordination breaks what defines it, from its scores and the pairs.

    A fit is the monotone one if its levels rise with the dissimilarities, and within each level
    the misfits add up to 0 and their running sums are never negative.
    """
    scores, trace = d.ordination(which)
    pairs = d.community(which).pairs
    fitted = materialise(monotone_fit(pairs, scores), "nmds-checked")
    values = fitted.groupBy("h", "d").agg(F.sum(F.col("dist") - F.col("h")).alias("gap"))
    order = W.partitionBy("h").orderBy("d")
    running = values.withColumn("sofar", F.sum("gap").over(order))
    levels = fitted.groupBy("h").agg(
        F.min("d").alias("low"), F.max("d").alias("high"), F.sum(F.col("dist") - F.col("h")).alias("gap")
    )
    spread = fitted.groupBy("d").agg(F.count_distinct("h").alias("levels"))
    # One row a level, so this window holds far fewer rows than there are pairs.
    falling = levels.withColumn("before", F.lag("high").over(W.orderBy("h"))).where("before >= low")
    told = trace.agg(F.min("stress")).first()[0]
    again = F.sqrt(F.sum((F.col("dist") - F.col("h")) ** 2) / F.sum(F.col("dist") ** 2))
    axes = scores.agg(
        F.avg("axis1").alias("m1"), F.avg("axis2").alias("m2"), F.covar_pop("axis1", "axis2").alias("c"),
        F.var_pop("axis1").alias("v1"), F.var_pop("axis2").alias("v2"),
    )
    slack = 1e-9
    unit, _ = half_change(pairs, scores)

    def row(name: str, frame: DataFrame, value) -> DataFrame:
        return frame.agg(value.cast("bigint").alias("n")).select(F.lit(name).alias("check_name"), "n")

    found = [
        row("sites", scores, F.count("axis1")),
        row("pairs", fitted, F.count("h")),
        row("centroids", _centroids(d, which), F.count("m1")),
        row("starts that did not converge", trace, F.count_if(~F.col("converged"))),
        row("axes off centre", axes, F.max((F.abs("m1") > slack).cast("int") + (F.abs("m2") > slack).cast("int"))),
        row("axes correlated", axes, F.max((F.abs("c") > slack).cast("int"))),
        row("axes out of order", axes, F.max((F.col("v1") < F.col("v2") - slack).cast("int"))),
        row("values with two levels", spread, F.count_if(F.col("levels") > 1)),
        row("levels off their mean", levels, F.count_if(F.abs("gap") > 1e-7)),
        row("levels that should part", running, F.count_if(F.col("sofar") < -1e-7)),
        row("levels that fall", falling, F.count("h")),
        row("stress off", fitted, (F.abs(again - F.lit(told)) > slack).cast("int")),
        row("unit off", axes, F.max(F.lit(int(unit is None or abs(unit - 1) > 1e-6)))),
    ]
    return functools.reduce(DataFrame.unionByName, found)


def _centroids(d: Data, which: str) -> DataFrame:
    return communities.score_centroids(
        d.ordination(which)[0], d.community(which).sites.select("site", "nb", "nb_inc")
    )


# ---------------------------------------------------------------- figures

TRENDS = ("slope", "intercept")
FIGURES: dict[str, tuple[tuple[str, ...], Callable[[Data], DataFrame]]] = {
    "fig_importance_general": (
        (), lambda d: figures.importance_bars(_importance(d), survey.GENERAL_ITEMS)
    ),
    "fig_importance_traits": (
        (), lambda d: figures.importance_bars(_importance(d), survey.TRAIT_ITEMS)
    ),
    "fig_attitude_biodiversity": (
        (),
        lambda d: figures.points(
            _attitude(d, "a8", False), "med_inc_short", "mean_a8", "se",
            y_limits=figures.SCORE_LIMITS,
        ),
    ),
    "fig_attitude_color": (
        (),
        lambda d: figures.points(
            _attitude(d, "a902", True), "med_inc_short", "mean_a902", "se",
            y_limits=figures.SCORE_LIMITS,
        ),
    ),
    "fig_floral_ordination": (
        (), lambda d: figures.centroid_crosses(_centroids(d, "floral"))
    ),
    "fig_lawn_ordination": ((), lambda d: figures.centroid_crosses(_centroids(d, "lawn"))),
    "fig_colors_by_income": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _traits(d), "med_inc_short", "m_cols", "se_cols", y_limits=(0.0, 40.0)
        ),
    ),
    "fig_genera_by_colors": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _traits(d), "m_cols", "m_genera", "se_genera",
            x_limits=(0.0, 22.0), y_limits=(0.0, 60.0),
        ),
    ),
    "fig_inflorescence_by_income": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _traits(d), "med_inc_short", "m_inflor", "se_inflor",
            y_limits=figures.INFLORESCENCE_LIMITS,
        ),
    ),
    "fig_layers_by_income": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _layers(d), "med_inc_short", "num_species", "se",
            y_limits=(0.0, 31.0), group="variable",
        ),
    ),
    "fig_types_by_income": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _types(d), "med_inc_short", "type_mean", "se",
            y_limits=figures.TYPE_LIMITS, group="type",
        ),
    ),
    "fig_sides_richness": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _sides(d), "med_inc_short", "richness", "se_rich",
            y_limits=(0.0, 18.0), group="front_back",
        ),
    ),
    "fig_sides_colors": (
        TRENDS,
        lambda d: figures.points_with_trend(
            _sides(d), "med_inc_short", "m_cols", "se_cols",
            y_limits=(0.0, 14.0), group="front_back",
        ),
    ),
    "fig_preference_scatter": (
        (),
        lambda d: functools.reduce(
            DataFrame.unionByName,
            [
                figures.preference_scatter(
                    d.direct,
                    x,
                    y,
                    figures.WATER_ATTITUDE_LIMITS if x == "watercons" else None,
                    figures.SCATTER_LIMITS[y],
                ).select(F.lit(f"{x} ~ {y}").alias("comparison"), "x", "y")
                for x, y in inference.PREFERENCE_PAIRS
                if y in figures.SCATTER_LIMITS
            ],
        ),
    ),
}

# ---------------------------------------------------------------- large tables


def _missing_value_rules(spark: SparkSession, folder: str) -> DataFrame:
    x = F.nullif("l_discount", F.lit(0.0))
    gate = F.nullif("l_tax", F.lit(0.0))
    return _table("lineitem", spark, folder).groupBy("l_suppkey").agg(
        m.strict_sum(x).alias("strict_sum"),
        m.lenient_sum(x).alias("lenient_sum"),
        m.gated_sum(x, gate).alias("gated_sum"),
        m.strict_mean(x).alias("strict_mean"),
        m.lenient_mean(x).alias("lenient_mean"),
        m.strict_sd(x).alias("strict_sd"),
        m.lenient_sd(x).alias("lenient_sd"),
        m.lenient_var(x).alias("lenient_var"),
        m.rows().alias("all_rows"),
        m.present(x).alias("present_rows"),
        m.distinct_with_missing(x).alias("distinct_values"),
    )


def _priced_orders(spark: SparkSession, folder: str) -> DataFrame:
    orders, customer = _table("orders", spark, folder), _table("customer", spark, folder)
    return orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))


def _ols_by_group(spark: SparkSession, folder: str) -> DataFrame:
    lines = _table("lineitem", spark, folder).withColumn(
        "grp", F.concat("l_returnflag", "l_linestatus")
    )
    return ols_coefficients(
        lines, "l_extendedprice", ["l_quantity", "l_discount", "l_tax"], ["grp"]
    )


LARGE: dict[str, tuple[tuple[str, ...], Query]] = {
    "missing_value_rules": ((), _missing_value_rules),
    "pearson_by_group": (
        (), lambda s, f: pearson(_priced_orders(s, f), "o_totalprice", "c_acctbal", ["c_nationkey"])
    ),
    "kendall_by_group": (
        (), lambda s, f: kendall(_priced_orders(s, f), "o_totalprice", "c_acctbal", ["c_nationkey"])
    ),
    "kendall_ordinal": (
        (),
        lambda s, f: kendall(
            _table("lineitem", s, f), "l_quantity", "l_discount", ["l_returnflag"]
        ),
    ),
    "ols_by_group": (("estimate", "std_error"), _ols_by_group),
    "anova_by_group": (
        ("ss", "ms", "f"),
        lambda s, f: interaction_anova(
            _table("lineitem", s, f),
            "l_extendedprice", "l_quantity", "l_linestatus", ["l_returnflag"],
        ),
    ),
    "trend_lines_by_group": (
        TRENDS,
        lambda s, f: trend_lines(
            _table("lineitem", s, f).withColumnRenamed("l_returnflag", "series"),
            "l_quantity", "l_extendedprice", ["series"], (5.0, 45.0), (1000.0, 60000.0),
        ),
    ),
    "event_richness": (
        (),
        lambda s, f: community_structure(
            _table("events", s, f).groupBy("user_id", "event_type").agg(m.rows().alias("n")),
            "user_id",
            "n",
        ),
    ),
}


def _registered(make: Callable[[Data], DataFrame], significant: tuple[str, ...] = ()) -> Query:
    return lambda spark, folder: fixed(make(Data(spark, folder)), significant)


def _registered_large(make: Query, significant: tuple[str, ...]) -> Query:
    return lambda spark, folder: fixed(make(spark, folder), significant)


def queries() -> dict[str, Query]:
    registered = {name: _registered(make) for name, make in SUMMARIES.items()}
    for name, (digits, make) in {**MODELS, **FIGURES}.items():
        registered[name] = _registered(make, digits)
    for which in ("floral", "lawn"):
        registered.update(
            {name: _registered(make) for name, make in _community_queries(which).items()}
        )
    for name, (digits, make) in LARGE.items():
        registered[name] = _registered_large(make, digits)
    return registered
