"""Every table, test and figure of a study by name.

``catalogue(study)`` is the whole analysis: nothing but the shared row-level,
pair and ordination tables is computed until a named entry is called.
"""

from __future__ import annotations

import functools
from collections.abc import Callable

from pyspark.sql import DataFrame

from quadrat.operators import community as cm
from quadrat.operators.correlation import pearson
from quadrat.operators.ordination import nmds
from quadrat.plans import communities, figures, floral, inference, lawn, survey
from quadrat.sources.study import Study

Table = Callable[[], DataFrame]


#: How many starts the study's two ordinations try at most.
MOST_STARTS = {"floral": 100, "lawn": 1000}


def catalogue(
    study: Study, permutations: int = 999, starts: dict[str, int] | None = None
) -> dict[str, Table]:
    starts = MOST_STARTS | (starts or {})
    prepared = functools.cache(lambda: inference.prepare(study))
    rows = lambda: prepared().rows
    cover = lambda: prepared().cover
    link = lambda: prepared().link
    info = lambda: prepared().nb_info

    traits = lambda: floral.neighbourhood_traits(floral.house_traits(rows()), info())
    sides = lambda: floral.front_back(rows(), info())
    types = lambda: lawn.type_richness(cover(), link(), info())
    items = lambda: survey.item_importance(study.survey_parcel)

    def layers() -> DataFrame:
        return floral.layer_richness(rows(), lawn.house_richness(cover()), link(), info())

    def attitude(item: str, count_missing: bool) -> DataFrame:
        return survey.attitude_by_neighbourhood(
            study.survey_parcel, info(), item, count_missing=count_missing
        )

    inputs = functools.cache(lambda: inference.interaction_inputs(prepared()))
    tables: dict[str, Table] = {
        "clean_rows": rows,
        "house_neighbourhoods": link,
        "house_totals": lambda: floral.house_totals(rows()),
        "nb_summary": lambda: floral.neighbourhood_totals(floral.house_totals(rows()), info()),
        "floral_diversity_house": lambda: floral.house_diversity(rows()),
        "floral_diversity": lambda: floral.neighbourhood_diversity(rows(), link(), info()),
        "house_traits": lambda: floral.house_traits(rows()),
        "traits": traits,
        "color_area": lambda: floral.color_area(rows(), info()),
        "front_back": sides,
        "native_richness": lambda: floral.native_richness(rows(), link(), info()),
        "flower_labels": lambda: floral.labelled_rows(rows()),
        "water_need": lambda: floral.water_need(rows()),
        "layer_richness": layers,
        "species_cover": cover,
        "lawn_types": types,
        "lawn_diversity_house": lambda: lawn.house_diversity(cover()),
        "lawn_diversity": lambda: lawn.neighbourhood_diversity(cover(), link(), info()),
        "lawn_natives": lambda: lawn.native_species(cover(), info()),
        "lawn_per_house": lambda: lawn.house_summary(cover()),
        "lawn_cover_by_type": lambda: lawn.cover_by_type(cover()),
        "item_importance": items,
        "attitude_biodiversity": lambda: attitude("a8", False),
        "attitude_color": lambda: attitude("a902", True),
        "income_correlations": lambda: inference.income_correlations(study),
        "color_genera_correlation": lambda: pearson(traits(), "m_cols", "m_genera"),
        "regression_terms": lambda: inference.regression_terms(
            inference.response_table(prepared())
        ),
        "regression_fits": lambda: inference.regression_fits(inference.response_table(prepared())),
        "interaction_anova": lambda: inference.interaction_tables(inputs()),
        "interaction_terms": lambda: inference.interaction_terms(inputs()),
        "fig_importance_general": lambda: figures.importance_bars(items(), survey.GENERAL_ITEMS),
        "fig_importance_traits": lambda: figures.importance_bars(items(), survey.TRAIT_ITEMS),
        "fig_attitude_biodiversity": lambda: figures.points(
            attitude("a8", False), "med_inc_short", "mean_a8", "se", y_limits=figures.SCORE_LIMITS
        ),
        "fig_attitude_color": lambda: figures.points(
            attitude("a902", True), "med_inc_short", "mean_a902", "se",
            y_limits=figures.SCORE_LIMITS,
        ),
        "fig_colors_by_income": lambda: figures.points_with_trend(
            traits(), "med_inc_short", "m_cols", "se_cols", y_limits=figures.COLOR_LIMITS
        ),
        "fig_genera_by_colors": lambda: figures.points_with_trend(
            traits(), "m_cols", "m_genera", "se_genera",
            figures.COLOR_AXIS_LIMITS, figures.GENERA_LIMITS,
        ),
        "fig_inflorescence_by_income": lambda: figures.points_with_trend(
            traits(), "med_inc_short", "m_inflor", "se_inflor",
            y_limits=figures.INFLORESCENCE_LIMITS,
        ),
        "fig_layers_by_income": lambda: figures.points_with_trend(
            layers(), "med_inc_short", "num_species", "se",
            y_limits=figures.LAYER_LIMITS, group="variable",
        ),
        "fig_types_by_income": lambda: figures.points_with_trend(
            types(), "med_inc_short", "type_mean", "se",
            y_limits=figures.TYPE_LIMITS, group="type",
        ),
        "fig_sides_richness": lambda: figures.points_with_trend(
            sides(), "med_inc_short", "richness", "se_rich",
            y_limits=figures.SIDE_RICHNESS_LIMITS, group="front_back",
        ),
        "fig_sides_colors": lambda: figures.points_with_trend(
            sides(), "med_inc_short", "m_cols", "se_cols",
            y_limits=figures.SIDE_COLOR_LIMITS, group="front_back",
        ),
    }
    if study.direct_house is not None:
        direct = study.direct_house
        tables["preference_correlations"] = lambda: inference.preference_correlations(direct)
        for x, y in inference.PREFERENCE_PAIRS:
            if y in figures.SCATTER_LIMITS and x != "watercons":
                tables[f"fig_{y}_by_{x}"] = lambda x=x, y=y: figures.preference_scatter(
                    direct, x, y, None, figures.SCATTER_LIMITS[y]
                )
    if study.water_cons is not None:
        tables["fig_water_by_attitude"] = lambda: figures.preference_scatter(
            study.water_cons, "watercons", "water_wghtd_avg",
            figures.WATER_ATTITUDE_LIMITS, figures.SCATTER_LIMITS["water_wghtd_avg"],
        )
    for which in ("floral", "lawn"):
        tables.update(_community_tables(study, prepared, which, permutations, starts[which]))
    return tables


def _community_tables(
    study: Study,
    prepared: Callable[[], inference.Prepared],
    which: str,
    permutations: int,
    most_starts: int,
) -> dict[str, Table]:
    attributes = {
        "floral": communities.FLORAL_ATTRIBUTES, "lawn": communities.LAWN_ATTRIBUTES
    }[which]

    @functools.cache
    def long() -> DataFrame:
        data = prepared()
        if which == "floral":
            return communities.floral_community(data.rows, data.nb_info)
        return communities.lawn_community(study.lawn, data.nb_info)

    community = functools.cache(
        lambda: inference.community_pairs(long(), inference.CENTROID_FACTORS)
    )
    ordination = functools.cache(lambda: nmds(community().pairs, most_starts=most_starts))
    distances = lambda: inference.dispersion_distances(community())

    def centroids() -> DataFrame:
        sites = community().sites.select("site", "nb", "nb_inc")
        return communities.score_centroids(ordination()[0], sites)

    return {
        f"{which}_community": long,
        f"{which}_matrix": lambda: communities.community_matrix(long(), attributes),
        f"{which}_distances": lambda: community().pairs,
        f"{which}_centroid_tests": lambda: inference.centroid_tests(community(), permutations),
        f"{which}_dispersion": distances,
        f"{which}_dispersion_groups": lambda: cm.group_dispersion(distances()),
        f"{which}_dispersion_tests": lambda: inference.dispersion_tests(
            community(), permutations
        ),
        f"{which}_ordination": lambda: ordination()[0],
        f"{which}_ordination_stress": lambda: ordination()[1],
        f"{which}_ordination_centroids": centroids,
        f"fig_{which}_ordination": lambda: figures.centroid_crosses(centroids()),
    }
