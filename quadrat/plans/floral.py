"""Flowering plants: cleaned rows and the tables summarised from them."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import missing as m
from quadrat.operators.diversity import community_structure
from quadrat.operators.joins import attach, outer_zero_fill, right_zero_fill
from quadrat.operators.reshape import lengthen
from quadrat.operators.summaries import split_share, trait_counts

# Codes of the field protocol.
EXTRA_HOUSES = ("387_11_4",)
NO_FLOWERS = "NoFlowers"
NO_PHOTO = "NoPhoto"
UNKNOWN = "Unknown"
NOT_APPLICABLE = "n/a"
BLANK = "0"
COLOR_LEVELS = (
    "Blue", "Purple-Blue", "Purple", "Red-Purple", "Red", "Red-Orange", "Orange",
    "Yellow-Orange", "Yellow", "Green-Yellow", "White",
)
UNMAPPED_COLOR = "brown"
INCOME_LABELS = {"low": "Low", "mid": "Mid", "high": "High"}
INCOME_LEVELS = ("Low", "Mid", "High")
SQUARE_CM_PER_SQUARE_M = 10000

CLEAN_COLUMNS = (
    "nb", "block", "house_id", "family", "genus", "front_back", "water_wghtd", "water_man",
    "num_plants_water", "num_plants_water2", "num_plants", "native_plants", "native_bin",
    "num_flowers", "color1", "color2", "total_flower_area", "flower_size", "inf_type",
    "symmetry", "flowertype", "photo_id", "notes",
)


def _number(df: DataFrame, name: str):
    """A numeric column as it is, a text column through the lenient parser."""
    if isinstance(df.schema[name].dataType, T.StringType):
        return m.to_number(name)
    return F.col(name).cast("double")


def sampled(floral: DataFrame, exclude: Sequence[str] = EXTRA_HOUSES) -> DataFrame:
    """Rows of known neighbourhoods and regular sampling points."""
    return floral.where((F.col("nb") != "NA") & ~F.col("house_id").isin(list(exclude)))


def clean_rows(floral: DataFrame, exclude: Sequence[str] = EXTRA_HOUSES) -> DataFrame:
    """One row per plant observation with derived sizes, counts and areas."""
    rows = sampled(floral, exclude)
    parsed = rows.withColumns(
        {
            "num_plants": F.col("flower_plants"),
            "width": _number(rows, "flower_width_cm"),
            "length": _number(rows, "flower_length_cm"),
            "stems": _number(rows, "flower_stems"),
            "native_bin": _number(rows, "native_man"),
            "water_need": _number(rows, "water_man"),
        }
    )
    uncounted = F.col("water_man") == NOT_APPLICABLE
    derived = parsed.withColumns(
        {
            "flower_size": F.col("width") * F.col("length"),
            "num_flowers": F.col("stems") * F.col("ave_flower_perstem"),
            "native_plants": F.col("native_bin") * F.col("num_plants"),
            "num_plants_water": m.choose(
                uncounted, F.lit(NOT_APPLICABLE), m.number_text("num_plants")
            ),
            "num_plants_water2": m.choose(
                uncounted, F.lit(None).cast("double"), F.col("num_plants")
            ),
        }
    )
    area = F.col("flower_size") * F.col("num_flowers") / SQUARE_CM_PER_SQUARE_M
    return derived.withColumns(
        {
            "total_flower_area": area,
            "water_man": F.col("water_need"),
            "water_wghtd": F.col("water_need") * F.col("num_plants_water2"),
        }
    ).select(*CLEAN_COLUMNS)


def house_neighbourhoods(floral: DataFrame, exclude: Sequence[str] = EXTRA_HOUSES) -> DataFrame:
    """Distinct (neighbourhood, house) of the flower survey."""
    return sampled(floral, exclude).select("nb", "house_id").distinct()


def house_totals(rows: DataFrame) -> DataFrame:
    """Plants, flowers, area, flower size and water need per house."""
    return (
        rows.groupBy("nb", "house_id")
        .agg(
            m.strict_sum("num_plants").alias("total_plants"),
            m.gated_sum("num_plants_water2", "water_wghtd").alias("total_plants_water"),
            m.strict_sum("num_flowers").alias("total_flowers"),
            m.lenient_sum("total_flower_area").alias("total_area"),
            m.lenient_mean("flower_size").alias("avg_size"),
            m.lenient_sd("flower_size").alias("sd_size"),
            m.lenient_var("flower_size").alias("var_size"),
            m.lenient_sum("native_plants").alias("total_natives"),
            m.gated_sum("water_wghtd", "water_wghtd").alias("sum_water_wghtd"),
        )
        .withColumn("water_wghtd_avg", m.ratio("sum_water_wghtd", "total_plants_water"))
    )


def neighbourhood_totals(houses: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Means of the house totals per neighbourhood, with the neighbourhood's attributes."""
    summary = houses.groupBy("nb").agg(
        m.strict_mean("total_plants").alias("plants"),
        m.strict_sd("total_plants").alias("sd_plants"),
        m.rows().alias("n_plants"),
        m.strict_mean("total_flowers").alias("flowers"),
        m.strict_mean("total_area").alias("area"),
        m.strict_mean("avg_size").alias("m_size"),
        m.lenient_mean("sd_size").alias("m_sd_size"),
        m.lenient_mean("var_size").alias("m_var_size"),
        m.lenient_mean("total_natives").alias("natives_abun"),
        m.lenient_mean("water_wghtd_avg").alias("m_water"),
    )
    return attach(
        summary.withColumn("se_plants", m.standard_error("sd_plants", "n_plants")), nb_info, ["nb"]
    )


def genus_sums(rows: DataFrame) -> DataFrame:
    """Plants per house and genus."""
    return rows.groupBy("house_id", m.paste("family", "genus").alias("taxon")).agg(
        m.strict_sum("num_plants").alias("plants")
    )


def house_diversity(rows: DataFrame) -> DataFrame:
    return community_structure(genus_sums(rows), "house_id", "plants")


def neighbourhood_diversity(rows: DataFrame, link: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Mean genus richness and evenness of the houses of each neighbourhood."""
    means = (
        attach(house_diversity(rows), link, ["house_id"])
        .groupBy("nb")
        .agg(
            m.strict_mean("richness").alias("flow_rich"),
            m.lenient_mean("evar").alias("flow_even"),
        )
    )
    return attach(means, nb_info, ["nb"])


def with_traits(rows: DataFrame) -> DataFrame:
    """Trait codes; the codes for "nothing seen" become the blank code."""
    colors = m.paste("color1", "color2")
    taxon = m.paste("family", "genus")

    def blank(x, *codes):
        return m.choose(x.isin(list(codes)), F.lit(BLANK), x)

    return rows.withColumns(
        {
            "inflor": blank(F.col("inf_type"), NO_FLOWERS),
            "colors": blank(colors, f"{NO_FLOWERS} "),
            "genera": blank(taxon, f"{NO_FLOWERS} {NO_FLOWERS}"),
            "symm": blank(F.col("symmetry"), NO_FLOWERS, UNKNOWN),
            "sing_doub": blank(F.col("flowertype"), NO_FLOWERS, UNKNOWN),
        }
    )


HOUSE_TRAITS = {
    "inflor": "inflo_num",
    "colors": "color_num",
    "symm": "sym_num",
    "sing_doub": "sd_num",
    "genera": "genera_num",
}


def house_traits(rows: DataFrame, *results: str) -> DataFrame:
    """Distinct traits per house; ``results``: the counts that are wanted, all if none is named.

    Traits that are not counted do not move to the houses.
    """
    wanted = {c: name for c, name in HOUSE_TRAITS.items() if not results or name in results}
    return trait_counts(with_traits(rows), ["nb", "block", "house_id"], wanted, BLANK)


def neighbourhood_traits(houses: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Mean trait counts per neighbourhood with standard errors."""
    summary = (
        houses.groupBy("nb")
        .agg(
            m.strict_mean("inflo_num").alias("m_inflor"),
            m.strict_mean("color_num").alias("m_cols"),
            m.strict_mean("sym_num").alias("m_sym"),
            m.strict_mean("sd_num").alias("m_sd"),
            m.strict_mean("genera_num").alias("m_genera"),
            m.strict_sd("color_num").alias("sd_cols"),
            m.strict_sd("genera_num").alias("sd_genera"),
            m.strict_sd("inflo_num").alias("sd_inflor"),
            m.rows().alias("n_houses"),
        )
        .withColumns(
            {
                f"se_{trait}": m.standard_error(f"sd_{trait}", "n_houses")
                for trait in ("cols", "genera", "inflor")
            }
        )
    )
    return attach(summary, nb_info, ["nb"])


def color_area(rows: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Flower area by colour and income class, split over one or two colours.

    Areas are summed per neighbourhood before the attributes are attached, so the
    join sees one row per neighbourhood and colour.
    """
    seen = rows.where((F.col("color1") != NO_FLOWERS) & (F.col("color1") != NO_PHOTO))
    local = split_share(seen, ["nb"], "color1", "color2", "total_flower_area", "color").where(
        F.col("color") != UNMAPPED_COLOR
    )
    return (
        attach(local, nb_info.select("nb", "nb_inc"), ["nb"])
        .withColumn("income", m.recode("nb_inc", INCOME_LABELS))
        .groupBy("color", "income")
        .agg(m.lenient_sum("total_flower_area").alias("color_area"))
        .select(
            m.level_label("color", COLOR_LEVELS).alias("color"),
            m.level_rank("color", COLOR_LEVELS).alias("color_rank"),
            m.level_label("income", INCOME_LEVELS).alias("income"),
            m.level_rank("income", INCOME_LEVELS).alias("income_rank"),
            "color_area",
        )
    )


def front_back(rows: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Front and back yards: means of the house-side totals per neighbourhood."""
    sides = with_traits(rows).groupBy("nb", "block", "house_id", "front_back").agg(
        m.strict_sum("num_plants").alias("total_plants"),
        m.strict_sum("num_flowers").alias("total_flowers"),
        m.lenient_sum("total_flower_area").alias("total_area"),
        m.distinct_traits("colors").alias("color_num"),
        m.distinct_traits("genera").alias("total_genera"),
    )
    summary = (
        sides.groupBy("nb", "front_back")
        .agg(
            m.strict_mean("total_plants").alias("plants"),
            m.strict_sd("total_plants").alias("sd_plants"),
            m.rows().alias("n_houses"),
            m.strict_mean("total_flowers").alias("flowers"),
            m.strict_mean("total_area").alias("area"),
            m.strict_mean("color_num").alias("m_cols"),
            m.strict_sd("color_num").alias("sd_cols"),
            m.strict_mean("total_genera").alias("richness"),
            m.strict_sd("total_genera").alias("sd_rich"),
        )
        .withColumns(
            {
                **{
                    f"se_{name}": m.standard_error(f"sd_{name}", "n_houses")
                    for name in ("plants", "cols", "rich")
                },
                "richness_char": m.number_text("richness"),
            }
        )
    )
    return attach(summary, nb_info, ["nb"])


def house_native_richness(rows: DataFrame, link: DataFrame) -> DataFrame:
    """Native genera per house, 0 where none."""
    natives = (
        rows.where(F.col("native_bin") != 0)
        .groupBy("nb", "house_id")
        .agg(m.distinct_with_missing(m.paste("family", "genus")).alias("natives_rich"))
    )
    return right_zero_fill(natives, link, ["nb", "house_id"])


def native_richness(rows: DataFrame, link: DataFrame, nb_info: DataFrame) -> DataFrame:
    """Mean number of native genera per house; houses without natives count as 0."""
    means = (
        house_native_richness(rows, link)
        .groupBy("nb")
        .agg(m.strict_mean("natives_rich").alias("natf_rich"))
    )
    return attach(means, nb_info, ["nb"])


def labelled_rows(rows: DataFrame) -> DataFrame:
    """Cleaned rows with colour combination and genus label."""
    return rows.withColumns(
        {"color_combo": m.paste("color1", "color2"), "taxon": m.paste("family", "genus")}
    )


def water_need(rows: DataFrame) -> DataFrame:
    """Plants and weighted water need per genus and water class."""
    return (
        labelled_rows(rows)
        .groupBy("taxon", "water_man")
        .agg(m.strict_sum("num_plants").alias("plants"))
        .withColumn("water_weighted", F.col("plants") * F.col("water_man"))
    )


def layer_richness(
    rows: DataFrame, lawn_richness: DataFrame, link: DataFrame, nb_info: DataFrame
) -> DataFrame:
    """Lawn and flower richness side by side, per neighbourhood and layer.

    A house in only one of the two surveys has richness 0 in the other.
    """
    flowers = attach(house_diversity(rows).drop("evar"), link, ["house_id"])
    both = outer_zero_fill(lawn_richness, flowers, ["nb", "house_id"])
    long = lengthen(both, ["nb", "house_id"], ["lawn_richness", "richness"])
    summary = (
        long.groupBy("nb", "variable")
        .agg(
            m.strict_mean("value").alias("num_species"),
            m.strict_sd("value").alias("sd"),
            m.rows().alias("n"),
        )
        .withColumn("se", m.standard_error("sd", "n"))
    )
    return attach(summary, nb_info, ["nb"]).withColumn(
        "variable",
        m.recode(
            "variable", {"lawn_richness": "Lawn species", "richness": "Flowering plant genera"}
        ),
    )
