"""Home-owner survey: item importance and attitudes by neighbourhood."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.functions import missing as m
from quadrat.operators.joins import attach
from quadrat.operators.reshape import lengthen
from quadrat.operators.summaries import mean_se

# Survey item codes, their labels and the house that skipped them.
# Item A909 has no label and keeps its code.
ITEM_LABELS = {
    "A6": "Natives",
    "A7": "Variety",
    "A8": "Biodiversity",
    "A901": "Leaf Color",
    "A902": "Flower Color",
    "A903": "Flower Type",
    "A904": "Plant Shape",
    "A905": "Plant Height",
    "A906": "Seasonal Color",
    "A907": "Leaf Texture",
    "A908": "Plant Type",
    "A910": "Ornamental Species",
}
GENERAL_ITEMS = ("A6", "A7", "A8")
TRAIT_ITEMS = ("A901", "A902", "A903", "A904", "A905", "A906", "A907", "A908", "A910")
SKIPPED_HOUSES = ("110_2_1",)
IDS = ("parcel_id", "house_id")


def item_importance(survey: DataFrame) -> DataFrame:
    """Mean, deviation and count of every non-id column of the survey.

    Each column is summarised in one pass and the one-row result is unpivoted,
    so the answers themselves are never multiplied.
    """
    columns = [c for c in survey.columns if c not in IDS]
    answers = survey.select(*[m.to_number(F.col(c).cast("string")).alias(c) for c in columns])
    summary = answers.agg(
        *[
            F.struct(
                m.lenient_mean(c).alias("importance"),
                m.lenient_sd(c).alias("sd"),
                m.present(c).alias("n"),
            ).alias(c)
            for c in columns
        ]
    )
    long = lengthen(summary, [], {c: c.upper() for c in columns}, value="item")
    return long.select(m.recode("variable", ITEM_LABELS).alias("variable"), "item.*").withColumn(
        "se", m.standard_error("sd", "n")
    )


def attitude_by_neighbourhood(
    survey: DataFrame,
    nb_info: DataFrame,
    item: str,
    *,
    count_missing: bool,
    exclude: Sequence[str] = SKIPPED_HOUSES,
) -> DataFrame:
    """Mean answer per neighbourhood.

    The standard error divides by all houses or by those that answered; the
    study uses both, so the caller chooses.
    """
    answers = survey.where(~F.col("house_id").isin(list(exclude))).select(
        "nb", m.to_number(F.col(item).cast("string")).alias("answer")
    )
    summary = mean_se(
        answers,
        ["nb"],
        "answer",
        f"mean_{item}",
        strict=False,
        n=m.rows() if count_missing else m.present("answer"),
    )
    return attach(summary, nb_info, ["nb"])
