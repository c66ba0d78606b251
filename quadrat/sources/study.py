"""The study's input tables and their clean-up from CSV text."""

from __future__ import annotations

import re
from collections.abc import Mapping
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quadrat.functions import missing as m

# Headers that are renamed beyond lower-casing, written as a statistics
# package rewrites them (dots for symbols).
RENAMED = {
    "Yr_Built.x": "yr_built",
    "X.F.stems": "flower_stems",
    "X..F.plants": "flower_plants",
    "Flower.Width..cm.": "flower_width_cm",
    "Flower.Length..cm.": "flower_length_cm",
    "N.fixer": "n_fixer",
}
NUMERIC = {
    "nb_info": ["med_inc", "yr_built", "ave_elev", "ann_precip"],
    "direct_house": [
        "a902", "color_num_f", "a8", "rich_flowers", "a6", "natives_rich_f", "watercons",
        "water_wghtd_avg", "native_cover_l",
    ],
    "survey_parcel": [],
    "floral": ["flower_plants", "ave_flower_perstem"],
    "lawn": ["f1", "f2", "b1", "b2"],
    "native_lawn": [],
    "water_cons": ["watercons", "water_wghtd_avg"],
}

FILES = {name: f"{name}.csv" for name in NUMERIC}


@dataclass(frozen=True)
class Study:
    """The seven input tables, already normalised."""

    nb_info: DataFrame
    floral: DataFrame
    lawn: DataFrame
    native_lawn: DataFrame
    survey_parcel: DataFrame
    direct_house: DataFrame | None = None
    water_cons: DataFrame | None = None


def column_name(header: str) -> str:
    """snake_case name for a raw or already rewritten header."""
    dotted = re.sub(r"[^A-Za-z0-9._]", ".", header.strip())
    if not re.match(r"[A-Za-z]", dotted):
        dotted = "X" + dotted
    if dotted in RENAMED:
        return RENAMED[dotted]
    return re.sub(r"_+", "_", dotted.replace(".", "_")).strip("_").lower()


def normalise(df: DataFrame, numeric: list[str]) -> DataFrame:
    """Text as read from CSV to values with one missing marker.

    ``NA`` is missing.  A blank text cell is the empty text, which later rules
    rely on; a blank or unreadable number is missing.
    """
    cleaned = []
    for field in df.schema.fields:
        column = F.col(f"`{field.name}`")
        name = column_name(field.name)
        if name in numeric:
            column = m.to_number(column)
        elif isinstance(field.dataType, T.StringType):
            column = F.nullif(F.coalesce(column, F.lit("")), F.lit("NA"))
        cleaned.append(column.alias(name))
    return df.select(*cleaned)


def read_table(spark: SparkSession, path: str, numeric: list[str]) -> DataFrame:
    """One CSV file or folder; names come from the header, all cells are read as text."""
    return normalise(spark.read.csv(path, header=True, inferSchema=False, escape='"'), numeric)


def income_in_thousands(nb_info: DataFrame) -> DataFrame:
    return nb_info.withColumn("med_inc_short", F.col("med_inc") / 1000)


def read_study(
    spark: SparkSession, folder: str, files: Mapping[str, str] = FILES
) -> Study:
    """All tables of a study folder; ``files`` names any that are called differently."""
    names = {**FILES, **files}
    tables = {
        name: read_table(spark, f"{folder}/{names[name]}", numeric)
        for name, numeric in NUMERIC.items()
    }
    tables["nb_info"] = income_in_thousands(tables["nb_info"])
    return Study(**tables)
