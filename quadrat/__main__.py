"""Run the whole analysis on a folder of study files.

    spark-submit --py-files ... -m quadrat STUDY_FOLDER OUTPUT_FOLDER [table ...]

Each table is written as Parquet under its name.
"""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from quadrat.plans.catalogue import catalogue
from quadrat.sources.study import read_study


def main(arguments: list[str] | None = None, spark: SparkSession | None = None) -> None:
    parser = argparse.ArgumentParser(prog="quadrat", description=__doc__)
    parser.add_argument("study", help="folder with the study's CSV files")
    parser.add_argument("output", help="folder for the result tables")
    parser.add_argument("tables", nargs="*", help="tables to write; all by default")
    parser.add_argument("--permutations", type=int, default=999)
    parser.add_argument("--starts", type=int, help="most starts of either ordination")
    parser.add_argument(
        "--file", action="append", default=[], metavar="TABLE=FILE", help="name of an input file"
    )
    options = parser.parse_args(arguments)
    files = dict(item.split("=", 1) for item in options.file)
    spark = spark or SparkSession.builder.appName("quadrat").getOrCreate()
    study = read_study(spark, options.study, files)
    starts = dict.fromkeys(("floral", "lawn"), options.starts) if options.starts else None
    tables = catalogue(study, options.permutations, starts)
    unknown = set(options.tables) - set(tables)
    if unknown:
        parser.error(f"unknown tables: {', '.join(sorted(unknown))}")
    for name in options.tables or tables:
        tables[name]().write.mode("overwrite").parquet(f"{options.output}/{name}")


if __name__ == "__main__":
    main()
