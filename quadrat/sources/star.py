"""A study laid over star-schema order tables.

Nations act as neighbourhoods, market segments as blocks, customers as houses,
line items as plant observations, orders as lawn plots.  Missing values, blanks,
sentinels and unreadable numbers are derived from ordinary attributes, so every
missing-value rule is exercised and the study grows with the tables.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quadrat.plans import floral as floral_plans
from quadrat.plans import lawn as lawn_plans
from quadrat.session import spread
from quadrat.sources.study import Study, income_in_thousands

# Colour codes by position; the last three exercise special cases.
COLORS = (*floral_plans.COLOR_LEVELS, "brown", "NoPhoto", "brown")


def _colors() -> str:
    return "array(" + ", ".join(f"'{c}'" for c in COLORS) + ")"


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder}/{name}.parquet")


def floral(spark: SparkSession, folder: str) -> DataFrame:
    """Raw plant observations, numbers that come as text left as text."""
    lineitem, orders, customer, part = (
        table(spark, folder, t) for t in ("lineitem", "orders", "customer", "part")
    )
    # What is read off a line item's numbers is read before they move.
    lines = lineitem.select(
        "l_orderkey", "l_partkey", "l_linenumber", "l_quantity", "l_returnflag", "l_linestatus",
        F.expr("CAST(l_discount * 100 + 0.5 AS INT)").alias("disc"),
        F.expr("CAST(l_tax * 100 + 0.5 AS INT)").alias("tax"),
        F.expr("CAST(CAST(floor(l_extendedprice) AS BIGINT) % 9 AS INT)").alias("stems"),
        F.expr("CAST(l_suppkey % 14 AS INT)").alias("first_color"),
    )
    customer = customer.withColumn("listed", F.expr("c_acctbal <= 9500"))
    # Orders meet customers first: the line items are then shuffled by order and by
    # part only, never by customer, where a hot house would gather them.
    owners = spread(orders, "o_orderkey").join(customer, F.col("o_custkey") == F.col("c_custkey"))
    rows = (
        spread(lines, "l_orderkey")
        .join(owners, F.col("l_orderkey") == F.col("o_orderkey"))
        .join(part, F.col("l_partkey") == F.col("p_partkey"))
        .withColumns({"empty": F.expr("l_quantity = 50"), "palette": F.expr(_colors())})
    )
    fields = {
        "nb": "CASE WHEN listed THEN CAST(c_nationkey AS STRING) END",
        "block": "c_mktsegment",
        "house_id": "CAST(c_custkey AS STRING)",
        "family": "CASE WHEN empty THEN 'NoFlowers' ELSE p_brand END",
        "genus": "CASE WHEN empty THEN 'NoFlowers' ELSE p_type END",
        "front_back": "CASE WHEN l_linestatus = 'F' THEN 'Front' ELSE 'Back' END",
        "flower_plants": """CASE WHEN empty THEN 0.0D
            WHEN c_nationkey >= 20 AND disc = 10 AND tax = 8 THEN NULL ELSE l_quantity END""",
        "flower_stems": """CASE WHEN c_nationkey = 19 AND disc = 10 AND tax = 8 THEN 'many'
            ELSE CAST(stems AS STRING) END""",
        "flower_width_cm": "CASE WHEN tax = 8 THEN 'n/a' ELSE CAST(p_size AS STRING) END",
        "flower_length_cm": "CASE WHEN tax = 7 THEN '' ELSE CAST(l_linenumber AS STRING) END",
        "ave_flower_perstem": "CAST(disc AS DOUBLE)",
        "water_man": """CASE WHEN tax = 0 THEN NULL WHEN l_returnflag = 'N' THEN 'n/a'
            ELSE CAST(l_linenumber % 4 AS STRING) END""",
        "native_man": "CASE WHEN disc = 0 THEN 'n/a' ELSE CAST(l_linenumber % 2 AS STRING) END",
        "color1": """CASE WHEN empty THEN 'NoFlowers'
            ELSE element_at(palette, first_color + 1) END""",
        "color2": """CASE WHEN empty OR l_linenumber <= 5 THEN '' WHEN tax = 3 THEN NULL
            ELSE element_at(palette, CAST(l_partkey % 11 AS INT) + 1) END""",
        "inf_type": """CASE WHEN empty THEN 'NoFlowers' WHEN tax = 6 AND disc = 6 THEN NULL
            ELSE o_orderpriority END""",
        "symmetry": "CASE WHEN o_orderstatus = 'P' THEN 'Unknown' ELSE l_returnflag END",
        "flowertype": "CASE WHEN empty THEN 'NoFlowers' ELSE o_orderstatus END",
        "photo_id": "concat_ws('_', CAST(l_orderkey AS STRING), CAST(l_linenumber AS STRING))",
        "notes": "''",
    }
    return rows.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


SPECIES = "concat_ws('-', o_orderstatus, o_orderpriority, CAST(year(o_orderdate) AS STRING))"


def lawn(spark: SparkSession, folder: str) -> DataFrame:
    """Raw lawn plots: one species row per order."""
    orders, customer = (table(spark, folder, t) for t in ("orders", "customer"))
    plots = spread(orders, "o_orderkey")
    rows = plots.join(customer, F.col("o_custkey") == F.col("c_custkey")).withColumns(
        {
            "price": F.expr("CAST(floor(o_totalprice) AS BIGINT)"),
            "skipped": F.expr("o_orderstatus = 'P' AND o_orderpriority = '5-LOW'"),
        }
    )
    fields = {
        "nb": "CAST(c_nationkey AS STRING)",
        "block": "c_mktsegment",
        "house_id": "CAST(c_custkey AS STRING)",
        "species": f"""CASE WHEN c_acctbal < 0 THEN 'NO LAWN' WHEN skipped THEN 'Not collected'
            ELSE {SPECIES} END""",
        "f1": "CASE WHEN NOT skipped THEN CAST(price % 50 AS DOUBLE) END",
        "f2": """CASE WHEN NOT skipped AND o_orderpriority <> '1-URGENT'
            THEN CAST(price % 7 AS DOUBLE) END""",
        "b1": """CASE WHEN NOT skipped AND NOT (c_nationkey >= 22 AND o_orderstatus = 'F')
            THEN CAST(price % 13 AS DOUBLE) END""",
        "b2": "CASE WHEN NOT skipped THEN CAST(price % 29 AS DOUBLE) END",
        "n_fixer": """CASE WHEN c_nationkey = 3 AND o_orderpriority = '2-HIGH' THEN 'n/a'
            ELSE CAST(dayofmonth(o_orderdate) % 2 AS STRING) END""",
    }
    return rows.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


def native_lawn(spark: SparkSession, folder: str) -> DataFrame:
    """Species lookup: native flag and growth type."""
    fields = {
        "species": SPECIES,
        "native_merge": """CASE WHEN year(o_orderdate) = 1995 THEN NULL
            WHEN year(o_orderdate) % 3 = 0 THEN 'n/a'
            ELSE CAST(year(o_orderdate) % 2 AS STRING) END""",
        "type": """CASE o_orderpriority WHEN '1-URGENT' THEN 'Weed' WHEN '2-HIGH' THEN 'Seedling'
            ELSE 'Lawn' END""",
    }
    orders = table(spark, folder, "orders")
    return orders.select(*[F.expr(sql).alias(name) for name, sql in fields.items()]).distinct()


def survey(spark: SparkSession, folder: str) -> DataFrame:
    """Survey answers on a 0-3 scale, read off the digits of the balance."""
    items = ["a6", "a7", "a8", "a901", "a902", "a903", "a904", "a905", "a906", "a907"]
    rows = table(spark, folder, "customer").withColumn(
        "cents", F.expr("abs(CAST(round(c_acctbal * 100) AS BIGINT))")
    )
    fields = {
        "parcel_id": "concat('P', CAST(c_custkey AS STRING))",
        "house_id": "CAST(c_custkey AS STRING)",
        "nb": "CAST(c_nationkey AS STRING)",
    }
    for place, item in enumerate(items):
        answer = f"CAST((cents DIV {4 ** place}) % 4 AS STRING)"
        fields[item] = answer
    fields["a8"] = f"CASE WHEN c_mktsegment = 'HOUSEHOLD' THEN 'no answer' ELSE {fields['a8']} END"
    fields["a902"] = f"CASE WHEN c_acctbal < 500 THEN NULL ELSE {fields['a902']} END"
    fields["a908"] = "CAST(c_custkey % 4 AS STRING)"
    fields["a909"] = "CAST((c_custkey DIV 4) % 4 AS STRING)"
    fields["a910"] = "CAST((c_custkey DIV 16) % 4 AS STRING)"
    return rows.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])


def nb_info(spark: SparkSession, folder: str) -> DataFrame:
    """Neighbourhood attributes: one row per nation."""
    customer, orders, supplier, nation, region = (
        table(spark, folder, t) for t in ("customer", "orders", "supplier", "nation", "region")
    )
    income = customer.groupBy(F.col("c_nationkey").alias("k")).agg(
        F.round(F.avg("c_acctbal") * 10, 2).alias("med_inc")
    )
    built = (
        orders.join(customer, F.col("o_custkey") == F.col("c_custkey"))
        .groupBy(F.col("c_nationkey").alias("k"))
        .agg(F.round(F.avg(F.year("o_orderdate")), 4).alias("yr_built"))
    )
    elevation = supplier.groupBy(F.col("s_nationkey").alias("k")).agg(
        F.round(F.avg("s_acctbal"), 2).alias("ave_elev")
    )
    fields = {
        "nb": "CAST(n_nationkey AS STRING)",
        "med_inc": "med_inc",
        "yr_built": "yr_built",
        "ave_elev": "ave_elev",
        "ann_precip": "CAST(n_regionkey * 2.5 + 10 AS DOUBLE)",
        "nb_age": "CASE n_nationkey % 3 WHEN 0 THEN 'old' WHEN 1 THEN 'middle' ELSE 'new' END",
        "nb_inc": "CASE WHEN n_regionkey <= 1 THEN 'low' WHEN n_regionkey <= 3 THEN 'mid' "
        "ELSE 'high' END",
        "city": "r_name",
        "type": "concat('T', CAST(n_regionkey AS STRING))",
    }
    joined = (
        nation.join(region, F.col("n_regionkey") == F.col("r_regionkey"))
        .withColumn("k", F.col("n_nationkey"))
        .join(income, "k", "left")
        .join(built, "k", "left")
        .join(elevation, "k", "left")
    )
    return income_in_thousands(
        joined.select(*[F.expr(sql).alias(name) for name, sql in fields.items()])
    )


def direct_house(survey_parcel: DataFrame, rows: DataFrame, cover: DataFrame) -> DataFrame:
    """Houses with both a survey and yard data: answers next to yard measures.

    ``rows`` are the cleaned plant rows; they are read once per measure, so pass
    a materialised table.
    """
    number = lambda c: F.col(c).try_cast("double")
    answers = survey_parcel.select(
        "house_id",
        *[number(c).alias(c) for c in ("a6", "a8", "a902")],
        ((number("a901") + number("a903") + number("a905")) / 3).alias("watercons"),
    )
    traits = floral_plans.house_traits(rows, "color_num", "genera_num").select(
        "house_id",
        F.col("color_num").cast("double").alias("color_num_f"),
        F.col("genera_num").cast("double").alias("rich_flowers"),
    )
    link = rows.select("nb", "house_id").distinct()
    natives = floral_plans.house_native_richness(rows, link).select(
        "house_id", F.col("natives_rich").cast("double").alias("natives_rich_f")
    )
    water = floral_plans.house_totals(rows).select("house_id", "water_wghtd_avg")
    native_cover = lawn_plans.house_natives(cover).select(
        "house_id", F.col("native_cover").alias("native_cover_l")
    )
    return (
        answers.join(traits, "house_id")
        .join(natives, "house_id")
        .join(water, "house_id")
        .join(native_cover, "house_id", "left")
    )


def study(spark: SparkSession, folder: str) -> Study:
    """The whole study over one folder of tables."""
    return Study(
        nb_info=nb_info(spark, folder),
        floral=floral(spark, folder),
        lawn=lawn(spark, folder),
        native_lawn=native_lawn(spark, folder),
        survey_parcel=survey(spark, folder),
    )
