"""Plans and results that must hold when data grow, joins sort and keys run hot."""

from pathlib import Path

import pytest
from pyspark.sql import functions as F

from checks.registry import FIGURES, LARGE, SUMMARIES, Data, queries
from quadrat.plans import floral, inference
from quadrat.session import shared_folder
from quadrat.sources import star

FOLDER = Path("/root/testdata/sf0.001")
pytestmark = pytest.mark.skipif(not FOLDER.exists(), reason="test tables not present")


def plan(df):
    return df._jdf.queryExecution().executedPlan().toString()


@pytest.mark.parametrize(
    "name",
    [
        n
        for n in [*SUMMARIES, *FIGURES, *LARGE]
        if "kendall" not in n and "ordination" not in n and n != "direct_house"
    ],
)
def test_no_query_multiplies_rows_by_a_cross_join(spark, name):
    text = plan(queries()[name](spark, str(FOLDER)))
    assert "CartesianProduct" not in text and "BroadcastNestedLoopJoin" not in text


def test_scans_read_only_the_columns_needed(spark):
    data = Data(spark, str(FOLDER))
    text = plan(data.rows.groupBy("nb").agg(F.sum("num_plants")))
    schemas = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
    scan = next(s for s in schemas if "l_orderkey" in s)
    assert "l_extendedprice" not in scan and "l_shipdate" not in scan
    assert "PushedFilters" in text


@pytest.fixture
def without_broadcast(spark):
    names = ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.autoBroadcastJoinThreshold")
    for name in names:
        spark.conf.set(name, "-1")
    yield
    for name in names:
        spark.conf.unset(name)


def result(df):
    return sorted(tuple(str(v) for v in row) for row in df.collect())


@pytest.mark.parametrize(
    "name", ["nb_summary", "layer_richness", "floral_permanova_stat", "kendall_ordinal"]
)
def test_results_do_not_depend_on_broadcasts(spark, without_broadcast, name):
    sorted_joins = queries()[name](spark, str(FOLDER))
    text = plan(sorted_joins)
    assert "BroadcastHashJoin" not in text
    mine = result(sorted_joins)
    spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.unset("spark.sql.adaptive.autoBroadcastJoinThreshold")
    assert mine == result(queries()[name](spark, str(FOLDER)))


def test_a_house_with_a_third_of_all_rows(spark):
    """Repeating one house's rows scales its sums and leaves every distinct count alone."""
    rows = floral.clean_rows(star.floral(spark, str(FOLDER))).cache()
    hot = rows.groupBy("house_id").count().orderBy(F.desc("count")).first()["house_id"]
    times = rows.count() // (2 * rows.where(F.col("house_id") == hot).count())
    copies = F.explode(F.sequence(F.lit(1), F.lit(times)))
    repeated = rows.where(F.col("house_id") == hot).withColumn("copy", copies).drop("copy")
    skewed = rows.where(F.col("house_id") != hot).unionByName(repeated).repartition(8)
    assert skewed.where(F.col("house_id") == hot).count() * 3 >= skewed.count() * 0.9

    assert result(floral.house_traits(skewed)) == result(floral.house_traits(rows))
    before = {r["house_id"]: r for r in floral.house_totals(rows).collect()}
    for r in floral.house_totals(skewed).collect():
        factor = times if r["house_id"] == hot else 1
        old = before[r["house_id"]]
        assert r["total_natives"] == old["total_natives"] * factor
        assert (r["total_plants"] is None) == (old["total_plants"] is None)
        if old["avg_size"] is not None:
            assert r["avg_size"] == pytest.approx(old["avg_size"])


def test_every_factor_label_survives_a_hot_group(spark):
    """Two thirds of the sites in one group: sums of squares still add up."""
    data = Data(spark, str(FOLDER))
    community = data.community("floral")
    from quadrat.operators import community as cm

    labels = community.labels.where("factor = 'nb'").withColumn(
        "label", F.when(F.abs(F.hash("site")) % 3 > 0, "hot").otherwise(F.col("label"))
    )
    r = cm.permanova(community.pairs, labels).first()
    assert r["ss_between"] + r["ss_within"] == pytest.approx(r["ss_total"])
    z = cm.dispersion(community.pairs, labels)
    assert z.count() == community.sites.count()


def test_the_session_names_the_shared_folder(spark):
    named = spark.sparkContext.getConf().get("spark.checkpoint.dir")
    folder = shared_folder(spark)
    assert folder and (named is None or folder.startswith(named) or named in folder)


def test_prepared_rows_keep_what_every_table_needs(spark):
    data = inference.prepare(star.study(spark, str(FOLDER)))
    assert {"num_plants", "color1", "inf_type", "front_back"} <= set(data.rows.columns)
    assert data.rows.count() == floral.clean_rows(star.floral(spark, str(FOLDER))).count()


def test_houses_gather_only_the_traits_that_are_compared(spark):
    rows = spark.createDataFrame(
        [("n", "b", "h", "fam", "g1", "red", "", "x", "y", "z"), ("n", "b", "h", "fam", "g2", "red", None, "x", "y", "z"),
         (None, "b", "i", "fam", "g1", "blue", "", None, "y", "z")],
        "nb string, block string, house_id string, family string, genus string, color1 string, color2 string, "
        "inf_type string, symmetry string, flowertype string",
    )
    both = ("color_num", "genera_num")
    some = floral.house_traits(rows, *both)
    keys = ["nb", "block", "house_id", *both]
    assert some.columns == keys
    assert sorted(map(str, some.collect())) == sorted(map(str, floral.house_traits(rows).select(keys).collect()))


def test_direct_houses_do_not_move_unused_traits(spark):
    text = plan(queries()["direct_house"](spark, str(FOLDER)))
    schemas = [part.split(">")[0] for part in text.split("ReadSchema: struct<")[1:]]
    assert any("color1" in s for s in schemas)
    assert not any("flowertype" in s for s in schemas)


def test_line_items_do_not_carry_the_balance_of_their_house(spark):
    rows = star.floral(spark, str(FOLDER)).select("nb", "house_id", "genus")
    steps = [step for step in plan(rows).splitlines() if "Project [" in step and "l_partkey" in step]
    assert steps and not any("c_acctbal" in step for step in steps)
