"""One test per missing-value rule."""

import pytest
from pyspark.sql import functions as F

from quadrat.functions import missing as m


@pytest.fixture(scope="module")
def groups(spark):
    rows = [
        ("all missing", None, None),
        ("all missing", None, None),
        ("some missing", 1.0, 5.0),
        ("some missing", None, None),
        ("one row", 4.0, 1.0),
        ("complete", 1.0, None),
        ("complete", 3.0, None),
    ]
    return spark.createDataFrame(rows, "g string, x double, gate double")


def by_group(df, **aggregates):
    rows = df.groupBy("g").agg(*[c.alias(n) for n, c in aggregates.items()]).collect()
    return {r["g"]: r for r in rows}


def test_strict_aggregates_are_missing_if_any_value_is(groups):
    got = by_group(groups, s=m.strict_sum("x"), a=m.strict_mean("x"), d=m.strict_sd("x"))
    assert got["complete"]["s"] == 4.0 and got["complete"]["a"] == 2.0
    assert got["complete"]["d"] == pytest.approx(2**0.5)
    for g in ("all missing", "some missing"):
        assert got[g]["s"] is None and got[g]["a"] is None and got[g]["d"] is None


def test_lenient_sum_of_nothing_is_zero_and_mean_is_missing(groups):
    got = by_group(groups, s=m.lenient_sum("x"), a=m.lenient_mean("x"), v=m.lenient_var("x"))
    assert got["all missing"]["s"] == 0.0 and got["all missing"]["a"] is None
    assert got["some missing"]["s"] == 1.0 and got["some missing"]["a"] == 1.0
    assert got["some missing"]["v"] is None


def test_deviation_of_one_value_is_missing(groups):
    got = by_group(groups, d=m.strict_sd("x"), e=m.lenient_sd("x"))
    assert got["one row"]["d"] is None and got["one row"]["e"] is None


def test_gated_sum_is_lenient_only_if_the_gate_has_a_value(groups):
    got = by_group(groups, s=m.gated_sum("x", "gate"))
    assert got["some missing"]["s"] == 1.0
    assert got["all missing"]["s"] is None
    assert got["complete"]["s"] == 4.0


def test_counts(groups):
    got = by_group(groups, n=m.rows(), k=m.present("x"), d=m.distinct_with_missing("x"))
    assert (got["some missing"]["n"], got["some missing"]["k"], got["some missing"]["d"]) == (2, 1, 2)
    assert got["all missing"]["d"] == 1


def test_distinct_traits_ignore_blanks_and_count_missing_once(spark):
    df = spark.createDataFrame([("0",), ("a",), ("a",), ("b",), (None,), (None,)], "x string")
    assert df.agg(m.distinct_traits("x")).first()[0] == 3
    assert df.where("x = '0'").agg(m.distinct_traits("x")).first()[0] == 0


def test_choose_stays_missing(spark):
    df = spark.createDataFrame([("n/a",), ("2",), (None,)], "x string")
    got = [r[0] for r in df.select(m.choose(F.col("x") == "n/a", F.lit("no"), F.col("x"))).collect()]
    assert got == ["no", "2", None]


def test_paste_spells_out_missing_and_keeps_blanks(spark):
    df = spark.createDataFrame([("red", ""), (None, "x"), ("a", "b")], "a string, b string")
    assert [r[0] for r in df.select(m.paste("a", "b")).collect()] == ["red ", "NA x", "a b"]
    assert df.select(m.paste("a", "b", sep="_")).collect()[2][0] == "a_b"


def test_row_mean_skips_missing(spark):
    df = spark.createDataFrame([(1.0, 3.0), (None, 3.0), (None, None)], "a double, b double")
    assert [r[0] for r in df.select(m.row_mean("a", "b")).collect()] == [2.0, 3.0, None]


def test_ratio_and_standard_error_by_zero_are_missing(spark):
    df = spark.createDataFrame([(1.0, 0.0), (6.0, 4.0)], "a double, b double")
    assert [r[0] for r in df.select(m.ratio("a", "b")).collect()] == [None, 1.5]
    assert [r[0] for r in df.select(m.standard_error("a", "b")).collect()] == [None, 3.0]


def test_to_number_reads_numbers_only(spark):
    text = ["1", " 2.5 ", "-3e2", ".5", "5.", "", "n/a", "NaN", "1d", "many", None]
    df = spark.createDataFrame([(t,) for t in text], "x string")
    got = [r[0] for r in df.select(m.to_number("x")).collect()]
    assert got == [1.0, 2.5, -300.0, 0.5, 5.0, None, None, None, None, None, None]


def test_recode_and_levels(spark):
    df = spark.createDataFrame([("low",), ("mid",), ("other",), (None,)], "x string")
    recoded = df.select(m.recode("x", {"low": "Low", "mid": "Mid"}).alias("x"))
    assert [r[0] for r in recoded.collect()] == ["Low", "Mid", "other", None]
    rank = recoded.select(m.level_rank("x", ["Low", "Mid"]), m.level_label("x", ["Low", "Mid"]))
    assert [tuple(r) for r in rank.collect()] == [(1, "Low"), (2, "Mid"), (None, None), (None, None)]


def test_number_text(spark):
    df = spark.createDataFrame([(12.0,), (2.5,), (None,)], "x double")
    assert [r[0] for r in df.select(m.number_text("x")).collect()] == ["12", "2.5", None]
