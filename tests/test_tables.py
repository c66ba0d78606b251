"""Joins, reshaping, summaries and diversity on small frames."""

import math

import pytest
from pyspark.sql import functions as F

from quadrat.operators.diversity import community_structure
from quadrat.operators.joins import attach, null_safe_join, outer_zero_fill, right_zero_fill
from quadrat.operators.reshape import lengthen, widen
from quadrat.operators.summaries import mean_se, split_share, trait_counts


@pytest.fixture(scope="module")
def sides(spark):
    left = spark.createDataFrame([("n1", "h1", 3), (None, "h2", 4)], "nb string, house string, a int")
    right = spark.createDataFrame(
        [("n1", "h1", 7), (None, "h2", 8), ("n3", "h3", 9)], "nb string, house string, b int"
    )
    return left, right


def rows(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


def test_missing_keys_match_missing_keys(sides):
    left, right = sides
    assert rows(null_safe_join(left, right, ["nb", "house"], "left")) == rows(
        left.withColumn("b", F.when(F.col("house") == "h1", 7).otherwise(8))
    )


def test_outer_zero_fill_fills_text_keys_too(sides):
    left, right = sides
    assert rows(outer_zero_fill(left, right, ["nb", "house"])) == [
        ("0", "h2", 4, 8), ("n1", "h1", 3, 7), ("n3", "h3", 0, 9),
    ]


def test_right_zero_fill_keeps_unmatched_right_rows(sides):
    left, right = sides
    got = rows(right_zero_fill(left, right.select("nb", "house"), ["nb", "house"]))
    assert got == [("0", "h2", 4), ("n1", "h1", 3), ("n3", "h3", 0)]


def test_attach_keeps_left_columns_on_collision(spark):
    left = spark.createDataFrame([("k", "mine")], "k string, type string")
    lookup = spark.createDataFrame([("k", "theirs", 1)], "k string, type string, v int")
    assert rows(attach(left, lookup, ["k"])) == [("k", "mine", 1)]


def test_lengthen_casts_mixed_columns_and_renames_labels(spark):
    df = spark.createDataFrame([(1, "x", 2.5)], "id int, a string, b double")
    assert rows(lengthen(df, ["id"], {"a": "A", "b": "B"})) == [(1, "A", "x"), (1, "B", "2.5")]


def test_widen_fills_zero_and_refuses_duplicates(spark):
    df = spark.createDataFrame([("s", "t1", 2.0), ("r", "t2", 3.0)], "s string, t string, v double")
    assert rows(widen(df, ["s"], "t", "v")) == [("r", 0.0, 3.0), ("s", 2.0, 0.0)]
    with pytest.raises(Exception, match="repeated t"):
        widen(df.union(df), ["s"], "t", "v").collect()
    with pytest.raises(ValueError, match="more than 1"):
        widen(df, ["s"], "t", "v", limit=1)
    with pytest.raises(Exception, match="t not listed: t2"):
        widen(df, ["s"], "t", "v", ["t1"]).collect()


def test_mean_se(spark):
    df = spark.createDataFrame([("a", 1.0), ("a", 3.0), ("b", None)], "g string, x double")
    got = {r["g"]: r for r in mean_se(df, ["g"], "x").collect()}
    assert got["a"]["se"] == pytest.approx(1.0) and got["a"]["n"] == 2
    assert got["b"]["mean"] is None and got["b"]["n"] == 1


def test_split_share_halves_two_colours(spark):
    df = spark.createDataFrame(
        [("n", "red", "", 4.0), ("n", "red", "blue", 2.0), ("n", "red", None, 8.0)],
        "nb string, c1 string, c2 string, area double",
    )
    got = dict((r["value"], r["area"]) for r in split_share(df, ["nb"], "c1", "c2", "area").collect())
    assert got == {"red": 5.0, "blue": 1.0}


def test_trait_counts_keep_groups_without_traits(spark):
    df = spark.createDataFrame(
        [("h", "0", "a"), ("h", "0", None), ("g", "x", "0"), ("g", "x", "0")],
        "house string, p string, q string",
    )
    got = trait_counts(df, ["house"], {"p": "np", "q": "nq"}, "0")
    assert rows(got) == [("g", 1, 0), ("h", 0, 2)]


def test_richness_and_evenness(spark):
    data = [("even", 2.0)] * 3 + [("one", 5.0), ("one", 0.0), ("none", 0.0), ("gone", None)]
    data += [("skewed", 1.0), ("skewed", 100.0)]
    df = spark.createDataFrame(data, "site string, ab double")
    got = {r["site"]: (r["richness"], r["evar"]) for r in community_structure(df, "site", "ab").collect()}
    assert got["even"] == (3, pytest.approx(1.0))
    assert got["one"] == (1, None) and got["none"] == (0, None) and "gone" not in got
    spread = (math.log(100) / 2) ** 2
    assert got["skewed"][1] == pytest.approx(1 - 2 / math.pi * math.atan(spread))


def test_trait_counts_move_each_row_once(spark):
    rows = [(f"h{i % 3}", f"p{i % 5}", None if i % 7 == 0 else f"q{i % 4}") for i in range(60)]
    df = spark.createDataFrame(rows, "house string, p string, q string")
    counts = trait_counts(df, ["house"], {"p": "np", "q": "nq"}, "q0")
    plan = counts._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    for row in counts.collect():
        mine = [r for r in rows if r[0] == row["house"]]
        assert row["np"] == len({p for _, p, _ in mine})
        assert row["nq"] == len({q for _, _, q in mine} - {"q0"})
