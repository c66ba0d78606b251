"""Correlation, regression and probabilities against numpy and published values."""

import itertools
import math

import numpy as np
import pytest

from quadrat.functions import probability as prob
from quadrat.operators.correlation import kendall, pearson
from quadrat.operators.ranking import order_codes
from quadrat.operators.regression import (
    interaction_anova,
    interaction_coefficients,
    ols_coefficients,
    ols_fit,
    trend_lines,
)


@pytest.mark.parametrize(
    ("r", "df", "p", "slack"), [(-0.140, 7, 0.719, 0.001), (0.321, 7, 0.398, 0.002)]
)
def test_published_correlation_p_values(r, df, p, slack):
    t = r * math.sqrt(df / (1 - r * r))
    assert prob.t_tail(t, df) == pytest.approx(p, abs=slack)


@pytest.mark.parametrize(("partial", "p"), [(0.511, 0.071), (0.738, 0.013)])
def test_published_partial_r2_p_values(partial, p):
    t = math.sqrt(5 * partial / (1 - partial))
    assert prob.t_tail(t, 5) == pytest.approx(p, abs=0.001)


def test_tails_at_known_points():
    assert prob.t_tail(12.706204736, 1) == pytest.approx(0.05, abs=1e-9)
    assert prob.f_tail(4.0, 1, 7) == pytest.approx(prob.t_tail(2.0, 7), abs=1e-12)
    assert prob.f_tail(5.0, 2, 4) == pytest.approx((1 + 2 * 5.0 / 4) ** -2, abs=1e-12)
    assert prob.normal_tail(1.959963984540054) == pytest.approx(0.05, abs=1e-12)
    assert prob.t_tail(0.0, 9) == pytest.approx(1.0)
    assert prob.t_tail(3.0, 100000) == pytest.approx(prob.normal_tail(3.0), rel=1e-3)


def test_exact_kendall_tail_counts_permutations():
    n = 5
    scores = []
    for order in itertools.permutations(range(n)):
        scores.append(sum(a < b for a, b in itertools.combinations(order, 2)))
    for concordant in range(n * (n - 1) // 2 + 1):
        low = min(concordant, 10 - concordant)
        share = sum(s <= low for s in scores) / len(scores)
        assert prob.kendall_tail(concordant, n) == pytest.approx(min(1, 2 * share))


def test_pearson_drops_incomplete_pairs(spark):
    rng = np.random.default_rng(0)
    x, y = rng.normal(size=30), rng.normal(size=30)
    rows = [("a", float(p), float(q)) for p, q in zip(x, y)]
    rows += [("a", None, 1.0), ("a", 1.0, None), ("flat", 1.0, 2.0), ("flat", 1.0, 3.0)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in pearson(df, "x", "y", ["g"]).collect()}
    r = np.corrcoef(x, y)[0, 1]
    assert got["a"]["n"] == 30 and got["a"]["r"] == pytest.approx(r)
    assert got["a"]["t"] == pytest.approx(r * math.sqrt(28 / (1 - r * r)))
    assert got["a"]["conf_low"] == pytest.approx(math.tanh(math.atanh(r) - 1.959963984540054 / 27**0.5))
    assert got["flat"]["r"] is None and got["flat"]["p_value"] is None


def brute_tau(x, y):
    s = sum(
        np.sign(x[i] - x[j]) * np.sign(y[i] - y[j])
        for i, j in itertools.combinations(range(len(x)), 2)
    )
    n = len(x)
    ties = [[(v == u).sum() for u in set(v)] for v in (x, y)]
    pairs = [sum(t * (t - 1) / 2 for t in k) for k in ties]
    n0 = n * (n - 1) / 2
    return s, s / math.sqrt((n0 - pairs[0]) * (n0 - pairs[1]))


@pytest.mark.parametrize("y_block", [4096, 3])
def test_kendall_matches_brute_force(spark, y_block):
    rng = np.random.default_rng(7)
    data, rows = {}, []
    for g, size, levels in (("ordinal", 120, 4), ("fine", 90, 40)):
        x = rng.integers(0, levels, size).astype(float)
        y = np.round(rng.normal(size=size) + 0.3 * x, 1)
        data[g] = x, y
        rows += [(g, float(a), float(b)) for a, b in zip(x, y)]
    rows += [("fine", None, 1.0)]
    # A hot cell: a third of all rows share one (x, y).
    data["ordinal"] = tuple(np.append(v, np.full(80, 2.0)) for v in data["ordinal"])
    rows += [("ordinal", 2.0, 2.0)] * 80
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in kendall(df, "x", "y", ["g"], y_block=y_block).collect()}
    for g, (x, y) in data.items():
        s, tau = brute_tau(x, y)
        assert got[g]["s"] == s and got[g]["n"] == len(x)
        assert got[g]["tau"] == pytest.approx(tau)
        assert got[g]["p_value"] == pytest.approx(prob.normal_tail(got[g]["z"]))


def test_kendall_of_monotone_data_and_small_exact_sample(spark):
    df = spark.createDataFrame([(float(i), float(i * i)) for i in range(9)], "x double, y double")
    up = kendall(df, "x", "y").first()
    assert up["tau"] == 1.0 and up["z"] is None
    assert up["p_value"] == pytest.approx(2 / math.factorial(9))
    down = kendall(df.selectExpr("x", "-y AS y"), "x", "y").first()
    assert down["tau"] == -1.0 and down["p_value"] == pytest.approx(up["p_value"])


@pytest.mark.parametrize("range_size", [4096, 10])
def test_order_codes_are_dense_ranks(spark, range_size):
    values = [float(v % 97) / 3 for v in range(500)] + [float("inf")]
    df = spark.createDataFrame([(v,) for v in values], "v double")
    coded, size = order_codes(df, "v", "c", range_size=range_size, ranges=16)
    ranks = {v: i for i, v in enumerate(sorted(set(values)))}
    assert size == len(ranks)
    assert all(r["c"] == ranks[r["v"]] for r in coded.collect())


@pytest.fixture(scope="module")
def regression(spark):
    rng = np.random.default_rng(2)
    x = rng.normal(size=(40, 3)) * [1e4, 3, 200] + [5e4, 1990, 1300]
    y = 1 + x @ [1e-4, 0.2, -0.01] + rng.normal(size=40)
    rows = [("a", *map(float, x[i]), float(y[i])) for i in range(40)]
    rows += [("a", None, 1.0, 1.0, 1.0), ("flat", 1.0, 2.0, 3.0, 4.0), ("flat", 1.0, 5.0, 3.0, 4.0)]
    df = spark.createDataFrame(rows, "g string, x1 double, x2 double, x3 double, y double")
    design = np.column_stack([np.ones(40), x])
    return df, design, y


def test_ols_matches_least_squares_and_partial_r2(regression):
    df, design, y = regression
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    sse = ((y - design @ beta) ** 2).sum()
    cov = np.linalg.inv(design.T @ design) * sse / 36
    rows = ols_coefficients(df, "y", ["x1", "x2", "x3"], ["g"]).collect()
    got = [r for r in rows if r["g"] == "a"]
    assert [r["term"] for r in got] == ["(intercept)", "x1", "x2", "x3"]
    for i, r in enumerate(got):
        assert r["estimate"] == pytest.approx(beta[i], rel=1e-6)
        assert r["std_error"] == pytest.approx(math.sqrt(cov[i, i]), rel=1e-6)
        assert r["p_value"] == pytest.approx(prob.t_tail(r["t"], 36))
        if i:
            reduced = np.delete(design, i, axis=1)
            b, *_ = np.linalg.lstsq(reduced, y, rcond=None)
            less = ((y - reduced @ b) ** 2).sum()
            assert r["partial_r2"] == pytest.approx((less - sse) / less, rel=1e-6)
    assert all(r["estimate"] is None for r in rows if r["g"] == "flat")


def test_ols_fit_matches_mllib(spark, regression):
    from pyspark.ml.feature import VectorAssembler
    from pyspark.ml.regression import LinearRegression

    df, *_ = regression
    rows = df.where("g = 'a'").na.drop()
    table = VectorAssembler(inputCols=["x1", "x2", "x3"], outputCol="v").transform(rows)
    summary = LinearRegression(featuresCol="v", labelCol="y", solver="normal").fit(table).summary
    got = ols_fit(df, "y", ["x1", "x2", "x3"], ["g"]).where("g = 'a'").first()
    assert got["r2"] == pytest.approx(summary.r2) and got["adj_r2"] == pytest.approx(summary.r2adj)
    terms = ols_coefficients(rows, "y", ["x1", "x2", "x3"]).collect()
    assert [t["p_value"] for t in terms[1:]] == pytest.approx(summary.pValues[:3], abs=1e-9)


def nested_sse(x, g, y):
    """Error sums of squares of y ~ 1, x, x + g, x * g by dummy coding."""
    names = sorted(set(g))
    dummies = np.array([[float(v == k) for k in names[1:]] for v in g])
    one = np.ones((len(y), 1))
    designs = [one, np.c_[one, x], np.c_[one, x, dummies], np.c_[one, x, dummies, dummies * x[:, None]]]
    return [
        ((y - d @ np.linalg.lstsq(d, y, rcond=None)[0]) ** 2).sum() for d in designs
    ]


def test_interaction_anova_and_coefficients(spark):
    rng = np.random.default_rng(4)
    g = np.array([("a", "b", "c")[i % 3] for i in range(36)])
    x = rng.normal(size=36) + (g == "b")
    y = 2 + x * np.where(g == "c", 2.0, 0.5) + (g == "b") + rng.normal(size=36) / 3
    df = spark.createDataFrame(
        [("t", float(a), str(b), float(c)) for a, b, c in zip(x, g, y)],
        "test string, x double, g string, y double",
    )
    sse = nested_sse(x, g, y)
    rows = sorted(interaction_anova(df, "y", "x", "g", ["test"]).collect(), key=lambda r: r["position"])
    assert [r["term"] for r in rows] == ["x", "g", "x:g", "residuals"]
    assert [r["df"] for r in rows] == [1, 2, 2, 30]
    assert [r["ss"] for r in rows[:3]] == pytest.approx([sse[i] - sse[i + 1] for i in range(3)])
    assert sum(r["ss"] for r in rows) == pytest.approx(((y - y.mean()) ** 2).sum())
    f = ((sse[1] - sse[2]) / 2) / (sse[3] / 30)
    assert rows[1]["f"] == pytest.approx(f) and rows[1]["p_value"] == pytest.approx(prob.f_tail(f, 2, 30))

    one = interaction_coefficients(df, "y", "x", "g", "a")
    got = {r["term"]: r for r in one.collect()}
    dummies = np.array([[float(v == k) for k in "bc"] for v in g])
    design = np.c_[np.ones(36), x, dummies, dummies * x[:, None]]
    beta, *_ = np.linalg.lstsq(design, y, rcond=None)
    errors = np.sqrt(np.diag(np.linalg.inv(design.T @ design)) * sse[3] / 30)
    names = ["(intercept)", "x", "gb", "gc", "x:gb", "x:gc"]
    for name, b, e in zip(names, beta, errors):
        assert got[name]["estimate"] == pytest.approx(b) and got[name]["std_error"] == pytest.approx(e)


def test_trend_line_ignores_points_outside_the_limits(spark):
    rows = [(float(i), 2.0 * i + 1) for i in range(5)] + [(3.0, 900.0), (70.0, 0.0), (None, 1.0)]
    df = spark.createDataFrame(rows, "x double, y double")
    line = trend_lines(df, "x", "y", x_limits=(0, 10), y_limits=(0, 100)).first()
    assert (line["slope"], line["intercept"], line["n"]) == (pytest.approx(2), pytest.approx(1), 5)


def test_exact_lines_have_endless_statistics(spark):
    df = spark.createDataFrame([(float(i), 4.0 * i, -2.0 * i) for i in range(9)], "x double, y double, z double")
    for other, sign in (("y", 1.0), ("z", -1.0)):
        got = pearson(df, "x", other).first()
        assert got["r"] == sign and got["t"] == sign * math.inf and got["p_value"] == 0
        assert got["conf_low"] == got["conf_high"] == sign
    fit = ols_fit(df, "y", ["x"]).first()
    assert fit["f"] == math.inf and fit["p_value"] == 0 and fit["r2"] == 1
    slope = ols_coefficients(df, "y", ["x"]).where("term = 'x'").first()
    assert slope["partial_r2"] == 1 and slope["p_value"] == 0


def test_groups_with_a_missing_key_stay(spark):
    values = [(k, g, float(i), float((7 * i) % 5)) for k in ("a", None) for g in ("p", "q") for i in range(6)]
    df = spark.createDataFrame(values, "who string, g string, x double, y double")
    for block in (4096, 2):
        tau = {r["who"]: (r["n"], r["s"]) for r in kendall(df, "x", "y", ["who"], y_block=block).collect()}
        assert set(tau) == {"a", None} and tau["a"] == tau[None]
    terms = interaction_coefficients(df, "y", "x", "g", "p", ["who"]).collect()
    assert sorted((r["who"] or "", r["term"]) for r in terms) == sorted(
        (k, t) for k in ("a", "") for t in ("(intercept)", "x", "gq", "x:gq")
    )
    with pytest.raises(Exception, match="no level 'r'"):
        interaction_coefficients(df, "y", "x", "g", "r", ["who"]).collect()


@pytest.mark.parametrize("unit", [1 << 19, 40, 7])
def test_kendall_in_units_matches_brute_force(spark, unit, monkeypatch):
    from quadrat.operators import correlation

    met = []
    score = correlation._score
    monkeypatch.setattr(correlation, "_score", lambda cells, *rest: met.append(cells.count()) or score(cells, *rest))
    rng = np.random.default_rng(11)
    data = {
        "fine": (rng.normal(size=150), rng.normal(size=150)),
        # One x value holds two thirds of the cells, so no cut can part them.
        "heavy": (np.where(rng.random(120) < 0.66, 3.0, rng.integers(0, 9, 120)), rng.normal(size=120)),
        None: (rng.integers(0, 30, 25).astype(float), rng.integers(0, 3, 25).astype(float)),
        "odd": (np.array([math.inf, 1.0, -math.inf, 2.0]), np.array([1.0, 2.0, 3.0, math.inf])),
    }
    rows = [(g, float(a), float(b)) for g, (x, y) in data.items() for a, b in zip(x, y)]
    df = spark.createDataFrame(rows, "g string, x double, y double")
    got = {r["g"]: r for r in kendall(df, "x", "y", ["g"], unit=unit, y_block=5).collect()}
    for g, (x, y) in data.items():
        s = sum((a < b) * 1 - (a > b) for i, a in enumerate(y) for b, q in zip(y[i:], x[i:]) if q > x[i])
        s -= sum((a < b) * 1 - (a > b) for i, a in enumerate(y) for b, q in zip(y[i:], x[i:]) if q < x[i])
        assert got[g]["s"] == s and got[g]["n"] == len(x)
    # Cells are scored in their units; only counts of blocks go through all bits.
    assert sum(met) <= 4 * (2 * -(-150 // unit)) ** 2
    assert bool(met) == (unit < 150)


def test_signed_pairs_do_not_overflow():
    from quadrat.operators.correlation import _signed_pairs

    w = np.array([1 << 40, 1 << 40, 3])
    x, y = np.array([1.0, 2.0, 2.0]), np.array([1.0, 2.0, 0.0])
    assert _signed_pairs(x, y, w) == (1 << 80) - 3 * (1 << 40)
