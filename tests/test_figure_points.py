"""A figure's points are computed once, for themselves and for their line."""

import pytest

from quadrat.plans import figures


@pytest.mark.parametrize("group", [None, "kind"])
def test_points_and_line_read_what_was_written(spark, group):
    rows = [(float(i), 2.0 * i + 1, 0.1, "ab"[i % 2]) for i in range(6)]
    df = spark.createDataFrame(rows, "x double, y double, se double, kind string")
    out = figures.points_with_trend(df, "x", "y", "se", x_limits=(0.0, 4.0), group=group)
    assert out.inputFiles() and all("figure-points" in f for f in out.inputFiles())
    got = out.collect()
    assert len(got) == 5
    assert all(r["slope"] == pytest.approx(2.0) and r["intercept"] == pytest.approx(1.0) for r in got)
