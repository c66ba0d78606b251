"""An ordination of few pairs takes few jobs, and ends where the shared passes do."""

import math
import uuid

import pytest

from quadrat.operators import ordination


def _pairs(spark, n=12):
    rows = [
        (f"s{i:02d}", f"s{j:02d}", round(abs(math.sin(i * 1.7) - math.sin(j * 1.7)) / 2 + (i * j % 5) / 20, 3))
        for i in range(n) for j in range(i + 1, n)
    ]
    return spark.createDataFrame(rows, "site_i string, site_j string, d double")


def test_few_pairs_take_few_jobs(spark):
    group = uuid.uuid4().hex
    spark.sparkContext.setJobGroup(group, "ordination")
    scores, trace = ordination.nmds(_pairs(spark), most_starts=8)
    jobs = len(spark.sparkContext.statusTracker().getJobIdsForGroup(group))
    spark.sparkContext.setLocalProperty("spark.jobGroup.id", None)
    assert max(r["rounds"] for r in trace.collect()) > 20
    assert jobs < 60
    assert scores.count() == 12


def test_single_range_ends_where_several_do(spark):
    (_, one), (_, several) = [
        ordination.nmds(_pairs(spark, 8), most_starts=1, pairs_a_range=n) for n in (1 << 17, 16)
    ]
    one, several = [{r["start"]: r for r in t.collect()} for t in (one, several)]
    for start in one:
        assert one[start]["stress"] == pytest.approx(several[start]["stress"], rel=1e-3)
        assert one[start]["converged"] and several[start]["converged"]
