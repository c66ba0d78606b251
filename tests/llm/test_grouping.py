"""Groups of near copies: links by distances from a leader, against brute force."""

import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from quadrat.llm import grouping, jaccard
from quadrat.llm.grouping import spots, sure_links, tiles
from quadrat.llm.jaccard import similar_groups
from quadrat.llm.vectors import near_duplicates


def _components(n, near):
    root = list(range(n))

    def top(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in near:
        x, y = sorted((top(a), top(b)))
        root[y] = x
    return [top(x) for x in range(n)]


@pytest.fixture(scope="module")
def texts():
    """Variants of one text at all distances around the limit, copies and strangers among them."""
    draw = np.random.default_rng(5)
    base = [f"w{i}" for i in range(200)]
    made = []
    for i in range(420):
        words = list(base)
        for at in draw.integers(0, 200, i % 7):
            words[at] = f"x{draw.integers(1000)}"
        made.append(" ".join(words))
    made += made[:30] + [" ".join(f"s{i}_{j}" for j in range(30)) for i in range(20)]
    return made


def test_links_of_a_large_group_equal_brute_force(spark, texts):
    rows = [(i, t) for i, t in enumerate(texts)]
    got = {
        r["doc_id"]: (r["n_links"], r["class_id"])
        for r in similar_groups(spark.createDataFrame(rows, "doc_id long, text string"), limit=32).collect()
    }
    sets = []
    for t in texts:
        w = t.split()
        sets.append({tuple(w[i : i + 5]) for i in range(len(w) - 4)})
    near = [
        (a, b) for a in range(len(sets)) for b in range(a + 1, len(sets))
        if 5 * len(sets[a] & sets[b]) >= 4 * len(sets[a] | sets[b])
    ]
    links = [0] * len(sets)
    for a, b in near:
        links[a] += 1
        links[b] += 1
    root = _components(len(sets), near)
    assert got == {i: (links[i], root[i]) for i in range(len(sets))}


def test_vector_links_of_a_large_group_equal_brute_force(spark):
    draw = np.random.default_rng(3)
    base = draw.standard_normal(24)
    rows = [base + draw.standard_normal(24) * (i % 9) * 0.035 for i in range(900)]
    rows += rows[:20] + list(draw.standard_normal((60, 24)))
    x = np.array(rows)
    table = [(i, v.tolist()) for i, v in enumerate(x)]
    got = near_duplicates(spark.createDataFrame(table, "vec_id long, embedding array<double>")).collect()
    u = x / np.linalg.norm(x, axis=1, keepdims=True)
    cosine = u @ u.T
    np.fill_diagonal(cosine, 0)
    links = (cosine >= 0.95).sum(axis=1)
    pairs = [(a, b) for a, b in zip(*np.nonzero(cosine >= 0.95)) if a < b]
    root = _components(len(x), pairs)
    missed = sum(int(links[r["vec_id"]]) - r["n_links"] for r in got)
    assert 0 <= missed <= 0.002 * links.sum()
    assert [r["component_id"] for r in sorted(got, key=lambda r: r["vec_id"])] == root


def _group(spark, n):
    """One bucket of ``n`` members whose leader is at most four tenths of the limit away."""
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("key"), "id", F.lit(n).cast("long").alias("n"), F.lit(1).cast("long").alias("copies")
    )
    found = spots(rows, lambda pairs: pairs.select("id", (F.col("id") % 81).cast("int").alias("q")))
    return rows, found


@pytest.mark.parametrize("n", [1000, 4000, 16000])
def test_near_copies_of_a_leader_never_meet(spark, n):
    rows, found = _group(spark, n)
    assert tiles(rows, found).count() == 0
    links = sure_links(found).where("b IS NULL").agg(F.min("links"), F.max("links"), F.count("*")).first()
    assert tuple(links) == (n - 1, n - 1, n)


def test_pairs_that_are_not_sure_meet(spark):
    """Every pair meets in a cell or is linked for sure, whatever its steps and leaders."""
    n = 900
    rows = spark.range(n).select(
        F.lit(1).cast("long").alias("key"), "id", F.lit(n).cast("long").alias("n"), F.lit(1).cast("long").alias("copies")
    )
    steps = lambda pairs: pairs.select("id", (F.col("id") * 37 % (grouping.STEPS + 30)).cast("int").alias("q"))
    found = spots(rows, steps, 64)
    cells: dict = {}
    for r in tiles(rows, found, 64).collect():
        cells.setdefault((r["low"], r["high"]), []).append((r["mine"], r["id"]))
    met = np.zeros((n, n), dtype=bool)
    for (low, high), members in cells.items():
        assert len(members) <= 2 * 64 * 2
        for side, a in members:
            for other, b in members:
                if low == high or side != other:
                    met[a, b] = True
    q = {r["id"]: r["q"] for r in found.collect()}
    for a in range(n):
        for b in range(a + 1, n):
            sure = a in q and b in q and q[a] + q[b] <= grouping.STEPS
            assert met[a, b] or sure
    reach = {r["a"]: r["links"] for r in sure_links(found).where("b IS NULL").collect()}
    for a in q:
        assert reach.get(a, 0) == sum(q[a] + q[b] <= grouping.STEPS for b in q if b != a)


def test_groups_without_large_buckets(spark):
    empty = spark.createDataFrame([], "doc_id long, text string")
    assert similar_groups(empty).count() == 0
    two = spark.createDataFrame([(1, "a b c d e f"), (2, "a b c d e f"), (3, None)], "doc_id long, text string")
    assert {(r["doc_id"], r["n_links"], r["class_id"]) for r in similar_groups(two).collect()} == {
        (1, 1, 1), (2, 1, 1), (3, 0, 3),
    }
    assert math.isclose(grouping.STEPS % grouping.BAND, 0)


def test_a_bucket_within_its_room_is_one_cell(spark):
    """Members of a leader too far from it to be linked for sure: a row each, not one per pair of tiles."""
    n = 1500
    rows, _ = _group(spark, n)
    found = spots(rows, lambda pairs: pairs.select("id", (101 + F.col("id") % 90).cast("int").alias("q")))
    made = tiles(rows.withColumn("room", F.lit(2048)), found)
    assert made.count() == n and made.select("low", "high").distinct().count() == 1
    # Less room than members: cells of two tiles at most, more copies of a row.
    sizes = [r["count"] for r in tiles(rows.withColumn("room", F.lit(300)), found).groupBy("low", "high").count().collect()]
    assert len(sizes) > 1 and max(sizes) <= 2 * 300 * 1.3


def test_added_runs_join_the_buckets_of_those_before(spark):
    draw = np.random.default_rng(9)
    signed = spark.createDataFrame(
        [(str(i), 10, [int(x) for x in draw.integers(0, 4, jaccard.COORDINATES)]) for i in range(300)],
        "id string, size int, path array<int>",
    )

    def rows(runs):
        return {tuple(r) for r in jaccard._paths(signed, runs, 0.8, 32).distinct().collect()}

    whole = rows(range(6))
    assert whole and whole == rows(range(4)) | rows(range(4, 6))
    assert {r[3] for r in whole} == {jaccard.TILE}


def test_a_class_meets_its_path_once_however_many_runs_hold_it(spark, monkeypatch):
    """Joins by id have a row per class, not one per class, run and bucket."""
    draw = np.random.default_rng(11)
    alike = draw.integers(0, 1 << 30, 64)
    paths = []
    for _ in range(200):
        path = alike.copy()
        path[draw.integers(0, 64, 4)] = draw.integers(0, 1 << 30, 4)
        paths.append([int(x) for x in path])
    rows = [(f"c{i}", 40, p) for i, p in enumerate(paths)]
    signed = spark.createDataFrame(rows, "id string, size int, path array<int>")
    joined = []
    kind = type(signed)
    plain = kind.join

    def join(left, right, on=None, *rest):
        if on == "id":
            joined.append(left.count())
        return plain(left, right, on, *rest)

    monkeypatch.setattr(kind, "join", join)
    assert jaccard._paths(signed, range(8), 0.8, 32).distinct().count() > 200
    assert joined and max(joined) <= 200
