"""Distances, community tests and ordination against independent numpy work."""

import itertools

import numpy as np
import pytest

from quadrat.operators import community as cm
from quadrat.operators.distance import bray_curtis
from quadrat.operators import ordination
from quadrat.operators.permutation import permuted_sites
from quadrat.session import materialise

SITES, TAXA, GROUPS = 14, 9, 3


@pytest.fixture(scope="module")
def abundance():
    rng = np.random.default_rng(3)
    table = rng.integers(0, 6, (SITES, TAXA)).astype(float)
    table[0, :] = 0
    table[0, 0] = 4  # two sites that share no taxon
    table[1, :] = 0
    table[1, 1] = 2
    table[3] = table[2]  # and two equal ones
    return table


@pytest.fixture(scope="module")
def long(spark, abundance):
    rows = [
        (f"s{i:02d}", f"t{j}", float(abundance[i, j]))
        for i, j in itertools.product(range(SITES), range(TAXA))
        if abundance[i, j] > 0
    ]
    return materialise(spark.createDataFrame(rows, "site string, taxon string, n double"), "long")


@pytest.fixture(scope="module")
def matrix(abundance):
    total = abundance.sum(axis=1)
    shared = np.minimum(abundance[:, None, :], abundance[None, :, :]).sum(axis=2)
    return 1 - 2 * shared / (total[:, None] + total[None, :])


@pytest.fixture(scope="module")
def pairs(spark, long):
    return materialise(bray_curtis(long, "site", "taxon", "n"), "pairs")


@pytest.fixture(scope="module")
def groups():
    return [f"g{i % GROUPS}" for i in range(SITES)]


@pytest.fixture(scope="module")
def labels(spark, groups):
    rows = [("g", f"s{i:02d}", g) for i, g in enumerate(groups)]
    rows += [("half", f"s{i:02d}", str(i < 6)) for i in range(SITES)]
    return spark.createDataFrame(rows, "factor string, site string, label string")


def as_matrix(df):
    full = np.zeros((SITES, SITES))
    for i, j, d in df.collect():
        a, b = int(i[1:]), int(j[1:])
        assert a < b
        full[a, b] = full[b, a] = d
    return full


@pytest.mark.parametrize(("tile", "strip"), [(256, 4096), (3, 2), (1, 1), (5, 4096)])
def test_bray_curtis_does_not_depend_on_tiles(long, matrix, tile, strip):
    got = bray_curtis(long, "site", "taxon", "n", tile=tile, strip=strip)
    assert got.count() == SITES * (SITES - 1) // 2
    full = as_matrix(got)
    assert np.allclose(full, matrix)
    assert full[0, 1] == 1.0 and full[2, 3] == 0.0


def hat_matrix_f(matrix, groups):
    """Pseudo-F by the trace form on the doubly centred matrix."""
    n, names = len(groups), sorted(set(groups))
    centre = np.eye(n) - 1 / n
    gower = centre @ (-0.5 * matrix**2) @ centre
    design = np.array([[float(g == k) for k in names] for g in groups])
    hat = design @ np.linalg.pinv(design)
    among, total = np.trace(hat @ gower), np.trace(gower)
    k = len(names)
    return (among / (k - 1)) / ((total - among) / (n - k)), among / total


def test_permanova_matches_the_hat_matrix_form(pairs, labels, matrix, groups):
    got = {r["factor"]: r for r in cm.permanova(pairs, labels).collect()}
    f, r2 = hat_matrix_f(matrix, groups)
    assert got["g"]["pseudo_f"] == pytest.approx(f) and got["g"]["r2"] == pytest.approx(r2)
    assert got["g"]["ss_between"] + got["g"]["ss_within"] == pytest.approx(got["g"]["ss_total"])


def test_permutations_are_permutations(spark, long):
    rows = permuted_sites(long.select("site").distinct(), "site", 5).collect()
    for p in range(1, 6):
        mine = [r for r in rows if r["p"] == p]
        assert len(mine) == len({r["site"] for r in mine}) == len({r["source"] for r in mine}) == SITES


@pytest.mark.parametrize("tile", [cm.TILE, 5, 1])
def test_permutation_p_value(pairs, labels, matrix, groups, long, tile):
    """Same p whatever the tiles, and equal to permuting labels by hand."""
    one = labels.select("site").distinct().selectExpr("'same' AS factor", "site", "'x' AS label")
    both = labels.unionByName(one.select(labels.columns))
    got = {r["factor"]: r for r in cm.permanova_test(pairs, both, 19, tile).collect()}
    assert got["same"]["pseudo_f"] is None and got["same"]["p_value"] is None
    observed, _ = hat_matrix_f(matrix, groups)
    moved = permuted_sites(long.select("site").distinct(), "site", 19).collect()
    exceed = 0
    for p in range(1, 20):
        source = {r["site"]: int(r["source"][1:]) for r in moved if r["p"] == p}
        shuffled = [groups[source[f"s{i:02d}"]] for i in range(SITES)]
        exceed += hat_matrix_f(matrix, shuffled)[0] >= observed - cm.TOLERANCE
    assert got["g"]["p_value"] == pytest.approx((exceed + 1) / 20)


def test_dispersion_matches_principal_coordinates(pairs, labels, matrix, groups):
    centre = np.eye(SITES) - 1 / SITES
    values, vectors = np.linalg.eigh(centre @ (-0.5 * matrix**2) @ centre)
    axes = vectors * np.sqrt(np.abs(values))
    real = values > 0
    got = {r["site"]: r["z"] for r in cm.dispersion(pairs, labels).collect() if r["factor"] == "g"}
    for i, g in enumerate(groups):
        gap = axes[i] - axes[[j for j in range(SITES) if groups[j] == g]].mean(axis=0)
        z = np.sqrt(abs((gap[real] ** 2).sum() - (gap[~real] ** 2).sum()))
        assert got[f"s{i:02d}"] == pytest.approx(z, abs=1e-7)


def test_dispersion_test_is_a_one_way_f(pairs, labels):
    distances = materialise(cm.dispersion(pairs, labels), "z")
    got = {r["factor"]: r for r in cm.dispersion_test(distances, 49).collect()}
    rows = [r for r in distances.collect() if r["factor"] == "g"]
    z = np.array([r["z"] for r in rows])
    parts = [z[[r["label"] == g for r in rows]] for g in sorted({r["label"] for r in rows})]
    within = sum(((p - p.mean()) ** 2).sum() for p in parts)
    between = sum(len(p) * (p.mean() - z.mean()) ** 2 for p in parts)
    f = (between / (len(parts) - 1)) / (within / (len(z) - len(parts)))
    assert got["g"]["f"] == pytest.approx(f)
    assert 1 / 50 <= got["g"]["p_value"] <= 1


def test_a_group_of_one_site_has_no_dispersion(spark, pairs):
    rows = [("g", f"s{i:02d}", "alone" if i == 0 else "rest") for i in range(SITES)]
    labels = spark.createDataFrame(rows, "factor string, site string, label string")
    got = {r["site"]: r["z"] for r in cm.dispersion(pairs, labels).collect()}
    assert got["s00"] == 0.0 and got["s05"] > 0


def test_results_do_not_depend_on_partitioning(pairs, labels):
    a = cm.permanova(pairs.repartition(1), labels).collect()
    b = cm.permanova(pairs.repartition(7), labels.repartition(3)).collect()
    key = lambda r: r["factor"]
    for x, y in zip(sorted(a, key=key), sorted(b, key=key)):
        assert x["pseudo_f"] == pytest.approx(y["pseudo_f"])


def planted(spark, n: int, seed: int = 1):
    rng = np.random.default_rng(seed)
    points = rng.normal(size=(n, 2))
    names = [f"p{i:02d}" for i in range(n)]
    rows = [
        (names[i], names[j], float(np.linalg.norm(points[i] - points[j]) ** 1.5) / 12)
        for i, j in itertools.combinations(range(n), 2)
    ]
    frame = spark.createDataFrame(rows, "site_i string, site_j string, d double")
    return points, materialise(frame, "planted")


def test_nmds_recovers_a_planted_plane(spark):
    points, pairs = planted(spark, 16)
    scores, trace = ordination.nmds(pairs, most_starts=12, batch=4, threshold=9.0)
    rows = trace.orderBy("stress").collect()
    assert all(r["converged"] for r in rows) and rows[0]["stress"] < 0.01
    # The two best starts agree, so the other batches never began.
    assert rows[0]["agrees"] and rows[1]["residual"] < ordination.AGREE and len(rows) < 12
    found = np.array([[r["axis1"], r["axis2"]] for r in sorted(scores.collect())])
    assert np.allclose(found.mean(axis=0), 0, atol=1e-9)
    assert found[:, 0].var() >= found[:, 1].var()
    assert abs((found[:, 0] * found[:, 1]).mean()) < 1e-9
    assert ordination.residual(points, found) < 0.02


def plain_fit(d, dist):
    """Levels by a plain pooling loop over the distinct values."""
    merged = []
    for v in sorted(set(d)):
        merged.append([dist[d == v].mean(), int((d == v).sum()), [v]])
        while len(merged) > 1 and merged[-2][0] > merged[-1][0]:
            y, x = merged.pop(), merged.pop()
            n = x[1] + y[1]
            merged.append([(x[0] * x[1] + y[0] * y[1]) / n, n, x[2] + y[2]])
    level = {v: m for m, _, vs in merged for v in vs}
    return np.array([level[v] for v in d])


@pytest.mark.parametrize("kind,size", [("plain", 10**6), ("plain", 40), ("ties", 25), ("one value", 30), ("hot", 20)])
def test_monotone_fit_by_ranges_equals_a_plain_loop(spark, kind, size):
    rng = np.random.default_rng(5)
    names = [f"q{i:02d}" for i in range(24)]
    links = list(itertools.combinations(range(24), 2))
    d = rng.random(len(links))
    d = {"plain": d, "ties": np.round(d, 1), "one value": np.ones(len(links)), "hot": np.where(d < 0.5, 0.5, d)}[kind]
    rows = [(names[i], names[j], float(v)) for (i, j), v in zip(links, d)] + [(names[0], "alone", None)]
    pairs = materialise(spark.createDataFrame(rows, "site_i string, site_j string, d double"), "q")
    ranges = ordination.sorted_ranges(pairs, size)
    assert ranges.names == names
    points = rng.normal(size=(24, 2)) + np.linspace(0, 3, 24)[:, None]
    fitted = ordination.Stress(ranges).fitted(points).collect()
    place = dict(zip(names, points))
    dist = np.array([np.linalg.norm(place[r["site_i"]] - place[r["site_j"]]) for r in fitted])
    assert len(fitted) == len(links)
    assert np.allclose([r["dist"] for r in fitted], dist)
    want = plain_fit(np.array([r["d"] for r in fitted]), dist)
    assert np.allclose([r["h"] for r in fitted], want)
    stress, slope = ordination.Stress(ranges)({4: points})
    assert stress[4] == pytest.approx(np.sqrt(((dist - want) ** 2).sum() / (dist**2).sum()))
    if kind == "plain":
        for k in ((3, 0), (20, 1)):
            ends = []
            for step in (1e-6, -1e-6):
                moved = points.copy()
                moved[k] += step
                ends.append(ordination.Stress(ranges)({4: moved})[0][4])
            assert slope[4][k] == pytest.approx((ends[0] - ends[1]) / 2e-6, rel=1e-3, abs=1e-7)


def test_scores_are_in_units_of_half_change(spark):
    rng = np.random.default_rng(2)
    points = rng.random((12, 2))
    names = [f"h{i:02d}" for i in range(12)]
    far = {(i, j): float(np.linalg.norm(points[i] - points[j])) for i, j in itertools.combinations(range(12), 2)}
    # Replicates differ by 0.2; each 4 units of distance cost 0.4, half of the similarity left.
    rows = [(names[i], names[j], min(0.2 + 0.1 * v, 0.79) if v < 1 else 0.95) for (i, j), v in far.items()]
    pairs = materialise(spark.createDataFrame(rows, "site_i string, site_j string, d double"), "h")
    scores = spark.createDataFrame([(n, *map(float, p)) for n, p in zip(names, points)], "site string, axis1 double, axis2 double")
    unit, zero = ordination.half_change(pairs, scores)
    assert (unit, zero) == (pytest.approx(4.0), pytest.approx(0.2))
    scaled, _ = ordination.nmds(pairs, most_starts=1)
    assert ordination.half_change(pairs, scaled)[0] == pytest.approx(1.0)


def test_nmds_of_too_few_sites_is_missing(spark):
    pairs = spark.createDataFrame([("a", "b", 0.5)], "site_i string, site_j string, d double")
    scores, trace = ordination.nmds(pairs)
    assert [tuple(r) for r in sorted(scores.collect())] == [("a", None, None), ("b", None, None)]
    assert trace.count() == 0


def test_missing_taxon_is_a_taxon_of_its_own(spark):
    rows_ = [("r", None, 1.0), ("r", "t", 1.0), ("s", None, 1.0), ("s", "u", 1.0)]
    df = spark.createDataFrame(rows_, "site string, taxon string, n double")
    assert bray_curtis(df, "site", "taxon", "n").first()["d"] == 0.5
