"""Neighbours next to long vectors, inside groups of near and exact copies, and with odd rows."""

from __future__ import annotations

import numpy as np

from quadrat.llm import neighbours

KIND = "vec_id bigint, embedding array<double>"


def found(spark, ids, x, **options) -> dict[int, list[tuple[int, float]]]:
    rows = [(int(i), [float(c) for c in v]) for i, v in zip(ids, x)]
    frame = spark.createDataFrame(rows, KIND)
    got: dict = {}
    for r in neighbours.nearest(frame, **options).orderBy("query_id", "rank").collect():
        held = got.setdefault(r["query_id"], [])
        held.append((r["vec_id"], r["score"]))
        assert r["rank"] == len(held)
    return got


def recall(ids, x, got, top=20, only=None) -> float:
    hit = total = 0
    for q, near in got.items():
        at = int(np.nonzero(ids == q)[0][0])
        if only is not None and not only[at]:
            continue
        s = x @ x[at]
        order = [int(ids[j]) for j in np.lexsort((ids, -s)) if j != at][:top]
        hit += len(set(order) & {i for i, _ in near})
        total += len(order)
    return hit / total


def test_one_long_vector_does_not_blur_the_others(spark):
    rng = np.random.default_rng(8)
    x, ids = rng.standard_normal((1500, 32)), np.arange(1500)
    x[777] *= 100
    got = found(spark, ids, x)
    assert sorted(got) == list(range(0, 1500, 20))
    assert recall(ids, x, got) >= 0.95


def test_queries_inside_a_group_of_near_copies(spark):
    rng = np.random.default_rng(9)
    x, ids = rng.standard_normal((3000, 32)), np.arange(3000)
    crowd = rng.permutation(3000)[:300]
    x[crowd] = rng.standard_normal(32) + 0.01 * rng.standard_normal((300, 32))
    inside = np.zeros(3000, dtype=bool)
    inside[crowd] = True
    got = found(spark, ids, x)
    assert recall(ids, x, got) >= 0.95
    assert recall(ids, x, got, only=inside) >= 0.95


def test_exact_copies_go_to_the_smaller_ids(spark, copies=400):
    rng = np.random.default_rng(10)
    x, ids = rng.standard_normal((1000, 16)), np.arange(1000)
    crowd = np.sort(rng.permutation(1000)[:copies])
    x[crowd] = 3 * x[crowd[0]]
    got = found(spark, ids, x)
    for q in (int(i) for i in crowd if i % 20 == 0):
        s = x @ x[q]
        best = [i for i in np.lexsort((ids, -np.round(s, 9))) if i != q][:20]
        assert [i for i, _ in got[q]] == best
        assert all(abs(score - s[i]) < 1e-9 for i, score in got[q])


def test_few_rows_odd_rows_and_clashing_columns(spark):
    rows = [
        (0, [1.0, 0.0], "a"), (20, [1.0, 0.0], "b"), (1, [0.5, 0.5], None), (1, [0.4, 0.5], None),
        (None, [1.0, 1.0], "c"), (40, None, "d"), (60, [0.0, 0.0], "e"), (80, [1.0, None], "f"),
        (100, [float("nan"), 1.0], "g"), (120, [1.0, 2.0, 3.0], "h"), (140, [1e-300, -0.0], "i"),
    ]
    frame = spark.createDataFrame(rows, KIND + ", score string")
    got: dict = {}
    for r in neighbours.nearest(frame).orderBy("query_id", "rank").collect():
        got.setdefault(r["query_id"], []).append((r["vec_id"], r["score"]))
    assert got == {
        0: [(20, 1.0), (1, 0.5), (140, 1e-300)],
        20: [(0, 1.0), (1, 0.5), (140, 1e-300)],
        140: [(0, 1e-300), (20, 1e-300), (1, 5e-301)],
    }
