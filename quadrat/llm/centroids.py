"""Centroid clustering of integer vectors, exact, with bounds that skip most distances.

Every vector keeps its centroid, an upper bound of the distance to it, and a lower bound of the
distance to any other.  When centroids move, the upper bound grows by the full drift of the own
centroid.  The lower bound shrinks by less than the drift of the others: all vectors of a cluster
lie in a sphere about its old centroid, and only the part of a drift that the sphere can see counts.

For a centroid that moves from a to b, |x - a| - |x - b| = s > 0 is a branch of a hyperbola about
the line through a and b, and lies within its asymptotes: seen from the middle m of a and b, x is
at an angle to b - a whose cosine is at least s / |b - a|.  So s <= |b - a| cos(angle), and in a
sphere with centre c and radius r the least angle is that of c - m less arcsin(r / |c - m|), all in
the plane through a, b and c.  From a right angle on nothing is lost.

A vector whose upper bound lies below its lower bound, or below half the distance from its centroid
to the next one, stays.  The others are ambiguous: their own distance is made exact, and if that
does not settle it, all centroids are scanned in exact integers.

Vectors and their state are tables bucketed by row, so no round shuffles either; a task adds up
what joined and left each cluster, so a round sends k sums a task.

Defined results: vectors that are null, of another length, or with null or non-finite components are
left out.  Repeated rows and ids are vectors of their own.  Starts with equal hashes (equal ids) come
in the order of their vectors; a null id hashes as the bare tag.  With fewer vectors than clusters
there are as many clusters as vectors; no vectors give no rows.  Equally near centroids: the smaller
number.  Other columns are ignored.  A component beyond 2^27 after scaling is an error, because a
squared distance would no longer fit a long.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.llm.common import MOST_BUCKETS, bucketed, written
from quadrat.llm.vectors import matrix

MOST = 1 << 27
STATE = (
    "row bigint, cluster int, upper double, lower double, sums array<bigint>, reach array<double>, scanned bigint"
)
RESULT = "vec_id bigint, cluster int, distance bigint"
#: Bounds are sums of rounded square roots; a vector counts as settled only beyond this margin.
MARGIN = 1e-9
ROWS_A_BUCKET = 200_000


def points(embeddings: DataFrame, dimension: int, scale: int) -> DataFrame:
    """row, vec_id and point: the kept vectors, scaled and rounded down to integers."""
    vector = F.col("embedding").cast("array<double>")
    fine = F.forall(vector, lambda x: x.isNotNull() & (F.abs(x) < float("inf")) & ~F.isnan(x))
    kept = embeddings.where((F.size("embedding") == dimension) & F.coalesce(fine, F.lit(False)))

    def whole(x):
        scaled = F.lit(float(scale)) * x
        return F.when(F.abs(scaled) <= MOST, F.floor(scaled).cast("int")).otherwise(
            F.raise_error(F.lit("a vector component is too large for exact squared distances")).cast("int")
        )

    return kept.select(
        F.monotonically_increasing_id().alias("row"), F.col("vec_id").cast("bigint").alias("vec_id"),
        F.transform(vector, whole).alias("point"),
    )


def squared(x: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """Exact squared distances, vectors by centroids."""
    top = max(int(np.abs(x).max(initial=0)), int(np.abs(centroids).max(initial=0)), 1)
    if 4 * top * top * x.shape[1] < 1 << 53:
        # All sums are integers that a double holds exactly.
        a, b = x.astype(np.float64), centroids.astype(np.float64)
        both = (a * a).sum(axis=1)[:, None] + (b * b).sum(axis=1)[None, :] - 2 * (a @ b.T)
        return both.astype(np.int64)
    return np.stack([((x - c) * (x - c)).sum(axis=1) for c in centroids], axis=1)


def loosening(old: np.ndarray, new: np.ndarray, radius: np.ndarray) -> np.ndarray:
    """By how much the lower bound of each cluster's vectors can fall; see the module."""
    old, new = old.astype(np.float64), new.astype(np.float64)
    most = np.zeros(len(old))
    for j in range(len(old)):
        drift = new[j] - old[j]
        length = np.sqrt(drift @ drift)
        if not length:
            continue
        seen = old - (old[j] + new[j]) / 2
        away = np.sqrt((seen * seen).sum(axis=1))
        outside = away > radius * (1 + MARGIN)
        far = np.where(outside, away, 1.0)
        angle = np.arccos(np.clip(seen @ drift / (far * length), -1, 1))
        least = np.maximum(angle - np.arcsin(np.clip(radius / far, 0, 1)), 0)
        part = np.where(outside, np.maximum(np.cos(least), 0), 1.0) * length
        part[j] = 0
        most = np.maximum(most, part)
    return most


class Round:
    """What a task needs to assign vectors: centroids, drifts, loosening, half gaps."""

    def __init__(self, new: np.ndarray, old: np.ndarray | None, radius: np.ndarray):
        self.centroids = new
        self.first = old is None
        k = len(new)
        self.drift, self.loose = np.zeros(k), np.zeros(k)
        if old is not None:
            gone = (new - old).astype(np.float64)
            self.drift = np.sqrt((gone * gone).sum(axis=1))
            self.loose = loosening(old, new, radius)
        gaps = np.sqrt(squared(new, new).astype(np.float64))
        gaps[np.arange(k), np.arange(k)] = np.inf
        self.half = gaps.min(axis=1) / 2

    def assign(self, x: np.ndarray, cluster: np.ndarray, upper: np.ndarray, lower: np.ndarray):
        """New cluster and bounds, and which vectors were scanned."""
        upper = upper + self.drift[cluster]
        lower = lower - self.loose[cluster]
        limit = np.maximum(lower, self.half[cluster])
        if self.first:
            open_ = np.arange(len(x))
        else:
            open_ = np.nonzero(upper * (1 + MARGIN) + MARGIN >= limit)[0]
            own = x[open_] - self.centroids[cluster[open_]]
            upper[open_] = np.sqrt((own * own).sum(axis=1).astype(np.float64))
            open_ = open_[upper[open_] * (1 + MARGIN) + MARGIN >= limit[open_]]
        if len(open_):
            all_ = squared(x[open_], self.centroids)
            best = all_.argmin(axis=1)
            at = np.arange(len(open_))
            cluster[open_], upper[open_] = best, np.sqrt(all_[at, best].astype(np.float64))
            rest = all_.astype(np.float64)
            rest[at, best] = np.inf
            lower[open_] = np.sqrt(rest.min(axis=1))
        return cluster, upper, lower, open_


def _unpacked(batch: pa.RecordBatch, first: bool):
    x = matrix(batch.column("point")).astype(np.int64)
    if first:
        n = batch.num_rows
        return x, np.zeros(n, dtype=np.int64), np.full(n, np.inf), np.full(n, -np.inf)
    cluster = batch.column("cluster").to_numpy().astype(np.int64)
    bounds = [batch.column(c).to_numpy(zero_copy_only=False).copy() for c in ("upper", "lower")]
    return x, cluster, *bounds


def _assigning(now: Round):
    """State of every vector, and one row a task with the changes of the sums and the radii."""
    k, d = now.centroids.shape
    names = [field.split()[0] for field in STATE.split(", ")]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, reach = np.zeros((k, d + 1), dtype=np.int64), np.full(k, -1.0)
        last, scanned = None, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            x, before, upper, lower = _unpacked(batch, now.first)
            cluster, upper, lower, open_ = now.assign(x, before.copy(), upper, lower)
            scanned += len(open_)
            ones = np.concatenate([x, np.ones((len(x), 1), dtype=np.int64)], axis=1)
            moved = np.ones(len(x), dtype=bool) if now.first else cluster != before
            np.add.at(sums, cluster[moved], ones[moved])
            if not now.first:
                np.subtract.at(sums, before[moved], ones[moved])
            np.maximum.at(reach, cluster, upper)
            last = batch.column("row")[-1].as_py()
            none = [None] * len(x)
            yield pa.RecordBatch.from_arrays(
                [batch.column("row"), pa.array(cluster.astype(np.int32)), pa.array(upper), pa.array(lower),
                 pa.array(none, pa.list_(pa.int64())), pa.array(none, pa.list_(pa.float64())),
                 pa.array(none, pa.int64())],
                names=names,
            )
        if last is not None:
            # Under the bucket of a row of its own, so that the task still writes one file.
            yield pa.RecordBatch.from_arrays(
                [pa.array([last]), pa.array([None], pa.int32()), pa.array([None], pa.float64()),
                 pa.array([None], pa.float64()), pa.array([sums.ravel().tolist()], pa.list_(pa.int64())),
                 pa.array([reach.tolist()], pa.list_(pa.float64())), pa.array([scanned])],
                names=names,
            )

    return run


def _ending(now: Round):
    """vec_id, cluster and exact squared distance of every vector."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows:
                continue
            x, before, upper, lower = _unpacked(batch, now.first)
            cluster, *_ = now.assign(x, before, upper, lower)
            own = x - now.centroids[cluster]
            yield pa.RecordBatch.from_arrays(
                [batch.column("vec_id"), pa.array(cluster.astype(np.int32)), pa.array((own * own).sum(axis=1))],
                names=["vec_id", "cluster", "distance"],
            )

    return run


def starts(held: DataFrame, k: int, tag: str) -> np.ndarray:
    """The ``k`` vectors whose tagged ids have the smallest hashes."""
    name = F.sha2(F.concat(F.lit(f"{tag}:"), F.coalesce(F.col("vec_id").cast("string"), F.lit(""))), 256)
    first = held.select(name.alias("name"), "point").orderBy("name", "point").limit(k).collect()
    return np.array([row["point"] for row in first], dtype=np.int64)


@dataclass
class Clusters:
    """vec_id, cluster and squared distance of every kept vector; the final centroids; and how
    many vectors each round had to compare with all centroids."""

    vectors: DataFrame
    centroids: list[list[int]]
    scanned: list[int]


def cluster(
    embeddings: DataFrame, *, k: int = 8, rounds: int = 10, tag: str = "3", dimension: int = 64, scale: int = 1024
) -> Clusters:
    """Start at the ``k`` vectors of smallest hash, move ``rounds`` times, assign once more."""
    spark = embeddings.sparkSession
    made = written(points(embeddings, dimension, scale), "centroid-points")
    centroids = starts(made, k, tag)
    if not len(centroids):
        return Clusters(spark.createDataFrame([], RESULT), [], [])
    cores = spark.sparkContext.defaultParallelism
    buckets = min(max(cores, -(-made.count() // ROWS_A_BUCKET)), MOST_BUCKETS)
    held = bucketed(made, "centroid-points", "row", buckets)
    k, d = centroids.shape
    totals = [[0] * (d + 1) for _ in range(k)]
    now, state, scanned = Round(centroids, None, np.zeros(k)), None, []

    def inputs() -> DataFrame:
        if state is None:
            return held
        bounds = state.where("sums IS NULL").select("row", "cluster", "upper", "lower")
        return held.join(bounds.hint("merge"), "row")

    for _ in range(rounds):
        state = bucketed(inputs().mapInArrow(_assigning(now), STATE), "centroid-state", "row", buckets)
        parts = state.where("sums IS NOT NULL")
        change = (
            parts.select(F.posexplode("sums").alias("at", "n"))
            .groupBy("at").agg(F.sum(F.col("n").cast("decimal(38,0)")).alias("n")).collect()
        )
        for row in change:
            totals[row["at"] // (d + 1)][row["at"] % (d + 1)] += int(row["n"])
        tops = [F.max(F.get("reach", F.lit(i))).alias(f"r{i}") for i in range(k)]
        reach = parts.agg(*tops, F.sum("scanned").alias("scanned")).first()
        scanned.append(reach["scanned"])
        old = now.centroids
        new = np.array([
            [s // t[d] for s in t[:d]] if t[d] else old[i].tolist() for i, t in enumerate(totals)
        ], dtype=np.int64)
        now = Round(new, old, np.maximum([reach[i] for i in range(k)], 0.0))
    result = written(inputs().mapInArrow(_ending(now), RESULT), "centroid-result")
    return Clusters(result, now.centroids.tolist(), scanned)
