"""Non-metric multidimensional scaling on a table of site pairs.

Kruskal's stress-1 is lowered by quasi-Newton steps (limited memory, halved until the stress falls)
from many starts, until a start gains nothing more.  Starts go in batches; a batch shares every
pass over the pairs, and a start that has ended leaves it.  New batches come until the two best
configurations agree up to position, turn, mirroring and size (Procrustes), or ``most_starts`` have
ended; the trace says which.

Pairs are sorted by dissimilarity once and cut into ranges; a row holds a range.  In a pass a range
fits its own part of the monotone curve (pool adjacent violators on the means of tied values).  Its
blocks are final if all earlier ranges lie below them and all later ones above.  Only blocks for
which that fails leave their range: they are pooled in a few neighbouring ranges at a time, level by
level, and sent back.  A value that many pairs share may fill several ranges; its parts are added up.
So pairs move once, and the curve never meets in one place.  While all pairs fit one range there is
nothing to exchange between passes, so each start takes its steps in a task of its own; a pass of
such a table as a job of its own takes far longer than its sums.

A pass sends the coordinates to the tasks and brings back one sum per site and start.  For n sites
there are n(n-1)/2 pairs in the table already, so the 16 n bytes of a start are bounded by the square
root of what is stored.

Defined results: pairs without a dissimilarity are left out.  With fewer than three sites there is
nothing to place: axes and stress are missing.  Axes are centred, axis 1 varies most, and each axis
points to where its largest score is positive.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Generator, Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quadrat.session import materialise

#: Pairs of a range, and neighbouring ranges whose blocks are pooled in one task at a time.
PAIRS_A_RANGE = 1 << 17
MERGED_AT_ONCE = 16
#: Share of the sum of squares by which two configurations may differ and still agree.
AGREE = 1e-3

RANGES = "grp int, shared boolean, i array<int>, j array<int>, d array<double>"
SUMS = "start int, site int, ax double, ay double, bx double, by double, low double, high double"
TRACE = "start int, rounds int, stress double, converged boolean, residual double, agrees boolean"


def pooled(level: np.ndarray, weight: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Pool adjacent violators: level and weight of each block, and how many values it holds."""
    levels: list[float] = []
    weights: list[float] = []
    sizes: list[int] = []
    for y, w in zip(level.tolist(), weight.tolist()):
        n = 1
        while levels and levels[-1] >= y:
            before = weights.pop()
            y = (levels.pop() * before + y * w) / (before + w)
            w += before
            n += sizes.pop()
        levels.append(y)
        weights.append(w)
        sizes.append(n)
    return np.array(levels), np.array(weights), np.array(sizes, dtype=np.int64)


@dataclass
class Ranges:
    """The sorted pairs: site names in the order of their numbers, the table, and shared groups."""

    names: list[str]
    held: DataFrame
    groups: int
    shared: list[int]

    @property
    def single(self) -> bool:
        return self.groups == 3 and not self.shared


def sorted_ranges(pairs: DataFrame, pairs_a_range: int = PAIRS_A_RANGE) -> Ranges:
    """Pairs with numbered sites, sorted by dissimilarity, a row for each range."""
    spark = pairs.sparkSession
    known = pairs.where("d IS NOT NULL").select("site_i", "site_j", F.col("d").cast("double").alias("d"))
    ends = known.select(F.explode(F.array("site_i", "site_j")).alias("site"))
    names = sorted(row["site"] for row in ends.distinct().collect())
    numbers = spark.createDataFrame([(s, i) for i, s in enumerate(names)], "site string, number int")
    left = numbers.withColumnsRenamed({"site": "site_i", "number": "i"})
    right = numbers.withColumnsRenamed({"site": "site_j", "number": "j"})
    numbered = materialise(known.join(left, "site_i").join(right, "site_j").select("i", "j", "d"), "nmds-pairs")
    parts = max(1, -(-numbered.count() // pairs_a_range))
    order = ("d", F.xxhash64("i", "j"))
    spread = numbered.repartitionByRange(parts, *order) if parts > 1 else numbered.repartition(1)
    spread = materialise(
        spread.sortWithinPartitions("d", "i", "j").mapInArrow(_rowed, RANGES), "nmds-sorted"
    )
    first, last = F.get("d", F.lit(0)), F.element_at("d", -1)
    bounds = sorted(tuple(r) for r in spread.select(first.alias("a"), last.alias("b")).collect())
    # Values that end one range and begin the next get groups of their own.
    shared = sorted({b for (_, b), (a, _) in zip(bounds, bounds[1:]) if a == b})
    starts = sorted({a for a, _ in bounds} | set(shared))
    # Group 2k holds values strictly between boundaries, group 2k + 1 the k-th boundary value.
    held = materialise(spread.mapInArrow(_grouped(starts, set(shared)), RANGES), "nmds-ranges")
    return Ranges(names, held, 2 * len(starts) + 1, [2 * starts.index(v) + 1 for v in shared])


def _rowed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The sorted pairs of a task as one row."""
    held = [b for b in batches if b.num_rows]
    if held:
        table = pa.Table.from_batches(held)
        columns = [table.column(c).to_numpy() for c in ("i", "j", "d")]
        yield _range_rows([(0, False, *columns)])


def _range_rows(rows: list[tuple]) -> pa.RecordBatch:
    kinds = [pa.int32(), pa.bool_(), pa.list_(pa.int32()), pa.list_(pa.int32()), pa.list_(pa.float64())]
    arrays = [pa.array([r[k] for r in rows], kind) for k, kind in enumerate(kinds)]
    return pa.RecordBatch.from_arrays(arrays, names=[f.split()[0] for f in RANGES.split(", ")])


def _grouped(starts: list[float], shared: set[float]):
    edges = np.array(starts)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, i, j, d in _unpacked(batch):
                at = np.searchsorted(edges, d, side="right")
                own = np.array([v in shared for v in edges[np.maximum(at - 1, 0)].tolist()])
                own &= d == edges[np.maximum(at - 1, 0)]
                # A boundary value that no other range has stays with the values after it.
                group = np.where(own, 2 * at - 1, 2 * at)
                cuts = np.nonzero(np.diff(group))[0] + 1
                parts = zip(*[np.split(x, cuts) for x in (group, own, i, j, d)])
                yield _range_rows([(int(g[0]), bool(o[0]), *rest) for g, o, *rest in parts])

    return run


def _unpacked(batch: pa.RecordBatch):
    """Range by range: group, i, j, d."""
    columns = [batch.column(c) for c in ("i", "j", "d")]
    for n, group in enumerate(batch.column("grp").to_pylist()):
        yield group, *[c[n].values.to_numpy() for c in columns]


class Fit:
    """The monotone fit of one range for one start."""

    def __init__(self, points: np.ndarray, i: np.ndarray, j: np.ndarray, value: np.ndarray, count: np.ndarray):
        self.apart = points[i] - points[j]
        self.dist = np.sqrt((self.apart * self.apart).sum(axis=1))
        means = np.bincount(value, weights=self.dist) / count
        self.level, self.weight, self.sizes = pooled(means, count)

    def mend(self, corrections: list[dict]) -> None:
        """Take over the levels of blocks that were pooled outside the range."""
        for c in corrections:
            self.level[c["at"] : c["until"] + 1] = c["level"]

    def fitted(self, value: np.ndarray) -> np.ndarray:
        return np.repeat(self.level, self.sizes)[value]


def _values(d: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Number of each pair's value in ascending order, and how many pairs have it."""
    new = np.ones(len(d), dtype=bool)
    new[1:] = d[1:] != d[:-1]
    value = np.cumsum(new) - 1
    return value, np.bincount(value).astype(np.float64)


def _mended_of(batch: pa.RecordBatch) -> list[dict[int, list[dict]]]:
    """For each range of the batch, by start, the levels that were pooled outside it."""
    if "mended" not in batch.schema.names:
        return [{}] * batch.num_rows
    found = []
    for corrections in batch.column("mended").to_pylist():
        by_start: dict[int, list[dict]] = {}
        for c in corrections or ():
            by_start.setdefault(c["start"], []).append(c)
        found.append(by_start)
    return found


def _fitting(points, names: list[str]):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = pa.array(names)
        for batch in batches:
            for (_, i, j, d), mended in zip(_unpacked(batch), _mended_of(batch)):
                value, count = _values(d)
                fit = Fit(points.value[0], i, j, value, count)
                fit.mend(mended.get(0, ()))
                columns = [sites.take(pa.array(i)), sites.take(pa.array(j)), pa.array(d)]
                yield pa.RecordBatch.from_arrays(
                    [*columns, pa.array(fit.dist), pa.array(fit.fitted(value))],
                    names=["site_i", "site_j", "d", "dist", "h"],
                )

    return run


def _pulls(fit: Fit, gap: np.ndarray, i: np.ndarray, j: np.ndarray, n: int) -> np.ndarray:
    """Per site the sums of the gradient: of the misfit on both axes, then of the extent."""
    pull = np.divide(gap, fit.dist, out=np.zeros_like(gap), where=fit.dist > 0)[:, None] * fit.apart
    parts = (pull[:, 0], pull[:, 1], fit.apart[:, 0], fit.apart[:, 1])
    return np.stack([np.bincount(i, part, n) - np.bincount(j, part, n) for part in parts], axis=1)


def _stress(misfit: float, extent: float, own: np.ndarray) -> tuple[float, np.ndarray]:
    """Stress and its gradient from the sums."""
    value = math.sqrt(misfit / extent) if extent > 0 else 0.0
    if not misfit > 0:
        return value, np.zeros((len(own), 2))
    return value, value * (own[:, :2] / misfit - own[:, 2:] / extent)


def _descending(points, n: int, tolerance: float):
    """The whole descent of a start, for tables whose pairs are one range."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for (_, i, j, d), start in zip(_unpacked(batch), batch.column("start").to_pylist()):
                value, count = _values(d)
                steps = descent(points.value[start], tolerance)
                asked = next(steps)
                while True:
                    fit = Fit(asked, i, j, value, count)
                    gap = fit.dist - fit.fitted(value)
                    found = _stress(gap @ gap, fit.dist @ fit.dist, _pulls(fit, gap, i, j, n))
                    try:
                        asked = steps.send(found)
                    except StopIteration as end:
                        x, stress, rounds, done = end.value
                        break
                columns = [pa.array([start], pa.int32()), pa.array([x.ravel()], pa.list_(pa.float64()))]
                rest = [pa.array([float(stress)]), pa.array([rounds], pa.int32()), pa.array([done])]
                yield pa.RecordBatch.from_arrays([*columns, *rest], names=["start", "x", "stress", "rounds", "done"])

    return run


def _passing(points, n: int):
    """Per site and start the sums of the gradient; per group and start those of the fit.

    A group is told by site -1 - group: sum of distances and number of pairs (for shared values),
    misfit and extent, lowest and highest level.  Sites of one task are added up in the task.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coordinates: dict[int, np.ndarray] = points.value
        sums = {s: np.zeros((n, 4)) for s in coordinates}
        told: list[tuple] = []
        for batch in batches:
            for (group, i, j, d), mended in zip(_unpacked(batch), _mended_of(batch)):
                value, count = _values(d)
                for start, xy in coordinates.items():
                    fit = Fit(xy, i, j, value, count)
                    low, high = fit.level[0], fit.level[-1]
                    fit.mend(mended.get(start, ()))
                    gap = fit.dist - fit.fitted(value)
                    sums[start] += _pulls(fit, gap, i, j, n)
                    told.append((
                        start, -1 - group, fit.dist.sum(), float(len(d)), gap @ gap, fit.dist @ fit.dist, low, high,
                    ))
        rows = [pa.array(np.repeat(list(sums), n), pa.int32()), pa.array(np.tile(np.arange(n), len(sums)), pa.int32())]
        flat = np.concatenate(list(sums.values()))
        none = pa.nulls(len(flat), pa.float64())
        names = [f.split()[0] for f in SUMS.split(", ")]
        yield pa.RecordBatch.from_arrays([*rows, *[pa.array(flat[:, k]) for k in range(4)], none, none], names=names)
        if told:
            kinds = [pa.int32(), pa.int32(), *[pa.float64()] * 6]
            yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*told), kinds)], names=names)

    return run


@dataclass
class Pass:
    stress: dict[int, float]
    slope: dict[int, np.ndarray]
    #: Start to, by group: level sums, pairs, lowest and highest level.
    told: dict[int, pd.DataFrame]


class Stress:
    """Stress and its gradient for configurations of several starts at once."""

    def __init__(self, ranges: Ranges):
        self.ranges, self.spark = ranges, ranges.held.sparkSession
        self.passes = 0

    def __call__(self, points: dict[int, np.ndarray]) -> tuple[dict[int, float], dict[int, np.ndarray]]:
        shared = self.spark.sparkContext.broadcast(points)
        found = self._sums(self.ranges.held, shared)
        mended = self._mended(found.told, shared)
        if mended is not None:
            found = self._sums(self.ranges.held.join(mended, "grp", "left"), shared)
        shared.destroy()
        return found.stress, found.slope

    def descents(self, points: dict[int, np.ndarray], tolerance: float) -> dict[int, tuple[np.ndarray, float, int, bool]]:
        """Where each start ends, a task for each; for a single range."""
        shared = self.spark.sparkContext.broadcast(points)
        each = self.ranges.held.withColumn("start", F.explode(F.array(*[F.lit(s) for s in points])))
        kind = "start int, x array<double>, stress double, rounds int, done boolean"
        work = _descending(shared, len(self.ranges.names), tolerance)
        rows = each.repartition(len(points)).mapInArrow(work, kind).collect()
        shared.destroy()
        return {r["start"]: (np.array(r["x"]).reshape(-1, 2), r["stress"], r["rounds"], r["done"]) for r in rows}

    def fitted(self, points: np.ndarray) -> DataFrame:
        """``site_i``, ``site_j``, ``d``, ``dist`` and ``h``, the monotone fit, for one configuration."""
        shared = self.spark.sparkContext.broadcast({0: points})
        mended = self._mended(self._sums(self.ranges.held, shared).told, shared)
        held = self.ranges.held if mended is None else self.ranges.held.join(mended, "grp", "left")
        kind = "site_i string, site_j string, d double, dist double, h double"
        rows = materialise(held.mapInArrow(_fitting(shared, self.ranges.names), kind), "nmds-fitted")
        shared.destroy()
        return rows

    def _sums(self, held: DataFrame, shared) -> Pass:
        self.passes += 1
        n = len(self.ranges.names)
        rows = held.mapInArrow(_passing(shared, n), SUMS).groupBy("start", "site").agg(
            *[F.sum(c).alias(c) for c in ("ax", "ay", "bx", "by")], F.min("low").alias("low"), F.max("high").alias("high")
        )
        frame = rows.toPandas()
        stress, slope, told = {}, {}, {}
        for start, part in frame.groupby("start"):
            groups = part[part["site"] < 0]
            misfit, extent = groups["bx"].sum(), groups["by"].sum()
            own = part[part["site"] >= 0].sort_values("site")[["ax", "ay", "bx", "by"]].to_numpy()
            stress[start], slope[start] = _stress(misfit, extent, own)
            groups = groups.assign(grp=-1 - groups["site"]).sort_values("grp")
            told[start] = groups[["grp", "ax", "ay", "low", "high"]].rename(columns={"ax": "sum", "ay": "pairs"})
        return Pass(stress, slope, told)

    def _mended(self, told: dict[int, pd.DataFrame], shared) -> DataFrame | None:
        """Levels, by group, that the ranges could not know by themselves; none if there are none."""
        alone = set(self.ranges.shared)
        limits, blocks = {}, []
        for start, part in told.items():
            common = part["grp"].isin(alone).to_numpy()
            mean = (part["sum"] / part["pairs"]).to_numpy()
            low, high = np.where(common, mean, part["low"]), np.where(common, mean, part["high"])
            below = np.maximum.accumulate(np.concatenate([[-np.inf], high[:-1]]))
            above = np.minimum.accumulate(np.concatenate([low[1:], [np.inf]])[::-1])[::-1]
            # A run ends where everything before lies below everything after.
            ends = np.maximum.accumulate(high)[:-1] < np.minimum.accumulate(low[::-1])[::-1][1:]
            run = np.concatenate([[0], np.cumsum(ends)])
            for g, lo, hi, r, c, m, w in zip(part["grp"], below, above, run, common, mean, part["pairs"]):
                if c:
                    blocks.append((start, int(r), int(g), 0, int(g), 0, float(m), float(w)))
                else:
                    limits[start, int(g)] = (float(lo), float(hi), int(r))
        parted = any(lo >= row.low or hi <= row.high for start, part in told.items() for row in part.itertuples()
                     if (start, row.grp) in limits for lo, hi, _ in [limits[start, row.grp]])
        if not blocks and not parted:
            return None
        kind = "start int, run int, grp int, at int, last_grp int, until int, level double, weight double"
        bounds = self.spark.sparkContext.broadcast(limits)
        loose = self.ranges.held.where("NOT shared").mapInArrow(_leaving(shared, bounds), kind)
        loose = materialise(loose.unionByName(self.spark.createDataFrame(blocks, kind)), "nmds-blocks")
        width = 1
        while True:
            node = F.floor(F.col("grp") / (width * MERGED_AT_ONCE)).alias("node")
            loose = materialise(loose.groupBy("start", "run", node).applyInPandas(_merged, kind), "nmds-blocks")
            width *= MERGED_AT_ONCE
            if width >= self.ranges.groups:
                break
        each = loose.select(
            "start", "grp", "at", "last_grp", "until", "level", F.explode(F.sequence("grp", "last_grp")).alias("of")
        )
        inside = F.struct(
            "start", F.when(F.col("of") == F.col("grp"), F.col("at")).otherwise(0).alias("at"),
            F.when(F.col("of") == F.col("last_grp"), F.col("until")).otherwise((1 << 31) - 2).alias("until"), "level",
        )
        return materialise(
            each.groupBy(F.col("of").alias("grp")).agg(F.collect_list(inside).alias("mended")), "nmds-mended"
        )


def _leaving(points, bounds):
    """Blocks of a range that do not lie above all earlier and below all later levels."""
    names = ["start", "run", "grp", "at", "last_grp", "until", "level", "weight"]
    kinds = [*[pa.int32()] * 6, pa.float64(), pa.float64()]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for group, i, j, d in _unpacked(batch):
                value, count = _values(d)
                for start, xy in points.value.items():
                    fit = Fit(xy, i, j, value, count)
                    low, high, of = bounds.value[start, group]
                    at = np.nonzero((fit.level <= low) | (fit.level >= high))[0]
                    same = [np.full(len(at), x) for x in (start, of, group)]
                    columns = [*same, at, same[2], at, fit.level[at], fit.weight[at]]
                    yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names=names)

    return run


def _merged(frame: pd.DataFrame) -> pd.DataFrame:
    """Neighbouring blocks pooled."""
    frame = frame.sort_values(["grp", "at"])
    level, weight, sizes = pooled(frame["level"].to_numpy(), frame["weight"].to_numpy())
    last = np.cumsum(sizes) - 1
    first = last - sizes + 1
    out = frame.iloc[first].copy()
    out["last_grp"], out["until"] = frame["last_grp"].to_numpy()[last], frame["until"].to_numpy()[last]
    out["level"], out["weight"] = level, weight
    return out


def random_start(names: list[str], start: int) -> np.ndarray:
    """Coordinates in (-0.5, 0.5) that depend on the site names and the start only."""
    def coordinate(name: str, axis: int) -> float:
        return int(hashlib.md5(f"{name}|{axis}|{start}".encode()).hexdigest()[:8], 16) / 16.0**8 - 0.5

    return np.array([[coordinate(s, 1), coordinate(s, 2)] for s in names])


def classical_start(ranges: Ranges, rounds: int = 12) -> np.ndarray:
    """About the two leading axes of classical scaling, by subspace iteration over the pairs.

    Double centring needs no matrix: for a centred vector v it is the centred product of the squared
    dissimilarities with v, times -1/2.  It is only where a start begins, so its rounds are few.
    """
    spark, n = ranges.held.sparkSession, len(ranges.names)
    axes = random_start(ranges.names, 0)
    for number in range(rounds + 1):
        axes = axes - axes.mean(axis=0)
        axes = np.linalg.qr(axes)[0]
        shared = spark.sparkContext.broadcast(axes)
        rows = ranges.held.mapInArrow(_squares(shared, n), "site int, x double, y double")
        frame = rows.groupBy("site").agg(F.sum("x").alias("x"), F.sum("y").alias("y")).toPandas().sort_values("site")
        shared.destroy()
        image = -0.5 * frame[["x", "y"]].to_numpy()
        image = image - image.mean(axis=0)
        if number < rounds:
            axes = image
    small = axes.T @ image
    values, turn = np.linalg.eigh((small + small.T) / 2)
    return (axes @ turn * np.sqrt(np.abs(values)))[:, ::-1]


def _squares(axes, n: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        xy, out = axes.value, np.zeros((n, 2))
        for batch in batches:
            for _, i, j, d in _unpacked(batch):
                for k in (0, 1):
                    out[:, k] += np.bincount(i, d * d * xy[j, k], n) + np.bincount(j, d * d * xy[i, k], n)
        arrays = [pa.array(np.arange(n), pa.int32()), pa.array(out[:, 0]), pa.array(out[:, 1])]
        yield pa.RecordBatch.from_arrays(arrays, names=["site", "x", "y"])

    return run


Steps = Generator[np.ndarray, tuple[float, np.ndarray], tuple[np.ndarray, float, int, bool]]


def descent(points: np.ndarray, tolerance: float, memory: int = 8, quiet: int = 3) -> Steps:
    """Asks for stress and gradient at a configuration, and ends with the best one found.

    It has converged once ``quiet`` steps in a row gained less than ``tolerance`` relative, or no
    step along the gradient gains anything.
    """
    x = points
    stress, slope = yield x
    rounds, silent = 1, 0
    held: list[tuple[np.ndarray, np.ndarray]] = []
    while stress > 0 and (slope * slope).sum() > 0:
        way, parts = slope.copy(), []
        for s, y in reversed(held):
            a = (way * s).sum() / (y * s).sum()
            way -= a * y
            parts.append(a)
        if held:
            s, y = held[-1]
            way *= (s * y).sum() / (y * y).sum()
        else:
            way *= 0.1 * np.sqrt((x * x).sum() / (way * way).sum())
        for (s, y), a in zip(held, reversed(parts)):
            way += s * (a - (y * way).sum() / (y * s).sum())
        length, down = 1.0, (slope * way).sum()
        while True:
            new = x - length * way
            found, turned = yield new
            rounds += 1
            if found <= stress - 1e-4 * length * down or length < 1e-4:
                break
            length /= 2
        if found >= stress:
            if not held:
                break
            # The remembered curvature misleads: go on along the gradient alone.
            held = []
            continue
        move, change = new - x, turned - slope
        if (move * change).sum() > 1e-14:
            held = [*held, (move, change)][-memory:]
        silent = silent + 1 if stress - found < tolerance * stress else 0
        x, stress, slope = new, found, turned
        if silent >= quiet:
            break
    return x, stress, rounds, True


def residual(a: np.ndarray, b: np.ndarray) -> float:
    """Share of the sum of squares left when ``b`` is moved, turned, mirrored and scaled onto ``a``."""
    a, b = a - a.mean(axis=0), b - b.mean(axis=0)
    size = (a * a).sum() * (b * b).sum()
    if not size:
        return 0.0
    return float(max(1 - np.linalg.svd(a.T @ b, compute_uv=False).sum() ** 2 / size, 0.0))


def principal_axes(points: np.ndarray) -> np.ndarray:
    """Centred, turned so that axis 1 varies most, each axis with its largest score positive."""
    points = points - points.mean(axis=0)
    _, turn = np.linalg.eigh(points.T @ points)
    points = points @ turn[:, ::-1]
    top = points[np.abs(points).argmax(axis=0), [0, 1]]
    return points * np.where(top < 0, -1.0, 1.0)


def half_change(pairs: DataFrame, scores: DataFrame, threshold: float = 0.8) -> tuple[float | None, float | None]:
    """Unit of half change, and the dissimilarity of sites at one place.

    Dissimilarity is regressed on the distance of the configuration over the pairs below
    ``threshold``, above which it saturates.  Its value at distance 0 is that of replicates; one unit
    is the distance over which the similarity that replicates have falls to a half.  Missing where
    there is no rising line.
    """
    placed = with_distances(pairs, scores).where(F.col("d") < threshold)
    cell = placed.agg(F.regr_slope("d", "dist").alias("slope"), F.regr_intercept("d", "dist").alias("zero")).first()
    if cell["slope"] is None or not cell["slope"] > 0 or not cell["zero"] < 1:
        return None, None
    return (1 - cell["zero"]) / 2 / cell["slope"], cell["zero"]


def with_distances(pairs: DataFrame, scores: DataFrame) -> DataFrame:
    """``site_i``, ``site_j``, ``d`` and ``dist``, the distance of the configuration."""
    ends = scores.select("site", "axis1", "axis2")
    left = ends.toDF("site_i", "x_i", "y_i")
    right = ends.toDF("site_j", "x_j", "y_j")
    joined = pairs.where("d IS NOT NULL").join(left, "site_i").join(right, "site_j")
    return joined.select("site_i", "site_j", "d", F.hypot(F.expr("x_i - x_j"), F.expr("y_i - y_j")).alias("dist"))


def monotone_fit(pairs: DataFrame, scores: DataFrame, pairs_a_range: int = PAIRS_A_RANGE) -> DataFrame:
    """``site_i``, ``site_j``, ``d``, ``dist`` and ``h``: distances of the configuration and their
    monotone fit on the dissimilarities."""
    ranges = sorted_ranges(pairs, pairs_a_range)
    at = {r["site"]: (r["axis1"], r["axis2"]) for r in scores.collect()}
    return Stress(ranges).fitted(np.array([at[s] for s in ranges.names]))


def nmds(
    pairs: DataFrame,
    *,
    most_starts: int = 20,
    batch: int = 8,
    tolerance: float = 1e-5,
    pairs_a_range: int = PAIRS_A_RANGE,
    threshold: float = 0.8,
) -> tuple[DataFrame, DataFrame]:
    """``(site, axis1, axis2)`` of the best start in units of half change, and the trace of all starts.

    Start 0 begins at classical scaling, the others at random.  The trace has a row per start:
    rounds (stress values asked for), stress, whether it converged, its Procrustes residual to the
    best configuration, and whether the two best agree, which ends the search before ``most_starts``.
    Without a unit of half change (see ``half_change``) scores keep the size at which they ended.
    """
    spark = pairs.sparkSession
    ranges = sorted_ranges(pairs, pairs_a_range)
    if len(ranges.names) < 3:
        scores = spark.createDataFrame([(s, None, None) for s in ranges.names], "site string, axis1 double, axis2 double")
        return scores, spark.createDataFrame([], TRACE)
    stress = Stress(ranges)
    ended: dict[int, tuple[np.ndarray, float, int, bool]] = {}
    apart, agrees = math.inf, False
    while len(ended) < most_starts and not agrees:
        numbers = range(len(ended), min(len(ended) + batch, most_starts))
        begin = {s: random_start(ranges.names, s) if s else classical_start(ranges) for s in numbers}
        if ranges.single:
            ended.update(stress.descents(begin, tolerance))
            begin = {}
        going = {s: descent(x, tolerance) for s, x in begin.items()}
        asked = {s: next(steps) for s, steps in going.items()}
        while asked:
            value, slope = stress(asked)
            for s in list(asked):
                try:
                    asked[s] = going[s].send((value[s], slope[s]))
                except StopIteration as end:
                    ended[s] = end.value
                    del asked[s]
        order = sorted(ended, key=lambda s: (ended[s][1], s))
        if len(order) > 1:
            apart = residual(ended[order[0]][0], ended[order[1]][0])
            agrees = apart < AGREE
    best = min(ended, key=lambda s: (ended[s][1], s))
    points = principal_axes(ended[best][0])
    rows = [(s, float(x), float(y)) for s, (x, y) in zip(ranges.names, points)]
    scores = spark.createDataFrame(rows, "site string, axis1 double, axis2 double")
    unit, _ = half_change(pairs, scores, threshold)
    if unit:
        scores = scores.select("site", *[(F.col(c) / unit).alias(c) for c in ("axis1", "axis2")])
    trace = [
        (s, rounds, float(value), done, residual(ended[best][0], x), agrees) for s, (x, value, rounds, done) in sorted(ended.items())
    ]
    return scores, spark.createDataFrame(trace, TRACE)
