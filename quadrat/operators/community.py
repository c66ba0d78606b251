"""PERMANOVA and multivariate dispersion on a table of site pairs.

Both tests need only sums over pairs, so no matrix is ever assembled:

* PERMANOVA: SST = sum(d^2)/N and SSW = sum over groups of sum(d^2 within)/n_g.
* Dispersion: the squared distance of a site to its group centroid in
  principal-coordinate space is  mean_j d_ij^2 - sum_{j<k} d_jk^2 / n_g^2.

``pairs`` has ``(site_i, site_j, d)``, each pair once.  ``labels`` has
``(factor, site, label)``, so several factors are tested in one pass.
"""

from __future__ import annotations

import hashlib
import math
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from quadrat.operators.permutation import permuted_sites
from quadrat.session import materialise

TOLERANCE = math.sqrt(2.0**-52)  # fixed value: slack when comparing permuted F with observed F
TILE = 256  # sites of a tile; a task holds the pairs of two tiles at most


def site_labels(sites: DataFrame, site: str, factors: list[str]) -> DataFrame:
    """Long label table ``(factor, site, label)``; a missing label is its own value."""
    columns = [F.coalesce(F.col(f).cast("string"), F.lit("NA")).alias(f) for f in factors]
    return sites.select(F.col(site).cast("string").alias("site"), *columns).unpivot(
        ["site"], factors, "factor", "label"
    )


def _group_sizes(labels: DataFrame) -> DataFrame:
    return labels.groupBy("factor", "label").agg(F.count(F.lit(1)).alias("size"))


def _design(labels: DataFrame) -> DataFrame:
    """Sites n and groups k of each factor."""
    return (
        _group_sizes(labels)
        .groupBy("factor")
        .agg(F.sum("size").alias("n"), F.count(F.lit(1)).alias("k"))
    )


def _total_squares(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(factor, n, k, ss_total)``."""
    squares = pairs.select(F.sum(F.col("d") * F.col("d"))).scalar()
    return _design(labels).select("factor", "n", "k", (squares / F.col("n")).alias("ss_total"))


def _f_ratio(ss_within: str) -> Column:
    # Undefined, hence missing, for a factor with one label.
    between = F.try_divide(F.col("ss_total") - F.col(ss_within), F.col("k") - 1)
    return F.try_divide(between, F.col(ss_within) / (F.col("n") - F.col("k")))


def _within(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """``(factor, ss_within)``: pairs inside a group, each weighted by 1/n_g."""
    left = labels.withColumnsRenamed({"site": "site_i"})
    right = labels.withColumnsRenamed({"site": "site_j"})
    inside = pairs.join(left, "site_i").join(right, ["factor", "label", "site_j"])
    sums = inside.groupBy("factor", "label").agg(F.sum(F.col("d") * F.col("d")).alias("__d2"))
    return (
        sums.join(_group_sizes(labels), ["factor", "label"])
        .groupBy("factor")
        .agg(F.sum(F.col("__d2") / F.col("size")).alias("ss_within"))
    )


def permanova(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """One row per factor: df, sums of squares, pseudo-F and R2."""
    fit = _total_squares(pairs, labels).join(_within(pairs, labels), "factor")
    return fit.select(
        "factor",
        "n",
        (F.col("k") - 1).alias("df_between"),
        (F.col("n") - F.col("k")).alias("df_within"),
        (F.col("ss_total") - F.col("ss_within")).alias("ss_between"),
        "ss_within",
        "ss_total",
        _f_ratio("ss_within").alias("pseudo_f"),
        (1 - F.col("ss_within") / F.col("ss_total")).alias("r2"),
    )


class _Sites:
    """Site names in order, their label codes by factor, and the weight of each code.

    It goes to every task: n names and codes, where the pairs hold n(n-1)/2 rows.
    """

    def __init__(self, labels: DataFrame):
        rows = labels.select("factor", "site", "label").collect()
        self.names = sorted({r["site"] for r in rows})
        self.factors = sorted({r["factor"] for r in rows})
        number = {s: i for i, s in enumerate(self.names)}
        # Code -1, a site without the factor, weighs nothing.
        self.codes = np.full((len(self.factors), len(self.names)), -1, dtype=np.int32)
        self.weights: list[np.ndarray] = []
        for f, factor in enumerate(self.factors):
            own = [(number[r["site"]], r["label"]) for r in rows if r["factor"] == factor]
            known = {v: c for c, v in enumerate(sorted({v for _, v in own}))}
            for site, label in own:
                self.codes[f, site] = known[label]
            sizes = np.bincount(self.codes[f][self.codes[f] >= 0], minlength=len(known))
            self.weights.append(np.append(1 / sizes, 0.0))

    def order(self, number: int) -> np.ndarray:
        """The sites in the order of permutation ``number``; see ``permutation``."""
        keys = [hashlib.md5(f"{number}|{s}".encode()).hexdigest() for s in self.names]
        return np.array(sorted(range(len(keys)), key=lambda i: (keys[i], self.names[i])))


CODES = "row int, col int, high boolean, p int, factor int, codes array<int>"
TILED = "row int, col int, i int, j int, d2 double"


def _permuting(shared, tiles: int, tile: int):
    """Label codes of each permutation, cut into tiles of sites and copied to the cells of a tile."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sites = shared.value
        base = sites.order(0)
        for batch in batches:
            for number in batch.column("id").to_pylist():
                codes = np.empty_like(sites.codes)
                codes[:, sites.order(number)] = sites.codes[:, base]
                rows = [
                    (min(t, other), max(t, other), high, number, f, codes[f, t * tile : (t + 1) * tile])
                    for t in range(tiles) for other in range(tiles) for f in range(len(codes))
                    # Below its own tile a tile is the high side of a cell, above it the low one.
                    for high in ((False, True) if other == t else (other < t,))
                ]
                kinds = [pa.int32(), pa.int32(), pa.bool_(), pa.int32(), pa.int32(), pa.list_(pa.int32())]
                yield pa.RecordBatch.from_arrays(
                    [pa.array(c, k) for c, k in zip(zip(*rows), kinds)], names=["row", "col", "high", "p", "factor", "codes"]
                )

    return run


def _tiled(shared, tile: int):
    """Pairs with numbered sites and the cell of their tiles; the smaller site is the row."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = pa.array(shared.value.names, pa.string())
        for batch in batches:
            ends = [pc.index_in(batch.column(c), names) for c in ("site_i", "site_j")]
            known = pc.and_(ends[0].is_valid(), ends[1].is_valid())
            one, two = (x.filter(known).to_numpy() for x in ends)
            i, j = np.minimum(one, two), np.maximum(one, two)
            d = batch.column("d").filter(known).to_numpy(zero_copy_only=False)
            columns = [i // tile, j // tile, i % tile, j % tile]
            yield pa.RecordBatch.from_arrays(
                [*[pa.array(c.astype(np.int32)) for c in columns], pa.array(d * d)], names=["row", "col", "i", "j", "d2"]
            )

    return run


def _summing(shared, permutations: int, chunk: int = 1024):
    """Of one cell: by factor and permutation, d^2 within groups, each weighted by 1/n_g."""

    def run(pairs: pa.Table, codes: pa.Table) -> pa.Table:
        i, j, d2 = (pairs.column(c).to_numpy() for c in ("i", "j", "d2"))
        high, p, factor = (codes.column(c).to_numpy() for c in ("high", "p", "factor"))
        held = codes.column("codes").combine_chunks()
        values, ends = held.flatten().to_numpy(), np.cumsum(held.value_lengths().to_numpy())
        out: list[tuple] = []
        for f, weights in enumerate(shared.value.weights if len(i) else []):
            sides = []
            for side in (False, True):
                rows = np.nonzero((factor == f) & (high == side))[0]
                rows = rows[np.argsort(p[rows])]
                width = len(values[ends[rows[0]] - len(held[int(rows[0])]) : ends[rows[0]]])
                sides.append(values[(ends[rows] - width)[:, None] + np.arange(width)])
            sums = np.zeros(permutations)
            for at in range(0, len(i), chunk):
                a, b = sides[0][:, i[at : at + chunk]], sides[1][:, j[at : at + chunk]]
                sums += np.where(a == b, weights[a], 0.0) @ d2[at : at + chunk]
            out += [(f, n + 1, float(v)) for n, v in enumerate(sums)]
        columns = list(zip(*out)) or [(), (), ()]
        return pa.table({"f": pa.array(columns[0], pa.int32()), "p": pa.array(columns[1], pa.int32()),
                         "part": pa.array(columns[2], pa.float64())})

    return run


def _permuted_within(pairs: DataFrame, labels: DataFrame, permutations: int, tile: int) -> DataFrame:
    """``(factor, p, ss_within)`` for every permutation.

    Sites are cut into tiles.  A cell holds the pairs of two tiles and both tiles' label codes under
    all permutations, and gives one sum per factor and permutation.
    """
    spark = pairs.sparkSession
    sites = _Sites(labels)
    shared = spark.sparkContext.broadcast(sites)
    tiles = max(1, -(-len(sites.names) // tile))
    numbers = spark.range(1, permutations + 1, numPartitions=min(permutations, 4 * spark.sparkContext.defaultParallelism))
    codes = numbers.mapInArrow(_permuting(shared, tiles, tile), CODES)
    known = pairs.where("d IS NOT NULL").select("site_i", "site_j", F.col("d").cast("double").alias("d"))
    cells = known.mapInArrow(_tiled(shared, tile), TILED).groupBy("row", "col")
    sums = cells.cogroup(codes.groupBy("row", "col")).applyInArrow(
        _summing(shared, permutations), "f int, p int, part double"
    )
    factors = spark.createDataFrame(list(enumerate(sites.factors)), "f int, factor string")
    total = sums.groupBy("f", "p").agg(F.sum("part").alias("ss_within"))
    return total.join(F.broadcast(factors), "f").select("factor", "p", "ss_within")


def permanova_test(
    pairs: DataFrame, labels: DataFrame, permutations: int = 999, tile: int = TILE
) -> DataFrame:
    """PERMANOVA with a permutation p-value per factor.

    p = (permutations with F >= observed F, plus 1) / (permutations + 1); missing where F is.
    ``tile`` bounds the sites one task sees; it does not change the result.
    """
    observed = permanova(pairs, labels)
    permuted = _permuted_within(pairs, labels, permutations, tile)
    ratios = (
        permuted.join(_total_squares(pairs, labels), "factor")
        .select("factor", _f_ratio("ss_within").alias("f_perm"))
        .join(observed.select("factor", "pseudo_f"), "factor")
    )
    exceed = ratios.groupBy("factor").agg(
        F.count_if(F.col("f_perm") >= F.col("pseudo_f") - TOLERANCE).alias("exceed")
    )
    return observed.join(exceed, "factor").select(
        *observed.columns,
        F.lit(permutations).alias("permutations"),
        F.when(F.col("pseudo_f").isNotNull(), (F.col("exceed") + 1) / (permutations + 1)).alias("p_value"),
    )


def dispersion(pairs: DataFrame, labels: DataFrame) -> DataFrame:
    """Distance ``z`` of each site to its group centroid: ``(factor, label, site, z)``.

    The closed form equals the principal-coordinate one, negative eigenvalues
    included, which is why the square root is of the absolute value.
    """
    left = labels.withColumnsRenamed({"site": "site_i"})
    right = labels.withColumnsRenamed({"site": "site_j"})
    inside = (
        pairs.join(left, "site_i")
        .join(right, ["factor", "label", "site_j"])
        .select("factor", "label", "site_i", "site_j", (F.col("d") * F.col("d")).alias("d2"))
    )
    per_site = (
        inside.unpivot(["factor", "label", "d2"], ["site_i", "site_j"], "__end", "site")
        .groupBy("factor", "label", "site")
        .agg(F.sum("d2").alias("to_members"))
    )
    # A pair reaches both its sites, so the group's pair sum is half of this.
    per_group = per_site.groupBy("factor", "label").agg(
        (F.sum("to_members") / 2).alias("inside")
    )
    return (
        labels.join(_group_sizes(labels), ["factor", "label"])
        .join(per_site, ["factor", "label", "site"], "left")
        .join(per_group, ["factor", "label"], "left")
        .select(
            "factor",
            "label",
            "site",
            F.sqrt(
                F.abs(
                    F.coalesce(F.col("to_members"), F.lit(0.0)) / F.col("size")
                    - F.coalesce(F.col("inside"), F.lit(0.0)) / (F.col("size") * F.col("size"))
                )
            ).alias("z"),
        )
    )


def group_dispersion(distances: DataFrame) -> DataFrame:
    """Mean distance to centroid per group."""
    return distances.groupBy("factor", "label").agg(
        F.count(F.lit(1)).alias("n"), F.avg("z").alias("mean_z")
    )


def dispersion_test(distances: DataFrame, permutations: int = 999) -> DataFrame:
    """Permutation test of equal dispersion: one-way F on z, residuals permuted."""
    groups = distances.groupBy("factor", "label").agg(
        F.count(F.lit(1)).alias("size"), F.avg("z").alias("mean_z")
    )
    residuals = distances.join(groups, ["factor", "label"]).withColumn(
        "e", F.col("z") - F.col("mean_z")
    )
    overall = residuals.groupBy("factor").agg(
        F.count(F.lit(1)).alias("n"),
        F.count_distinct("label").alias("k"),
        F.avg("z").alias("grand"),
        F.sum(F.col("e") * F.col("e")).alias("ss_within"),
        F.avg("e").alias("mean_e"),
    )
    between = (
        groups.join(overall, "factor")
        .groupBy("factor")
        .agg(
            F.sum(F.col("size") * F.pow(F.col("mean_z") - F.col("grand"), 2)).alias("ss_between")
        )
    )
    df_between, df_within = F.col("k") - 1, F.col("n") - F.col("k")
    observed = overall.join(between, "factor").select(
        "factor",
        df_between.alias("df_between"),
        df_within.alias("df_within"),
        "ss_between",
        "ss_within",
        F.try_divide(F.col("ss_between") / df_between, F.col("ss_within") / df_within).alias("f"),
    )
    moved = permuted_sites(distances.select("site").distinct(), "site", permutations)
    # The permuted residual sits in the receiving site's group.
    placed = (
        moved.join(residuals.select(F.col("site").alias("source"), "factor", "e"), "source")
        .join(residuals.select("site", "factor", "label"), ["site", "factor"])
        .groupBy("factor", "p", "label")
        .agg(F.sum("e").alias("s1"), F.count(F.lit(1)).alias("size"))
    )
    squares = placed.groupBy("factor", "p").agg(
        F.sum(F.col("s1") * F.col("s1") / F.col("size")).alias("explained")
    )
    perm_between = F.col("explained") - F.col("n") * F.col("mean_e") * F.col("mean_e")
    perm_within = F.col("ss_within") - F.col("explained")
    f_perm = F.try_divide(perm_between / df_between, perm_within / df_within)
    exceed = (
        squares.join(overall, "factor")
        .select("factor", f_perm.alias("f_perm"))
        .join(observed.select("factor", "f"), "factor")
        .groupBy("factor")
        .agg(F.count_if(F.col("f_perm") >= F.col("f") - TOLERANCE).alias("exceed"))
    )
    return observed.join(exceed, "factor").select(
        *observed.columns,
        F.lit(permutations).alias("permutations"),
        ((F.col("exceed") + 1) / (permutations + 1)).alias("p_value"),
    )
