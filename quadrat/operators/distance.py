"""Bray-Curtis dissimilarity of all site pairs, by tiles of the site grid.

A self-join on taxon would emit every pair of sites sharing a taxon, once per
shared taxon, and a taxon found everywhere would land in one task.  Instead the
site x site grid is cut into square tiles and the taxa into strips.  Each
abundance row is copied to the tiles its site belongs to (one copy per row of
tiles), and a task sees one (tile, strip): at most ``2 * tile`` sites, in
expectation, and one strip of taxa.  It returns one number per pair, and the
strips of a pair are added up.  Only the n(n-1)/2 pairs, which are the result,
are ever emitted.
"""

from __future__ import annotations

import math

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F


MISSING = "\0missing"


def _tile_minima(block: pd.DataFrame) -> pd.DataFrame:
    """For the tile's pairs, sum over the strip's taxa of the smaller abundance.

    ``totals`` is the sum of both site totals where the block carries them
    (strip 0) and 0 elsewhere.
    """
    low, high = int(block["tile_low"].iat[0]), int(block["tile_high"].iat[0])
    taxa, column = np.unique(block["taxon"].to_numpy(), return_inverse=True)
    tables = {}
    for side in {low, high}:
        rows = block["tile"].to_numpy() == side
        names, index = np.unique(block["site"].to_numpy()[rows], return_inverse=True)
        table, totals = np.zeros((len(names), len(taxa))), np.zeros(len(names))
        np.add.at(table, (index, column[rows]), block["abundance"].to_numpy()[rows])
        np.add.at(totals, index, block["total"].to_numpy()[rows])
        tables[side] = names, table, totals
    (left, a, total_a), (right, b, total_b) = tables[low], tables[high]
    parts = []
    for i, name in enumerate(left):
        rest = slice(i + 1, None) if low == high else slice(None)
        others = right[rest]
        swap = others < name
        parts.append(
            pd.DataFrame(
                {
                    "site_i": np.where(swap, others, name),
                    "site_j": np.where(swap, name, others),
                    "shared": np.minimum(a[i], b[rest]).sum(axis=1),
                    "totals": total_a[i] + total_b[rest],
                }
            )
        )
    filled = [part for part in parts if len(part)]
    return pd.concat(filled, ignore_index=True) if filled else _NO_PAIRS


_NO_PAIRS = pd.DataFrame({"site_i": [], "site_j": [], "shared": [], "totals": []}).astype(
    {"site_i": object, "site_j": object}
)


def bray_curtis(
    community: DataFrame,
    site: str,
    taxon: str,
    abundance: str,
    *,
    tile: int = 256,
    strip: int = 4096,
) -> DataFrame:
    """All pairs ``(site_i, site_j, d)`` with ``site_i < site_j``.

    ``community`` is the long table, one row per site and taxon, abundance > 0;
    it is read more than once, so pass a materialised one.  ``tile`` and
    ``strip`` bound the sites and taxa one task sees; they set the cost, not the
    result.  d = 1 - 2 * sum(min) / (total_i + total_j).  A missing taxon is a taxon of its own.
    """
    rows = community.select(
        F.col(site).cast("string").alias("site"),
        F.coalesce(F.col(taxon).cast("string"), F.lit(MISSING)).alias("taxon"),
        F.col(abundance).cast("double").alias("abundance"),
    )
    extent = rows.agg(
        F.approx_count_distinct("site").alias("sites"),
        F.approx_count_distinct("taxon").alias("taxa"),
    ).first()
    tiles = max(1, math.ceil(extent["sites"] / tile))
    strips = max(1, math.ceil(extent["taxa"] / strip))
    # One row per site carries its total into strip 0.  Every pair therefore
    # appears there, with or without a common taxon, and the totals need no join.
    totals = rows.groupBy("site").agg(F.sum("abundance").alias("total")).select(
        "site",
        F.lit("").alias("taxon"),
        F.lit(0.0).alias("abundance"),
        "total",
        F.lit(0).alias("strip"),
    )
    keyed = rows.select(
        "*",
        F.lit(0.0).alias("total"),
        F.pmod(F.xxhash64("taxon"), F.lit(strips)).cast("int").alias("strip"),
    ).unionByName(totals)
    copies = (
        keyed.withColumn("tile", F.pmod(F.xxhash64("site"), F.lit(tiles)).cast("int"))
        .withColumn("other", F.explode(F.sequence(F.lit(0), F.lit(tiles - 1))))
        .withColumn("tile_low", F.least("tile", "other"))
        .withColumn("tile_high", F.greatest("tile", "other"))
        .drop("other")
    )
    pairs = copies.groupBy("tile_low", "tile_high", "strip").applyInPandas(
        _tile_minima, "site_i string, site_j string, shared double, totals double"
    )
    if strips > 1:
        pairs = pairs.groupBy("site_i", "site_j").agg(
            F.sum("shared").alias("shared"), F.sum("totals").alias("totals")
        )
    return pairs.select(
        "site_i", "site_j", (1 - F.try_divide(2 * F.col("shared"), F.col("totals"))).alias("d")
    )
