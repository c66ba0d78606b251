"""Reproducible permutations of sites.

Permutation ``p`` orders the sites by md5 of ``p|site``; the site at rank r takes
the label of the site at rank r of permutation 0.  The order depends on names
only, so results repeat exactly on any cluster and can be checked in plain SQL.
"""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F


def permuted_sites(sites: DataFrame, site: str, permutations: int) -> DataFrame:
    """Rows ``(p, site, source)``, p = 1..permutations: ``site`` takes ``source``'s label.

    Each window partition is one permutation, so permutations are spread over
    tasks and none holds more than the n sites whose n(n-1)/2 pairs were
    computed before.
    """
    order = W.partitionBy("p").orderBy(
        F.md5(F.concat_ws("|", F.col("p").cast("string"), F.col("site")).cast("binary")), "site"
    )
    ranked = (
        sites.select(F.col(site).alias("site"))
        .withColumn("p", F.explode(F.sequence(F.lit(0), F.lit(permutations))))
        .withColumn("r", F.row_number().over(order))
    )
    base = ranked.where("p = 0").select("r", F.col("site").alias("source"))
    return ranked.where("p > 0").join(base, "r").select("p", "site", "source")
