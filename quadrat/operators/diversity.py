"""Richness and evenness of communities held in long form."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def community_structure(df: DataFrame, site: str | Sequence[str], abundance: str) -> DataFrame:
    """Richness and Evar (Smith and Wilson 1996) per site.

    Each row with an abundance other than 0 counts as one taxon.  Rows without
    an abundance are dropped first, so a site with none left does not appear.
    Evar = 1 - 2/pi * atan(population variance of ln abundance); it is missing
    with fewer than two taxa.
    """
    sites = [site] if isinstance(site, str) else list(site)
    a = F.col(abundance)
    spread = F.var_pop(F.when(a > 0, F.ln(a)))
    defined = (F.col("richness") > 1) & (F.col("__lowest") >= 0)
    return (
        df.where(a.isNotNull())
        .groupBy(*sites)
        .agg(
            F.count(F.when(a != 0, 1)).alias("richness"),
            F.min(a).alias("__lowest"),
            spread.alias("__spread"),
        )
        .select(
            *sites,
            "richness",
            F.when(defined, 1 - 2 / F.pi() * F.atan("__spread")).alias("evar"),
        )
    )
