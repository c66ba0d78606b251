"""Time the headline queries and print one JSON line.

Every run starts from the raw tables: shared intermediate tables are dropped
before it.  Each query runs twice and the better time counts, so that JVM warm-up
is not charged to whichever query comes first.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from checks import registry  # noqa: E402
from quadrat.session import local_session  # noqa: E402

HEADLINE = [
    "nb_summary",
    "distinct_traits",
    "richness_evenness",
    "color_area",
    "front_back",
    "layer_richness",
    "floral_bray_curtis",
    "floral_permanova_perm",
    "floral_dispersion_perm",
    "kendall",
    "kendall_ordinal",
    "ols_table",
    "ols_by_group",
    "anova_by_group",
    "missing_value_rules",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session("bench", cores)
    spark.sparkContext.setLogLevel("ERROR")
    queries = registry.queries()

    def run(name: str) -> float:
        registry.forget()
        start = time.perf_counter()
        queries[name](spark, folder).write.format("noop").mode("overwrite").save()
        return round(time.perf_counter() - start, 3)

    times = {name: min(run(name), run(name)) for name in names}
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
