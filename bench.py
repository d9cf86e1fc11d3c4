"""Times the headline queries and prints one JSON line.

``BENCH_SF_DIR`` names the tables, ``BENCH_CPUS`` the local cores, ``BENCH_QUERIES`` an
optional comma list. Every query runs ``BENCH_RUNS`` times and its least time counts.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from panelwright.runtime import local_session  # noqa: E402
from workload import QUERIES  # noqa: E402

HEADLINE = (
    "period_change", "stage_9_complete", "dataset_primary", "star_join", "global_zscore",
    "group_max", "policy_expand", "lag_cumulative", "running_means", "describe",
    "percentile_grid", "percentile_grid_ranged", "hist1d", "hist2d", "density_grid",
    "split_keyed", "unpivot_feed", "ols_fit", "ols_score", "r_squared_by_group", "rmspe",
    "brown_forsythe", "qq_pairs", "shapiro", "boxcox_profile", "boxcox_refine", "step_aic",
    "best_subset_cv", "residual_sink", "study_primary",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    runs = int(os.environ.get("BENCH_RUNS", "2"))
    chosen = os.environ.get("BENCH_QUERIES", "")
    names = [n for n in chosen.split(",") if n] or HEADLINE
    spark = local_session(cpus, int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()
    times: dict[str, float] = {}
    for name in names:
        least = float("inf")
        for _ in range(runs):
            start = time.perf_counter()
            QUERIES[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
            least = min(least, time.perf_counter() - start)
        times[name] = round(least, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec",
        "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
