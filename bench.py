"""Time the headline queries: prints one JSON line with seconds per query."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from epispan.registry import load_all  # noqa: E402

HEADLINE = (
    "event_counts",
    "experiment_grid",
    "hot_deck_sample",
    "build_person_dates",
    "asof_latest_visit",
    "asof_from_wide",
    "code_count_lookback",
    "attach_features",
    "map_codes",
    "collect_code_arrays",
    "merge_covariates",
    "time_grid",
    "aalen_johansen",
    "stratified_folds",
    "hte_quantile_groups",
    "exact_quantiles",
    "standardized_differences",
    "nearest_neighbor_match",
    "rolling_rate",
    "c_harrell",
    "c_antolini",
    "auc_over_time",
    "integrated_brier",
    "influence_values",
    "estimates",
    "propensity_scores",
    "cross_fit",
    "tmle_estimates",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus if cpus.isdigit() else "8")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "8g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    entries = load_all()
    chosen = sys.argv[1:] or HEADLINE
    spark.read.parquet(f"{sf_dir}/orders.parquet").groupBy("o_orderstatus").count().collect()
    seconds = {}
    for name in chosen:
        start = time.perf_counter()
        entries[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
        print(name, seconds[name], file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline_queries_total",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
