"""Time the headline queries; prints a JSON line with all figures so far after each query, so the last line is the result.

``BENCH_SF_DIR`` names the tables (default /root/testdata/sf0.1), ``BENCH_CPUS``
the local cores. Besides the registered queries there is one sweep with the full
forest (100 trees), reported per seed.
"""

from __future__ import annotations

from collections.abc import Callable
import json
import os
import re
import time

from pyspark.sql import SparkSession

from steadyseed.operators import sweep
from steadyseed.plans import fixtures as fx
from steadyseed.plans.queries import PRICES, REGISTRY

HEADLINE = [
    "column_profile_orders", "distinct_counts", "categorical_suggestions_all_rules", "class_distribution",
    "numeric_target_statistics_orders", "target_histogram", "one_hot_encode", "encode_features", "impute_mean",
    "impute_iterative_linear", "adasyn", "neighbour_shares_embeddings", "neighbour_shares_lineitem", "assign_split", "assign_split_stratified",
    "baseline_sweep_orders", "seed_sweep_orders", "index_target_names", "all_classification_metrics", "summarize_mae", "rank_leaderboard",
    "mean_error_stability", "compare_models_line", "compare_models_discriminants", "forest_sweep_stump",
]
# After the full forest, those that take longest last.
SLOW = [
    "forest_sweep_classification", "forest_sweep_regression", "run_analysis", "impute_iterative_forest", "compare_models_regression",
    "compare_models_classification",
]
FULL_FOREST_SEEDS = [1, 2, 3, 4]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("steadyseed-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC").config("spark.driver.memory", "16g").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    REGISTRY["row_and_column_counts"].run(spark, sf_dir).collect()  # starts the session, not timed
    timings: dict[str, float] = {}
    scale = re.search(r"sf([0-9.]+)", sf_dir)
    more: dict[str, float] = {}

    def timed(name: str, work: Callable[[], None]) -> None:
        started = time.monotonic()
        work()
        timings[name] = round(time.monotonic() - started, 3)
        print(json.dumps({
            "metric": "total_query_seconds", "value": round(sum(timings.values()), 3), "unit": "sec", "queries": timings,
            "sf": float(scale.group(1)) if scale else None, **more,
        }), flush=True)

    def query(name: str) -> None:
        timed(name, lambda: REGISTRY[name].run(spark, sf_dir).write.format("noop").mode("overwrite").save())

    for name in HEADLINE:
        query(name)
    rows = fx.big(spark, sf_dir)
    more["full_forest_rows"] = rows.count()
    timed("full_forest_sweep", lambda: sweep.seed_sweep(rows, "row_id", PRICES, "label", "classification", FULL_FOREST_SEEDS, trees=100).collect())
    more["full_forest_seconds_per_seed"] = round(timings["full_forest_sweep"] / len(FULL_FOREST_SEEDS), 3)
    for name in SLOW:
        query(name)


if __name__ == "__main__":
    main()
