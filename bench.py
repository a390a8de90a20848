"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import statistics
import time

from pyspark.sql import SparkSession

from dqengine import registry

# One or more of every family, the heavy ones first.
HEADLINE = (
    "clean_orders_by_year",
    "profile_columns",
    "top_values",
    "describe_quantiles",
    "snake_case",
    "drop_duplicate_columns",
    "fill_median",
    "fill_mode",
    "fill_by_group",
    "fill_forward",
    "to_numeric",
    "normalize_standard",
    "outliers_iqr",
    "to_datetime",
    "convert_case_title",
    "clean_text_aggressive",
    "remove_duplicates",
    "duplicates_keep_first",
    "fuzzy_duplicates_blocked",
    "aggregate",
    "transform_agg",
    "audit_missing",
    "audit_relations",
    "quality_score",
    "keyword_search",
    "dense_search",
    "hybrid_search",
    "sparse_search_bm25",
    "pack_context",
    "chunk_text",
    "extract_lines",
    "pattern_counts",
    "clean_with_preferences",
)
RUNS = 3


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    names = os.environ.get("BENCH_QUERIES", " ".join(HEADLINE)).split()
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.driver.memory", "16g")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("OFF")
    seconds = {}
    for name in names:
        times = []
        for _ in range(1 + RUNS):
            start = time.perf_counter()
            # building the query is timed too: some operators run a small job for their statistics
            registry.QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
            times.append(time.perf_counter() - start)
        seconds[name] = round(statistics.median(times[1:]), 3)
    print(
        json.dumps(
            {
                "metric": "total seconds of the headline queries, median of 3 after a warm-up",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
