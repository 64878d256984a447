"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Every query runs to completion into Spark's no-op sink, so that all columns of
all rows are computed but nothing is moved to Python.
"""

from __future__ import annotations

import json
import os
import time

from smeltry.catalog import all_queries
from smeltry.session import builder

HEADLINE = [
    "sales_performance", "campaign_effectiveness", "customer_segmentation", "feature_table",
    "scd2_apply", "silver_sales", "silver_user_events", "temporal_join_current",
    "temporal_join_history", "late_repair", "upsert", "parse_user_events", "delay_histogram",
    "session_activity", "validate_bronze_layer", "expectation_suite", "hybrid_rollup",
    "scd_integrity", "cross_layer_reconciliation", "profile_table", "profile_numeric",
    "price_rank_in_category", "latest_by_business_key", "correlations", "flag_outliers",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        builder("bench", "local").master(f"local[{cpus}]")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "16g"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    registered = all_queries()
    wanted = os.environ.get("BENCH_QUERIES")
    names = list(registered) if wanted == "all" else (wanted.split(",") if wanted else HEADLINE)
    times = {}
    for name in names:
        # An untimed pass of each query, so that no figure holds start-up or compilation.
        for _ in range(2):
            start = time.perf_counter()
            registered[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            times[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    print(
        json.dumps(
            {
                "metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec",
                "queries": times, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )


if __name__ == "__main__":
    main()
