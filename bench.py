"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from tillwise.plans.catalog import QUERIES
from tillwise.staging import configure

FOLDER = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
CPUS = os.environ.get("BENCH_CPUS", "8")
# The first one pays for starting the session; process_datasets pays for the pipeline that
# the queries after it report on.
HEADLINES = (
    "completed_lines", "sales_kpis", "sales_kpis_filtered", "daily_revenue", "weekly_revenue",
    "category_performance", "country_performance", "channel_performance", "product_performance",
    "top_products_by_revenue", "return_reasons", "products_by_return_rate", "orders_enriched",
    "returns_enriched", "target_achievement", "period_comparison", "current_vs_previous",
    "product_velocity", "inventory_metrics", "recommendations", "filter_options",
    "dedupe_keep_first", "dedupe_keep_latest", "parsed_values", "normalized_values",
    "clean_orders", "validate_all", "process_datasets", "all_issues", "excluded_rows",
    "quality_summary", "issue_groups", "issue_export", "report_analytics", "dashboard_kpis",
)


def main() -> None:
    builder = configure(SparkSession.builder.master(f"local[{CPUS}]").appName("bench"))
    spark = (
        builder.config("spark.sql.shuffle.partitions", CPUS)
        .config("spark.driver.memory", "16g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    spark.read.parquet(f"{FOLDER}/nation.parquet").count()
    seconds = {}
    for name in HEADLINES:
        started = time.perf_counter()
        QUERIES[name](spark, FOLDER).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - started, 3)
    print(
        json.dumps(
            {
                "metric": "total_query_seconds",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": FOLDER.rstrip("/").rpartition("sf")[2],
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
