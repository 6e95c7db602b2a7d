"""Headline queries, timed end to end; prints one JSON line."""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from lakesight.plans.catalog import catalog

HEADLINE = [
    "sales_by_brand", "store_performance", "feedback_by_brand", "top_models", "sales_totals", "biggest_region",
    "monthly_brand_sales", "consistently_negative_stores", "sales_rows", "csv_load", "last_write_wins", "upsert_lines",
    "full_row_edits", "order_page", "analytics_snapshot", "primary_results", "query_outcomes", "chained_sql",
    "agent_metrics", "failure_streaks", "event_text_answers", "log_times", "tool_calls", "transcripts",
    "document_sections", "renumbered_documents", "message_tree_order", "resource_buckets", "deletion_order",
    "semantic_search", "filtered_search", "label_neighbours", "text_vectors", "benchmark_neighbours",
    "statement_guard_words", "sql_inner_join", "sql_theta_join", "sql_percentiles", "sql_window_ranks",
    "stream_query_states", "stream_closed_queries", "stream_agent_metrics", "stream_refresh",
]


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("lakesight-bench")
        .config("spark.driver.memory", "16g").config("spark.ui.enabled", "false")
        .config("spark.checkpoint.dir", os.environ.get("BENCH_SHARED_DIR") or tempfile.mkdtemp(prefix="lakesight-bench-"))
        .config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    operators = catalog()
    # Start the JVM, the code cache and a Python worker before the clock runs.
    operators.run("sales_by_brand", spark, folder).write.format("noop").mode("overwrite").save()
    operators.run("label_neighbours", spark, folder).write.format("noop").mode("overwrite").save()

    seconds = {}
    for name in HEADLINE:
        start = time.perf_counter()
        operators.run(name, spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
