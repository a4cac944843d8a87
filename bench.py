"""Time the headline queries and print one JSON line.

``BENCH_SF_DIR`` names the tables (default sf0.1), ``BENCH_CPUS`` the local cores. Every query is evaluated in full
into a sink that discards the rows. One small query runs first, so that no query pays for the start of the engine.
"""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from pyspark.sql import SparkSession  # noqa: E402

from pairlens.catalog import QUERIES  # noqa: E402

HEADLINE = (
    "condition_summary", "common_valid_summary", "pair_join", "paired_contrast", "paired_bootstrap_ci",
    "ablation_contrast", "interaction_contrast", "normalize_responses", "integrity_profile", "metadata_drift",
    "reference_drift", "frame_intersection", "repeated_sample", "repeated_aggregate", "terciles", "stratum_metrics",
    "percentile_linear", "near_far_groups", "label_summary", "level_metrics", "step_trajectory", "prior_history",
    "flip_from_previous", "answer_extract", "answer_extract_documents", "jaccard", "semantic_profile_lexical",
    "req_stepwise", "msg_collapse", "response_ingest", "src_jsonl_strict", "stream_responses",
)


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("pairlens-bench")
        .config("spark.sql.shuffle.partitions", cpus).config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false").config("spark.sql.session.timeZone", "UTC")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.execution.arrow.pyspark.enabled", "true").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    QUERIES["report_order"](spark, folder).collect()
    times = {}
    for name in HEADLINE:
        start = time.perf_counter()
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
        "sf": folder.rstrip("/").rsplit("sf", 1)[-1],
    }))
    spark.stop()


if __name__ == "__main__":
    main()
