"""Time the headline queries on local[$BENCH_CPUS] and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from catalog import QUERIES  # noqa: E402

HEADLINE = (
    "j1_dataset_build",
    "p6_grounded",
    "p16_prediction_records",
    "p34_json_shape",
    "a17_metrics_by_arm_target",
    "a20_error_rates",
    "a25_scorecard",
    "a29_system_metrics",
    "a33_source_boundary_table",
    "a36_review_scores",
    "b2_b3_paired_bootstrap_grid",
    "b2_large_sample_bootstrap",
    "b5_stratified_sample_by_buckets",
    "b9_tiered_audit_sample",
    "b11_key_sheet",
    "b14_m_annotation_sheet",
    "b16_curated_examples",
    "j7_pilot_vs_main",
    "k1_resumable_rounds",
    "p26_span_location",
    "s6_s7_record_lines",
    "s12_case_documents",
)


def main() -> None:
    cpus = os.environ.get("BENCH_CPUS", "8")
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").appName("bench")
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false")
        .config("spark.python.sql.dataFrameDebugging.enabled", "false")  # no call-site capture per column
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    # start the session and its Python workers before the clock
    scan = spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id").repartition(int(cpus))
    scan.mapInPandas(lambda batches: batches, "doc_id long").count()
    names = [n for n in HEADLINE if not sys.argv[1:] or n in sys.argv[1:]]
    seconds = {}
    for name in names:
        start = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "headline_queries_total", "value": round(sum(seconds.values()), 3), "unit": "sec",
        "queries": seconds, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
