"""Headline queries on one folder of tables; prints one JSON line."""

from __future__ import annotations

import json
import os
import time

from pyspark.sql import SparkSession

from stitchspark import plans

QUERIES = ("execution_report", "stitch_texture_metrics", "path_event_stats", "coverage_metrics", "visible_connectors", "promote_preview_sweep",
           "promote_guarded_no_regression", "benefit_gate_sweep", "line_guard_chain", "summarize_by_each", "risk_summary", "grid_sweep",
           "pareto_front", "ridge_leave_one_sample_out", "teacher_union_summary", "canonical_split", "page_records")


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (SparkSession.builder.master(f"local[{cpus}]").appName("bench").config("spark.ui.enabled", "false")
             .config("spark.sql.shuffle.partitions", cpus).config("spark.driver.memory", "16g").config("spark.sql.adaptive.enabled", "true")
             .config("spark.sql.session.timeZone", "UTC").getOrCreate())
    spark.sparkContext.setLogLevel("ERROR")
    spark.range(1000).selectExpr("sum(id)").collect()
    times = {}
    for name in QUERIES:
        start = time.time()
        plans.RUN[name](spark, folder).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - start, 3)
    print(json.dumps({"metric": "headline_queries_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times,
                      "sf": os.path.basename(folder.rstrip("/")).removeprefix("sf")}))
    spark.stop()


if __name__ == "__main__":
    main()
