"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
HEADLINE = [
    "event_markers", "gradient_uneven", "smooth_savgol7", "impact_reconcile", "contact_episodes", "near_event_anti", "parabola_fit", "coherence_corr", "restitution", "momentum_fingerprint",
    "no_friction", "consecutive_drift", "rank_auc", "findings_timeline", "local_report", "linear_fit",
]


def main() -> None:
    from pyspark.sql import SparkSession

    from tracewright.plans import catalog

    sf, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]").config("spark.sql.shuffle.partitions", cpus).config("spark.sql.session.timeZone", "UTC")
        .config("spark.ui.enabled", "false").config("spark.driver.memory", "12g").config("spark.ui.showConsoleProgress", "false").getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    catalog.QUERIES["scan_project_filter"](spark, sf).write.format("noop").mode("overwrite").save()  # starts the engine
    times = {}
    for name in HEADLINE:
        began = time.time()
        catalog.QUERIES[name](spark, sf).write.format("noop").mode("overwrite").save()
        times[name] = round(time.time() - began, 3)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times, "sf": sf.rpartition("sf")[2]}))


if __name__ == "__main__":
    main()
