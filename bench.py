"""Time the headline queries and print one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

from pyspark.sql import SparkSession

HEADLINE = [
    "exact_groups", "exact_ranked", "lines_ranked", "hot_groups_ranked", "removal_plan", "move_plan", "latest_state",
    "index_stats", "prune_drop", "changes", "tombstones", "diff_status", "diff_copy", "sync_mirror", "text_hash_groups",
    "content_hash", "hamming_pairs", "hamming_clusters", "temporal_clusters", "tolerance_clusters", "dhash",
    "formatting", "rolling_eta", "report_md", "latest_stream",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("twinfinder-bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.driver.memory", os.environ.get("BENCH_MEMORY", "12g"))
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from twinfinder.queries import all_queries

    queries = all_queries()
    names = sys.argv[1:] or HEADLINE
    queries["latest_state"](spark, sf_dir).count()  # start the session's machinery outside of the timings
    seconds = {}
    for name in names:
        start = time.perf_counter()
        queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - start, 3)
    print(json.dumps({
        "metric": "total_query_seconds",
        "value": round(sum(seconds.values()), 3),
        "unit": "sec",
        "queries": seconds,
        "sf": os.path.basename(sf_dir.rstrip("/")),
        "cpus": int(cpus),
    }))
    spark.stop()


if __name__ == "__main__":
    main()
