"""Times headline queries over whole tables; prints one JSON line.

Each query runs once to warm up and is then timed, its whole result going to Spark's ``noop`` sink.
"""

from __future__ import annotations

import json
import os
import tempfile
import time

from pyspark.sql import SparkSession

from marginalia.queries import QUERIES

NAMES = (
    "list_projects", "filter_tags_all", "search_relevance", "search_recency", "search_total_count", "search_all_scores", "token_estimate", "content_dedup",
    "links_resolved", "backlinks", "degree", "neighbors_d1", "neighbors_d2", "recent_docs", "outline", "context_candidates", "context_pack", "rate_limit_windows",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .appName("bench")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.files.maxPartitionBytes", "2m")
        .config("spark.driver.memory", "8g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.checkpoint.dir", tempfile.mkdtemp(prefix="bench-"))
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    took = {}
    for name in NAMES:
        for _ in range(2):
            start = time.perf_counter()
            QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            took[name] = round(time.perf_counter() - start, 3)
    spark.stop()
    sf = os.path.basename(os.path.normpath(sf_dir)).removeprefix("sf")
    print(json.dumps({"metric": "total seconds of headline queries, warm", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": float(sf) if sf.replace(".", "").isdigit() else sf}))


if __name__ == "__main__":
    main()
