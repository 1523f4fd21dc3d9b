"""Times the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS] and prints one line of JSON."""

import json
import os
import time

from pyspark.sql import SparkSession

from lumenreel.plans import catalogue

HEADLINE = (
    "hybrid_search", "fts_and", "fts_phrase", "fts_prefix", "fts_nested", "fts_postings", "vector_topk", "vector_topk_allowed", "facets_all", "folder_stats", "popular_tags", "majority_vote",
    "segment_full", "overlap_join", "srt_format", "sync_upsert", "sync_exclude", "orphan_recover", "nearest_parent", "event_dedupe", "debounce", "sliding_rate", "nearest_color",
)


def main() -> None:
    sf_dir, cpus = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1"), os.environ.get("BENCH_CPUS", "8")
    spark = (
        SparkSession.builder.master(f"local[{cpus}]")
        .config("spark.sql.shuffle.partitions", cpus)
        .config("spark.sql.session.timeZone", "UTC")
        .config("spark.driver.memory", "12g")
        .config("spark.ui.enabled", "false")
        .config("spark.ui.showConsoleProgress", "false")
        .getOrCreate()
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, took = catalogue.queries(), {}
    for name in HEADLINE:
        best = None
        for _ in range(3):
            began = time.perf_counter()
            queries[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
            seconds = time.perf_counter() - began
            best = seconds if best is None else min(best, seconds)
        took[name] = round(best, 3)
    print(json.dumps({"metric": "seconds for the headline queries, best of three each", "value": round(sum(took.values()), 3), "unit": "sec", "queries": took, "sf": sf_dir.rsplit("sf", 1)[-1]}))
    spark.stop()


if __name__ == "__main__":
    main()
