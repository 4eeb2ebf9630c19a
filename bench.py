"""Time the headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import re
import sys
import time

# Queries and the tables whose rows count as their input.
HEADLINE = {
    "merge_detections": "events",
    "merge_detections_default": "lineitem",
    "detections_in_clips": "events",
    "range_filter_keep": "lineitem",
    "range_filter_by_site": "lineitem",
    "top_k": "lineitem",
    "segment_grid": "orders",
    "segment_grid_overlap": "orders",
    "species_summary": "lineitem",
    "recording_summary": "lineitem",
    "run_summary": "events",
    "selection_number": "lineitem",
    "pending_recordings": "orders",
    "resolve_audio": "orders",
    "classify_embeddings": "embeddings",
    "occurrence_scores": "orders",
    "to_csv_rows": "lineitem",
    "result_documents": "lineitem",
    "analyze_by_site": "lineitem",
}


def main() -> None:
    folder = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", str(os.cpu_count()))
    sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))
    from dawnchorus.session import local_session
    from dawnchorus.testbed.catalog import QUERIES

    spark = local_session(cores, "bench", partitions=int(cores))
    # Start the JVM's code paths once, so that the first query is not charged for them.
    QUERIES["merge_detections"](spark, folder).write.format("noop").mode("overwrite").save()
    rows = {
        table: spark.read.parquet(f"{folder}/{table}.parquet").count()
        for table in set(HEADLINE.values())
    }
    seconds = {}
    for name in HEADLINE:
        at = time.perf_counter()
        # Building counts too: measured broadcasts run small jobs while the plan is made.
        QUERIES[name](spark, folder).write.format("noop").mode("overwrite").save()
        seconds[name] = round(time.perf_counter() - at, 3)
    scale = re.search(r"sf([0-9.]+)", folder)
    print(
        json.dumps(
            {
                "metric": "total wall time of headline queries",
                "value": round(sum(seconds.values()), 3),
                "unit": "sec",
                "queries": seconds,
                "sf": float(scale.group(1)) if scale else None,
                "input_rows_per_sec": {
                    name: round(rows[HEADLINE[name]] / max(took, 0.001))
                    for name, took in seconds.items()
                },
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
