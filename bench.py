"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = (
    "semantic_search", "reranked_prompts", "nearest_tiles", "similar_tiles", "query_parse", "combined_filters", "tile_grid",
    "best_pairs", "location_timeline", "earliest_supported", "tile_quality", "index_summary", "difference_masks", "change_analyses",
    "training_split", "retrieval_report", "paired_recall", "index_changes", "applied_manifest", "latency_by_type", "keyed_upsert",
)


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", str(os.cpu_count() or 8))
    from orbitloom.session import build_session

    spark = build_session("bench", master=f"local[{cpus}]", shuffle_partitions=int(cpus) if cpus.isdigit() else 8)
    import workload.all  # noqa: F401
    from workload.registry import QUERIES

    names = sys.argv[1:] or HEADLINE
    spark.range(1000).selectExpr("sum(id)").collect()
    took = {}
    for name in names:
        t0 = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        took[name] = round(time.perf_counter() - t0, 3)
        print(name, took[name], file=sys.stderr)
    print(json.dumps({
        "metric": "total wall time of the headline queries", "value": round(sum(took.values()), 3), "unit": "sec",
        "queries": took, "sf": os.path.basename(sf_dir.rstrip("/")), "cpus": cpus,
    }))
    spark.stop()


if __name__ == "__main__":
    main()
