"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

from skyloom.plans.catalog import QUERIES  # noqa: E402
from skyloom.session import build_session  # noqa: E402

HEADLINE = [
    "fuzzy_search_topk",
    "fuzzy_search_bbox",
    "bbox_select",
    "polygon_select",
    "aabb_overlap",
    "nearest_site",
    "nearby_sites",
    "track_clean",
    "track_segments",
    "corridor_zones",
    "origin_destination",
    "leg_ids",
    "route_asof",
    "route_origin_fallback",
    "route_extract",
    "resolve_route",
    "greedy_dedup",
    "zoom_thinning",
    "gazetteer_union",
    "phonetic_keys",
]


def run_once(spark, name: str, sf_dir: str) -> float:
    start = time.perf_counter()
    QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = int(os.environ.get("BENCH_CPUS", "8"))
    runs = int(os.environ.get("BENCH_RUNS", "3"))
    names = os.environ.get("BENCH_QUERIES", "").split() or HEADLINE
    spark = build_session(
        "skyloom-bench",
        f"local[{cpus}]",
        **{
            "spark.sql.shuffle.partitions": str(cpus),
            "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        },
    )
    spark.sparkContext.setLogLevel("OFF")
    times = {}
    for name in names:
        run_once(spark, name, sf_dir)  # warm-up
        laps = sorted(run_once(spark, name, sf_dir) for _ in range(runs))
        times[name] = round(laps[len(laps) // 2], 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    print(
        json.dumps(
            {
                "metric": "headline queries, sum of median warm runs",
                "value": round(sum(times.values()), 3),
                "unit": "sec",
                "queries": times,
                "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
            }
        )
    )
    spark.stop()


if __name__ == "__main__":
    main()
