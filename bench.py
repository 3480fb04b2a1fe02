"""Time the headline queries; prints one JSON line.

BENCH_SF_DIR  input folder (default /root/testdata/sf0.1)
BENCH_CPUS    local cores (default 8)
BENCH_REPEATS timed runs per query after one warm-up (default 2, the median counts)
BENCH_QUERIES comma-separated names instead of the headline list
"""

from __future__ import annotations

import json
import os
import statistics
import sys
import time

from drovera.plans import load_queries
from drovera.session import build_session

HEADLINE = (
    "frame_geo", "telemetry_snapshot", "asof_nearest", "match_streak", "fallback_radius",
    "frame_affine", "geodesic_distance", "geofence_spans", "class_counts", "mask_union_area",
    "danger_flags", "mosaic_dem", "slope_mask", "sample_raster", "keyframes", "world_velocity",
    "knn_features", "bridge_gaps", "interpolate_tracks", "herd_ema", "score_sequences",
    "track_state", "anomaly_events", "alert_cooldown", "session_close", "stage_throughput",
    "health_monitoring", "danger_detection",
)


def run(query, spark, sf_dir: str) -> float:
    start = time.perf_counter()
    query(spark, sf_dir).write.format("noop").mode("overwrite").save()
    return time.perf_counter() - start


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    repeats = int(os.environ.get("BENCH_REPEATS", "2"))
    spark = build_session(
        "bench", master=f"local[{cpus}]",
        **{"spark.driver.memory": os.environ.get("BENCH_MEMORY", "8g"), "spark.sql.shuffle.partitions": cpus},
    )
    spark.sparkContext.setLogLevel("ERROR")
    queries, _ = load_queries()
    names = [n for n in os.environ.get("BENCH_QUERIES", "").split(",") if n] or HEADLINE
    times: dict[str, float] = {}
    for name in names:
        run(queries[name], spark, sf_dir)
        times[name] = round(statistics.median(run(queries[name], spark, sf_dir) for _ in range(repeats)), 3)
        print(f"{name} {times[name]}", file=sys.stderr, flush=True)
    frames = queries["frame_geo"](spark, sf_dir).count() if "frame_geo" in times else 0
    result = {
        "metric": "total_query_seconds",
        "value": round(sum(times.values()), 3),
        "unit": "sec",
        "queries": times,
        "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf"),
        "cpus": int(cpus),
    }
    if frames:
        per_sec = frames / times["frame_geo"]
        result["frames_per_sec"] = round(per_sec, 1)
        result["flight_seconds_per_sec"] = round(per_sec / 30, 2)
    print(json.dumps(result), flush=True)
    spark.stop()


if __name__ == "__main__":
    main()
