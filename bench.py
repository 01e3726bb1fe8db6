"""Headline queries, timed. Prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.abspath(__file__)))

HEADLINE = [
    "photo_verdicts",
    "photo_intake_report",
    "first_wins_duplicates",
    "shoot_distinctness",
    "sharpest_frame_per_bucket",
    "mesh_weld",
    "mesh_solid_report",
    "mesh_components",
    "mesh_cleanup_report",
    "face_budget_reduction",
    "view_fragments",
    "edge_votes",
    "voxel_shell",
    "nearest_vertex",
    "uv_texels",
    "log_tail_by_cursor",
    "stage_keys",
    "machine_presence",
    "hardware_cost_cube",
    "busy_hosts",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    from facetlake.session import local_session
    from facetlake.starschema.catalog import QUERIES

    wanted = sys.argv[1:] or HEADLINE
    spark = local_session(cpus, "bench", int(cpus) if cpus.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/part.parquet").groupBy("p_brand").count().collect()
    times = {}
    for name in wanted:
        start = time.perf_counter()
        # Every output column is computed; nothing is sent to the driver.
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name}: {times[name]}", file=sys.stderr, flush=True)
    spark.stop()
    out = {"metric": "headline_total", "value": round(sum(times.values()), 3), "unit": "sec", "queries": times}
    print(json.dumps({**out, "sf": os.path.basename(sf_dir.rstrip("/")).removeprefix("sf")}))


if __name__ == "__main__":
    main()
