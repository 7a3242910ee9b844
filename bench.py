"""Headline queries on local[$BENCH_CPUS] over $BENCH_SF_DIR; prints one JSON line."""

from __future__ import annotations

import json
import os
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parent))

from landpulse import plans  # noqa: E402,F401
from landpulse.plans.registry import QUERIES  # noqa: E402
from landpulse.session import local_session  # noqa: E402

HEADLINE = [
    "index_delta", "event_attributes", "fuse_flood_gated", "tristate_flood", "tristate_drought", "leave_one_year_out",
    "ablation_matrix", "pr_auc_exact", "block_bootstrap_ci", "scene_pair_match", "asof_nearest_scene", "fire_dedup",
    "track_link_iou", "object_match_strict", "lifecycle_state", "flood_alert_state", "polygon_to_cells", "paired_delta_stats",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cores = os.environ.get("BENCH_CPUS", "8")
    names = sys.argv[1:] or HEADLINE
    spark = local_session(cores, partitions=int(cores) if cores.isdigit() else 8)
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").count()  # start the JVM workers outside the timings
    timings = {}
    for name in names:
        started = time.perf_counter()
        QUERIES[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        timings[name] = round(time.perf_counter() - started, 3)
    print(json.dumps({"metric": "headline_total", "value": round(sum(timings.values()), 3), "unit": "sec",
                      "queries": timings, "sf": Path(sf_dir).name}))


if __name__ == "__main__":
    main()
