"""Headline queries at $BENCH_SF_DIR on local[$BENCH_CPUS]; prints one JSON line.

Each query is built and fully evaluated into a ``noop`` sink, so nothing is cut short by column pruning or collected.
"""

from __future__ import annotations

import json
import os
import sys
import time

from kinetable.plans.session import session
from kinetable.queries import load

HEADLINE = [
    "voxel_occupancy", "voxelize_lineitem", "normalize_sequence", "normalize_frame", "lineitem_ranks", "cloud_quality",
    "voxel_downsample", "crop", "subsample_vertices_even", "surface_sample", "knn_join", "nearest_map", "knn_graph",
    "knn_lineitem", "chamfer_clip", "voxel_bce", "surface_faces", "joint_distances", "motion_derivatives",
    "temporal_separation", "graph_consistency", "trajectory_similarity", "median_bone_length", "semantic_scores",
    "soft_argmax", "gaussian_combine_max", "rest_pose_scores", "slerp", "distance_weights_inverse",
    "linear_blend_skin", "fit_bone_motion", "interpolate_pose_slerp", "interpolate_direct", "vertex_normals",
    "all_pairs_hops", "skeleton_from_affinity", "forward_kinematics", "metric_weighted_total", "stream_metrics",
]


def main() -> None:
    sf_dir = os.environ.get("BENCH_SF_DIR", "/root/testdata/sf0.1")
    cpus = os.environ.get("BENCH_CPUS", "8")
    spark = session(f"local[{cpus}]", "bench", **{
        "spark.sql.shuffle.partitions": cpus, "spark.driver.memory": os.environ.get("BENCH_MEMORY", "16g"),
        "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    registry = load().spark
    only = sys.argv[1:]
    times: dict[str, float] = {}
    registry["bind_axes"](spark, sf_dir).write.format("noop").mode("overwrite").save()  # start-up is not measured
    for name in [q for q in HEADLINE if not only or q in only]:
        start = time.perf_counter()
        registry[name](spark, sf_dir).write.format("noop").mode("overwrite").save()
        times[name] = round(time.perf_counter() - start, 3)
        print(f"{name:28s} {times[name]:8.2f}", file=sys.stderr, flush=True)
    print(json.dumps({"metric": "total_query_time", "value": round(sum(times.values()), 3), "unit": "sec",
                      "queries": times, "sf": sf_dir.rstrip("/").rsplit("sf", 1)[-1]}))


if __name__ == "__main__":
    main()
