"""A cross-section of the registered queries against DuckDB, and the driver contract."""

import os

import pytest

from kinetable.queries import load
from tests.oracle import compare, connect

SF = "/root/testdata/sf0.001"
PICK = ["voxel_occupancy", "normalize_all", "voxelize_drop", "epoch_clip", "pad_last", "farthest_point_sample", "surface_sample",
        "knn_join", "idw_map", "bone_guided_remap", "chamfer_clip", "voxel_bce", "trajectory_similarity", "median_bone_length",
        "soft_argmax", "best_rest_pose", "slerp", "heat_weights", "linear_blend_skin", "interpolate_pose_slerp", "spline_rotation",
        "all_pairs_hops", "sanitize_parents", "forward_kinematics", "vertex_normals", "obj_round_trip", "stream_frames", "stream_metrics"]

pytestmark = pytest.mark.skipif(not os.path.isdir(SF), reason="test tables not present")


@pytest.fixture(scope="module")
def con():
    return connect(SF)


@pytest.mark.parametrize("name", PICK)
def test_query_equals_sql(spark, con, name):
    reg = load()
    assert compare(reg.spark[name](spark, SF), con, reg.sql[name]) == ""


def test_contract(spark):
    import __spark_entry__ as e
    assert e.entry(spark).count() > 0
    assert set(e.oracle_sql()) <= set(e.queries())


def test_chain_equals_step_by_step(spark):
    """The unified chain against a plain NumPy walk over the frames of one sequence."""
    import numpy as np
    from kinetable.operators.correspondence import unify_chain
    rng = np.random.default_rng(2)
    clouds = [rng.normal(size=(n, 3)) for n in (12, 12, 15, 12)]
    joints = [rng.normal(size=(3, 3)) * 0.1 for _ in clouds]
    clouds[1] = clouds[0] + 0.01
    joints[1] = joints[0] + 0.01

    def feat(p, j):
        ext = np.linalg.norm(p.max(0) - p.min(0))
        return np.concatenate([p, np.exp(-3 * np.linalg.norm(p[:, None] - j[None], axis=2) / (ext + 1e-8))], axis=1)

    def step(prev, pj, cur, cj):
        q = 0.0
        if len(prev) == len(cur):
            q = 0.7 * np.exp(-np.linalg.norm(pj - cj, axis=1).mean()) + 0.3 * np.exp(-5 * np.linalg.norm(prev.mean(0) - cur.mean(0)))
        if q > 0.8:
            return cur
        d = np.sqrt(((feat(prev, pj)[:, None] - feat(cur, cj)[None]) ** 2).sum(2))
        near = np.argsort(d, axis=1, kind="stable")[:, :3]
        w = 1 / (np.take_along_axis(d, near, 1) + 1e-8)
        return (cur[near] * (w / w.sum(1, keepdims=True))[..., None]).sum(1)

    rest = 1
    want = {rest: clouds[rest]}
    for i in (2, 3):
        want[i] = step(want[i - 1], joints[i - 1], clouds[i], joints[i])
    want[0] = step(want[1], joints[1], clouds[0], joints[0])
    pts = spark.createDataFrame([("s", f, v, *map(float, p)) for f, c in enumerate(clouds) for v, p in enumerate(c)],
                                "seq_id string, frame_id long, vertex_id long, x double, y double, z double")
    js = spark.createDataFrame([("s", f, k, *map(float, p)) for f, c in enumerate(joints) for k, p in enumerate(c)],
                               "seq_id string, frame_id long, k long, x double, y double, z double")
    r = spark.createDataFrame([("s", rest)], "seq_id string, frame_id long")
    got = unify_chain(pts, js, r).collect()
    for f, w in want.items():
        mine = np.array([[x.x, x.y, x.z] for x in sorted((x for x in got if x.frame_id == f), key=lambda x: x.vertex_id)])
        assert mine.shape == w.shape and np.allclose(mine, w)
