"""Rotations, fits, splines, sampling and weights against NumPy."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.functions import names, rotation as rot, space
from kinetable.operators import clips, interpolate as ip, normalize as nz, sampling, skin, tracks, weights
from kinetable.schema import FRAME


def rotation(rng):
    q, _ = np.linalg.qr(rng.normal(size=(3, 3)))
    return q * np.sign(np.linalg.det(q))


def test_normalize_round_trip(spark, cloud):
    arr = np.random.default_rng(1).uniform(-7, 9, (3, 20, 3))
    p = cloud(arr)
    box = nz.bbox(p, "frame")
    back = nz.denormalize(nz.normalize(p, "frame", box=box), box, "frame").orderBy(*FRAME, "vertex_id").collect()
    assert np.allclose(np.array([[r.x, r.y, r.z] for r in back]).reshape(arr.shape), arr, rtol=1e-5, atol=1e-4)


def test_outside_points_raise(spark, cloud):
    with pytest.raises(Exception, match="outside the 8 grid"):
        nz.voxelize(cloud(np.full((1, 2, 3), 1.5)), 8).collect()


def test_validation_report(spark, cloud):
    arr = np.zeros((2, 4, 3))
    arr[1] = np.arange(12).reshape(4, 3)
    arr[1, 0, 0] = np.nan
    rows = {r.frame_id: r for r in nz.validate_points(cloud(arr)).collect()}
    assert rows[0].zero_extent and rows[1].n_not_finite == 1
    with pytest.raises(Exception, match="failed validation"):
        nz.validate_sequences(cloud(arr), fail=True).collect()


def test_quaternions(spark):
    rng = np.random.default_rng(2)
    mats = [rotation(rng) for _ in range(30)] + [np.diag(d).astype(float) for d in ([1, -1, -1], [-1, 1, -1], [-1, -1, 1], [1, 1, 1])]
    df = spark.createDataFrame([(i, [float(v) for v in m.ravel()]) for i, m in enumerate(mats)], "i int, m array<double>")
    out = rot.add_quat(df, "m", "q").withColumn("b", rot.quat_to_matrix(F.col("q"))).orderBy("i").collect()
    for r, m in zip(out, mats):
        assert np.allclose(np.array(r.b).reshape(3, 3), m, atol=1e-12) and r.q[3] >= 0
    flat = rot.add_quat(spark.createDataFrame([([0.0] * 9,)], "m array<double>"), "m", "q").first()
    assert flat.q == [0.0, 0.0, 0.0, 1.0]


def test_slerp_ends_and_middle(spark):
    a, b = [0.0, 0.0, 0.0, 1.0], [0.0, 0.0, np.sin(0.6), np.cos(0.6)]
    df = spark.createDataFrame([(a, [-float(v) for v in b], t) for t in (0.0, 0.5, 1.0)], "a array<double>, b array<double>, t double")
    q = [r.q for r in rot.add_slerp(df, "a", "b", "t", "q").orderBy("t").collect()]
    assert np.allclose(q, [a, [0, 0, np.sin(0.3), np.cos(0.3)], b])


def test_yaw(spark, cloud):
    rng = np.random.default_rng(3)
    v = np.array([0.2, 0.7, -0.4])
    t = np.linalg.norm(v)
    k = np.array([[0, -v[2], v[1]], [v[2], 0, -v[0]], [-v[1], v[0], 0]]) / t
    m = np.eye(3) + np.sin(t) * k + (1 - np.cos(t)) * k @ k
    yaw = np.arcsin(-m[2, 0])
    ry = np.array([[np.cos(yaw), 0, np.sin(yaw)], [0, 1, 0], [-np.sin(yaw), 0, np.cos(yaw)]]).T
    arr = rng.normal(size=(2, 5, 3))
    rv = spark.createDataFrame([("s", 0, *map(float, v)), ("s", 1, 9.0, 9.0, 9.0)], "seq_id string, frame_id long, rx double, ry double, rz double")
    starts = spark.createDataFrame([("s", 0)], "seq_id string, start long")
    got = clips.yaw_align(cloud(arr), rv, starts).orderBy(*FRAME, "vertex_id").collect()
    assert np.allclose([[r.x, r.y, r.z] for r in got], (arr.reshape(-1, 3) @ ry.T))


def test_clip_rules(spark):
    lens = spark.createDataFrame([("a", 53), ("b", 7), ("c", 20)], "seq_id string, length long")
    for e in range(12):
        got = {r.seq_id: r.start for r in clips.epoch_starts(lens, e, 10, 2).collect()}
        for s, n in (("a", 53), ("c", 20)):
            off = (e % 10) * 2
            start = e % (n // 20) * 20 + off
            if start + 18 >= n:
                start = max(start - 2 * off, 0)
            assert got[s] == start
        assert got["b"] == 0
    r = {x.seq_id: x.start for x in clips.random_starts(lens, 5, 10, 2).collect()}
    assert 0 <= r["a"] <= 53 - 1 - 18 and r["b"] == 0 and 0 <= r["c"] <= 1


def test_split_and_limits(spark):
    ids = spark.createDataFrame([(f"s{i:03d}", 0) for i in range(100)], "seq_id string, frame_id long")
    split = clips.train_test_split(ids, 7).collect()
    assert sorted(r.position for r in split) == list(range(100))
    assert sum(r.split == "train" for r in split) == 91
    assert clips.limit_sequences(ids, 7, 5).count() == 5


def test_farthest_points(spark, cloud):
    arr = np.random.default_rng(4).normal(size=(2, 40, 3))
    got = sampling.farthest_point_sample(cloud(arr), 12, every=4).collect()
    for f in range(2):
        d, want = np.full(40, np.inf), [0]
        for _ in range(11):
            d = np.minimum(d, ((arr[f] - arr[f, want[-1]]) ** 2).sum(1))
            want.append(int(d.argmax()))
        assert [r.vertex_id for r in sorted((r for r in got if r.frame_id == f), key=lambda r: r.pick)] == want


def test_surface_samples_lie_on_their_faces(spark, cloud):
    arr = np.random.default_rng(5).normal(size=(1, 9, 3))
    faces = spark.createDataFrame([("s", 0, i, i, i + 1, i + 2) for i in range(7)], "seq_id string, frame_id long, face_id long, v0 long, v1 long, v2 long")
    rows = sampling.surface_sample(cloud(arr), faces, 500, seed=3).collect()
    assert sorted(r.sample_id for r in rows) == list(range(500))
    area = np.array([np.linalg.norm(np.cross(arr[0, i + 1] - arr[0, i], arr[0, i + 2] - arr[0, i])) for i in range(7)])
    share = np.bincount([r.face_id for r in rows], minlength=7) / 500
    assert np.allclose(share, area / area.sum(), atol=0.005)
    for r in rows[:50]:
        a, b, c = arr[0, r.face_id:r.face_id + 3]
        n = np.cross(b - a, c - a)
        assert abs(np.dot(n / np.linalg.norm(n), np.array([r.x, r.y, r.z]) - a)) < 1e-9


def test_lower_median(spark):
    rng = np.random.default_rng(6)
    groups = {"even": rng.normal(size=40), "odd": rng.normal(size=41), "same": np.ones(9), "one": np.array([3.0]),
              "outlier": np.append(rng.uniform(0, 1e-6, 60), 1e9)}
    df = spark.createDataFrame([(g, float(v)) for g, vs in groups.items() for v in vs], "g string, v double")
    got = {r.g: r.median_v for r in tracks.lower_median(df, ["g"], "v", cuts=8).collect()}
    assert got == {g: float(np.sort(v)[(len(v) - 1) // 2]) for g, v in groups.items()}


def test_spline_weights():
    keys = np.array([0.0, 2, 3, 7, 11])
    t = np.linspace(0, 11, 30)
    c = ip.spline_coefficients(keys, t)
    cubic = lambda x: 0.3 * x ** 3 - x ** 2 + 2 * x - 5  # a not-a-knot spline reproduces cubics
    assert np.allclose(c @ cubic(keys), cubic(t))
    assert np.allclose(ip.spline_coefficients(keys, keys), np.eye(5), atol=1e-9)
    three = np.array([0.0, 1, 4])
    assert np.allclose(ip.spline_coefficients(three, t) @ (three ** 2), t ** 2)
    assert np.allclose(ip.spline_coefficients(three[:2], t) @ (3 * three[:2] + 1), 3 * t + 1)


def test_spline_runs_equal_the_dense_solution(spark, monkeypatch):
    """Keys of every sequence from a table, in runs of seventy; 2, 3, 4 and many keys, unevenly spaced."""
    rng = np.random.default_rng(14)
    monkeypatch.setattr(ip, "RUN_KEYS", 70)
    keys = {s: np.sort(rng.choice(600, n, replace=False)) for s, n in (("a", 2), ("b", 3), ("c", 4), ("d", 90), ("e", 8), ("f", 9))}
    pose = {(s, int(f)): rng.normal(size=3) for s, ks in keys.items() for f in ks}
    rows = [(s, f, 0, [0.0, 0.0, 0.0, 1.0], *map(float, v)) for (s, f), v in pose.items()] + [("a", 601, 0, [0.0, 0.0, 0.0, 1.0], 9.0, 9.0, 9.0)]
    bones = spark.createDataFrame(rows, "seq_id string, frame_id long, k long, q array<double>, tx double, ty double, tz double")
    table = spark.createDataFrame([(s, int(f)) for s, ks in keys.items() for f in ks], "seq_id string, key long")
    got: dict = {}
    for x in ip.interpolate_spline(bones, table, 50).orderBy("frame_id").collect():
        got.setdefault(x.seq_id, []).append((x.tx, x.ty, x.tz))
    for s, ks in keys.items():
        c = ip.spline_coefficients(ks.astype(float), np.linspace(ks[0], ks[-1], 50))
        want = c @ np.array([pose[s, int(f)] for f in ks])
        assert np.allclose(np.array(got[s]), want, atol=1e-8), s


def test_rigid_fit_recovers_bone_motion(spark, cloud):
    rng = np.random.default_rng(7)
    rest = rng.normal(size=(12, 3))
    r, t = rotation(rng), np.array([0.3, -1.0, 2.0])
    frames = np.stack([rest, rest @ r.T + t])
    restdf = cloud(rest[None]).drop("frame_id")
    w = spark.createDataFrame([("s", v, k, 0.5) for v in range(12) for k in (0, 1)], "seq_id string, vertex_id long, k long, w double")
    fit = {(x.frame_id, x.k): x for x in skin.fit_bone_motion(cloud(frames), restdf, w).collect()}
    assert np.allclose(np.array(fit[(1, 1)].r).reshape(3, 3), r) and np.allclose([fit[(1, 0)].tx, fit[(1, 0)].ty, fit[(1, 0)].tz], t)
    tr = skin.fit_bone_motion(cloud(frames), restdf, w).select(*FRAME, "k", "m")
    err = skin.reconstruction_error(skin.linear_blend_skin(restdf, w, tr), cloud(frames)).collect()
    assert len(err) == 2 and max(e.max_error for e in err) < 1e-9


def test_identity_transforms_give_rest(spark, cloud):
    rest = np.random.default_rng(8).normal(size=(1, 10, 3))
    p = cloud(rest)
    bones = spark.createDataFrame([(0, -1), (1, 0)], "k long, parent long")
    w = spark.createDataFrame([("s", v, v % 2, 1.0) for v in range(10)], "seq_id string, vertex_id long, k long, w double")
    out = skin.linear_blend_skin(p.drop("frame_id"), w, skin.identity_transforms(p.select(*FRAME).distinct(), bones))
    assert np.allclose([[r.x, r.y, r.z] for r in out.orderBy("vertex_id").collect()], rest[0])


def test_rigid_align(spark, cloud):
    rng = np.random.default_rng(9)
    target = rng.uniform(-1, 1, (1, 120, 3))
    a = 0.05
    r = np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])
    source = target @ r.T + [0.03, -0.02, 0.01]
    out = skin.rigid_align(cloud(source), cloud(target), scales=(), final_size=0.3, final_iterations=15)
    got = np.array([[x.x, x.y, x.z] for x in out.orderBy("vertex_id").collect()])
    assert np.abs(got - target[0]).max() < 1e-6


def test_heat_weights_solve_the_system(spark, cloud):
    rng = np.random.default_rng(10)
    rest, joints = rng.uniform(0, 3, (60, 3)), rng.uniform(0, 3, (3, 3))
    d = np.linalg.norm(rest[:, None] - rest[None], axis=2)
    w = np.zeros((60, 60))
    for i in range(60):
        for j in np.argsort(d[i], kind="stable")[1:9]:
            w[i, j] = w[j, i] = 1 / (d[i, j] + 1e-8)
    lap = np.diag(w.sum(1)) - w
    full = np.zeros((60, 3))
    for k in range(3):
        dj = np.linalg.norm(rest - joints[k], axis=1)
        near = np.argsort(dj, kind="stable")[:3]
        b = np.zeros(60)
        b[near[0]] = 1
        for i in near:
            if dj[i] < 0.1:
                b[i] = np.exp(-10 * dj[i])
        full[:, k] = np.linalg.solve(np.eye(60) + 0.01 * lap, b)
    full /= full.sum(1, keepdims=True)
    jdf = spark.createDataFrame([("s", k, *map(float, joints[k])) for k in range(3)], "seq_id string, k long, x double, y double, z double")
    got = np.zeros((60, 3))
    for r in weights.heat_weights(cloud(rest[None]).drop("frame_id"), jdf, iterations=40, every=10).collect():
        got[r.vertex_id, r.k] = r.w
    assert np.allclose(got, full, atol=1e-5) and np.allclose(got.sum(1), 1)


def test_weights_sum_to_one(spark, cloud):
    rng = np.random.default_rng(11)
    rest = cloud(rng.normal(size=(1, 30, 3))).drop("frame_id")
    j = spark.createDataFrame([("s", k, *map(float, rng.normal(size=3))) for k in range(6)], "seq_id string, k long, x double, y double, z double")
    for kind in ("exp", "inverse"):
        r = weights.weight_sum_report(weights.distance_weights(rest, j, kind), 1e-6).first()
        assert r.normalized


def test_segment_text(spark):
    r = spark.createDataFrame([("0,10;20,30",)], "s string").select(names.segments(F.col("s")).alias("a")).first()
    assert [tuple(x) for x in r.a] == [(0, 10), (20, 30)]
    pairs = spark.createDataFrame([("s", 0, 99)], "seq_id string, frame_a long, frame_b long")
    lens = spark.createDataFrame([("s", 50)], "seq_id string, length long")
    with pytest.raises(Exception, match="bad segment"):
        ip.check_segments(pairs, lens).collect()
