"""What operators write, join and send as tables grow; results beside it are checked in the other files."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.operators import correspondence as co, interpolate as ip, skin, trees, weights
from kinetable.plans import knn


def test_neighbour_join_writes_few_rows_per_point(spark, monkeypatch):
    rng = np.random.default_rng(11)
    n, written = 3000, []

    def cut(df, label="state", by=None):
        out = real(df, label, by)
        written.append(out.count())
        return out

    real = knn.cut
    monkeypatch.setattr(knn, "cut", cut)
    table = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (n, 3)))],
                                  "g long, vertex_id long, x double, y double, z double")
    hits = knn.knn_join(table, table, ["g"], 1, leaf=64, direct=64)
    assert hits.where("left_id = right_id and rank = 1").count() == n
    assert sum(written) <= 6 * n


def test_frames_of_some_thousand_points_register_without_joins(spark, cloud, monkeypatch):
    def no_join(*a, **k):
        raise AssertionError("a neighbour join per round")

    monkeypatch.setattr(skin, "knn_join", no_join)
    pts = np.random.default_rng(12).uniform(-1, 1, (1, 3000, 3))
    got = skin.rigid_align(cloud(pts + 0.001), cloud(pts), scales=(), final_size=0.02, final_iterations=20).collect()
    back = np.array([[r.x, r.y, r.z] for r in sorted(got, key=lambda r: r.vertex_id)])
    assert np.abs(back - pts[0]).max() < 1e-9


@pytest.mark.parametrize("batch", [64, 1 << 20])
def test_nearest_within_reach_is_that_of_brute_force(batch):
    rng = np.random.default_rng(13)
    q = np.concatenate([rng.integers(0, 6, (300, 3)) * 0.1, rng.normal(size=(80, 3)), [[1e9, 0, 0]]])
    p = np.concatenate([rng.integers(0, 6, (90, 3)) * 0.1, rng.normal(size=(60, 3)), [[-1e9, 3, 1e7], [1e9, 0, 0.05]]])
    d2 = ((p[:, None] - q) ** 2).sum(axis=2)
    for reach in (0.1, 0.35, 1e-7):
        want = np.where(d2.min(axis=1) <= reach * reach, d2.argmin(axis=1), -1)
        assert (skin._Cells(q, reach, batch).nearest(p) == want).all()


def test_feature_search_is_one_neighbour_join(spark, monkeypatch):
    calls = []
    monkeypatch.setattr(co, "DIRECT", 8)
    monkeypatch.setattr(co, "knn_join", lambda *a, **k: calls.append(1) or knn.knn_join(*a, **k))
    rng = np.random.default_rng(14)
    f, g = rng.normal(size=(60, 5)), rng.normal(size=(70, 5)) + 1
    ta = spark.createDataFrame([(0, i, v.tolist()) for i, v in enumerate(f)], "g long, vertex_id long, fa array<double>")
    cb = spark.createDataFrame([(0, i, v.tolist(), *v[:3].tolist()) for i, v in enumerate(g)], "g long, other_id long, fb array<double>, ox double, oy double, oz double")
    rows = co.feature_nearest(ta, cb, ["g"], 3, (60, 70), batch=4).collect()
    d = ((f[:, None] - g) ** 2).sum(2)
    want = {(i, int(j)) for i in range(60) for j in np.argsort(d[i])[:3]}
    assert {(r.vertex_id, r.other_id) for r in rows} == want and len(rows) == 180 and len(calls) == 1
    assert all((r.ox, r.oy, r.oz) == tuple(g[r.other_id][:3]) for r in rows)


def test_bones_are_not_broadcast(spark):
    bones = spark.createDataFrame([(s, k, (k + 1) % 3 if s else k - 1) for s in (0, 1) for k in range(3)], "skeleton_id long, k long, parent long")
    for df in (trees.has_cycle(bones), trees.sanitize_parents(bones)):
        assert "Broadcast" not in df._jdf.queryExecution().executedPlan().toString()
    assert {(r.skeleton_id, r.has_cycle) for r in trees.has_cycle(bones).collect()} == {(0, False), (1, True)}


def test_methods_compared_per_match_as_per_step(spark, cloud):
    rng = np.random.default_rng(15)
    points = cloud(rng.normal(size=(1, 9, 3))).unionByName(cloud(rng.normal(size=(2, 11, 3)), first=1))
    pairs = ip.consecutive_pairs(points)
    direct = {m: ip.interpolate_direct(points, pairs, 4, m) for m in ("nearest", "idw")}
    matched = {m: ip.matched_pairs(points, pairs, m) for m in ("nearest", "idw")}
    rows = lambda df: sorted(tuple(round(v, 12) if isinstance(v, float) else v for v in r) for r in df.collect())
    assert rows(ip.compare_matched(matched, "nearest", 4)) == rows(ip.compare_methods(direct, "nearest"))


def test_keys_of_some_thousand_points_are_joined_without_tables(spark, monkeypatch):
    """one block per key, nothing written; boxes inside the block are exact, ties and copies included."""
    def no_table(*a, **k):
        raise AssertionError("a table is written")

    monkeypatch.setattr(knn, "cut", no_table)
    rng = np.random.default_rng(16)
    p = np.concatenate([rng.integers(0, 12, (4300, 3)) * 0.5, np.zeros((300, 3)), rng.normal(size=(400, 3)), [[1e9, 0, 0]]])
    q = np.concatenate([p[::9] + 0.1, [[-1e9, 1e9, 0]], np.zeros((5, 3))])
    schema = "g long, vertex_id long, x double, y double, z double"
    table = lambda v: spark.createDataFrame([(0, i, *map(float, r)) for i, r in enumerate(v)], schema)
    got = {(r.left_id, r["rank"]): (r.right_id, r.d2) for r in knn.knn_join(table(q), table(p), ["g"], 3).collect()}
    d2 = knn._squares(q, p)
    order = np.argsort(d2, axis=1, kind="stable")[:, :3]
    assert got == {(i, r + 1): (int(j), float(d2[i, j])) for i in range(len(q)) for r, j in enumerate(order[i])}


@pytest.mark.parametrize("n", [1, 9, 40])
def test_boxes_of_a_block_are_exact(monkeypatch, n):
    monkeypatch.setattr(knn, "DIRECT", 100)
    monkeypatch.setattr(knn, "BOX", 8)
    rng = np.random.default_rng(17)
    b = np.concatenate([rng.integers(0, 5, (500, 3)).astype(float), rng.normal(size=(300, 3)), [[1e9, -1e9, 2]]])
    a = np.concatenate([rng.integers(0, 5, (90, 3)).astype(float), rng.normal(size=(90, 3)) * 9, [[1e9, 1e9, 1e9]]])
    d2 = knn._squares(a, b)
    want = np.argsort(d2, axis=1, kind="stable")[:, :n]
    seen = 0
    for rows, at, value in knn._nearest(a, b, n):
        seen += len(rows)
        assert (at == want[rows]).all() and (value == np.take_along_axis(d2, want, axis=1)[rows]).all()
    assert seen == len(a)


def test_graph_of_a_frame_shuffles_its_points_only(spark, monkeypatch):
    """no edge goes through a shuffle when a frame is a block."""
    rng = np.random.default_rng(18)
    v = np.concatenate([rng.integers(0, 4, (80, 3)).astype(float), rng.normal(size=(60, 3)), np.zeros((12, 3))])
    points = spark.createDataFrame([(0, 3 * i + 1, *map(float, r)) for i, r in enumerate(v)], "g long, vertex_id long, x double, y double, z double")
    edges = co.knn_graph(points, ["g"], 8)
    assert edges._jdf.queryExecution().executedPlan().toString().count("Exchange") == 1
    monkeypatch.setattr(co, "WHOLE", 0)
    rows = lambda df: sorted((r.src, r.dst, r.w) for r in df.collect())
    assert rows(edges) == rows(co.knn_graph(points, ["g"], 8))


@pytest.mark.parametrize("iterations", [3, None])
def test_heat_of_a_sequence_needs_no_table_per_step(spark, cloud, monkeypatch, iterations):
    """no edge and no state is written or shuffled; the same weights as by joins."""
    rng = np.random.default_rng(19)
    rest = cloud(rng.uniform(0, 1, (2, 40, 3))).withColumn("seq_id", F.col("frame_id").cast("string")).drop("frame_id")
    joints = spark.createDataFrame([(str(s), k, *map(float, rng.uniform(0, 1, 3))) for s in range(2) for k in range(11)], "seq_id string, k long, x double, y double, z double")
    labels = []
    monkeypatch.setattr(weights, "cut", lambda df, label="state", by=None: labels.append(label) or real(df, label, by))
    real = knn.cut
    rows = lambda df: {(r.seq_id, r.vertex_id, r.k): round(r.w, 9) for r in df.collect()}
    blocks = rows(weights.heat_weights(rest, joints, iterations=iterations))
    assert labels == ["heat-rest", "heat-b"]
    monkeypatch.setattr(weights, "WHOLE", 0)
    assert blocks == rows(weights.heat_weights(rest, joints, iterations=iterations)) and len(blocks) > 50


def test_pages_are_not_broadcast(spark, monkeypatch):
    """of a join with many pages only the trees, one row per key, may be sent through the driver."""
    plans = []
    plan = lambda df: df._jdf.queryExecution().executedPlan().toString()
    real = knn.cut
    monkeypatch.setattr(knn, "cut", lambda df, label="state", by=None: plans.append((label, plan(df))) or real(df, label, by))
    rng = np.random.default_rng(20)
    table = spark.createDataFrame([(0, i, *map(float, p)) for i, p in enumerate(rng.uniform(0, 1, (900, 3)))], "g long, vertex_id long, x double, y double, z double")
    out = knn.knn_join(table, table, ["g"], 3, leaf=24, direct=24)
    plans = [p for label, p in plans if label in ("knn-bounds", "knn-reach", "knn-near", "knn-loads")] + [plan(out)[plan(out).rindex("FlatMapCoGroups"):]]
    assert len(plans) == 5 and not [p for p in plans if "BroadcastExchange" in p and "_depth" not in p and "_n#" not in p]


def test_poses_are_written_and_their_bones_looked_up_once(spark, monkeypatch):
    """a weight finds its matrix once, and result rows, not the bytes that go in, say how many tasks make them."""
    from kinetable.operators import interpolate, skin
    from kinetable.plans import tiles
    monkeypatch.setattr(tiles, "TASK_ROWS", 4)
    rest = spark.createDataFrame([(0, v, float(v), 1.0, 2.0) for v in range(8)], "seq_id long, vertex_id long, x double, y double, z double")
    w = rest.select("seq_id", "vertex_id", F.explode(F.expr("array(0L, 2L)")).alias("k"), F.lit(0.5).alias("w"))
    q = [0.0, 0.0, 0.0, 1.0]
    bones = spark.createDataFrame([(0, f, k, q, float(f), 0.0, float(k)) for f in range(3) for k in (0, 2)],
                                  "seq_id long, frame_id long, k long, q array<double>, tx double, ty double, tz double")
    labels, real = [], interpolate.cut
    monkeypatch.setattr(interpolate, "cut", lambda df, label="state", by=None: labels.append(label) or real(df, label, by))
    out = interpolate.interpolate_pose(rest, w, bones, interpolate.consecutive_pairs(bones), 1)
    plan = out._jdf.queryExecution().optimizedPlan().toString()
    assert labels == ["turned-poses"] and plan.count("raise_error") == 1 and "RepartitionByExpression" in plan
    assert {(r.frame_id, r.vertex_id): (r.x, r.y, r.z) for r in out.collect()} == {(f, v): (v + f + 0.5, 1.0, 3.0) for f in range(2) for v in range(8)}


def test_unified_rows_are_made_and_shuffled_once(spark):
    """of a pair both frames come from one shuffle of the rows."""
    from kinetable.operators import interpolate
    rows = spark.createDataFrame([(0, f, v, float(f * v), float(f), 0.0) for f in range(4) for v in range(5) if (f, v) != (2, 4)],
                                 "seq_id long, frame_id long, vertex_id long, x double, y double, z double")
    pairs = spark.createDataFrame([(0, 0, 1), (0, 1, 2), (0, 0, 3), (0, 3, 0), (0, 1, 1), (0, 3, 4)], "seq_id long, frame_a long, frame_b long")
    out = interpolate.interpolate_unified(rows.withColumn("z", F.xxhash64("vertex_id") * 0.0), pairs, 2)
    assert out._jdf.queryExecution().optimizedPlan().toString().count("xxhash64") == 1
    want = {(a, b, s, v): a * v + s / 2 * (b - a) * v for a, b in ((0, 1), (1, 2), (0, 3), (3, 0), (1, 1)) for s in range(3) for v in range(5)
            if (2, 4) not in ((a, v), (b, v))}
    assert {(r.frame_a, r.frame_b, r.step, r.vertex_id): r.x for r in out.collect()} == want


@pytest.mark.parametrize("n", [1, 3, 16])
def test_rows_of_many_numbers_meet_few_exactly(monkeypatch, n):
    """rows of many numbers that lie on a line or surface; copies, ties, far rows and an offset included."""
    exact = []
    monkeypatch.setattr(knn, "_squares", lambda a, b, real=knn._squares: exact.append(len(a) * len(b)) or real(a, b))
    rng = np.random.default_rng(21)
    joints = rng.normal(size=(9, 3))
    features = lambda p, j: np.concatenate([p, np.exp(-np.linalg.norm(p[:, None] - j, axis=2))], axis=1)
    a, b = (features(rng.uniform(-1, 1, (m, 3)) * [1, 0.01, 0.01], j) for m, j in ((2000, joints), (5000, joints + 0.3)))
    wide = [(a, b), (a[:300] + 1e6, b + 1e6), (rng.integers(0, 2, (200, 9)) * 1.0, rng.integers(0, 2, (900, 9)) * 1.0),
            (np.concatenate([a[:50], a[:1] * 0 + 1e12]), np.concatenate([b[:400], b[:400], b[:1] * 0 - 1e12])), (a[:40] * 0, b[:600] * 0)]
    for i, (a, b) in enumerate(wide):
        exact.clear()
        got = list(knn._nearest(a, b, n))
        few = sum(exact)
        d2 = np.zeros((len(a), len(b)))
        for x in range(a.shape[1]):
            d2 += (a[:, x, None] - b[:, x]) ** 2
        want = np.argsort(d2, axis=1, kind="stable")[:, :n]
        assert sorted(np.concatenate([r for r, _, _ in got])) == list(range(len(a)))
        assert all((at == want[r]).all() and (value == np.take_along_axis(d2, want, axis=1)[r]).all() for r, at, value in got)
        assert i or few < len(a) * len(b) / 10


def test_chain_steps_are_a_task_a_frame(spark, monkeypatch):
    """no features are shuffled and no neighbour join runs for frames that fit a task; a step writes one table."""
    labels = []

    def none(*a, **k):
        raise AssertionError("features go through a join")

    monkeypatch.setattr(co, "feature_nearest", none)
    monkeypatch.setattr(co, "cut", lambda df, label="state", by=None, real=co.cut: labels.append(label) or real(df, label, by))
    rng = np.random.default_rng(22)
    rows = [(0, f, v, *map(float, rng.normal(size=3))) for f in range(3) for v in range(20 + f)]
    points = spark.createDataFrame(rows, "seq_id long, frame_id long, vertex_id long, x double, y double, z double")
    joints = points.where("vertex_id < 4").withColumnRenamed("vertex_id", "k")
    rest = spark.createDataFrame([(0, 1)], "seq_id long, frame_id long")
    got = {(r.frame_id, r["count"]) for r in co.unify_chain(points, joints, rest).groupBy("frame_id").count().collect()}
    assert got == {(0, 21), (1, 21), (2, 21)} and labels == ["chain-rows", "chain"]
    nxt = points.where("frame_id >= 1").selectExpr("seq_id", "frame_id - 1 as frame_id", "vertex_id", "x", "y", "z")
    nj = joints.where("frame_id >= 1").selectExpr("seq_id", "frame_id - 1 as frame_id", "k", "x", "y", "z")
    assert co.bone_guided_remap(points, nxt, joints, nj, ["seq_id", "frame_id"]).count() == 20 + 21
