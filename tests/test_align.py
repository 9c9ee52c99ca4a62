"""Registration: the work list, the rounds inside tasks and plain NumPy take the same steps."""

import numpy as np

from kinetable.operators import skin


def turn(a: float) -> np.ndarray:
    return np.array([[np.cos(a), -np.sin(a), 0], [np.sin(a), np.cos(a), 0], [0, 0, 1]])


def thin(p: np.ndarray, size: float) -> np.ndarray:
    cells, which = np.unique(np.floor(p / size), axis=0, return_inverse=True)
    return np.stack([p[which.ravel() == i].mean(axis=0) for i in range(len(cells))])


def plain(source: np.ndarray, target: np.ndarray, stages: list) -> np.ndarray:
    for size, reach, rounds in stages:
        p, q = (source, target) if size is None else (thin(source, size), thin(target, size))
        r, t = np.eye(3), np.zeros(3)
        for _ in range(rounds):
            at = p @ r.T + t
            d = np.linalg.norm(at[:, None] - q, axis=2)
            met = d.min(axis=1) <= reach
            if not met.any():
                break
            a, b = at[met], q[d.argmin(axis=1)[met]]
            ca, cb = a.mean(axis=0), b.mean(axis=0)
            u, _, vt = np.linalg.svd((a - ca).T @ (b - cb))
            m = vt.T @ np.diag([1, 1, np.sign(np.linalg.det(vt.T @ u.T))]) @ u.T
            s = cb - m @ ca
            r, t = m @ r, m @ t + s
            if np.abs(np.diag(m) - 1).sum() + np.abs(s).sum() < 1e-6:
                break
        source = source @ r.T + t
    return source


def moved(df) -> dict:
    out: dict = {}
    for r in df.orderBy("frame_id", "vertex_id").collect():
        out.setdefault(r.frame_id, []).append((r.x, r.y, r.z))
    return {f: np.array(v) for f, v in out.items()}


def test_work_list_equals_plain_rounds(spark, cloud):
    """Frames that settle in one round, after some, and never; one without target, one target without source."""
    rng = np.random.default_rng(11)
    base = rng.uniform(-1, 1, (5, 90, 3))
    source = np.stack([base[0], base[1] @ turn(0.05).T + [0.04, -0.02, 0.01], base[2] @ turn(0.2).T, base[3] + 0.3, base[4]])
    target = cloud(base).where("frame_id <> 4").unionByName(cloud(base[:1], first=9))
    want = [plain(source[f], base[f], [(0.2, 0.4, 6), (None, 0.2, 8)]) for f in range(4)] + [source[4]]
    for small in (1000, 0):
        got = moved(skin.rigid_align(cloud(source), target, scales=(0.2,), iterations=6, final_size=0.2, final_iterations=8, small=small))
        assert sorted(got) == [0, 1, 2, 3, 4]
        assert all(np.abs(got[f] - want[f]).max() < 1e-6 for f in range(5)), small
    assert np.abs(want[1] - base[1]).max() < 1e-5


def test_small_and_large_frames_together(spark, cloud):
    rng = np.random.default_rng(12)
    base = rng.uniform(-1, 1, (1, 400, 3))
    few = cloud(base).where("vertex_id < 50").withColumnRenamed("seq_id", "s").selectExpr("'few' as seq_id", "frame_id", "vertex_id", "x", "y", "z")
    shifted = lambda df: df.selectExpr("seq_id", "frame_id", "vertex_id", "x + 0.01 as x", "y", "z - 0.01 as z")
    both = cloud(base).unionByName(few)
    got = skin.rigid_align(shifted(both), both, scales=(), final_size=0.1, final_iterations=9, small=100)
    off = got.withColumnsRenamed({c: f"g{c}" for c in "xyz"}).join(both, ["seq_id", "frame_id", "vertex_id"])
    assert off.count() == 450 and off.where("abs(gx - x) + abs(gy - y) + abs(gz - z) > 1e-9").count() == 0


def test_nothing_to_register(spark, cloud):
    none = cloud(np.zeros((1, 1, 3))).limit(0)
    assert skin.rigid_align(none, none).count() == 0
    one = cloud(np.ones((1, 3, 3)))
    assert moved(skin.rigid_align(one, none))[0].tolist() == np.ones((3, 3)).tolist()


def test_dense_frames_compare_few_points_a_round(monkeypatch):
    """where all points lie within some reaches of each other, a point meets few of them, and again only if it must."""
    met = []
    real = skin._Grid._meet
    monkeypatch.setattr(skin._Grid, "_meet", lambda self, p, rows, lo, n, *a: met.append(int(n.sum())) or real(self, p, rows, lo, n, *a))
    rng = np.random.default_rng(14)
    q = rng.uniform(0, 1, (4000, 3)) * [1, 0.01, 0.01]
    p = rng.uniform(0, 1, (3000, 3)) * [1, 0.01, 0.01]
    d2 = ((p[:, None] - q) ** 2).sum(axis=2)
    cells = skin._Cells(q, 0.05)
    assert (cells.nearest(p) == d2.argmin(axis=1)).all()
    assert sum(met) < 100 * len(p)  # some 400 by cells as wide as the reach
    follow = skin._Followed(cells, len(p))
    for shift in (0.0, 1e-6, 2e-6, 0.001, 0.3, 9.0):
        met.clear()
        at = p + [shift, -shift, 0]
        d2 = ((at[:, None] - q) ** 2).sum(axis=2)
        assert (follow.nearest(at) == np.where(d2.min(axis=1) <= 0.05 ** 2, d2.argmin(axis=1), -1)).all()
        assert not 0 < shift < 1e-5 or sum(met) < 5 * len(p)
