"""Skinning and registration: blending, bone motions, rigid alignment."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, functions as F, types as T
from pyspark.sql.functions import pandas_udf

from ..functions.rotation import det3, matmul3, matvec3
from ..functions.space import apply_affine, norm3
from ..plans.knn import _positions, _sides, _unpacked, knn_join, packed
from ..plans.lineage import cut, sized
from ..plans.tiles import tile_join
from ..schema import FRAME
from .clips import voxel_downsample

MIN_WEIGHT = 1e-6


def _packed_vertices(rest: DataFrame, weights: DataFrame) -> DataFrame:
    """Rest vertices with their few weights as an array in bone order; a vertex without weights has an empty one."""
    packed = weights.where(F.col("w") > MIN_WEIGHT).groupBy("seq_id", "vertex_id").agg(
        F.sort_array(F.collect_list(F.struct("k", "w"))).alias("ws"))
    out = rest.select("seq_id", "vertex_id", "x", "y", "z").join(packed, ["seq_id", "vertex_id"], "left")
    # written, as tiles need the vertices twice: for the runs of ids and for the rows
    return cut(out.withColumn("ws", F.coalesce("ws", F.array().cast(packed.schema["ws"].dataType))), "skin-vertices")


def _of_bone(table: Column, k: Column) -> Column:
    """The value of bone ``k`` in a frame's map; a bone that the frame lacks is an error, never another bone's value."""
    missing = F.raise_error(F.concat(F.lit("no transform of bone "), k.cast("string")))
    return F.when(F.map_contains_key(table, k), F.try_element_at(table, k)).otherwise(missing)


def _blend(ws: Column, table: Column, term) -> Column:
    """Sum over the weights of w * term(t) where t is the bone's value in ``table``, looked up once, and term gives (x, y, z)."""
    found = F.transform(ws, lambda e: F.struct(e["w"].alias("w"), _of_bone(table, e["k"]).alias("t")))
    start = F.struct(*[F.lit(0.0).alias(c) for c in "xyz"])
    return F.aggregate(found, start, lambda acc, e: F.struct(*[(acc[c] + e["w"] * v).alias(c) for c, v in zip("xyz", term(e["t"]))]))


def linear_blend_skin(rest: DataFrame, weights: DataFrame, transforms: DataFrame) -> DataFrame:
    """p' = sum_k w_k (M_k [p, 1]) for every frame of ``transforms(seq_id, frame_id, k, m)``.

    Bones are found by their number, which may have gaps; a weight on a bone that a frame has no matrix for raises.
    A vertex without weights keeps its rest position.

    The weights of a vertex and the matrices of a frame are packed first (both bounded by the bone count), so
    each result row comes from one tiled join and a projection; nothing is shuffled after it.
    """
    frames = transforms.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("k", "m"))).alias("ms"))
    frames = sized(frames, "skin-frames")
    met = tile_join(_packed_vertices(rest, weights), frames, "vertex_id", "frame_id")
    term = lambda m: apply_affine(m, F.col("x"), F.col("y"), F.col("z"))
    bound = F.size("ws") > 0
    return met.withColumn("p", _blend(F.col("ws"), F.col("ms"), term)).select(
        *FRAME, "vertex_id", *[F.when(bound, F.col(f"p.{c}")).otherwise(F.col(c)).alias(c) for c in "xyz"])


def translation_skin(rest: DataFrame, weights: DataFrame, moves: DataFrame) -> DataFrame:
    """p' = rest + sum_k w_k move_k for every frame of ``moves(seq_id, frame_id, k, x, y, z)``.
    At zero movement the result is the rest pose; so it is for a vertex without weights."""
    frames = moves.groupBy(*FRAME).agg(F.map_from_entries(F.collect_list(F.struct("k", F.struct("x", "y", "z")))).alias("js"))
    frames = sized(frames, "skin-frames")
    met = tile_join(_packed_vertices(rest, weights), frames, "vertex_id", "frame_id")
    shift = _blend(F.col("ws"), F.col("js"), lambda j: (j["x"], j["y"], j["z"]))
    return met.withColumn("d", shift).select(*FRAME, "vertex_id", *[(F.col(c) + F.col(f"d.{c}")).alias(c) for c in "xyz"])


def joint_moves(joints: DataFrame, reference: DataFrame) -> DataFrame:
    """Joint position minus the same joint of ``reference(seq_id, k, x, y, z)``."""
    ref = reference.select("seq_id", "k", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return joints.join(ref, ["seq_id", "k"]).select(*FRAME, "k", *[(F.col(c) - F.col(f"r{c}")).alias(c) for c in "xyz"])


def bone_translations(joints: DataFrame, reference: DataFrame) -> DataFrame:
    """Affine matrices that only move each joint from its reference position."""
    one, zero = F.lit(1.0), F.lit(0.0)
    m = F.array(one, zero, zero, F.col("x"), zero, one, zero, F.col("y"), zero, zero, one, F.col("z"))
    return joint_moves(joints, reference).select(*FRAME, "k", m.alias("m"))


def identity_transforms(frames: DataFrame, bones: DataFrame) -> DataFrame:
    """The identity for every bone of every frame."""
    values = (1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0, 0.0, 0.0, 0.0, 1.0, 0.0)
    ks = bones.agg(F.sort_array(F.collect_set("k")).alias("ks")).scalar()  # one small array
    return frames.select(*FRAME, F.explode(ks).alias("k"), F.array(*[F.lit(v) for v in values]).alias("m"))


def deform_to_frames(rest: DataFrame, weights: DataFrame, joints: DataFrame, template: DataFrame) -> DataFrame:
    """The template moved to every frame by its joints; the template frame itself passes through unchanged."""
    t = template.select("seq_id", F.col("frame_id").alias("_tf"))
    ref = joints.join(t, "seq_id").where(F.col("frame_id") == F.col("_tf")).select("seq_id", "k", "x", "y", "z")
    others = joints.join(t, "seq_id").where(F.col("frame_id") != F.col("_tf")).drop("_tf")
    own = rest.select("seq_id", "vertex_id", "x", "y", "z").join(t, "seq_id").select(
        "seq_id", F.col("_tf").alias("frame_id"), "vertex_id", "x", "y", "z")
    return linear_blend_skin(rest, weights, bone_translations(others, ref)).unionByName(own)


def reconstruction_error(deformed: DataFrame, actual: DataFrame) -> DataFrame:
    other = actual.select(*FRAME, "vertex_id", *[F.col(c).alias(f"a{c}") for c in "xyz"])
    gap = norm3(*[F.col(c) - F.col(f"a{c}") for c in "xyz"])
    return deformed.join(other, [*FRAME, "vertex_id"]).groupBy(*FRAME).agg(
        F.avg(gap).alias("mean_error"), F.max(gap).alias("max_error"))


def deformation_magnitude(points: DataFrame, rest: DataFrame) -> DataFrame:
    r = rest.select("seq_id", "vertex_id", *[F.col(c).alias(f"r{c}") for c in "xyz"])
    return points.join(r, ["seq_id", "vertex_id"]).select(
        *FRAME, "vertex_id", norm3(*[F.col(c) - F.col(f"r{c}") for c in "xyz"]).alias("magnitude"))


def transform_validity(transforms: DataFrame) -> DataFrame:
    """Share of matrices per sequence whose determinant is within 0.1 of +1 or -1."""
    ok = F.abs(F.abs(det3(F.col("m"), 4)) - 1) < 0.1
    return transforms.groupBy("seq_id").agg(F.avg(ok.cast("double")).alias("validity"), F.count(F.lit(1)).alias("n"))


@pandas_udf(T.ArrayType(T.DoubleType()))
def rotation_from_covariance(h: pd.Series) -> pd.Series:
    """Proper rotation that best turns the source into the target, from the 3x3 covariance source x target."""
    if len(h) == 0:
        return pd.Series([], dtype=object)
    return pd.Series(list(rotations(np.stack(h.to_numpy()).reshape(-1, 3, 3)).reshape(-1, 9)))


def rotations(m: np.ndarray) -> np.ndarray:
    """Proper rotations [..., 3, 3] that best turn sources into targets, from covariances source x target."""
    u, _, vt = np.linalg.svd(m)
    v, ut = np.swapaxes(vt, -1, -2), np.swapaxes(u, -1, -2)
    d = np.ones(m.shape[:-1])
    d[..., 2] = np.where(np.linalg.det(v @ ut) < 0, -1.0, 1.0)
    return (v * d[..., None, :]) @ ut


def rigid_fit(pairs: DataFrame, keys: list[str]) -> DataFrame:
    """Weighted rigid motion from p to q per key: r (3x3) and t with q ~ r p + t.

    ``pairs`` has px..pz, qx..qz and w.  Only 16 sums per key leave the map tasks, so a group of any size is
    cheap; the decomposition runs on one 3x3 matrix per key.
    """
    w = F.col("w")
    sums = [F.sum(w).alias("sw")]
    sums += [F.sum(w * F.col(f"{s}{c}")).alias(f"s{s}{c}") for s in "pq" for c in "xyz"]
    sums += [F.sum(w * F.col(f"p{a}") * F.col(f"q{b}")).alias(f"h{a}{b}") for a in "xyz" for b in "xyz"]
    g = pairs.groupBy(*keys).agg(*sums).where("sw > 0")
    h = F.array(*[F.col(f"h{a}{b}") - F.col(f"sp{a}") * F.col(f"sq{b}") / F.col("sw") for a in "xyz" for b in "xyz"])
    g = g.withColumn("r", rotation_from_covariance(h))
    turned = matvec3(F.col("r"), *[F.col(f"sp{c}") / F.col("sw") for c in "xyz"])
    return g.select(*keys, "r", *[(F.col(f"sq{c}") / F.col("sw") - v).alias(f"t{c}") for c, v in zip("xyz", turned)])


def fit_bone_motion(points: DataFrame, rest: DataFrame, weights: DataFrame) -> DataFrame:
    """Rigid motion of every bone in every frame: weighted fit of the rest vertices to the frame's vertices.

    Bones are those of ``weights``, also at weight zero.  A bone without a bound vertex in a frame does not move there."""
    r = rest.select("seq_id", "vertex_id", *[F.col(c).alias(f"p{c}") for c in "xyz"])
    bound = weights.where(F.col("w") > MIN_WEIGHT).join(r, ["seq_id", "vertex_id"])
    q = points.select(*FRAME, "vertex_id", *[F.col(c).alias(f"q{c}") for c in "xyz"])
    fit = rigid_fit(q.join(bound, ["seq_id", "vertex_id"]), [*FRAME, "k"])
    every = points.select(*FRAME).distinct().join(weights.select("seq_id", "k").distinct(), "seq_id")
    still = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    fit = every.join(fit, [*FRAME, "k"], "left").withColumn("r", F.coalesce("r", still)).fillna(0.0, ["tx", "ty", "tz"])
    from ..functions.rotation import compose
    return fit.select(*FRAME, "k", "r", "tx", "ty", "tz", compose(F.col("r"), F.col("tx"), F.col("ty"), F.col("tz")).alias("m"))


#: Frames with at most this many points on both sides are registered inside one task.
SMALL_CLOUD = 1 << 19
_MOTION = ["r", "tx", "ty", "tz"]


def rigid_align(source: DataFrame, target: DataFrame, scales: tuple = (0.05, 0.02, 0.01), iterations: int = 50,
                final_size: float = 0.005, final_iterations: int = 100, tolerance: float = 1e-6,
                small: int = SMALL_CLOUD) -> DataFrame:
    """Multi-scale point-to-point registration of ``source`` to ``target`` in every frame at once: moved source points.

    Each scale works on both clouds thinned to one point per cell and pairs points within twice the cell size;
    the last stage uses all points within ``final_size``.  A frame leaves a stage once it moves by no more than
    ``tolerance``, or finds no pair.  A frame without target points stays where it is.

    What goes from round to round is one motion per frame; points are moved once a stage.  Frames whose two clouds have at
    most ``small`` points run their rounds inside one task each, all of them in one job.  The others are a work list: a
    round is one neighbour join of the frames that still move, 16 sums and a 3x3 decomposition per frame.  Both go by the
    same steps, so ``small`` changes no result beyond the last bits.
    """
    source = cut(source.select(*FRAME, "vertex_id", "x", "y", "z"), "align")
    target = cut(target.select(*FRAME, "vertex_id", "x", "y", "z"), "align-target")
    motion: DataFrame | None = None
    for size, reach, rounds in [(s, 2 * s, iterations) for s in scales] + [(None, final_size, final_iterations)]:
        moved = source if motion is None else _move(source, motion)
        moving, fixed = (df if size is None else cut(_thin(df, size), "align-thin") for df in (moved, target))
        moving = cut(moving, "align-moving") if size is None else moving
        step = cut(_register(moving, fixed, reach, rounds, tolerance, small), "align-motion")
        motion = step if motion is None else cut(_then(motion, step), "align-motion")
    return _move(source, motion)


def _thin(points: DataFrame, size: float) -> DataFrame:
    return voxel_downsample(points, size).select(*FRAME, _cell_id().alias("vertex_id"), "x", "y", "z")


def _register(moving: DataFrame, fixed: DataFrame, reach: float, rounds: int, tolerance: float, small: int) -> DataFrame:
    """The motion of every frame with points on both sides that brings ``moving`` onto ``fixed``."""
    count = lambda df, name: df.groupBy(*FRAME).agg(F.count(F.lit(1)).alias(name))
    sizes = cut(count(moving, "n").join(count(fixed, "m"), FRAME), "align-sizes")
    little = F.greatest("n", "m") <= small
    most = sizes.agg(*[F.max(F.when(~little, F.col(c))) for c in "nm"], F.count(F.when(little, 1))).first()
    few = sizes.where(little).select(*FRAME)
    done = _register_in_tasks(moving.join(few, FRAME, "left_semi"), fixed.join(few, FRAME, "left_semi"), most[2], reach, rounds, tolerance)
    if most[0] is None:
        return done
    still = F.array(*[F.lit(1.0 if i % 4 == 0 else 0.0) for i in range(9)])
    zero = F.lit(0.0)
    active = cut(sizes.where(~little).select(*FRAME, still.alias("r"), zero.alias("tx"), zero.alias("ty"), zero.alias("tz")), "align-active")
    moving, fixed = (cut(df.join(active.select(*FRAME), FRAME, "left_semi"), "align-large") for df in (moving, fixed))
    settled = []
    for _ in range(rounds):
        there = fixed.join(active.select(*FRAME), FRAME, "left_semi")
        hit = knn_join(_move(moving, active, "inner"), there, FRAME, 1, sizes=(most[0], most[1]), own=True).where(F.col("d2") <= reach * reach)
        pairs = hit.select(*FRAME, *[F.col(f"l{c}").alias(f"p{c}") for c in "xyz"], *[F.col(f"r{c}").alias(f"q{c}") for c in "xyz"], F.lit(1.0).alias("w"))
        step = cut(rigid_fit(pairs, FRAME), "align-step")
        turn = F.abs(F.col("r")[0] - 1) + F.abs(F.col("r")[4] - 1) + F.abs(F.col("r")[8] - 1)
        moves = step.where(turn + F.abs("tx") + F.abs("ty") + F.abs("tz") >= tolerance).select(*FRAME, F.lit(True).alias("moves"))
        state = cut(_then(active, step).join(moves, FRAME, "left"), "align-active")
        settled.append(state.where("moves IS NULL").select(*FRAME, *_MOTION))
        active = state.where("moves").select(*FRAME, *_MOTION)
        if active.isEmpty():
            break
    for part in [*settled, active]:
        done = done.unionByName(part)
    return done


def _register_in_tasks(moving: DataFrame, fixed: DataFrame, frames: int, reach: float, rounds: int, tolerance: float) -> DataFrame:
    """The same rounds for the ``frames`` of few points, a frame at a time."""
    import pyarrow as pa

    kinds = {f.name: f for f in moving.schema.fields}
    schema = T.StructType([*[kinds[c] for c in FRAME], T.StructField("r", T.ArrayType(T.DoubleType())),
                           *[T.StructField(c, T.DoubleType()) for c in ("tx", "ty", "tz")]])

    def run(left: pa.Table, right: pa.Table) -> pa.Table:
        left, right = _unpacked(left, FRAME), _unpacked(right, [f"_of_{c}" for c in FRAME])
        if not left.num_rows or not right.num_rows:
            return pa.table({c: left.column(c).slice(0, 0) for c in FRAME} | {
                "r": pa.array([], pa.list_(pa.float64())), **{c: pa.array([], pa.float64()) for c in ("tx", "ty", "tz")}})
        right = right.sort_by("vertex_id")
        p, q = (np.stack([t.column(c).to_numpy() for c in "xyz"], axis=1) for t in (left, right))
        order, number, start = _positions(p)
        copy_of = np.empty(len(p), np.int64)
        copy_of[order] = number
        first = order[start]  # copies of a point go the same way
        nearest = _Followed(_Cells(q, reach), len(first)).nearest
        r, t = np.eye(3), np.zeros(3)
        for _ in range(rounds):
            at = p @ r.T + t
            near = nearest(at[first])[copy_of]
            met = near >= 0
            if not met.any():
                break
            turn, shift = _best_motion(at[met], q[near[met]])
            r, t = turn @ r, turn @ t + shift
            if np.abs(np.diag(turn) - 1).sum() + np.abs(shift).sum() < tolerance:
                break
        return pa.table({**{c: left.column(c).slice(0, 1) for c in FRAME}, "r": pa.array([r.ravel().tolist()], pa.list_(pa.float64())),
                         **{f"t{c}": pa.array([float(v)]) for c, v in zip("xyz", t)}})

    a, b = _sides(*[packed(df.select(*FRAME, "vertex_id", "x", "y", "z"), FRAME, frames) for df in (moving, fixed)], FRAME)
    return a.cogroup(b).applyInArrow(run, schema)


class _Cells:
    """The nearest points of one frame within ``reach``, by cells of several widths: a point looks into its cell and those
    beside it, the narrowest first, where few points are; one without a hit within that width goes on to the next width."""

    def __init__(self, q: np.ndarray, reach: float, batch: int = 1 << 20) -> None:
        order, _, start = _positions(q)
        row = order[start]  # of equal points the first
        self.q, self.reach = q, reach
        # wider than the reach by a factor, so that a point without a hit may move a little before it is sought again
        self.grids = [_Grid(q, row, 2 * reach, batch)]
        while self.grids[-1].crowd > CROWD and np.isfinite(self.grids[-1].width):
            finer = _Grid(q, row, self.grids[-1].width / 2, batch)
            if not np.isfinite(finer.width) or len(self.grids) == 40:
                break
            self.grids.append(finer)

    def search(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Row of the nearest point, the first on ties, or -1 without one within twice the reach; and a distance below
        which there is no other."""
        found, apart = np.full(len(p), -1), np.full(len(p), self.grids[0].width)
        rows = np.arange(len(p))
        for grid in reversed(self.grids):
            at, best, second = grid.meet(p[rows])
            hit = best <= grid.width ** 2
            found[rows[hit]], apart[rows[hit]] = at[hit], np.minimum(np.sqrt(second[hit]), grid.width)
            rows = rows[~hit]
            if not len(rows):
                break
        return found, apart

    def within(self, p: np.ndarray, found: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """``found`` without what is beyond the reach, and the distance to it, or the reach."""
        d2 = ((p - self.q[found]) ** 2).sum(axis=1)
        some = found >= 0
        return np.where(some & (d2 <= self.reach * self.reach), found, -1), np.where(some, np.sqrt(d2), self.reach)

    def nearest(self, p: np.ndarray) -> np.ndarray:
        """Row of the nearest point within ``reach``, the first on ties; -1 without one."""
        return self.within(p, self.search(p)[0])[0]


#: Points of a cell, as its points see it, from which there are cells of half the width.
CROWD = 4


class _Grid:
    """Points by cells of one width; all in one cell if they are so far off that cells cannot be numbered."""

    def __init__(self, q: np.ndarray, row: np.ndarray, width: float, batch: int) -> None:
        self.batch, self.width = batch, width
        self.step = width * (1 + 1e-9)
        self.low = np.floor(q[row].min(axis=0) / self.step)
        cells = np.floor(q[row] / self.step) - self.low
        self.size = cells.max(axis=0) + 1
        if np.prod(self.size) >= 2.0 ** 62:
            self.width, self.low, self.size, cells = np.inf, np.zeros(3), np.ones(3), np.zeros_like(cells)
        code = self._code(cells)
        by = np.lexsort((row, code))
        self.row, self.code, self.q = row[by], code[by], q[row[by]]
        many = np.diff(np.flatnonzero(np.concatenate([[True], self.code[1:] != self.code[:-1], [True]]))).astype(float)
        self.crowd = (many * many).sum() / many.sum()

    def _code(self, cells: np.ndarray) -> np.ndarray:
        n = self.size.astype(np.int64)
        c = cells.astype(np.int64)
        return (c[:, 0] * n[1] + c[:, 1]) * n[2] + c[:, 2]

    def meet(self, p: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Row and squared distance of the nearest point in the cells around each of ``p``, and that of the second one."""
        found, best, second = np.full(len(p), -1), np.full(len(p), np.inf), np.full(len(p), np.inf)
        at = np.zeros_like(p) if np.isinf(self.width) else np.clip(np.floor(p / self.step) - self.low, -2, self.size + 1)
        for dx in (-1, 0, 1):
            for dy in (-1, 0, 1):
                lane = at + [dx, dy, 0]
                ok = np.flatnonzero(((lane[:, :2] >= 0) & (lane[:, :2] < self.size[:2])).all(axis=1) & (lane[:, 2] >= -1) & (lane[:, 2] <= self.size[2]))
                lane = lane[ok]
                below, above = lane.copy(), lane.copy()
                below[:, 2], above[:, 2] = np.maximum(lane[:, 2] - 1, 0), np.minimum(lane[:, 2] + 1, self.size[2] - 1)
                lo = np.searchsorted(self.code, self._code(below), side="left")
                n = np.searchsorted(self.code, self._code(above), side="right") - lo
                ok, lo, n = ok[n > 0], lo[n > 0], n[n > 0]
                ends = np.cumsum(n)
                s = 0
                while s < len(ok):  # some candidates at a time
                    e = max(s + 1, int(np.searchsorted(ends, (ends[s - 1] if s else 0) + self.batch, side="right")))
                    self._meet(p, ok[s:e], lo[s:e], n[s:e], found, best, second)
                    s = e
        return found, best, second

    def _meet(self, p: np.ndarray, rows: np.ndarray, lo: np.ndarray, n: np.ndarray, found: np.ndarray, best: np.ndarray, second: np.ndarray) -> None:
        start = np.cumsum(n) - n
        col = np.arange(n.sum()) + np.repeat(lo - start, n)
        d2 = ((np.repeat(p[rows], n, axis=0) - self.q[col]) ** 2).sum(axis=1)
        low = np.minimum.reduceat(d2, start)
        first = np.minimum.reduceat(np.where(d2 == np.repeat(low, n), self.row[col], np.iinfo(np.int64).max), start)
        d2[self.row[col] == np.repeat(first, n)] = np.inf
        next_ = np.minimum.reduceat(d2, start)
        better = (low < best[rows]) | ((low == best[rows]) & (first < found[rows]))
        second[rows] = np.minimum(np.minimum(second[rows], next_), np.maximum(best[rows], low))
        best[rows[better]], found[rows[better]] = low[better], first[better]


class _Followed:
    """The nearest points of points that move round by round.  One is sought again only if another may have become the
    nearest: not while its distance and the way gone since are less than the distance of all others was then."""

    def __init__(self, cells: _Cells, n: int) -> None:
        self.cells, self.found, self.apart, self.since = cells, np.full(n, -1), np.full(n, -np.inf), np.zeros((n, 3))

    def nearest(self, p: np.ndarray) -> np.ndarray:
        near, d = self.cells.within(p, self.found)
        gone = np.sqrt(((p - self.since) ** 2).sum(axis=1))
        again = np.flatnonzero(~((d + gone) * (1 + 1e-9) < self.apart))
        if len(again):
            self.found[again], self.apart[again] = self.cells.search(p[again])
            self.since[again] = p[again]
            near[again] = self.cells.within(p[again], self.found[again])[0]
        return near


def _best_motion(p: np.ndarray, q: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    cp, cq = p.mean(axis=0), q.mean(axis=0)
    turn = rotations((p - cp).T @ (q - cq))
    return turn, cq - turn @ cp


def _then(first: DataFrame, second: DataFrame) -> DataFrame:
    """One motion per frame of ``first``: it and then that of ``second``, where there is one."""
    s = second.select(*FRAME, *[F.col(c).alias(f"_{c}") for c in _MOTION])
    turned = matvec3(F.col("_r"), F.col("tx"), F.col("ty"), F.col("tz"))
    none = F.col("_r").isNull()
    return first.join(s, FRAME, "left").select(
        *FRAME, F.when(none, F.col("r")).otherwise(matmul3(F.col("_r"), F.col("r"))).alias("r"),
        *[F.when(none, F.col(c)).otherwise(v + F.col(f"_{c}")).alias(c) for c, v in zip(("tx", "ty", "tz"), turned)])


def _cell_id() -> Column:
    """One number per cell of a frame, exact for cell numbers within +-2^20 (a cell of a thousandth in a box of a thousand);
    beyond that the numbers' text is hashed."""
    half = 1 << 20
    packed = F.lit(0).cast("long")
    inside = F.lit(True)
    for c in ("ci", "cj", "ck"):
        packed = packed * (2 * half) + F.col(c).cast("long") + half
        inside = inside & F.col(c).between(-half, half - 1)
    far = F.conv(F.substring(F.md5(F.concat_ws(":", "ci", "cj", "ck")), 1, 15), 16, 10).cast("long")
    return F.when(inside, packed).otherwise(-1 - far)


def _move(points: DataFrame, motion: DataFrame, how: str = "left") -> DataFrame:
    """Apply each frame's rigid motion; frames without one stay, or go where ``how`` is inner."""
    m = motion.select(*FRAME, *_MOTION)
    j = points.join(m, FRAME, how)
    turned = matvec3(F.col("r"), F.col("x"), F.col("y"), F.col("z"))
    return j.select(*FRAME, "vertex_id", *[
        F.when(F.col("r").isNull(), F.col(c)).otherwise(v + F.col(f"t{c}")).alias(c) for c, v in zip("xyz", turned)])
