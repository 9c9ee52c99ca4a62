"""In-between frames: direct, weighted, skeletal, pose and spline interpolation.

``pairs(seq_id, frame_a, frame_b)`` lists the frame pairs; all pairs of all sequences run as one job and every
result row carries its pair, its step and t.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions import names
from ..functions.rotation import add_nlerp, add_slerp, compose, quat_to_matrix
from ..functions.space import from_unit, lerp
from ..plans.lineage import cut, sized
from ..plans.ranking import position_by_id
from ..schema import FRAME
from .correspondence import match_frames
from .skin import linear_blend_skin, translation_skin

PAIR = ["seq_id", "frame_a", "frame_b"]


def consecutive_pairs(frames: DataFrame) -> DataFrame:
    """(t, t + 1) for every frame that has a successor; frame ids are dense."""
    last = frames.groupBy("seq_id").agg(F.max("frame_id").alias("_last"))
    return frames.select(*FRAME).distinct().join(last, "seq_id").where(F.col("frame_id") < F.col("_last")).select(
        "seq_id", F.col("frame_id").alias("frame_a"), (F.col("frame_id") + 1).alias("frame_b"))


def of_frame(df: DataFrame, pairs: DataFrame, which: str) -> DataFrame:
    """Rows of the pair's first (``frame_a``) or second frame, keyed by the pair."""
    return df.withColumnRenamed("frame_id", which).join(pairs, ["seq_id", which])


def with_steps(df: DataFrame, steps: int) -> DataFrame:
    """One row per step 0 .. steps with t = step / steps."""
    return df.withColumn("step", F.explode(F.sequence(F.lit(0), F.lit(steps)))).withColumn("t", F.col("step") / float(steps))


def to_world(df: DataFrame, box: DataFrame) -> DataFrame:
    """Normalised results back to world units with the box of frame a."""
    b = box.select("seq_id", F.col("frame_id").alias("frame_a"), "bmin_x", "bmin_y", "bmin_z", "blen")
    return df.join(b, ["seq_id", "frame_a"]).withColumns(
        {c: from_unit(F.col(c), F.col(f"bmin_{c}"), F.col("blen")) for c in "xyz"}).drop("bmin_x", "bmin_y", "bmin_z", "blen")


def interpolate_direct(points: DataFrame, pairs: DataFrame, steps: int, method: str = "nearest", shared_topology: str = "equal_count") -> DataFrame:
    """Straight lines from frame a's vertices to their matches in frame b (``nearest`` or ``idw``); ``shared_topology`` says
    which frames match by id (``match_frames``)."""
    return with_steps(matched_pairs(points, pairs, method, shared_topology), steps).select(
        *PAIR, "step", "t", "vertex_id", *[lerp(F.col(c), F.col(f"b{c}"), F.col("t")).alias(c) for c in "xyz"])


def matched_pairs(points: DataFrame, pairs: DataFrame, method: str = "nearest", shared_topology: str = "equal_count") -> DataFrame:
    """Frame a's vertices with their matches in frame b (bx, by, bz), keyed by the pair."""
    pairs = sized(pairs, "pairs")
    a, b = of_frame(points, pairs, "frame_a"), of_frame(points, pairs, "frame_b")
    pick = lambda df: df.select(*PAIR, "vertex_id", "x", "y", "z")
    return match_frames(pick(a), pick(b), PAIR, method, shared_topology=shared_topology)


def _numbered(pairs: DataFrame) -> DataFrame:
    """Pairs with a dense number inside their sequence, so they can be tiled."""
    return position_by_id(pairs.select(*PAIR), ["seq_id"], ["frame_a", "frame_b"], "pair")


def interpolate_skeleton(rest: DataFrame, weights: DataFrame, joints: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    """Rest pose moved by the blended joint translations from frame a towards frame b; t = 0 is the rest pose."""
    numbered = _numbered(pairs)
    j = ["seq_id", "pair", "k"]
    pick = lambda which, p: joints.withColumnRenamed("frame_id", which).join(numbered, ["seq_id", which]).select(
        *j, *[F.col(c).alias(f"{p}{c}") for c in "xyz"])
    moves = pick("frame_a", "a").join(pick("frame_b", "b"), j).select(
        "seq_id", F.col("pair").alias("frame_id"), "k", *[(F.col(f"b{c}") - F.col(f"a{c}")).alias(c) for c in "xyz"])
    full = translation_skin(rest, weights, moves).join(
        rest.select("seq_id", "vertex_id", *[F.col(c).alias(f"r{c}") for c in "xyz"]), ["seq_id", "vertex_id"])
    out = with_steps(full.withColumnRenamed("frame_id", "pair").join(numbered, ["seq_id", "pair"]), steps)
    # the movement is linear in t
    return out.select(*PAIR, "step", "t", "vertex_id", *[
        (F.col(f"r{c}") + F.col("t") * (F.col(c) - F.col(f"r{c}"))).alias(c) for c in "xyz"])


def interpolate_joints(joints: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    a = of_frame(joints, pairs, "frame_a").select(*PAIR, "k", "x", "y", "z")
    b = of_frame(joints, pairs, "frame_b").select(*PAIR, "k", *[F.col(c).alias(f"b{c}") for c in "xyz"])
    return with_steps(a.join(b, [*PAIR, "k"]), steps).select(
        *PAIR, "step", "t", "k", *[lerp(F.col(c), F.col(f"b{c}"), F.col("t")).alias(c) for c in "xyz"])


def number_segments(pairs: DataFrame, n: int) -> DataFrame:
    """Segments with the number of their first output frame; outputs are numbered on across segments."""
    return _numbered(pairs).withColumn("first", F.col("pair") * n)


def interpolate_transforms(bones: DataFrame, pairs: DataFrame, n: int, method: str = "slerp") -> DataFrame:
    """``n`` interior bone poses per pair at t = 1/(n+1) ... n/(n+1).

    ``bones(seq_id, frame_id, k, q, tx, ty, tz)``.  Output frames are numbered consecutively over the pairs of a
    sequence (column frame_id) and carry the affine matrix m.
    """
    seg = sized(number_segments(pairs, n), "segments")
    key = ["seq_id", "pair", "k"]
    cols = ["q", "tx", "ty", "tz"]
    pick = lambda which, p: bones.withColumnRenamed("frame_id", which).join(seg, ["seq_id", which]).select(
        *key, "first", *[F.col(c).alias(f"{p}{c}") for c in cols])
    both = pick("frame_a", "a").join(pick("frame_b", "b").drop("first"), key)
    both = both.withColumn("i", F.explode(F.sequence(F.lit(1), F.lit(n)))).withColumn("t", F.col("i") / float(n + 1))
    turn = {"slerp": add_slerp, "linear": add_nlerp}[method]
    moved = [lerp(F.col(f"at{c}"), F.col(f"bt{c}"), F.col("t")) for c in "xyz"]
    # written, so that the matrix is made of quaternions and not of all that they are made of
    turned = cut(turn(both, "aq", "bq", "t", "q").select(
        "seq_id", (F.col("first") + F.col("i") - 1).cast("long").alias("frame_id"), "pair", "t", "k", "q",
        *[v.alias(f"t{c}") for c, v in zip("xyz", moved)]), "turned-poses")
    return turned.withColumn(
        "m", compose(quat_to_matrix(F.col("q")), F.col("tx"), F.col("ty"), F.col("tz")))


def interpolate_pose(rest: DataFrame, weights: DataFrame, bones: DataFrame, pairs: DataFrame, n: int, method: str = "slerp") -> DataFrame:
    """Skinned meshes of the interpolated poses."""
    poses = interpolate_transforms(bones, pairs, n, method)
    return linear_blend_skin(rest, weights, poses.select(*FRAME, "k", "m"))


def check_segments(pairs: DataFrame, lens: DataFrame) -> DataFrame:
    """Segments whose frames exist and differ; any other segment is an error."""
    ok = (F.col("frame_a") >= 0) & (F.col("frame_b") >= 0) & (F.col("frame_a") < F.col("length")) \
        & (F.col("frame_b") < F.col("length")) & (F.col("frame_a") != F.col("frame_b"))
    bad = F.raise_error(F.format_string("bad segment %d,%d", "frame_a", "frame_b")).cast("long")
    return pairs.join(lens, "seq_id").withColumn("frame_a", F.when(ok, F.col("frame_a")).otherwise(bad)).drop("length")


def spline_coefficients(keys: np.ndarray, times: np.ndarray) -> np.ndarray:
    """C[i, j]: weight of key j's value in the cubic not-a-knot spline at times[i].

    The spline is linear in the key values, so its values for unit vectors are the weights.  Fewer than four keys
    give the polynomial through them.
    """
    n = len(keys)
    if n < 4:
        return np.stack([np.prod([(times - keys[m]) / (keys[j] - keys[m]) for m in range(n) if m != j], axis=0)
                         if n > 1 else np.ones_like(times) for j in range(n)], axis=1)
    h = np.diff(keys)
    a, b = np.zeros((n, n)), np.zeros((n, n))
    for i in range(1, n - 1):  # continuity of the first derivative in terms of second derivatives
        a[i, i - 1:i + 2] = h[i - 1], 2 * (h[i - 1] + h[i]), h[i]
        b[i, i - 1:i + 2] = 6 / h[i - 1], -6 / h[i - 1] - 6 / h[i], 6 / h[i]
    a[0, :3] = h[1], -(h[0] + h[1]), h[0]  # equal third derivatives across the second and the last but one key
    a[-1, -3:] = h[-1], -(h[-2] + h[-1]), h[-2]
    second = np.linalg.solve(a, b)
    seg = np.clip(np.searchsorted(keys, times, side="right") - 1, 0, n - 2)
    u, v, hs = (keys[seg + 1] - times)[:, None], (times - keys[seg])[:, None], h[seg][:, None]
    eye = np.eye(n)
    return (second[seg] * u ** 3 + second[seg + 1] * v ** 3) / (6 * hs) \
        + (eye[seg] / hs - second[seg] * hs / 6) * u + (eye[seg + 1] / hs - second[seg + 1] * hs / 6) * v


def spline_segments(times: DataFrame, keys: DataFrame) -> DataFrame:
    """Range lookup for keys that live in a table: every time meets the interval (key_a, key_b] it falls in.

    ``times(seq_id, t)``, ``keys(seq_id, key)``.  Keys are few per sequence; they are packed into one sorted
    array, and the interval is found in it without a range join.
    """
    packed = keys.groupBy("seq_id").agg(F.sort_array(F.collect_set(F.col("key").cast("double"))).alias("ks"))
    j = times.join(packed, "seq_id")
    below = F.size(F.filter("ks", lambda k: k < F.col("t")))
    at = F.least(F.greatest(below - 1, F.lit(0)), F.greatest(F.size("ks") - 2, F.lit(0)))
    j = j.withColumn("i", at).withColumns({"key_a": F.get("ks", F.col("i")), "key_b": F.get("ks", F.least(F.col("i") + 1, F.size("ks") - 1))})
    width = F.col("key_b") - F.col("key_a")
    u = F.when(width > 0, F.least(F.greatest((F.col("t") - F.col("key_a")) / F.when(width > 0, width), F.lit(0.0)), F.lit(1.0))).otherwise(0.0)
    return j.withColumn("u", u).drop("ks", "i")


#: Keys of one run of a spline, and keys on either side (fewer than a run has) that its solution looks at.
RUN_KEYS, HALO_KEYS = 1024, 64


def second_derivatives(keys: np.ndarray, values: np.ndarray, starts: bool, ends: bool) -> np.ndarray:
    """Second derivatives at the keys of the cubic through ``values`` [key, column], by elimination along the keys.

    Where the keys start or end, the third derivative is the same on both sides of the next key; elsewhere the second
    derivative is taken to be zero.  Two keys give a line, three at both ends the parabola through them."""
    n = len(keys)
    if n < 3:
        return np.zeros_like(values)
    h, slope = np.diff(keys), np.diff(values, axis=0) / np.diff(keys)[:, None]
    if n == 3 and starts and ends:
        return np.repeat(2 * (slope[1:] - slope[:1]) / (keys[2] - keys[0]), 3, axis=0)
    low, mid, up = h[:-1].copy(), 2 * (h[:-1] + h[1:]), h[1:].copy()
    right = 6 * np.diff(slope, axis=0)
    # the first and the last unknown, in terms of their two neighbours, go into the rows beside them
    if starts:
        mid[0] += h[0] * (h[0] + h[1]) / h[1]
        up[0] -= h[0] * h[0] / h[1]
    if ends:
        mid[-1] += h[-1] * (h[-1] + h[-2]) / h[-2]
        low[-1] -= h[-1] * h[-1] / h[-2]
    out = np.zeros_like(values)
    for i in range(1, n - 2):
        f = low[i] / mid[i - 1]
        mid[i] -= f * up[i - 1]
        right[i] -= f * right[i - 1]
    out[n - 2] = right[-1] / mid[-1]
    for i in range(n - 4, -1, -1):
        out[i + 1] = (right[i] - up[i] * out[i + 2]) / mid[i]
    if starts:
        out[0] = ((h[0] + h[1]) * out[1] - h[0] * out[2]) / h[1]
    if ends:
        out[-1] = ((h[-1] + h[-2]) * out[-2] - h[-1] * out[-3]) / h[-2]
    return out


def spline_pieces(at_keys: DataFrame) -> DataFrame:
    """One row per bone and interval between keys: the poses and the second derivatives of the translation at its ends.

    Keys are cut into runs of bounded length.  What a key far off does to a cubic spline halves with every key between, so
    a run that looks ``HALO_KEYS`` keys beyond its ends has the whole spline's derivatives to the last bit, and runs are
    solved independently, in time linear in their keys."""
    track, per_run = ["seq_id", "k"], RUN_KEYS
    placed = cut(position_by_id(at_keys.select(*FRAME, "k", "q", "tx", "ty", "tz"), track, ["frame_id"], "pos"), "spline-keys")
    counts = placed.groupBy(*track).agg(F.count(F.lit(1)).alias("n"))
    run = lambda shift: F.floor((F.col("pos") + F.lit(shift)) / F.lit(per_run))
    runs = placed.join(counts, track).withColumn("run", F.explode(F.array_distinct(F.array(run(-HALO_KEYS - 1), run(0), run(HALO_KEYS)))))
    fields = {f.name: f for f in runs.schema.fields}
    number = lambda c: T.StructField(c, T.DoubleType())
    quat = T.ArrayType(T.DoubleType())
    schema = T.StructType([*[fields[c] for c in track], T.StructField("key_a", T.LongType()), T.StructField("key_b", T.LongType()),
                           T.StructField("qa", quat), T.StructField("qb", quat), *[number(f"{v}{c}{e}") for v in "tm" for c in "xyz" for e in "ab"]])

    def solve(group: pa.Table) -> pa.Table:
        group = group.sort_by("pos")
        pos, keys = group["pos"].to_numpy(), group["frame_id"].to_numpy()
        values = np.stack([group[f"t{c}"].to_numpy() for c in "xyz"], axis=1)
        m = second_derivatives(keys.astype(np.float64), values, pos[0] == 0, pos[-1] == group["n"][0].as_py() - 1)
        a = np.flatnonzero((pos[:-1] // per_run) == group["run"][0].as_py())
        rows = group.take(pa.array(a))
        return pa.table({**{c: rows[c] for c in track}, "key_a": keys[a], "key_b": keys[a + 1], "qa": rows["q"], "qb": group["q"].take(pa.array(a + 1)),
                         **{f"{v}{c}{e}": arr[a + off, i] for v, arr in (("t", values), ("m", m)) for i, c in enumerate("xyz") for e, off in (("a", 0), ("b", 1))}})

    return runs.groupBy(*track, "run").applyInArrow(solve, schema)


def interpolate_spline(bones: DataFrame, keys: list[int] | DataFrame, total: int) -> DataFrame:
    """Bone poses along key frames: translations by a cubic not-a-knot spline, rotations by piecewise slerp.

    ``keys`` is a list for all sequences or a table (seq_id, key).  ``total`` frames are spread evenly from a sequence's first
    key to its last; a time on a key belongs to the interval that ends there, the first time to the first interval.  A bone
    without a pose at some key goes by those it has, and has no frames beyond them.

    Each interval lists the output frames that fall into it, so times are not looked up."""
    if isinstance(keys, list):
        if len(keys) < 2:
            raise ValueError("at least two key frames")
        keys = bones.select("seq_id").distinct().withColumn("key", F.explode(F.array(*[F.lit(int(k)).cast("long") for k in keys])))
    keys = keys.select("seq_id", F.col("key").cast("long").alias("frame_id")).distinct()
    ends = sized(keys.groupBy("seq_id").agg(F.min("frame_id").alias("_first"), F.max("frame_id").alias("_last")), "spline-ends")
    pieces = spline_pieces(bones.join(keys, ["seq_id", "frame_id"], "left_semi")).join(ends, "seq_id")
    length = F.col("_last") - F.col("_first")
    spot = lambda key: F.floor((F.col(key) - F.col("_first")) * F.lit(total - 1) / length).cast("long")
    low = F.when(F.col("key_a") == F.col("_first"), 0).otherwise(spot("key_a") + 1)
    each = pieces.where(low <= spot("key_b")).withColumn("frame_id", F.explode(F.sequence(low.cast("long"), spot("key_b"))))
    t = F.col("_first") + F.col("frame_id") * (length / F.lit(float(max(1, total - 1))))
    each = each.withColumn("u", (t - F.col("key_a")) / (F.col("key_b") - F.col("key_a")))
    h, u, v = F.col("key_b") - F.col("key_a"), F.col("u"), 1 - F.col("u")
    bend = lambda c: ((v * v * v - v) * F.col(f"m{c}a") + (u * u * u - u) * F.col(f"m{c}b")) * h * h / 6
    each = each.select(*FRAME, "k", "qa", "qb", "u", *[(v * F.col(f"t{c}a") + u * F.col(f"t{c}b") + bend(c)).alias(f"t{c}") for c in "xyz"])
    # written, so that the matrix is made of quaternions and not of all that they are made of
    turned = cut(add_slerp(each, "qa", "qb", "u", "q").select(*FRAME, "k", "tx", "ty", "tz", "q", "u"), "spline-poses")
    return turned.withColumn("m", compose(quat_to_matrix(F.col("q")), F.col("tx"), F.col("ty"), F.col("tz")))


UNIFIED_ORDER = ["skeleton_driven", "nearest_neighbor", "original"]


def choose_unified(available: dict[str, DataFrame], wanted: str = "skeleton_driven") -> tuple[str, DataFrame]:
    """The wanted unified set, or the first available one in the fixed order."""
    for name in [wanted, *UNIFIED_ORDER]:
        if name in available:
            return name, available[name]
    raise ValueError("no unified vertices available")


def original_unified(rest: DataFrame, frames: DataFrame) -> DataFrame:
    """Stand-in when no unified set exists: the rest pose repeated for every frame."""
    from ..plans.tiles import tile_join
    return tile_join(rest.select("seq_id", "vertex_id", "x", "y", "z"), frames.select(*FRAME).distinct(),
                     "vertex_id", "frame_id").select(*FRAME, "vertex_id", "x", "y", "z")


def interpolate_unified(unified: DataFrame, pairs: DataFrame, steps: int) -> DataFrame:
    """Straight lines between frames that share their vertices; ``unified`` has a vertex once in a frame.

    The rows are made and shuffled once, by vertex; there each one goes to the pairs that its frame begins or ends."""
    pairs = pairs.select(*PAIR)
    ends = sized(pairs.withColumn("frame_id", F.col("frame_a")).withColumn("_ends", F.lit(0)).unionByName(
        pairs.withColumn("frame_id", F.col("frame_b")).withColumn("_ends", F.lit(1))), "pair-ends")
    rows = unified.select(*FRAME, "vertex_id", *"xyz").repartition("seq_id", "vertex_id").join(ends, FRAME)
    of_end = lambda end, c, name: F.max(F.when(F.col("_ends") == end, F.col(c))).alias(name)
    both = rows.groupBy(*PAIR, "vertex_id").agg(*[of_end(0, c, c) for c in "xyz"], *[of_end(1, c, f"b{c}") for c in "xyz"],
                                                F.min("_ends").alias("_first"), F.max("_ends").alias("_last")).where("_first < _last")
    return with_steps(both, steps).select(
        *PAIR, "step", "t", "vertex_id", *[lerp(F.col(c), F.col(f"b{c}"), F.col("t")).alias(c) for c in "xyz"])


def unified_joints(template_joints: DataFrame, transforms: DataFrame) -> DataFrame:
    """Joints of every frame: template joint plus the translation of its bone's matrix."""
    t = template_joints.select("seq_id", "k", "x", "y", "z")
    return transforms.join(t, ["seq_id", "k"]).select(
        *FRAME, "k", *[(F.col(c) + F.col("m")[4 * i + 3]).alias(c) for i, c in enumerate("xyz")])


def manifest(pairs: DataFrame, method: str, steps: int) -> DataFrame:
    """One row per generated mesh: method, frames, step, t and file name."""
    return with_steps(pairs, steps).select(*PAIR, F.lit(method).alias("method"), "step", "t",
                                           names.step_file(F.col("step"), F.col("t")).alias("file"))


def compare_methods(results: dict[str, DataFrame], reference: str) -> DataFrame:
    """Meshes and vertices per method, with the mean and largest change against the reference method."""
    key = [*PAIR, "step", "vertex_id"]
    return _by_method({name: df.select(*key, *"xyz").join(results[reference].select(*key, *[F.col(c).alias(f"r{c}") for c in "xyz"]), key, "left")
                       for name, df in results.items()})


def compare_matched(matched: dict[str, DataFrame], reference: str, steps: int) -> DataFrame:
    """``compare_methods`` of straight lines between matches (``matched_pairs``): methods meet once per vertex, before the
    steps between are made, and the reference does not meet itself."""
    key = [*PAIR, "vertex_id"]
    ends = ["x", "y", "z", "bx", "by", "bz"]
    ref = matched[reference].select(*key, *[F.col(c).alias(f"r{c}") for c in ends])
    both = {name: matched[name].select(*key, *ends, *[F.col(c).alias(f"r{c}") for c in ends]) if name == reference
            else matched[name].select(*key, *ends).join(ref, key, "left") for name in matched}
    return _by_method({name: with_steps(df, steps).select(
        *PAIR, "step", "vertex_id", *[lerp(F.col(c), F.col(f"b{c}"), F.col("t")).alias(c) for c in "xyz"],
        *[lerp(F.col(f"r{c}"), F.col(f"rb{c}"), F.col("t")).alias(f"r{c}") for c in "xyz"]) for name, df in both.items()})


def _by_method(results: dict[str, DataFrame]) -> DataFrame:
    """``results`` have the reference position rx, ry, rz, or null, beside x, y, z."""
    out = None
    for name, df in results.items():
        gap = F.greatest(*[F.abs(F.col(c) - F.col(f"r{c}")) for c in "xyz"])
        part = df.withColumn("gap", gap).groupBy(*PAIR, "step").agg(
            F.count(F.lit(1)).alias("n"), F.sum("gap").alias("s"), F.max("gap").alias("m"), F.count("gap").alias("c"))
        part = part.withColumn("method", F.lit(name))
        out = part if out is None else out.unionByName(part)
    return out.groupBy("method").agg(
        F.count(F.lit(1)).alias("meshes"), F.sum("n").alias("vertices"),
        (F.sum("s") / F.sum("c")).alias("mean_change"), F.max("m").alias("max_change"))
