"""Skinning weights: sparse rows (seq_id, vertex_id, k, w), absent = 0.

A vertex has at most as many weight rows as there are bones, so windows per vertex are bounded.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F, types as T

from ..functions.space import palette_channel
from ..plans.knn import WHOLE, knn_join, neighbour_pairs
from ..plans.lineage import cut
from ..plans.ranking import top_k
from .correspondence import IDW_EPS, joint_distances, knn_graph

VERTEX = ["seq_id", "vertex_id"]
HEAT_PARTS = 8  # tasks that share the joints of one rest cloud
HEAT_DENSE = 1 << 26  # numbers that the elimination of one rest cloud may keep (512 MB)
NO_HEAT = -10 ** 8  # the exponent of a column of zeros


def _row_sum(c: str = "w"):
    return F.sum(c).over(Window.partitionBy(*VERTEX))


def normalize_weights(w: DataFrame) -> DataFrame:
    """Divide by the row sum; rows that sum to less than 1e-8 are left as they are."""
    total = _row_sum()
    return w.withColumn("_t", total).withColumn("w", F.when(F.col("_t") < 1e-8, F.col("w")).otherwise(F.col("w") / F.col("_t"))).drop("_t")


def weight_sum_report(w: DataFrame, tolerance: float = 1e-6) -> DataFrame:
    """Range of the row sums per sequence and whether all are within ``tolerance`` of 1."""
    sums = w.groupBy(*VERTEX).agg(F.sum("w").alias("s"))
    return sums.groupBy("seq_id").agg(F.min("s").alias("min_sum"), F.max("s").alias("max_sum"),
                                      (F.max(F.abs(F.col("s") - 1)) <= tolerance).alias("normalized"))


def sparsify_weights(w: DataFrame, k: int = 4, eps: float = 1e-8) -> DataFrame:
    """The ``k`` largest weights of each vertex, renormalised (``eps`` is added to the divisor; 0 for the plain form)."""
    kept = top_k(w, VERTEX, [F.desc("w"), "k"], k)
    total = _row_sum() + F.lit(eps)
    return kept.withColumn("_t", total).withColumn("w", F.when(F.col("_t") > 0, F.col("w") / F.col("_t")).otherwise(F.col("w"))).drop("_t")


def weight_stats(w: DataFrame, n_bones: int) -> DataFrame:
    """Per sequence over the dense N x K matrix: range, share of near-zero entries, mean non-zeros per vertex."""
    per = w.groupBy(*VERTEX).agg(F.sum((F.col("w") > 1e-6).cast("long")).alias("nz"), F.min("w").alias("lo"),
                                 F.max("w").alias("hi"), F.count(F.lit(1)).alias("stored"))
    dense = F.count(F.lit(1)) * n_bones
    return per.groupBy("seq_id").agg(
        F.least(F.min("lo"), F.min(F.when(F.col("stored") < n_bones, 0.0).otherwise(F.col("lo")))).alias("min_w"),
        F.max("hi").alias("max_w"), (1 - F.sum("nz") / dense).alias("near_zero"), F.avg("nz").alias("mean_nonzero"))


def bone_weight_stats(w: DataFrame, n_vertices: DataFrame) -> DataFrame:
    """Per bone over all vertices of the sequence (``n_vertices``: seq_id, n): min, max, mean."""
    per = w.groupBy("seq_id", "k").agg(F.min("w").alias("lo"), F.max("w").alias("max_w"), F.sum("w").alias("s"),
                                       F.count(F.lit(1)).alias("stored")).join(n_vertices, "seq_id")
    return per.select("seq_id", "k", F.when(F.col("stored") < F.col("n"), F.least(F.lit(0.0), F.col("lo"))).otherwise(F.col("lo")).alias("min_w"),
                      "max_w", (F.col("s") / F.col("n")).alias("mean_w"))


def distance_weights(rest: DataFrame, joints: DataFrame, kind: str = "exp", k: int = 4) -> DataFrame:
    """Weights from the distance of each rest vertex to each joint, the ``k`` strongest kept.

    ``exp``: exp(-2 d) normalised, cut, renormalised.  ``inverse``: 1 / (d + 1e-3), cut, normalised, all on
    bone 0 when the sum vanishes.
    """
    d = joint_distances(rest, joints, ["seq_id"])
    if kind == "exp":
        raw = d.select(*VERTEX, "k", F.exp(F.col("d") * -2.0).alias("w"))
        full = raw.withColumn("w", F.col("w") / (_row_sum() + F.lit(1e-8)))
        return sparsify_weights(full, k, 1e-8)
    if kind == "inverse":
        raw = top_k(d.select(*VERTEX, "k", (1 / (F.col("d") + 1e-3)).alias("w")), VERTEX, [F.desc("w"), "k"], k)
        total = _row_sum()
        fallback = F.when(F.col("k") == 0, 1.0).otherwise(0.0)
        return raw.withColumn("_t", total).withColumn(
            "w", F.when(F.col("_t") > 1e-8, F.col("w") / F.col("_t")).otherwise(fallback)).drop("_t")
    raise ValueError(kind)


def default_weights(vertices: DataFrame, n_bones: int, kind: str = "first") -> DataFrame:
    """Everything on bone 0, or bones in turn by vertex number."""
    k = F.lit(0).cast("long") if kind == "first" else F.col("vertex_id") % n_bones
    return vertices.select(*VERTEX, k.alias("k"), F.lit(1.0).alias("w"))


def heat_sources(rest: DataFrame, joints: DataFrame) -> DataFrame:
    """Heat of the vertices at a joint: 1 at the nearest; exp(-10 d) at those of the three nearest with d < 0.1."""
    near = knn_join(joints, rest, ["seq_id"], 3, left_id="k").select(
        "seq_id", F.col("left_id").alias("k"), F.col("right_id").alias("vertex_id"), "rank", F.sqrt("d2").alias("d"))
    hot = near.withColumn("b", F.when(F.col("d") < 0.1, F.exp(F.col("d") * -10.0)).when(F.col("rank") == 1, 1.0))
    return hot.where(F.col("b").isNotNull()).select(*VERTEX, "k", "b")


def heat_weights(rest: DataFrame, joints: DataFrame, dt: float = 0.01, k: int = 8, iterations: int | None = None,
                 tolerance: float = 1e-9, every: int = 8) -> DataFrame:
    """Heat diffused from each joint over the neighbour graph of the rest vertices.

    Solves (I + dt L) w = b with L = D - W; the sign keeps the system positive definite and all weights non-negative.
    A rest cloud of at most ``WHOLE`` vertices goes to one task.  Its vertices are put in levels by hops from a far end, which
    couples a level with its two neighbours only, and the levels are eliminated one after the other; so a long strip costs
    no more than its vertices.  Where the levels are so wide that this would keep more than ``HEAT_DENSE`` numbers, and in larger
    clouds, there are Jacobi steps w <- (b + dt sum_j W_ij w_j) / (1 + dt deg_i) until none changes a weight by more than
    ``tolerance`` of itself and heat has reached every vertex that a joint's heat can reach; ``iterations`` asks for so many steps in
    any cloud.

    The heat of one joint is independent of the others, so for the steps a cloud of at most ``WHOLE`` vertices goes to
    ``HEAT_PARTS`` tasks, each with some of the joints.  Larger clouds are joined with their edges step by step, and one row of
    flags comes back to the driver every ``every`` steps.
    """
    rest = cut(rest.select(*VERTEX, *"xyz"), "heat-rest")
    sources = cut(heat_sources(rest, joints), "heat-b")
    most = rest.groupBy("seq_id").count().agg(F.max("count")).first()[0] or 0
    if most > WHOLE:
        state = _heat_by_joins(rest, sources, dt, iterations, tolerance, every)
    elif iterations is None:
        settled, wide = _heat_by_levels(rest, sources, dt, k)
        if wide.isEmpty():
            return settled
        state = _heat_in_blocks(rest.join(wide, "seq_id", "left_semi"), sources.join(wide, "seq_id", "left_semi"), dt, None, tolerance, every)
        return settled.unionByName(_strongest(state, k))
    else:
        state = _heat_in_blocks(rest, sources, dt, iterations, tolerance, every)
    return _strongest(state, k)


def _strongest(state: DataFrame, k: int) -> DataFrame:
    # joints that share their sources have equal heat; rounding keeps such ties exact whatever the order of the sums
    positive = state.where("w > 0").withColumn("w", F.round(F.col("w") / _row_sum(), 12))
    return sparsify_weights(positive, k, 0.0)


def _edges(points: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Both directions of the neighbour graph with their weights, by their ends."""
    i, j, d2 = neighbour_pairs(points, 8)
    w = 1 / (np.sqrt(np.concatenate([d2, d2])) + IDW_EPS)
    src, dst = np.concatenate([i, j]), np.concatenate([j, i])
    order = np.lexsort((dst, src))
    return src[order], dst[order], w[order]


def _sources(points: pa.Table, hot: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The bones, and the heat put in, vertex by bone; ids of the vertices."""
    ids = points.column("vertex_id").to_numpy()
    by_id = np.argsort(ids)
    at = by_id[np.searchsorted(ids[by_id], hot.column("vertex_id").to_numpy())]
    bones, row = np.unique(hot.column("k").to_numpy(), return_inverse=True)
    b = np.zeros((points.num_rows, len(bones)))
    b[at, row] = hot.column("b").to_numpy()
    return bones, b, ids


def _levels(start: int, first: np.ndarray, dst: np.ndarray, level: np.ndarray) -> list[np.ndarray]:
    """The vertices at each number of hops from ``start``; ``level`` is -1 where there is none yet."""
    out, frontier = [], np.array([start])
    while len(frontier):
        level[frontier] = len(out)
        out.append(frontier)
        many = first[frontier + 1] - first[frontier]
        near = dst[np.repeat(first[frontier] - np.cumsum(many) + many, many) + np.arange(many.sum())]
        frontier = np.unique(near[level[near] < 0])
    return out


def _scaled(x: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """x 2^e, column by column, with the largest number of each column between a half and one."""
    up = np.frexp(x.max(axis=0))[1]
    return np.ldexp(x, -up), np.where(x.any(axis=0), e + up, NO_HEAT)


def _sum_scaled(x: np.ndarray, e: np.ndarray, y: np.ndarray, f: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    top = np.maximum(e, f)
    return _scaled(np.ldexp(x, np.maximum(e - top, -2000)) + np.ldexp(y, np.maximum(f - top, -2000)), top)


def _heat_by_levels(rest: DataFrame, sources: DataFrame, dt: float, k: int) -> tuple[DataFrame, DataFrame]:
    """The ``k`` strongest weights of each vertex, without the clouds whose levels are too wide; those clouds' seq_id.

    The matrix has no positive number beside its diagonal, so nothing but sums of positive numbers is formed on the way and
    weights are exact in proportion, however small they are; powers of two are kept apart, as heat falls below any double."""
    of_sequence, of_bone = rest.schema["seq_id"], sources.schema["k"]
    schema = T.StructType([of_sequence, T.StructField("vertex_id", T.LongType()), of_bone, T.StructField("w", T.DoubleType())])

    def levels(points: pa.Table, hot: pa.Table):
        """The graph, the heat put in, and the levels of each part of the graph that has a source."""
        src, dst, w = _edges(points)
        bones, b, ids = _sources(points, hot)
        first = np.searchsorted(src, np.arange(len(ids) + 1))
        level, done, parts = np.full(len(ids), -1), np.zeros(len(ids), bool), []
        for start in np.flatnonzero(b.any(axis=1)).tolist():
            if done[start]:
                continue
            found = _levels(start, first, dst, level)
            for _ in range(2):  # from an end the levels are many and narrow
                level[np.concatenate(found)] = -1
                found = _levels(int(found[-1][0]), first, dst, level)
            done[np.concatenate(found)] = True
            parts.append(found)
        narrow = sum(len(x) * len(y) for found in parts for x, y in zip(found, [*found[1:], found[-1]])) <= HEAT_DENSE
        return src, dst, dt * w, first, bones, b, ids, level, parts, narrow

    def too_wide(points: pa.Table, hot: pa.Table) -> pa.Table:
        wide = points.num_rows and hot.num_rows and not levels(points, hot)[-1]
        return pa.table({"seq_id": points.column("seq_id").slice(0, 1 if wide else 0)})

    def solve(points: pa.Table, hot: pa.Table) -> pa.Table:
        vertex, bone, weight = [], [], []
        sequence = points.column("seq_id")
        *graph, parts, narrow = levels(points, hot) if points.num_rows and hot.num_rows else (None, [], True)
        if parts and narrow:
            src, dst, c, first, bones, b, ids, level = graph
            diag = 1 + np.bincount(src, c, minlength=len(ids))
            place = np.zeros(len(ids), np.int64)
            for found in parts:
                kept, up, before = [], None, None
                for i, at in enumerate(found):
                    place[at] = np.arange(len(at))
                    if i + 1 < len(found):
                        place[found[i + 1]] = np.arange(len(found[i + 1]))
                    many = first[at + 1] - first[at]
                    e = np.repeat(first[at] - np.cumsum(many) + many, many) + np.arange(many.sum())
                    own, on = e[level[dst[e]] == i], e[level[dst[e]] == i + 1]
                    s = np.diag(diag[at])
                    s[place[src[own]], place[dst[own]]] -= c[own]
                    right, power = _scaled(b[at], np.zeros(len(bones), np.int64))
                    if i:
                        s -= up.T @ kept[-1][0]
                        right, power = _sum_scaled(right, power, up.T @ kept[-1][1], kept[-1][2])
                    up = np.zeros((len(at), len(found[i + 1]) if i + 1 < len(found) else 0))
                    up[place[src[on]], place[dst[on]]] = c[on]
                    x = np.linalg.solve(s, np.concatenate([up, right], axis=1))
                    kept.append((x[:, :up.shape[1]], *_scaled(x[:, up.shape[1]:], power)))
                for at, (z, x, power) in zip(reversed(found), reversed(kept)):
                    if before is not None:
                        x, power = _sum_scaled(x, power, z @ before[0], before[1])
                    before = x, power
                    top = np.where(x > 0, np.frexp(x)[1] + power, NO_HEAT).max(axis=1, keepdims=True)
                    share = np.ldexp(x, np.maximum(power - top, -2000))
                    total = np.maximum(share.sum(axis=1, keepdims=True), 1e-300)
                    share = np.where(x > 0, np.round(share / total, 12), -1.0)
                    best = np.argsort(-share, axis=1, kind="stable")[:, :k]
                    share = np.take_along_axis(share, best, axis=1)
                    some = share >= 0
                    share = share / np.maximum(np.where(some, share, 0.0).sum(axis=1, keepdims=True), 1e-300)
                    vertex.append(np.repeat(ids[at], some.sum(axis=1)))
                    bone.append(bones[best[some]])
                    weight.append(share[some])
        flat = lambda x, kind: np.concatenate(x) if x else np.zeros(0, kind)
        vertex = flat(vertex, np.int64)
        return pa.table({"seq_id": pa.repeat(sequence[0], len(vertex)) if len(vertex) else sequence.slice(0, 0), "vertex_id": pa.array(vertex, pa.int64()),
                         "k": pa.array(flat(bone, np.int64), pa.int64()), "w": pa.array(flat(weight, np.float64))})

    each = rest.groupBy("seq_id").cogroup(sources.groupBy("seq_id"))
    return each.applyInArrow(solve, schema), each.applyInArrow(too_wide, T.StructType([of_sequence]))


def _heat_in_blocks(rest: DataFrame, sources: DataFrame, dt: float, iterations: int | None, tolerance: float, every: int) -> DataFrame:
    """The heat of some joints of a sequence in one task.  All sequences take as many steps as the slowest needs."""
    of_sequence, of_bone = rest.schema["seq_id"], sources.schema["k"]
    each = rest.withColumn("_part", F.explode(F.sequence(F.lit(0), F.lit(HEAT_PARTS - 1)))).groupBy("seq_id", "_part")
    some = sources.withColumn("_part", F.pmod("k", F.lit(HEAT_PARTS)).cast("int")).groupBy("seq_id", "_part")

    def system(points: pa.Table, hot: pa.Table):
        """One step as a function, the state it starts from, bone by vertex, and the ids of both."""
        src, dst, w = _edges(points)
        bones, b, ids = _sources(points, hot)
        diag = 1 + dt * np.bincount(src, w, minlength=len(ids))
        c, to, first = dt * w / diag[src], *np.unique(src, return_index=True)
        own = np.ascontiguousarray((b / diag[:, None]).T)

        def step(state: np.ndarray) -> np.ndarray:
            out = own.copy()
            if len(to):
                for r in range(len(bones)):
                    out[r, to] += np.add.reduceat(c * state[r, dst], first)
            return out

        return step, own, bones, ids

    def steps_needed(points: pa.Table, hot: pa.Table) -> pa.Table:
        steps = 0
        if points.num_rows and hot.num_rows:
            step, state, _, _ = system(points, hot)
            while True:
                before = state
                for _ in range(every):
                    state = step(state)
                steps += every
                if not ((state != 0) & (before == 0)).any() and (np.abs(state - before) <= tolerance * state).all():
                    break
        return pa.table({"steps": pa.array([steps], pa.int32())})

    if iterations is None:
        iterations = each.cogroup(some).applyInArrow(steps_needed, "steps int").agg(F.max("steps")).first()[0] or 0
    schema = T.StructType([of_sequence, T.StructField("vertex_id", T.LongType()), of_bone, T.StructField("w", T.DoubleType())])

    def settle(points: pa.Table, hot: pa.Table) -> pa.Table:
        found, n = None, 0
        if points.num_rows and hot.num_rows:
            step, state, bones, ids = system(points, hot)
            for _ in range(iterations):
                state = step(state)
            found = np.nonzero(state)
            n = len(found[0])
        sequence = hot.column("seq_id") if n else points.column("seq_id")
        return pa.table({"seq_id": pa.repeat(sequence[0], n) if n else sequence.slice(0, 0), "vertex_id": pa.array(ids[found[1]] if n else [], pa.int64()),
                         "k": pa.array(bones[found[0]] if n else [], pa.int64()), "w": pa.array(state[found] if n else [], pa.float64())})

    return each.cogroup(some).applyInArrow(settle, schema)


def _heat_by_joins(rest: DataFrame, sources: DataFrame, dt: float, iterations: int | None, tolerance: float, every: int) -> DataFrame:
    edges = cut(knn_graph(rest, ["seq_id"], 8), "heat-edges")
    degree = edges.groupBy("seq_id", "src").agg((1 + F.lit(dt) * F.sum("w")).alias("diag"))
    pull = cut(edges.join(degree, ["seq_id", "src"]).select(
        "seq_id", F.col("src").alias("to"), F.col("dst").alias("vertex_id"), (F.lit(dt) * F.col("w") / F.col("diag")).alias("c")), "heat-pull")
    own = cut(sources.join(degree.withColumnRenamed("src", "vertex_id"), VERTEX, "left").select(
        *VERTEX, "k", (F.col("b") / F.coalesce("diag", F.lit(1.0))).alias("w")), "heat-own")
    state = own
    steps = 0
    while iterations is None or steps < iterations:
        before, now = state, every if iterations is None else min(every, iterations - steps)
        for _ in range(now):
            moved = state.join(pull, VERTEX).select("seq_id", F.col("to").alias("vertex_id"), "k", (F.col("c") * F.col("w")).alias("w"))
            state = own.unionByName(moved).groupBy(*VERTEX, "k").agg(F.sum("w").alias("w"))
        steps += now
        if steps == iterations:
            break
        state = cut(state, "heat")
        if iterations is None:
            change = state.join(before.withColumnRenamed("w", "_w"), [*VERTEX, "k"], "left").agg(
                F.max(F.abs(F.col("w") - F.col("_w")) / F.col("w")).alias("most"), F.max(F.col("_w").isNull()).alias("new")).first()
            if not change["new"] and (change["most"] or 0.0) <= tolerance:
                break
    return state


def adapt_weight_layout(entries: DataFrame, shapes: DataFrame) -> DataFrame:
    """Bring weight matrices of unknown orientation to (vertex_id, k, w), then normalise.

    ``entries(seq_id, row, col, value)``; a flat vector has a null ``row``.  ``shapes(seq_id, n, n_bones, rows,
    cols)``: the wanted shape and the shape delivered (rows null when flat).  Accepted: N x K, K x N, flat of
    N * K values (bone-major), fewer bones than K (missing ones stay absent).  Anything else puts all weight on bone 0.
    """
    s = shapes.withColumn("layout", F.when(F.col("rows").isNull() & (F.col("cols") == F.col("n") * F.col("n_bones")), "flat")
                          .when((F.col("rows") == F.col("n")) & (F.col("cols") == F.col("n_bones")), "vertex")
                          .when((F.col("cols") == F.col("n")) & (F.col("rows") <= F.col("n_bones")), "bone")
                          .otherwise("other"))
    e = entries.join(s, "seq_id")
    flat, vertex = F.col("layout") == "flat", F.col("layout") == "vertex"
    v = F.when(flat, F.col("col") % F.col("n")).when(vertex, F.col("row")).otherwise(F.col("col"))
    k = F.when(flat, F.floor(F.col("col") / F.col("n"))).when(vertex, F.col("col")).otherwise(F.col("row"))
    known = e.where(F.col("layout") != "other").select("seq_id", v.alias("vertex_id"), k.alias("k"), F.col("value").alias("w"))
    default = s.where("layout = 'other'").select(
        "seq_id", F.explode(F.sequence(F.lit(0).cast("long"), F.col("n") - 1)).alias("vertex_id"),
        F.lit(0).cast("long").alias("k"), F.lit(1.0).alias("w"))
    return normalize_weights(known.unionByName(default))


def expand_weights(weights: DataFrame, rest: DataFrame, method: str = "idw") -> DataFrame:
    """Weights of a vertex subset for all rest vertices: the rest takes the inverse-distance mean of its three
    nearest weighted vertices (``idw``) or bone 0 (``default``)."""
    known = weights.select(*VERTEX).distinct()
    missing = rest.join(known, VERTEX, "left_anti")
    if method == "default":
        return weights.unionByName(missing.select(*VERTEX, F.lit(0).cast("long").alias("k"), F.lit(1.0).alias("w")))
    near = knn_join(missing, rest.join(known, VERTEX, "left_semi"), ["seq_id"], 3)
    g = near.select("seq_id", "left_id", "right_id", (1 / (F.sqrt("d2") + F.lit(IDW_EPS))).alias("g"))
    share = g.withColumn("g", F.col("g") / F.sum("g").over(Window.partitionBy("seq_id", "left_id")))
    filled = share.join(weights.withColumnRenamed("vertex_id", "right_id"), ["seq_id", "right_id"]).groupBy(
        "seq_id", F.col("left_id").alias("vertex_id"), "k").agg(F.sum(F.col("g") * F.col("w")).alias("w"))
    return weights.unionByName(filled)


def vertex_colors(weights: DataFrame) -> DataFrame:
    """Blend of the bone colours, clipped to [0, 1]."""
    mix = lambda ch: F.least(F.greatest(F.sum(F.col("w") * palette_channel(F.col("k"), ch)), F.lit(0.0)), F.lit(1.0))
    return weights.groupBy(*VERTEX).agg(mix(0).alias("red"), mix(1).alias("green"), mix(2).alias("blue"))
