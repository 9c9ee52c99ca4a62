"""Farthest-point and surface sampling."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window, functions as F

from ..functions.space import cross3, dist2, hash_unit, norm3
from ..plans.lineage import cut
from ..plans.ranking import ID_RANGE, running_sum_by_id
from ..schema import FRAME

# The additive low-discrepancy sequence in two dimensions (reciprocal powers of the plastic number).
R2 = (0.7548776662466927, 0.5698402909980532)


def farthest_point_sample(points: DataFrame, n: int, every: int = 8) -> DataFrame:
    """Greedy farthest points of every frame, starting at vertex 0; ties go to the lowest vertex id.

    Exact: each pick maximises the distance to *all* earlier picks.  The picks depend on each other, so the loop
    is over picks, with all frames in one job per step.  The state (distance to the nearest pick) is written
    every ``every`` picks; between two writes the few recent picks are folded into it on the fly.
    """
    state = cut(points.select(*FRAME, "vertex_id", "x", "y", "z", F.lit(float("inf")).alias("d")), "fps")
    picks = cut(state.where("vertex_id = 0").select(*FRAME, F.lit(0).cast("long").alias("pick"), "vertex_id", "x", "y", "z"), "fps-pick")
    done, recent = [picks], [picks]
    for i in range(1, n):
        fresh = state
        for p in recent:
            q = p.select(*FRAME, *[F.col(c).alias(f"q{c}") for c in "xyz"])
            d = dist2(*[F.col(c) for c in "xyz"], *[F.col(f"q{c}") for c in "xyz"])
            fresh = fresh.join(q, FRAME).withColumn("d", F.least("d", d)).drop("qx", "qy", "qz")
        if len(recent) >= every:
            state, recent = cut(fresh, "fps"), []
            fresh = state
        order = F.struct("d", -F.col("vertex_id"))
        best = fresh.groupBy(*FRAME).agg(
            F.max_by(F.struct("vertex_id", "x", "y", "z"), order).alias("p"), F.max("d").alias("_d"))
        # a frame with fewer distinct vertices than picks is exhausted: its largest distance is 0
        step = best.where(F.col("_d") > 0).select(*FRAME, F.lit(i).cast("long").alias("pick"), "p.*")
        picks = cut(step, "fps-pick")
        done.append(picks)
        recent.append(picks)
    out = done[0]
    for p in done[1:]:
        out = out.unionByName(p)
    return out


def triangles(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Faces with the positions of their three corners."""
    out = faces
    for i in range(3):
        corner = points.select(*FRAME, F.col("vertex_id").alias(f"v{i}"), *[F.col(c).alias(f"{c}{i}") for c in "xyz"])
        out = out.join(corner, [*FRAME, f"v{i}"])
    return out


def with_face_normal(tri: DataFrame) -> DataFrame:
    """Un-normalised face normal (cx, cy, cz) and area."""
    u = [F.col(f"{c}1") - F.col(f"{c}0") for c in "xyz"]
    v = [F.col(f"{c}2") - F.col(f"{c}0") for c in "xyz"]
    tri = tri.withColumns(dict(zip(("cx", "cy", "cz"), cross3(u, v))))
    return tri.withColumn("area", F.lit(0.5) * norm3(F.col("cx"), F.col("cy"), F.col("cz")))


def surface_sample(points: DataFrame, faces: DataFrame, n: int, seed: int = 0, grid: bool = False) -> DataFrame:
    """``n`` area-weighted points per frame on its triangles, with the face normal.

    Face f owns the interval (lo, hi] of the frame's cumulative area.  Sample i has its own stratum
    [i/n, (i+1)/n) of the unit interval, so the samples of a face follow from lo and hi by arithmetic; no
    range join is needed.  ``grid`` takes the middle of each stratum, otherwise the place is hashed.
    """
    tri = with_face_normal(triangles(points, faces))
    run = running_sum_by_id(tri, FRAME, "face_id", "area", "run")
    total = tri.groupBy(*FRAME).agg(F.sum("area").alias("total"))
    spans = run.join(total.where("total > 0"), FRAME).withColumns({
        "hi": F.col("run") / F.col("total")})
    # lo is the very number that is hi of the face before; the last face reaches to the end whatever the rounding
    order = Window.partitionBy(*FRAME, "_range").orderBy("face_id")
    spans = spans.where("area > 0").withColumn("_range", F.floor(F.col("face_id") / F.lit(ID_RANGE)))
    ends = spans.groupBy(*FRAME, "_range").agg(F.max("hi").alias("_end"))
    before = Window.partitionBy(*FRAME).orderBy("_range")
    ends = ends.select(*FRAME, "_range", F.coalesce(F.lag("_end").over(before), F.lit(-1.0)).alias("_start"),
                       (F.row_number().over(Window.partitionBy(*FRAME).orderBy(F.desc("_range"))) == 1).alias("_final"))
    spans = spans.join(ends, [*FRAME, "_range"]).withColumn("lo", F.coalesce(F.lag("hi").over(order), F.col("_start"))).withColumn(
        "hi", F.when(F.col("_final") & F.lead("hi").over(order).isNull(), F.lit(2.0)).otherwise(F.col("hi")))
    first = F.greatest(F.floor(F.col("lo") * n) - 1, F.lit(0))
    last = F.least(F.floor(F.col("hi") * n) + 1, F.lit(n - 1))
    each = spans.withColumn("sample_id", F.explode(F.sequence(first.cast("long"), last.cast("long"))))
    i = F.col("sample_id")
    if grid:
        u, a, b = (i + 0.5) / n, i * R2[0] - F.floor(i * R2[0]), i * R2[1] - F.floor(i * R2[1])
    else:
        ids = [F.col("seq_id"), F.col("frame_id"), i]
        u = (i + hash_unit(*ids, F.lit(seed))) / n
        a, b = hash_unit(*ids, F.lit(seed + 1)), hash_unit(*ids, F.lit(seed + 2))
    each = each.withColumns({"_u": u, "_a": a, "_b": b}).where((F.col("_u") > F.col("lo")) & (F.col("_u") <= F.col("hi")))
    fold = F.col("_a") + F.col("_b") > 1
    each = each.withColumns({"_p": F.when(fold, 1 - F.col("_a")).otherwise(F.col("_a")),
                             "_q": F.when(fold, 1 - F.col("_b")).otherwise(F.col("_b"))})
    length = norm3(F.col("cx"), F.col("cy"), F.col("cz"))
    return each.select(
        *FRAME, "sample_id", "face_id",
        *[(F.col(f"{c}0") * (1 - F.col("_p") - F.col("_q")) + F.col(f"{c}1") * F.col("_p")
           + F.col(f"{c}2") * F.col("_q")).alias(c) for c in "xyz"],
        *[(F.col(f"c{c}") / length).alias(f"n{c}") for c in "xyz"])
