"""Set distances, losses and surfaces of sparse voxel tables.  A row that is absent is an empty cell."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions import space
from ..plans.knn import knn_join
from ..schema import FRAME
from .normalize import occupied, voxel_centers


def _cells(voxels: DataFrame, grid: int) -> DataFrame:
    """Cells as points with one id that orders like (i, j, k)."""
    ident = (F.col("i").cast("long") * grid + F.col("j")) * grid + F.col("k")
    return voxel_centers(voxels, grid).select(*FRAME, ident.alias("cell"), "x", "y", "z")


def chamfer(gt: DataFrame, recon: DataFrame, grid: int = 64) -> DataFrame:
    """Per frame: mean squared distance to the nearest cell of the other set, both ways, added."""
    a, b = _cells(gt, grid), _cells(occupied(recon), grid)
    one_way = lambda p, q, name: knn_join(p, q, FRAME, 1, left_id="cell", right_id="cell").groupBy(*FRAME).agg(F.avg("d2").alias(name))
    both = one_way(a, b, "to_recon").join(one_way(b, a, "to_gt"), FRAME)
    return both.select(*FRAME, (F.col("to_recon") + F.col("to_gt")).alias("chamfer"))


def chamfer_clips(frames: DataFrame) -> DataFrame:
    return frames.groupBy("seq_id").agg(F.avg("chamfer").alias("chamfer"))


def chamfer_final(clips: DataFrame) -> DataFrame:
    """One number over all clips, scaled by 1e4."""
    return clips.agg((F.avg("chamfer") * 1e4).alias("chamfer_final"))


def voxel_bce(gt: DataFrame, pred: DataFrame, grid: int = 64) -> DataFrame:
    """Binary cross entropy averaged over all grid cells, logarithms clamped at -100.
    A cell absent on both sides contributes 0, so only the union of the sparse rows is touched."""
    g = gt.select(*FRAME, "i", "j", "k", F.lit(1.0).alias("y"))
    both = g.join(pred.select(*FRAME, "i", "j", "k", "p"), [*FRAME, "i", "j", "k"], "full_outer")
    p = F.coalesce("p", F.lit(0.0))
    clamped = lambda v: F.when(v > 0, F.greatest(F.log(v), F.lit(-100.0))).otherwise(-100.0)
    term = -F.when(F.col("y").isNotNull(), clamped(p)).otherwise(clamped(1 - p))
    return both.groupBy(*FRAME).agg((F.sum(term) / float(grid ** 3)).alias("bce"))


def temporal_occupancy(voxels: DataFrame) -> DataFrame:
    """Mean over time per cell and the dynamic form (1 - mean + 1/T) * min(1, sum)."""
    lens = voxels.groupBy("seq_id").agg((F.max("frame_id") + 1).cast("double").alias("_t"))
    sums = voxels.groupBy("seq_id", "i", "j", "k").agg(F.count(F.lit(1)).cast("double").alias("_n")).join(lens, "seq_id")
    mean = F.col("_n") / F.col("_t")
    return sums.select("seq_id", "i", "j", "k", mean.alias("mean_occ"),
                       ((1 - mean + 1 / F.col("_t")) * F.least(F.lit(1.0), F.col("_n"))).alias("dynamic_occ"))


def surface_faces(voxels: DataFrame, iso: float = 0.5) -> DataFrame:
    """Grid faces between a cell at or above ``iso`` and a neighbour below it or absent."""
    inside = voxels.where(F.col("p") >= iso).select(*FRAME, "i", "j", "k")
    sides = F.array(*[F.struct(F.lit(a).alias("axis"), F.lit(s).alias("side"), *[
        F.lit(s if a == b else 0).alias(f"d{c}") for b, c in zip("xyz", "ijk")]) for a in "xyz" for s in (-1, 1)])
    around = inside.withColumn("o", F.explode(sides)).select(
        *FRAME, "i", "j", "k", "o.axis", "o.side", *[(F.col(c) + F.col(f"o.d{c}")).alias(f"n{c}") for c in "ijk"])
    other = inside.select(*FRAME, *[F.col(c).alias(f"n{c}") for c in "ijk"])
    return around.join(other, [*FRAME, "ni", "nj", "nk"], "left_anti").select(*FRAME, "i", "j", "k", "axis", "side")


def volume_fit(voxels: DataFrame, keypoints: DataFrame, kind: str = "chamfer", grid: int = 64, sigma: float = 1.0) -> DataFrame:
    """How well the keypoints cover the occupied cells: mean squared distance to the nearest keypoint
    (``chamfer``), mean of 1 - largest Gaussian of width 4 sigma and unit height (``gaussian``), 0 (``none``).
    The keypoints of a frame are a fixed small number, so each cell meets only those."""
    if kind == "none":
        return voxels.select(*FRAME).distinct().withColumn("fit", F.lit(0.0))
    cells = voxels.select(*FRAME, "i", "j", "k", *[space.grid_line(F.col(c), grid).alias(a) for a, c in zip("xyz", "ijk")])
    kp = keypoints.select(*FRAME, *[F.col(a).alias(f"k{a}") for a in "xyz"])
    met = cells.join(kp, FRAME)
    if kind == "chamfer":
        d2 = space.dist2(*[F.col(a) for a in "xyz"], *[F.col(f"k{a}") for a in "xyz"])
        best = met.groupBy(*FRAME, "i", "j", "k").agg(F.min(d2).alias("v"))
    elif kind == "gaussian":
        width = 2.0 * (sigma * 4.0 / grid) ** 2
        g = None
        for a in "xyz":
            d = F.col(a) - F.col(f"k{a}")
            e = F.exp(-d * d / F.lit(width))
            g = e if g is None else g * e
        best = met.groupBy(*FRAME, "i", "j", "k").agg((1 - F.max(g)).alias("v"))
    else:
        raise ValueError(kind)
    return best.groupBy(*FRAME).agg(F.avg("v").alias("fit"))
