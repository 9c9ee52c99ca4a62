"""Bounding boxes, normalisation, occupancy and checks of point tables.

Boxes are aggregated (with map-side partial results) and joined back; a window over a frame would put that
whole frame into one task.  No broadcast is forced.  The box of a sequence is written first, so Spark knows its true
size and need not shuffle the points to meet it; frame boxes are joined by frame, skewed partitions being split.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from ..functions import space
from ..plans.lineage import sized
from ..schema import FRAME

SCOPES = {"frame": ["seq_id", "frame_id"], "sequence": ["seq_id"], "all": []}


def bbox(points: DataFrame, scope: str = "frame") -> DataFrame:
    """bmin_*, bmax_* and blen (largest axis extent) per frame, per sequence or over everything."""
    keys = SCOPES[scope]
    ends = [f(a).alias(f"{n}_{a}") for n, f in (("bmin", F.min), ("bmax", F.max)) for a in "xyz"]
    box = points.groupBy(*keys).agg(*ends)
    return box.withColumn("blen", F.greatest(*[F.col(f"bmax_{a}") - F.col(f"bmin_{a}") for a in "xyz"]))


def with_box(df: DataFrame, box: DataFrame, scope: str) -> DataFrame:
    keys = SCOPES[scope]
    fields = ["bmin_x", "bmin_y", "bmin_z", "blen"]
    if keys:
        return df.join(box.select(*keys, *fields), keys)
    one = box.select(F.struct(*fields).alias("b")).scalar()  # one row: a scalar subquery, not a join
    return df.withColumn("_b", one).select("*", *[F.col(f"_b.{f}").alias(f) for f in fields]).drop("_b")


def normalize(points: DataFrame, scope: str = "frame", scale: float = 1.0, x_trans: float = 0.0,
              z_trans: float = 0.0, box: DataFrame | None = None, keep_box: bool = False) -> DataFrame:
    """Points to [-1, 1] by the isotropic box of ``scope``."""
    if box is None:
        box = bbox(points, scope)
        if scope == "sequence":
            box = sized(box, "box")
    boxed = with_box(points, box, scope)
    shift = {"x": x_trans, "y": 0.0, "z": z_trans}
    out = boxed.withColumns({a: space.to_unit(F.col(a), F.col(f"bmin_{a}"), F.col("blen"), scale, shift[a]) for a in "xyz"})
    return out if keep_box else out.drop("bmin_x", "bmin_y", "bmin_z", "blen")


def normalize_joints(joints: DataFrame, points: DataFrame, scope: str = "sequence", scale: float = 1.0) -> DataFrame:
    """Joints by the box of the *points*; the translation term of the points is not applied."""
    box = bbox(points, scope)
    return normalize(joints, scope, scale, box=sized(box, "box") if scope == "sequence" else box)


def denormalize(points: DataFrame, box: DataFrame, scope: str = "frame") -> DataFrame:
    boxed = with_box(points, box, scope)
    return boxed.withColumns({a: space.from_unit(F.col(a), F.col(f"bmin_{a}"), F.col("blen")) for a in "xyz"}).drop(
        "bmin_x", "bmin_y", "bmin_z", "blen")


def with_cells(points: DataFrame, grid: int, on_outside: str = "error") -> DataFrame:
    """Cell (i, j, k) of normalised points; points outside the grid raise, are dropped or are clipped."""
    cells = points.withColumns({c: space.voxel_index(F.col(a), grid) for a, c in zip("xyz", "ijk")})
    inside = (F.least("i", "j", "k") >= 0) & (F.greatest("i", "j", "k") < grid)
    if on_outside == "drop":
        return cells.where(inside)
    if on_outside == "clip":
        return cells.withColumns({c: F.least(F.greatest(F.col(c), F.lit(0)), F.lit(grid - 1)) for c in "ijk"})
    if on_outside == "error":
        fail = F.raise_error(F.format_string("point outside the %d grid", F.lit(grid))).cast("int")
        return cells.withColumn("i", F.when(inside, F.col("i")).otherwise(fail))
    raise ValueError(on_outside)


def voxelize(points: DataFrame, grid: int = 64, on_outside: str = "error") -> DataFrame:
    """Occupied cells of normalised points with the number of points in each."""
    return with_cells(points, grid, on_outside).groupBy(*FRAME, "i", "j", "k").agg(F.count(F.lit(1)).alias("n"))


def voxel_centers(voxels: DataFrame, grid: int = 64) -> DataFrame:
    return voxels.withColumns({a: space.voxel_center(F.col(c), grid) for a, c in zip("xyz", "ijk")})


def occupied(voxels: DataFrame) -> DataFrame:
    """Cells whose probability is at least one half, as set members."""
    return voxels.where(F.col("p") >= 0.5)


def coord_grid(df: DataFrame, grid: int, dims: int = 3) -> DataFrame:
    """Every cell of a ``grid`` ** ``dims`` lattice for each row of ``df``, with its coordinates in [-1, 1]."""
    for axis, cell in list(zip("xyz", "ijk"))[:dims]:
        df = df.withColumn(cell, F.explode(F.sequence(F.lit(0), F.lit(grid - 1))))
        df = df.withColumn(f"g{axis}", space.grid_line(F.col(cell), grid))
    return df


def centroid_stats(points: DataFrame, keys: list[str] = FRAME) -> DataFrame:
    """Centroid, population spread and extent per axis."""
    aggs: list[Column] = []
    for a in "xyz":
        aggs += [F.avg(a).alias(f"mean_{a}"), F.stddev_pop(a).alias(f"std_{a}"), (F.max(a) - F.min(a)).alias(f"extent_{a}")]
    return points.groupBy(*keys).agg(*aggs)


def validate_points(points: DataFrame, warn_abs: float = 10.0) -> DataFrame:
    """Per frame: row count, non-finite rows, zero extent, rows beyond ``warn_abs``."""
    bad = F.lit(False)
    far = F.lit(False)
    for a in "xyz":
        bad = bad | F.col(a).isNull() | F.isnan(a) | (F.abs(a) == float("inf"))
        far = far | (F.abs(a) > warn_abs)
    span = F.greatest(*[F.max(a) - F.min(a) for a in "xyz"])
    return points.groupBy(*FRAME).agg(
        F.count(F.lit(1)).alias("n_vertices"),
        F.sum(bad.cast("long")).alias("n_not_finite"),
        F.sum((far & ~bad).cast("long")).alias("n_far"),
        (span == 0).alias("zero_extent"),
    )


def validate_sequences(points: DataFrame, min_frames: int = 2, min_vertices: int = 3, fail: bool = False) -> DataFrame:
    """One verdict per sequence from the frame checks; ``fail`` turns a bad verdict into an error."""
    frames = validate_points(points)
    out = frames.groupBy("seq_id").agg(
        F.count(F.lit(1)).alias("n_frames"), F.min("n_vertices").alias("min_vertices"),
        F.sum("n_not_finite").alias("n_not_finite"), F.sum("n_far").alias("n_far"),
        F.sum(F.col("zero_extent").cast("long")).alias("n_flat_frames"),
    )
    ok = ((F.col("n_frames") >= min_frames) & (F.col("min_vertices") >= min_vertices)
          & (F.col("n_not_finite") == 0) & (F.col("n_flat_frames") == 0))
    out = out.withColumn("ok", ok)
    if fail:
        message = F.format_string("sequence %s failed validation", F.col("seq_id").cast("string"))
        out = out.withColumn("ok", F.when(F.col("ok"), True).otherwise(F.raise_error(message).cast("boolean")))
    return out


def select_template(points: DataFrame) -> DataFrame:
    """Frame with most vertices per sequence; the earliest frame wins a tie."""
    counts = points.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("n"))
    best = F.max_by("frame_id", F.struct("n", -F.col("frame_id")))
    return counts.groupBy("seq_id").agg(best.alias("frame_id"), F.max("n").alias("n_vertices"))


def cloud_quality(points: DataFrame) -> DataFrame:
    """Size, range, mean and population deviation of every frame."""
    aggs = [F.count(F.lit(1)).alias("n_vertices"),
            F.least(*[F.min(a) for a in "xyz"]).alias("lo"), F.greatest(*[F.max(a) for a in "xyz"]).alias("hi")]
    for a in "xyz":
        aggs += [F.avg(a).alias(f"mean_{a}"), F.stddev_pop(a).alias(f"std_{a}")]
    return points.groupBy(*FRAME).agg(*aggs)


def cloud_difference(a: DataFrame, b: DataFrame) -> DataFrame:
    """Same frame under two methods: mean, maximum and population deviation of the absolute change."""
    other = b.select(*FRAME, "vertex_id", *[F.col(c).alias(f"b_{c}") for c in "xyz"])
    gaps = a.join(other, [*FRAME, "vertex_id"]).select(
        *FRAME, F.explode(F.array(*[F.abs(F.col(c) - F.col(f"b_{c}")) for c in "xyz"])).alias("d"))
    return gaps.groupBy(*FRAME).agg(
        F.avg("d").alias("mean_abs"), F.max("d").alias("max_abs"), F.stddev_pop("d").alias("std_abs"))
