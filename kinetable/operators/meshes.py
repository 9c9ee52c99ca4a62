"""Triangle meshes: normals, joint regression."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..functions.space import norm3
from ..schema import FRAME
from .sampling import triangles, with_face_normal


def vertex_normals(points: DataFrame, faces: DataFrame) -> DataFrame:
    """Area-weighted mean direction of the faces around each vertex; zero where the faces cancel."""
    tri = with_face_normal(triangles(points, faces))
    corners = tri.select(*FRAME, F.explode(F.array("v0", "v1", "v2")).alias("vertex_id"), "cx", "cy", "cz")
    sums = corners.groupBy(*FRAME, "vertex_id").agg(*[F.sum(f"c{c}").alias(f"s{c}") for c in "xyz"])
    sums = sums.withColumn("_n", norm3(F.col("sx"), F.col("sy"), F.col("sz")))
    return sums.select(*FRAME, "vertex_id", *[F.when(F.col("_n") > 0, F.col(f"s{c}") / F.when(F.col("_n") > 0, F.col("_n"))).otherwise(0.0).alias(f"n{c}") for c in "xyz"])


def regress_joints(points: DataFrame, regressor: DataFrame) -> DataFrame:
    """J_k = sum_v reg(k, v) p_v per frame; ``regressor(vertex_id, k, w)`` is one table for all sequences."""
    return points.join(regressor, "vertex_id").groupBy(*FRAME, "k").agg(
        *[F.sum(F.col("w") * F.col(c)).alias(c) for c in "xyz"])
