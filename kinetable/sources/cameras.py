"""Camera files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..schema import CAMERA


def read_camera_json(spark: SparkSession, path: str) -> DataFrame:
    """Extrinsic (16 values, column by column) and intrinsic parameters; translation is extrinsic[12..14]."""
    df = spark.read.schema(CAMERA).option("multiLine", True).json(path)
    at = lambda i: F.get("extrinsic", F.lit(i))
    return df.select(
        F.url_decode(F.col("_metadata.file_path")).alias("path"), "extrinsic", "intrinsic",
        *[at(12 + i).alias(f"t{c}") for i, c in enumerate("xyz")],
        F.array(*[at(4 * c + r) for r in range(3) for c in range(3)]).alias("r"),
        F.get("intrinsic.intrinsic_matrix", F.lit(0)).alias("fx"), F.get("intrinsic.intrinsic_matrix", F.lit(4)).alias("fy"),
        F.get("intrinsic.intrinsic_matrix", F.lit(6)).alias("cx"), F.get("intrinsic.intrinsic_matrix", F.lit(7)).alias("cy"))
