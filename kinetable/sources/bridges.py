"""The library's tables derived from the star-schema test tables.

``events`` gives point clouds, ``embeddings`` gives joint tracks, ``lineitem`` gives large clouds.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..operators.normalize import normalize
from ..plans.ranking import position_by_id
from ..schema import FRAME

JOINT_COUNT = 21
SEQ_CODES = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def points(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select(
        F.col("event_type").alias("seq_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame_id"),
        "event_id", F.col("value").alias("x"), F.col("user_id").cast("double").alias("y"),
        F.get_json_object("props", "$.k").cast("double").alias("z"))
    return position_by_id(e, FRAME, ["event_id"], "vertex_id").select(*FRAME, "vertex_id", "x", "y", "z")


def lineitem_points(spark: SparkSession, sf_dir: str) -> DataFrame:
    order = ["l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_extendedprice", "l_quantity",
             "l_discount", "l_tax", "l_linestatus"]
    li = table(spark, sf_dir, "lineitem").select(
        F.col("l_returnflag").alias("seq_id"),
        (F.year("l_shipdate") * 12 + F.month("l_shipdate")).cast("long").alias("frame_id"), *order)
    return position_by_id(li, FRAME, order, "vertex_id").select(
        *FRAME, "vertex_id", F.col("l_quantity").alias("x"), F.col("l_extendedprice").alias("y"), F.col("l_discount").alias("z"))


def keypoints(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "embeddings").select(F.col("label").cast("long").alias("seq_id"), "vec_id", "embedding")
    ranked = position_by_id(e, ["seq_id"], ["vec_id"], "frame_id")
    joints = ranked.withColumn("k", F.explode(F.sequence(F.lit(0), F.lit(JOINT_COUNT - 1))))
    at = lambda i: F.get("embedding", i).cast("double")
    return joints.select(
        "seq_id", "frame_id", F.col("k").cast("long").alias("k"),
        *[at(F.col("k") * 3 + i).alias(c) for i, c in enumerate("xyz")],
        F.least(F.lit(1.0), F.abs(at(F.lit(63))) * (F.col("k") + 1)).alias("intensity"))


def bones(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Binary tree over the joints that occur in the keypoints; the root's parent is -1."""
    ks = keypoints(spark, sf_dir).select("k").distinct()
    return ks.select("k", F.when(F.col("k") == 0, -1).otherwise(F.floor((F.col("k") - 1) / 2)).cast("long").alias("parent"))


def faces(pts: DataFrame) -> DataFrame:
    """Triangle strip (i, i+1, i+2) over the vertices of each frame."""
    counts = pts.groupBy(*FRAME).agg(F.count(F.lit(1)).alias("_c"))
    v = F.col("vertex_id")
    return pts.join(counts, FRAME).where(v + 2 < F.col("_c")).select(
        *FRAME, v.alias("face_id"), v.alias("v0"), (v + 1).alias("v1"), (v + 2).alias("v2"))


def affinity(kps: DataFrame) -> DataFrame:
    """Two weight sheets per sequence (even and odd frames): exp(-mean distance) of every joint pair."""
    a = kps.select("seq_id", "frame_id", F.col("k").alias("src"), *[F.col(c).alias(f"a{c}") for c in "xyz"])
    b = kps.select("seq_id", "frame_id", F.col("k").alias("dst"), *[F.col(c).alias(f"b{c}") for c in "xyz"])
    gaps = [F.col(f"a{c}") - F.col(f"b{c}") for c in "xyz"]
    d = F.sqrt(gaps[0] * gaps[0] + gaps[1] * gaps[1] + gaps[2] * gaps[2])
    pairs = a.join(b, FRAME).where(F.col("src") != F.col("dst"))
    return pairs.groupBy(F.col("seq_id").alias("graph_id"), (F.col("frame_id") % 2).alias("n"), "src", "dst").agg(
        F.round(F.exp(-F.avg(d)), 9).alias("w"))


def heat(pts: DataFrame, grid: int = 8) -> DataFrame:
    """One heat channel per event type on a coarse grid."""
    code = F.array_position(F.array(*[F.lit(s) for s in SEQ_CODES]), F.col("seq_id")) - 1
    cell = lambda c, size: F.floor(F.least(F.lit(float(grid - 1)), F.col(c) / size)).cast("long")
    return pts.groupBy("frame_id", code.cast("long").alias("k"), cell("x", 62.5).alias("i"),
                       cell("y", 18.75).alias("j"), cell("z", 12.5).alias("l")).agg(F.sum("x").alias("h"))


def metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "events").select(
        F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("epoch"), F.col("user_id").alias("batch"),
        F.col("event_type").alias("key"), "value")


def clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Event clouds in [-1, 1] under the numeric sequence ids of the joint tracks."""
    code = F.array_position(F.array(*[F.lit(s) for s in SEQ_CODES]), F.col("seq_id")) - 1
    unit = normalize(points(spark, sf_dir), "sequence")
    return unit.withColumn("seq_id", code.cast("long"))


def frames_of_clouds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The frames that have a cloud, under the numeric sequence ids."""
    code = F.array_position(F.array(*[F.lit(s) for s in SEQ_CODES]), F.col("event_type")) - 1
    return table(spark, sf_dir, "events").select(
        code.cast("long").alias("seq_id"), F.datediff("ts", F.lit("2024-01-01")).cast("long").alias("frame_id")).distinct()


def joints(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Joint tracks of the sequences that also have a cloud, spread to the cloud's extent."""
    k = keypoints(spark, sf_dir).join(frames_of_clouds(spark, sf_dir), FRAME, "left_semi")
    return k.withColumns({c: F.col(c) * 3 for c in "xyz"})


def transforms(kps: DataFrame) -> DataFrame:
    """A rigid bone transform per joint: orientation from its own and its successor's position, translation
    its own position.  Columns r (3x3), tx, ty, tz and m (3x4)."""
    from ..functions.rotation import add_rot6d_matrix, compose

    nxt = kps.select(*FRAME, ((F.col("k") + (JOINT_COUNT - 1)) % JOINT_COUNT).alias("k"), *[F.col(c).alias(f"n{c}") for c in "xyz"])
    df = kps.join(nxt, [*FRAME, "k"]).withColumn("p6", F.array("x", "y", "z", "nx", "ny", "nz"))
    df = add_rot6d_matrix(df, "p6", "r")
    return df.select(*FRAME, "k", "r", F.col("x").alias("tx"), F.col("y").alias("ty"), F.col("z").alias("tz"),
                     compose(F.col("r"), F.col("x"), F.col("y"), F.col("z")).alias("m"))
