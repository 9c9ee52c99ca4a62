"""Wavefront OBJ frames.

A file of at most ``WHOLE`` bytes is one row (``wholetext``); vertex and face ordinals are array positions inside that row,
so reading needs no window, no shuffle, and also works on a stream.  A larger file is read as lines, by as many tasks as it
has blocks: vertices and faces are numbered inside each block, and the totals of the blocks before are added.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window, functions as F

from ..functions.names import base_name
from ..plans.lineage import cut
from ..plans.ranking import position_in_order
from ..schema import FRAME

#: Bytes of the largest file that is read as one row.
WHOLE = 64 << 20


def file_paths(df: DataFrame) -> DataFrame:
    """Sequence (folder) and frame name of each file."""
    path = F.url_decode(F.col("_metadata.file_path"))
    return df.select("*", F.element_at(F.split(path, "/"), -2).alias("seq_id"), base_name(path).alias("name"), path.alias("path"))


def lines_of(text: Column, tag: str) -> Column:
    """Token arrays of the lines that start with ``tag``."""
    rows = F.filter(F.split(text, r"\r?\n"), lambda s: s.rlike(rf"^\s*{tag}\s"))
    tokens = F.transform(rows, lambda s: F.split(F.trim(s), r"\s+"))
    return F.transform(tokens, lambda t: F.slice(t, F.lit(2), F.size(t)))


def vertex_array(text: Column) -> Column:
    return F.transform(lines_of(text, "v"), lambda t: F.struct(*[t[i].cast("double").alias(c) for i, c in enumerate("xyz")]))


def face_array(text: Column) -> Column:
    """0-based triangles; a polygon becomes a fan, a negative number counts back from the last vertex.  A face line with
    fewer than three corners is no face."""
    count = F.size(lines_of(text, "v"))
    whole = lambda s: F.split(s, "/")[0].cast("long")
    at = lambda s: F.when(whole(s) < 0, count + whole(s)).otherwise(whole(s) - 1)
    fans = F.transform(F.filter(lines_of(text, "f"), lambda t: F.size(t) >= 3), lambda t: F.transform(
        F.sequence(F.lit(1), F.size(t) - 2),
        lambda i: F.struct(at(t[0]).alias("v0"), at(F.get(t, i)).alias("v1"), at(F.get(t, i + 1)).alias("v2"))))
    return F.flatten(fans)


def read_obj_frames(spark: SparkSession, path: str, whole: int = WHOLE) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(frames, points, faces) of ``<sequence>/<name>.obj`` files; frame_id is the rank of the name in its folder.

    Files of more than ``whole`` bytes are read by blocks, whose lines end in LF, CR LF or CR."""
    source = lambda text: file_paths(spark.read.text(path, wholetext=text, recursiveFileLookup=True, pathGlobFilter="*.obj"))
    size = F.col("_metadata.file_size")
    text = source(True)
    listing = position_in_order(text.select("seq_id", "name", "path", size.alias("_size")), ["seq_id"], ["name"], "frame_id")
    named = listing.drop("_size")
    frames = text.where(size <= whole).select("path", "value").join(named, "path")
    points = frames.select(*FRAME, F.posexplode(vertex_array(F.col("value"))).alias("vertex_id", "p")).select(
        *FRAME, F.col("vertex_id").cast("long").alias("vertex_id"), "p.x", "p.y", "p.z")
    faces = frames.select(*FRAME, F.posexplode(face_array(F.col("value"))).alias("face_id", "f")).select(
        *FRAME, F.col("face_id").cast("long").alias("face_id"), "f.v0", "f.v1", "f.v2")
    if listing.where(F.col("_size") > whole).isEmpty():
        return named, points, faces
    more_points, more_faces = _by_blocks(source(False).where(size > whole), named)
    return named, points.unionByName(more_points), faces.unionByName(more_faces)


def _by_blocks(lines: DataFrame, listing: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Points and faces of files whose lines are rows.

    Of the vertex and face lines, the tokens are written with their block and their order in the task that read them; a
    window covers one block at most, and only one row a block is summed over a file."""
    tokens = F.split(F.trim(F.regexp_replace("value", r"\s+", " ")), " ")
    kept = lines.withColumn("t", tokens).where(F.get("t", F.lit(0)).isin("v", "f")).select(
        "path", F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("row"),
        (F.col("t")[0] == "v").alias("vertex"), F.slice("t", F.lit(2), F.size("t")).alias("t"))
    kept = cut(kept.select("*", F.when(F.col("vertex"), 1).otherwise(F.greatest(F.size("t") - 2, F.lit(0))).cast("long").alias("n")), "obj-lines")
    in_block = ["path", "vertex", "block"]
    sums = kept.groupBy(*in_block).agg(F.sum("n").alias("n"))
    earlier = Window.partitionBy("path", "vertex").orderBy("block").rowsBetween(Window.unboundedPreceding, -1)
    before = cut(sums.select(*in_block, F.coalesce(F.sum("n").over(earlier), F.lit(0)).alias("before")), "obj-blocks")
    upto = F.sum("n").over(Window.partitionBy(*in_block).orderBy("row").rowsBetween(Window.unboundedPreceding, 0))
    placed = kept.withColumn("upto", upto).join(before, in_block).withColumn("first", F.col("before") + F.col("upto") - F.col("n"))
    placed = placed.join(listing.select("path", *FRAME), "path")
    at = lambda i: F.get("t", F.lit(i)).cast("double")
    points = placed.where("vertex").select(*FRAME, F.col("first").alias("vertex_id"), *[at(i).alias(c) for i, c in enumerate("xyz")])
    count = sums.where("vertex").groupBy("path").agg(F.sum("n").alias("vertices"))
    fans = placed.where("NOT vertex AND n > 0").join(count, "path", "left").withColumn("i", F.explode(F.sequence(F.lit(1).cast("long"), F.col("n"))))
    number = lambda s: F.split(s, "/")[0].cast("long")
    corner = lambda s: F.when(number(s) < 0, F.coalesce("vertices", F.lit(0)) + number(s)).otherwise(number(s) - 1)
    i = F.col("i").cast("int")
    faces = fans.select(*FRAME, (F.col("first") + F.col("i") - 1).alias("face_id"), corner(F.col("t")[0]).alias("v0"),
                        corner(F.get("t", i)).alias("v1"), corner(F.get("t", i + 1)).alias("v2"))
    return points, faces


def obj_lines(points: DataFrame, faces: DataFrame | None = None) -> DataFrame:
    """Text lines of each frame with their order: vertices by id, then 1-based faces by id."""
    out = points.select(*FRAME, F.lit(0).alias("kind"), F.col("vertex_id").alias("ord"),
                        F.concat_ws(" ", F.lit("v"), *[F.col(c).cast("string") for c in "xyz"]).alias("value"))
    if faces is not None:
        out = out.unionByName(faces.select(*FRAME, F.lit(1).alias("kind"), F.col("face_id").alias("ord"), F.concat_ws(
            " ", F.lit("f"), *[(F.col(f"v{i}") + 1).cast("string") for i in range(3)]).alias("value")))
    return out


def write_obj_frames(points: DataFrame, faces: DataFrame | None, path: str) -> None:
    """One file per frame under ``seq_id=.../frame_id=...``.  A frame is one OBJ file, hence one writing task; its
    lines are sorted on disk when they do not fit in memory."""
    lines = obj_lines(points, faces).repartition(*FRAME).sortWithinPartitions(*FRAME, "kind", "ord")
    lines.select(*FRAME, "value").write.partitionBy(*FRAME).text(path)
