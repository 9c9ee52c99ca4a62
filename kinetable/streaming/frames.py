"""Incremental ingest of frame files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from ..functions import space
from ..sources.obj import vertex_array


def frame_stream(spark: SparkSession, path: str, max_files: int = 1000) -> DataFrame:
    """Rows (seq_id, frame_id, value) of the frame files appearing under ``seq_id=.../frame_id=...``."""
    text = (spark.readStream.format("text").option("wholetext", True).option("maxFilesPerTrigger", max_files)
            .option("recursiveFileLookup", True).schema("value string").load(path))
    file = F.url_decode(F.col("_metadata.file_path"))
    return text.select(F.regexp_extract(file, r"seq_id=([^/]+)", 1).alias("seq_id"),
                       F.regexp_extract(file, r"frame_id=(\d+)", 1).cast("long").alias("frame_id"), "value")


def voxel_rows(frames: DataFrame, grid: int = 64) -> DataFrame:
    """Frame-wise normalised occupied cells of whole-file rows.

    A file is one frame, so its box, its cells and their de-duplication are array functions of one row: the stream
    has no state, needs no watermark and never emits a frame twice.  The same function serves batch reads.
    """
    f = frames.withColumn("_v", vertex_array(F.col("value"))).where(F.size("_v") > 0)
    for c in "xyz":
        f = f.withColumn(f"_{c}", F.col("_v")[c])
    f = f.withColumns({**{f"_lo{c}": F.array_min(f"_{c}") for c in "xyz"}, **{f"_hi{c}": F.array_max(f"_{c}") for c in "xyz"}})
    f = f.withColumn("_len", F.greatest(*[F.col(f"_hi{c}") - F.col(f"_lo{c}") for c in "xyz"]))
    cell = lambda p, c: space.voxel_index(space.to_unit(p[c], F.col(f"_lo{c}"), F.col("_len")), grid)
    cells = F.array_distinct(F.transform("_v", lambda p: F.struct(*[cell(p, c).alias(i) for c, i in zip("xyz", "ijk")])))
    return f.select("seq_id", "frame_id", F.explode(cells).alias("_c")).select("seq_id", "frame_id", "_c.i", "_c.j", "_c.k")


def stream_frames(spark: SparkSession, source: str, sink: str, checkpoint: str, grid: int = 64) -> StreamingQuery:
    """Append the voxels of all files not processed yet; the checkpoint remembers them across runs."""
    return (voxel_rows(frame_stream(spark, source), grid).writeStream.format("parquet").outputMode("append")
            .option("path", sink).option("checkpointLocation", checkpoint).trigger(availableNow=True).start())
