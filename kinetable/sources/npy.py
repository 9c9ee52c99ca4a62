"""NumPy array files: (T, N, >= 3) sequences and (T, K, 3) joints."""

from __future__ import annotations

from io import BytesIO

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F

BLOCK = 1 << 17  # rows handed to Spark at a time


def _decode(batches):
    for pdf in batches:
        for path, content in zip(pdf["path"], pdf["content"]):
            arr = np.load(BytesIO(content), allow_pickle=False)
            t, n = arr.shape[:2]
            step = max(1, BLOCK // max(n, 1))
            for start in range(0, t, step):
                part = np.asarray(arr[start:start + step, :, :3], dtype=np.float64)
                frames, ids = np.divmod(np.arange(part.shape[0] * n, dtype=np.int64), n)
                flat = part.reshape(-1, 3)
                yield pd.DataFrame({"path": path, "frame_id": frames + start, "vertex_id": ids,
                                    "x": flat[:, 0], "y": flat[:, 1], "z": flat[:, 2]})


def read_npy_sequences(spark: SparkSession, path: str, parts: tuple[str, ...] = ()) -> DataFrame:
    """Points of every ``*.npy`` below ``path``; columns after the third are dropped.

    ``parts`` names the folders above the file from the outermost on (for instance subject, episode); they become
    columns.  The sequence id is the path below ``path`` without its suffix.
    """
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).option("pathGlobFilter", "*.npy").load(path)
    rows = files.select(F.url_decode("path").alias("path"), "content").mapInPandas(
        _decode, "path string, frame_id long, vertex_id long, x double, y double, z double")
    root = path.rstrip("/").split("/")[-1]
    below = F.regexp_replace(F.substring_index(F.col("path"), f"/{root}/", -1), r"\.npy$", "")
    names = F.split(below, "/")
    return rows.select(below.alias("seq_id"), *[F.get(names, F.lit(i)).alias(p) for i, p in enumerate(parts)],
                       "frame_id", "vertex_id", "x", "y", "z")


def read_npy_joints(spark: SparkSession, path: str, parts: tuple[str, ...] = ()) -> DataFrame:
    return read_npy_sequences(spark, path, parts).withColumnRenamed("vertex_id", "k")


def pair_joints(sequences: DataFrame, joints: DataFrame, pattern: str, replacement: str) -> DataFrame:
    """Joints under the ids of their sequences; the joint file name follows from the sequence name by a rule."""
    names = sequences.select("seq_id").distinct().withColumn("_j", F.regexp_replace("seq_id", pattern, replacement))
    return joints.withColumnRenamed("seq_id", "_j").join(names, "_j").drop("_j")
