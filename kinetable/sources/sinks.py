"""Result sinks and table reports."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from ..operators.interpolate import manifest


def write_interpolation(meshes: DataFrame, pairs: DataFrame, method: str, steps: int, path: str, transforms: DataFrame | None = None) -> None:
    """Meshes, optional bone transforms and the manifest as three tables under ``path``."""
    meshes.write.mode("overwrite").partitionBy("seq_id").parquet(f"{path}/meshes")
    if transforms is not None:
        transforms.write.mode("overwrite").partitionBy("seq_id").parquet(f"{path}/transforms")
    manifest(pairs, method, steps).write.mode("overwrite").parquet(f"{path}/manifest")


def write_named_texts(files: DataFrame, path: str) -> None:
    """One file below ``path`` per row of ``files(file, text)``, under its own name, in any store that Arrow can open.

    A task that runs again writes the same bytes to the same name."""
    def write(rows) -> None:
        from pyarrow.fs import FileSystem

        store, root = FileSystem.from_uri(path)
        for row in rows:
            name = f"{root}/{row['file']}"
            store.create_dir(name.rsplit("/", 1)[0], recursive=True)
            with store.open_output_stream(name) as f:
                f.write(row["text"].encode())

    files.select("file", "text").foreachPartition(write)


def write_metric_csv(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").csv(path)


def describe_tables(tables: dict[str, DataFrame], value: str = "x") -> DataFrame:
    """One row per table: rows, frames, vertices and the range of ``value``.

    Frames and vertices are counted on pre-aggregated rows, so no distinct set is gathered in one task."""
    out = None
    for name, df in tables.items():
        frames = df.groupBy("seq_id", "frame_id").agg(
            F.count(F.lit(1)).alias("n"), F.min(value).alias("lo"), F.max(value).alias("hi"))
        one = frames.agg(
            F.lit(name).alias("table"), F.sum("n").alias("rows"), F.count(F.lit(1)).alias("frames"),
            F.max("n").alias("most_rows"), F.min("lo").alias("min_value"), F.max("hi").alias("max_value"))
        out = one if out is None else out.unionByName(one)
    return out


def rows_by_frame(df: DataFrame) -> DataFrame:
    """Row counts per frame, per sequence and in total (nulls mark the totals)."""
    return df.rollup("seq_id", "frame_id").agg(F.count(F.lit(1)).alias("rows"))


def count_files(spark, path: str) -> DataFrame:
    """Files below ``path`` per suffix with their total size."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", True).load(path).select("path", "length")
    return files.groupBy(F.regexp_extract("path", r"(\.[^./]+)$", 1).alias("kind")).agg(
        F.count(F.lit(1)).alias("files"), F.sum("length").alias("bytes"))
