"""Cached frame tables: write what is new, list and resolve what is there."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.ranking import position_in_order
from ..schema import FRAME


def new_frames(df: DataFrame, done: DataFrame) -> DataFrame:
    """Rows of the frames that are not in ``done`` yet."""
    return df.join(done.select(*FRAME).distinct(), FRAME, "left_anti")


def materialize_frames(df: DataFrame, path: str) -> DataFrame:
    """Append the frames missing under ``path`` (one folder per sequence) and read the whole table back."""
    spark = df.sparkSession
    try:
        todo = new_frames(df, spark.read.parquet(path))
    except AnalysisException as e:
        if e.getCondition() != "PATH_NOT_FOUND":
            raise
        todo = df
    # tasks by (sequence, run of frames): files stay large without one task holding a long sequence
    todo = todo.repartition("seq_id", F.floor(F.col("frame_id") / 64))
    todo.write.mode("append").partitionBy("seq_id").parquet(path)
    return read_frame_tables(spark, path, df.schema)


def read_frame_tables(spark: SparkSession, path: str, schema=None) -> DataFrame:
    reader = spark.read if schema is None else spark.read.schema(schema)
    df = reader.parquet(path)
    return df if schema is None else df.select(*schema.fieldNames())


def number_frames(frames: DataFrame) -> DataFrame:
    """``frames(seq_id, name)`` with the 1-based number of each name in name order."""
    return position_in_order(frames, ["seq_id"], ["name"], "_p").withColumn("number", F.col("_p") + 1).drop("_p")


def resolve_frame(numbered: DataFrame, selector: str) -> DataFrame:
    """Digits select by number, anything else by exact name; selecting nothing is an error at run time."""
    hit = F.col("number") == int(selector) if selector.isdigit() else F.col("name") == selector
    found = numbered.where(hit)
    n = found.agg(F.count(F.lit(1))).scalar()
    checked = F.when(n == 0, F.raise_error(F.lit(f"frame {selector!r} not found")).cast("long")).otherwise(F.col("number"))
    # the check must run even when no row matches, so it guards the unfiltered listing
    return numbered.withColumn("number", checked).where(hit)
