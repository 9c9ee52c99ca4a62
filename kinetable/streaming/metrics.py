"""Running means of metric events."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery


def windowed_means(metrics: DataFrame, window: str = "1 day", late: str = "1 hour") -> DataFrame:
    """Mean and count per tumbling window and key of ``metrics(ts, key, value)``; events later than ``late`` behind
    the newest one are dropped and finished windows leave the state."""
    return (metrics.withWatermark("ts", late).groupBy(F.window("ts", window), "key")
            .agg(F.avg("value").alias("value"), F.count(F.lit(1)).alias("n"))
            .select(F.col("window.start").alias("start"), "key", "value", "n"))


def stream_metrics(metrics: DataFrame, sink: str, checkpoint: str, window: str = "1 day", late: str = "1 hour") -> StreamingQuery:
    """Changed windows of each trigger go to the table ``sink`` with their batch number.  A batch that is repeated
    after a failure overwrites its own folder, so the sink holds each batch once."""
    def save(df: DataFrame, batch: int) -> None:
        df.write.mode("overwrite").parquet(f"{sink}/batch={batch}")

    return (windowed_means(metrics, window, late).writeStream.outputMode("update").foreachBatch(save)
            .option("checkpointLocation", checkpoint).trigger(availableNow=True).start())


def latest_means(spark: SparkSession, sink: str) -> DataFrame:
    """Last value of each window and key."""
    rows = spark.read.parquet(sink)
    return rows.groupBy("start", "key").agg(F.max_by("value", "batch").alias("value"), F.max_by("n", "batch").alias("n"))
