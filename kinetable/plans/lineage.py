"""Cutting the lineage of iterative jobs with tables in the cluster's shared checkpoint folder."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame, SparkSession

_LOCAL_DIR: dict[str, str] = {}


def state_dir(spark: SparkSession) -> str:
    """The shared folder named by ``spark.checkpoint.dir``; only a local session may fall back to a scratch folder."""
    shared = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    app = spark.sparkContext.applicationId
    if shared:
        return f"{shared.rstrip('/')}/{app}"
    if not spark.sparkContext.master.startswith("local"):
        raise RuntimeError("set spark.checkpoint.dir to a folder every executor can reach")
    if app not in _LOCAL_DIR:
        _LOCAL_DIR[app] = tempfile.mkdtemp(prefix="spark-kinetable-")
    return f"{_LOCAL_DIR[app]}/{app}"


def cut(df: DataFrame, label: str = "state", by: str | None = None) -> DataFrame:
    """Write ``df`` once and continue from the written table; ``by`` keeps one folder per value, so a loop that
    reads one value per step does not scan the others.

    The table survives the loss of executors, stops the plan from growing with every loop step, and gives
    the optimizer exact sizes, so whether a side is broadcast is decided on its true size.
    """
    spark = df.sparkSession
    path = f"{state_dir(spark)}/{label}-{uuid.uuid4().hex}"
    if by:
        df.repartition(by, *[c for c in ("seq_id", "vertex_id") if c in df.columns]).write.partitionBy(by).parquet(path)
    else:
        df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def sized(df: DataFrame, label: str = "side") -> DataFrame:
    """A small join side (one row per sequence, joint or the like), written so that its true size is known.

    An aggregate is planned with the size of its input, so the table it is joined to would be shuffled even when
    the side has a handful of rows.  From the written table Spark broadcasts it below
    ``spark.sql.autoBroadcastJoinThreshold`` and shuffles both sides above it.
    """
    return cut(df, label)
