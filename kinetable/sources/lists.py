"""Text lists: split members, sectioned lists, ignore lists."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F


def read_split_list(spark: SparkSession, path: str, split: str) -> DataFrame:
    """One sequence id per line; blank lines are skipped."""
    return spark.read.text(path).select(F.trim("value").alias("seq_id")).where("seq_id <> ''").withColumn("split", F.lit(split))


def assign_split(sequences: DataFrame, members: DataFrame) -> DataFrame:
    """Split of each sequence; null when no list names it."""
    return sequences.join(members, "seq_id", "left")


def read_sectioned_list(spark: SparkSession, path: str) -> DataFrame:
    """Two-token header lines ``id gender`` followed by one-token members: (id, gender, member).

    A file is one row; inside it the lines are folded with the header carried along, so no window runs over lines.
    """
    text = spark.read.text(path, wholetext=True)
    lines = F.transform(F.split("value", r"\r?\n"), lambda s: F.split(F.trim(s), r"\s+"))
    state = "struct<id:string,gender:string,rows:array<struct<id:string,gender:string,member:string>>>"
    start = F.struct(F.lit(None).cast("string").alias("id"), F.lit(None).cast("string").alias("gender"),
                     F.expr("cast(array() as array<struct<id:string,gender:string,member:string>>)").alias("rows")).cast(state)

    def step(acc, tokens):
        header = F.size(tokens) == 2
        member = (F.size(tokens) == 1) & (tokens[0] != "") & acc["id"].isNotNull()
        row = F.struct(acc["id"].alias("id"), acc["gender"].alias("gender"), tokens[0].alias("member"))
        return F.struct(
            F.when(header, tokens[0]).otherwise(acc["id"]).alias("id"),
            F.when(header, F.regexp_replace(F.get(tokens, F.lit(1)), r"[()]", "")).otherwise(acc["gender"]).alias("gender"),
            F.when(member, F.concat(acc["rows"], F.array(row))).otherwise(acc["rows"]).alias("rows")).cast(state)

    rows = text.select(F.explode(F.aggregate(lines, start, step, lambda a: a["rows"])).alias("r"))
    return rows.select("r.*")


def drop_by_prefix(sequences: DataFrame, ignore: DataFrame, length: int = 26) -> DataFrame:
    """Sequences whose first ``length`` characters equal those of no ignored name."""
    keys = ignore.select(F.substring("seq_id", 1, length).alias("_prefix")).distinct()
    return sequences.withColumn("_prefix", F.substring("seq_id", 1, length)).join(keys, "_prefix", "left_anti").drop("_prefix")
