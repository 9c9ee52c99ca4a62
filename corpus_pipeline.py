"""The corpus pipeline: language, near duplicates, personal data, packing.

Each stage works on all rows that the one before kept and is written as Parquet before the next reads it.
"""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from kinetable.llm import op7_language, op9_jaccard, op10_pii
from kinetable.llm.common import cut, table
from kinetable.llm.queries import pack_digests
from kinetable.plans.lineage import state_dir


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without those that language identification rejects: no letter at all, or a score below the threshold."""
    return op7_language.keep_known(docs, op7_language.train(docs, ~op7_language.held_out()))


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group that shingle similarity links: that with the smallest id.

    Of rows that repeat the smallest id the first by their other columns stays; rows with a null id all stay."""
    groups = op9_jaccard.join(docs).select(F.col("doc_id").alias("_id"), (F.col("doc_id") == F.col("component_id")).alias("_first"))
    kept = cut(groups.where("_first").select("_id").distinct(), "kept")  # written, so that the groups are made once
    out = docs.join(kept, docs["doc_id"] == kept["_id"], "left_semi")
    repeated = cut(docs.groupBy("doc_id").agg(F.count(F.lit(1)).alias("_n")).where("_n > 1").select("doc_id"), "repeated")
    once = out.join(repeated, "doc_id", "left_anti")
    several = out.join(repeated, "doc_id", "left_semi")
    least = several.groupBy("doc_id").agg(F.min(F.struct(*[c for c in docs.columns if c != "doc_id"])).alias("_row"))
    least = least.select(*[F.col("doc_id") if c == "doc_id" else F.col("_row")[c].alias(c) for c in docs.columns])
    return once.select(docs.columns).unionByName(least).unionByName(docs.where("doc_id IS NULL"))


def personal_data(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind; n_chars is that of the new text."""
    out = op10_pii.redact(docs, op10_pii.train(docs))
    return out.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text").cast("long")))


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of all documents in sequences of 2048 tokens."""
    return pack_digests(docs)


STAGES = [("language_id", language), ("ngram_jaccard_join", near_duplicates), ("pii", personal_data), ("packing", packing)]
#: Trained models, graph components and a tokenizer: not for SQL; tests hold the rows against a brute-force version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        path = f"{state_dir(spark)}/{name}-{uuid.uuid4().hex}"
        stage(spark, docs, sf_dir).write.parquet(path)
        docs = spark.read.parquet(path)
    return docs


SPARK = {"pipeline": run}
SQL = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
