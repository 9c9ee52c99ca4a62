"""The corpus operators as registered queries over the given tables, and the same in SQL where SQL can state it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession, functions as F

from . import op1_near_vectors, op2_warc, op3_sharding, op4_packing, op5_prefix_forest, op6_bpe, op7_language, op8_token_counts, op9_jaccard, op10_pii, op11_filter_audit, op12_byte_bpe, op13_importance
from ..plans.lineage import state_dir
from .common import table

SPARK: dict = {}
SQL: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def add(fn):
        SPARK[name] = fn
        if sql:
            SQL[name] = sql
        return fn
    return add


def vocabulary(name: str) -> str:
    import public_tokenizers
    return public_tokenizers.path(name)


@query("op1_near_vectors")
def near_vectors(spark: SparkSession, sf: str) -> DataFrame:
    return op1_near_vectors.near_vectors(table(spark, sf, "embeddings"))


@query("op2_warc_transactions", f"""
    with p as (select page_id, strlen(coalesce(html, ''))::bigint as payload_bytes, sha256(coalesce(html, '')) as payload_digest from pages),
         m as (select *, min(page_id) over (partition by payload_digest) as f from p)
    select page_id, payload_bytes, payload_digest,
           case when payload_bytes >= {op2_warc.MIN_REVISIT} and page_id > f then 'revisit' else 'response' end as record_type,
           case when payload_bytes >= {op2_warc.MIN_REVISIT} and page_id > f then f end as refers_to from m""")
def warc(spark: SparkSession, sf: str) -> DataFrame:
    path = f"{state_dir(spark)}/warc-{uuid.uuid4().hex}"
    op2_warc.write(table(spark, sf, "pages"), path)
    return page_digests(op2_warc.captures(op2_warc.read(spark, path)))


def page_digests(captures: DataFrame) -> DataFrame:
    page = lambda c: F.regexp_extract(c, r"^urn:page:(-?[0-9]+)", 1).try_cast("long")
    own = F.col("response.type") == "response"
    return captures.select(
        page("capture_id").alias("page_id"),
        F.when(own, F.col("response.read_bytes")).otherwise(F.col("response.payload_bytes")).alias("payload_bytes"),
        F.when(own, F.col("response.read_digest")).otherwise(F.col("response.payload_digest")).alias("payload_digest"),
        F.col("response.type").alias("record_type"), page("response.refers_to").alias("refers_to"))


#: Bytes of a shard.
SHARD_BYTES = 1 << 20


@query("op3_extendible_hashing", op3_sharding.sql(SHARD_BYTES))
def sharding(spark: SparkSession, sf: str) -> DataFrame:
    return op3_sharding.shards(table(spark, sf, "documents"), SHARD_BYTES)


@query("op4_harmonic_packing")
def packing(spark: SparkSession, sf: str) -> DataFrame:
    return pack_digests(table(spark, sf, "documents"))


def pack_digests(docs: DataFrame) -> DataFrame:
    cut = op4_packing.pieces(docs, vocabulary("byte_bpe_50k.json"))
    return op4_packing.pack(cut.select("doc_id", "start", "length", F.crc32("ids").alias("ids_crc32"), "doc_tokens"))


@query("op5_prefix_forest")
def nearest(spark: SparkSession, sf: str) -> DataFrame:
    return op5_prefix_forest.nearest(table(spark, sf, "embeddings"), F.col("vec_id") % 20 == 0)


@query("op6_bpe_backtracking")
def bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = op6_bpe.encode(table(spark, sf, "documents"), vocabulary("word_bpe_49k.json"))
    return coded.select("doc_id", F.size("ids").cast("long").alias("n_tokens"),
                        F.sha2(F.array_join("ids", " "), 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op7_language_id")
def language(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    model = op7_language.train(docs, ~op7_language.held_out())
    return op7_language.predict(docs, model).select("doc_id", op7_language.held_out().alias("held_out"), "lang_pred", "score", "rejected")


@query("op8_token_counts")
def token_counts(spark: SparkSession, sf: str) -> DataFrame:
    return op8_token_counts.token_counts(table(spark, sf, "documents"), vocabulary("piece_bpe_32k.model"))


@query("op9_ngram_jaccard")
def jaccard(spark: SparkSession, sf: str) -> DataFrame:
    return op9_jaccard.join(table(spark, sf, "documents"))


@query("op10_pii_skip_chain")
def pii(spark: SparkSession, sf: str) -> DataFrame:
    docs = table(spark, sf, "documents")
    return span_digests(op10_pii.find(docs, op10_pii.train(docs)))


def span_digests(found: DataFrame) -> DataFrame:
    base = F.filter("spans", lambda s: s["base"])
    line = lambda spans: F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    of = lambda kind: F.size(F.filter(base, lambda s: s["kind"] == kind)).cast("long")
    counts = [of(k).alias(f"n_{k}") for k in op10_pii.KINDS]
    return found.select("doc_id", *counts, F.sha2(line(base), 256).alias("base_sha256"), line(F.col("spans")).alias("spans"))


@query("op11_filter_audit", op11_filter_audit.sql())
def filter_audit(spark: SparkSession, sf: str) -> DataFrame:
    return op11_filter_audit.audit(table(spark, sf, "documents"), table(spark, sf, "labels"))


@query("op12_byte_bpe")
def byte_bpe(spark: SparkSession, sf: str) -> DataFrame:
    coded = op12_byte_bpe.encode(table(spark, sf, "documents"), vocabulary("byte_bpe_50k.tiktoken"))
    return coded.select("doc_id", F.floor(F.octet_length("ids") / 4).cast("long").alias("n_tokens"),
                        F.sha2("ids", 256).alias("ids_sha256"), F.sha2("decoded", 256).alias("decoded_sha256"))


@query("op13_importance_resampling", op13_importance.sql())
def importance(spark: SparkSession, sf: str) -> DataFrame:
    return op13_importance.resample(table(spark, sf, "documents"), table(spark, sf, "benchmark"))
