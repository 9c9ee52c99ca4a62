"""Extendible hashing: shards are hash prefixes, and only a bucket over the byte limit is split on another bit.

A row's hash has 60 bits (of the MD5 of its id and text).  Its shard is the shortest prefix whose rows fit the limit
together.  The directory has one slot per prefix of ``depth`` bits; slots that a shorter prefix serves point to the same
shard.  Depth starts at what the average needs plus a few bits; the rows of buckets that are too large even there, and
only those, go on to a directory of more bits.  Rows that share all 60 bits (copies of one row, or a row larger than
the limit) can't be told apart by any bit: their bucket becomes a chain of numbered parts, each within the limit unless
a single row is larger.

Scale: one pass over the texts writes hash and size; after that only histograms of slots are shuffled, combined in the
map tasks first, so no key is hot.  The directory grows with the number of shards; it is written and joined by need.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranking import position_in_order
from .common import cut, pick

BITS, SPARE_BITS = 60, 2


def prefix(hash_: Column, depth: Column | int) -> Column:
    return F.call_function("shiftright", hash_, (F.lit(BITS) - (F.lit(depth) if isinstance(depth, int) else depth)).cast("int"))


def shards(docs: DataFrame, limit: int, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per row of ``docs``: doc_id, n_bytes, shard (bits of the prefix), depth, part, shard_bytes, shard_docs.

    A null text has no bytes and a null id hashes as the text "null"; repeated rows land in one shard, or in a chain of
    parts if they alone pass the limit.  An empty input has no shards."""
    src = pick(docs, doc_id=id_col, text=text_col)
    text = F.coalesce("text", F.lit(""))
    name = F.concat(F.coalesce(F.col("doc_id").cast("string"), F.lit("null")), F.lit("|"), F.md5(text))
    hashed = src.select("doc_id", F.octet_length(text).cast("long").alias("n_bytes"),
                        F.conv(F.substring(F.md5(name), 1, BITS // 4), 16, 10).cast("long").alias("_hash"))
    left = cut(hashed, "hashes")
    placed, base = [], 0
    while True:
        total = left.agg(F.sum("n_bytes"), F.max("n_bytes")).first()
        if total[0] is None:
            break
        depth = min(BITS, base + max(1, math.ceil(math.log2(max(1, total[0] / limit)))) + SPARE_BITS)
        slots = left.groupBy(prefix(F.col("_hash"), depth).alias("_slot")).agg(
            F.sum("n_bytes").alias("_bytes"), F.count(F.lit(1)).alias("_docs"))
        slots = cut(slots, "slots")
        levels = slots.withColumn("_depth", F.explode(F.sequence(F.lit(base), F.lit(depth)))).withColumn(
            "_node", F.call_function("shiftright", F.col("_slot"), (F.lit(depth) - F.col("_depth")).cast("int")))
        nodes = levels.groupBy("_depth", "_node").agg(F.sum("_bytes").alias("shard_bytes"), F.sum("_docs").alias("shard_docs"))
        fits = nodes.where(F.col("shard_bytes") <= limit)
        served = levels.select("_slot", "_depth", "_node").join(fits, ["_depth", "_node"])
        first = F.min(F.struct("_depth", "_node", "shard_bytes", "shard_docs"))
        directory = cut(slots.select("_slot").join(served.groupBy("_slot").agg(first.alias("_to")), "_slot", "left"), "directory")
        found = left.withColumn("_slot", prefix(F.col("_hash"), depth)).join(directory, "_slot")
        placed.append(found.where("_to IS NOT NULL").select(
            "doc_id", "n_bytes", F.expr("lpad(bin(_to._node), _to._depth, '0')").alias("shard"), F.col("_to._depth").alias("depth"),
            F.lit(0).cast("long").alias("part"), "_to.shard_bytes", "_to.shard_docs"))
        left = cut(found.where("_to IS NULL").select("doc_id", "n_bytes", "_hash"), "oversized")
        base = depth
        if depth == BITS:
            if left.limit(1).count():
                placed.append(_chains(left, limit))
            break
    if not placed:
        return hashed.select("doc_id", "n_bytes", F.lit("").alias("shard"), F.lit(0).alias("depth"), F.lit(0).cast("long").alias("part"),
                             F.col("n_bytes").alias("shard_bytes"), F.lit(0).cast("long").alias("shard_docs"))
    out = placed[0]
    for more in placed[1:]:
        out = out.unionByName(more)
    return out


def _chains(left: DataFrame, limit: int) -> DataFrame:
    """Parts of buckets whose rows share every bit: as many rows each as fit at the largest row's size."""
    per = left.groupBy("_hash").agg(F.greatest(F.lit(1), F.floor(F.lit(limit) / F.max("n_bytes"))).alias("_per"))
    ranked = position_in_order(left.withColumn("_row", F.monotonically_increasing_id()), ["_hash"], ["_row"], "_at")
    parts = cut(ranked.join(per, "_hash").withColumn("part", F.floor(F.col("_at") / F.col("_per")).cast("long")), "parts")
    sizes = parts.groupBy("_hash", "part").agg(F.sum("n_bytes").alias("shard_bytes"), F.count(F.lit(1)).alias("shard_docs"))
    return parts.join(sizes, ["_hash", "part"]).select(
        "doc_id", "n_bytes", F.lpad(F.bin("_hash"), BITS, "0").alias("shard"), F.lit(BITS).alias("depth"), "part", "shard_bytes", "shard_docs")


def sql(limit: int) -> str:
    return f"""
    with d as (select doc_id, coalesce(strlen(text), 0)::bigint n_bytes,
                      ('0x' || substr(md5(coalesce(doc_id::varchar, 'null') || '|' || md5(coalesce(text, ''))), 1, {BITS // 4}))::bigint h
               from documents),
         n as (select k, h >> ({BITS} - k) p, sum(n_bytes)::bigint s, count(*) c from d, range(0, {BITS + 1}) t(k) group by all),
         f as (select doc_id, n_bytes, h, min(struct_pack(k := k, p := p, s := s, c := c)) x
               from d join n on p = h >> ({BITS} - k) where s <= {limit} group by all)
    select doc_id, n_bytes, case when x.k = 0 then '' else lpad(bin(x.p), x.k::int, '0') end as shard, x.k::int as depth,
           0::bigint as part, x.s as shard_bytes, x.c as shard_docs from f"""
