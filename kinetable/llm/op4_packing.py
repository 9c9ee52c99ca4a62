"""Harmonic packing: token pieces in reciprocal-capacity classes, every class filling bins with a fixed number of pieces.

A sequence has ``capacity`` tokens.  A piece of length n is of class k = capacity // n: k such pieces fit a sequence
whatever their exact lengths, so a class is packed by counting alone and every worker can do it by itself.  Documents
are cut at full sequences first; of the rest, a part that would leave more than ``waste`` of a sequence empty in its
class is cut at exactly capacity // (k + 1), which fills its own class, and the remainder is treated likewise.

Scale: tokens are made in one pass; only lengths are ranked.  Ranks come from a hash bucket's own count plus the totals
of the buckets before it (one row per class and bucket), so no class, however common, meets in one task.  What is left
of the classes, under k pieces each (about ten thousand in all at 2048, whatever the input), goes first-fit into the
last sequences.
"""

from __future__ import annotations

import json
import os
import re
from array import array
from collections.abc import Iterator
from itertools import islice

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import at_work, bounded_batches, byte_symbols, cut, pick, rows_of

CAPACITY, WASTE, END_ID = 2048, 1 / 32, 1
#: Pre-tokens of byte-level vocabularies (fixed value).
BYTE_LEVEL = r"""'(?:[sdmt]|ll|ve|re)| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Pieces that one ranking window holds on average.
BUCKET_ROWS = 20_000
_INNER_SPACE = re.compile(r" (?<=\S )(?=\S)")
#: A space that is not between two other characters.
_ODD_SPACE = re.compile(r" (?!\S)|[^\S ] |^ ")
#: Characters beyond Latin letters and common punctuation, whose classes depend on a library's Unicode version.
_BEYOND = re.compile("[^\x00-\u024f\u2010-\u2027]")
_ENCODERS: dict[str, ChunkEncoder] = {}
#: Chunks that a worker keeps, and the longest of them: 40 MB at most.
KEPT_CHUNKS, KEPT_CHARS = 1 << 17, 32


class ChunkEncoder:
    """Ids of whole texts as the tokenizers library gives them.

    Texts of characters that every Unicode version has in the same class go through tiktoken whole, with the file's own
    vocabulary, which merges the same way and is faster.  Others are worked out only for chunks not met before.
    A byte-level pre-token starts with at most one space and ends before the next, so a text may be cut in front of any
    single space between two other characters.  Chunks repeat, so most of a text is looked up; the cache holds short
    chunks, and keeps the first half when it passes ``limit`` of them.  New chunks of ASCII go through tiktoken, others through tokenizers."""

    def __init__(self, path: str, limit: int = KEPT_CHUNKS) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tiktoken
        from tokenizers import Tokenizer

        self.tokenizer, self.limit, self.known = Tokenizer.from_file(path), limit, {}
        self.tokenizer.no_truncation()
        self.tokenizer.no_padding()
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        of_byte = {c: b for b, c in enumerate(byte_symbols())}
        ranks = {bytes(map(of_byte.__getitem__, t)): i for t, i in spec["model"]["vocab"].items() if t not in special}
        self.quick = tiktoken.Encoding("vocabulary", pat_str=BYTE_LEVEL, mergeable_ranks=ranks, special_tokens=special)

    @classmethod
    def of(cls, path: str) -> ChunkEncoder:
        if path not in _ENCODERS:
            _ENCODERS[path] = cls(path)
        return _ENCODERS[path]

    def _ids(self, chunk: str) -> bytes:
        if chunk.isascii():
            return array("I", self.quick.encode(chunk, allowed_special="all")).tobytes()
        return array("I", self.tokenizer.encode(chunk, add_special_tokens=False).ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        if not _BEYOND.search(text):
            return self.quick.encode_to_numpy(text, allowed_special="all").astype("<u4", copy=False).tobytes()
        known = self.known
        if len(known) > self.limit:  # frequent chunks are met early
            known = self.known = dict(islice(known.items(), self.limit // 2))
        head, *rest = _INNER_SPACE.split(text) if _ODD_SPACE.search(text) else text.split(" ")
        found = list(map(known.get, rest))
        if None in found:
            new = {chunk: self._ids(" " + chunk) for chunk in {*rest}.difference(known)}
            found = [new[chunk] if ids is None else ids for chunk, ids in zip(rest, found, strict=True)]
            known.update((chunk, ids) for chunk, ids in new.items() if len(chunk) <= KEPT_CHARS)
        return self._ids(head) + b"".join(found)


def cuts(n: int, capacity: int = CAPACITY, waste: float = WASTE) -> Iterator[int]:
    """Lengths of the pieces of a document of n tokens."""
    for _ in range(n // capacity):
        yield capacity
    rest = n % capacity
    while rest:
        k = capacity // rest
        piece = rest if k * rest >= capacity * (1 - waste) else capacity // (k + 1)
        yield piece
        rest -= piece


def pieces(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", end_id: int = END_ID,
           capacity: int = CAPACITY, waste: float = WASTE) -> DataFrame:
    """Every document's ids, ended by ``end_id`` and cut into pieces: doc_id, start, length, ids (binary, little-endian
    unsigned 32-bit), doc_tokens.  A null or empty text is the end id alone; a null doc_id stays null."""
    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()

    def cut_all(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("packing", _ENCODERS.clear)
        encoder, end = ChunkEncoder.of(tokenizer), np.array([end_id], "<u4").tobytes()
        out: list[list] = [[], [], [], [], []]
        held = 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = encoder.encode(text or "") + end
            at = 0
            for n in cuts(len(ids) // 4, capacity, waste):
                for col, v in zip(out, (doc_id, at, n, ids[4 * at:4 * (at + n)], len(ids) // 4), strict=True):
                    col.append(v)
                at += n
            held += len(ids)
            if held > 8 << 20:
                yield _batch(out, batch_type)
                out, held = [[], [], [], [], []], 0
        if out[0]:
            yield _batch(out, batch_type)

    from pyspark.sql.pandas.types import to_arrow_type
    batch_type = to_arrow_type(src.schema["doc_id"].dataType)
    return src.mapInArrow(cut_all, f"doc_id {kind}, start long, length long, ids binary, doc_tokens long")


def _batch(cols: list[list], id_type: pa.DataType) -> pa.RecordBatch:
    types = [id_type, pa.int64(), pa.int64(), pa.binary(), pa.int64()]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)],
                                      ["doc_id", "start", "length", "ids", "doc_tokens"])


def pack(pieces_: DataFrame, capacity: int = CAPACITY, bucket_rows: int = BUCKET_ROWS) -> DataFrame:
    """Adds sequence_id and offset to rows with a ``length`` from 1 to capacity, ``doc_id`` and ``start``.

    All other columns come along, whatever their names, through two shuffles; leave long ones (ids) away and join them by
    need; columns ``sequence_id`` and ``offset`` are replaced.  Rows alike in all columns, or without an id, are pieces of
    their own and are dealt over the buckets like others.  An empty input gives an empty output.  Lengths out of range raise."""
    pieces_ = pieces_.drop("sequence_id", "offset")
    names = pieces_.columns
    cols = [c if c in ("doc_id", "start", "length") else f"c{i}" for i, c in enumerate(names)]
    inner = pieces_.toDF(*cols)
    types = {f.name: f.dataType.simpleString() for f in inner.schema}
    src = cut(inner.withColumn("_salt", F.monotonically_increasing_id()), "pieces")
    if src.where(~F.col("length").between(1, capacity) | F.col("length").isNull()).limit(1).count():
        raise ValueError(f"a piece has a length out of 1 to {capacity}")
    buckets = max(1, src.count() // bucket_rows)
    src = src.withColumn("_k", F.floor(F.lit(capacity) / F.col("length")).cast("int")).withColumn(
        "_bucket", F.pmod(F.xxhash64("doc_id", "start", "_salt"), F.lit(buckets)))
    totals = src.groupBy("_k", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
    per_class = Window.partitionBy("_k")
    before = per_class.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    totals = cut(totals.select("_k", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_before"),
                               F.sum("_n").over(per_class).alias("_all")), "class-totals")
    inside = Window.partitionBy("_k", "_bucket").orderBy("doc_id", "start", "_salt")
    ranked = src.withColumn("_row", F.row_number().over(inside)).join(totals, ["_k", "_bucket"]).withColumn(
        "_rank", F.col("_before") + F.col("_row") - 1)
    full = F.col("_rank") < F.col("_all") - F.col("_all") % F.col("_k")
    ranked = cut(ranked.select(*cols, "_k", "_rank", full.alias("_full")), "ranked")
    in_bin = Window.partitionBy("sequence_id").orderBy("_rank").rowsBetween(Window.unboundedPreceding, -1)
    whole = ranked.where("_full").withColumn(
        "sequence_id", (F.floor(F.col("_rank") / F.col("_k")) * 2 * capacity + F.col("_k")).cast("long"))
    whole = whole.withColumn("offset", F.coalesce(F.sum("length").over(in_bin), F.lit(0)).cast("long"))
    rest = ranked.where("NOT _full")
    schema = f"{', '.join(f'{c} {types[c]}' for c in cols)}, sequence_id long, offset long"

    def first_fit(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        held = [b for b in batches if len(b)]
        if not held:
            return
        rows = pd.concat(held).sort_values(["length", "_rank"], ascending=[False, True], ignore_index=True)
        free = np.empty(0, np.int64)
        seq, off = [], []
        for n in rows["length"]:
            fits = np.flatnonzero(free >= n)
            if not len(fits):
                free, fits = np.append(free, capacity), [len(free)]
            seq.append(fits[0])
            off.append(capacity - free[fits[0]])
            free[fits[0]] -= n
        yield rows.assign(sequence_id=np.array(seq) * 2 * capacity, offset=off)[[*cols, "sequence_id", "offset"]]

    last = cut(rest.drop("_full", "_k"), "rest").coalesce(1).mapInPandas(first_fit, schema)
    return whole.select(*cols, "sequence_id", "offset").unionByName(last).toDF(*names, "sequence_id", "offset")


def sequences(packed: DataFrame, capacity: int = CAPACITY, pad_id: int = 0) -> DataFrame:
    """One row per sequence: sequence_id, its tokens before padding, and ids (binary) padded to ``capacity`` unless the
    sequence's length is a power of two.  ``packed`` holds the pieces' ids."""
    parts = F.array_sort(F.collect_list(F.struct("offset", "ids")))
    pad = np.array([pad_id], "<u4").tobytes().hex()
    n = F.col("n_tokens")
    out = packed.groupBy("sequence_id").agg(F.sum("length").alias("n_tokens"), parts.alias("_parts"))
    ids = F.aggregate("_parts", F.lit(b""), lambda acc, x: F.concat(acc, x["ids"]))
    padding = F.unhex(F.repeat(F.lit(pad), (F.lit(capacity) - n).cast("int")))
    power = n.bitwiseAND(n - 1) == 0
    return out.select("sequence_id", "n_tokens", F.when(power, ids).otherwise(F.concat(ids, padding)).alias("ids"))
