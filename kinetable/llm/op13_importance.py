"""Importance resampling towards a target distribution, with features hashed by length-bucketed CRC matrices.

A document's features are all runs of one to ``GRAM`` consecutive words.  The distinct features of a batch are grouped by
their length in bytes: those of one length are a matrix of bytes, a row each, and one table step per column moves the CRCs
of all rows at once.  The CRCs, modulo the number of buckets, are scattered back to where the features stood.  Features of
more than ``LONG`` bytes, of which hardly two share a length, are hashed one by one.

Bucket counts of the documents and of the target texts give each bucket a gain, the scaled logarithm of the target's
smoothed share over the documents' own.  A document's weight is the floored mean gain of its features.  A hash of its id
gives it Gumbel noise, so that the highest sums of weight and noise are a draw without replacement by weight.

Definite results: null and empty texts have no features and weight 0.  Repeated rows are documents each for itself; rows
alike in score and id are ranked by their features and weight.  A row without id has no noise, hence no score: it counts in
the buckets, but is neither drawn nor among those drawn from.  Other columns are not read.

Scale: two passes over the texts, the first for the counts: each task sends one row per bucket it met.  Gains are a table
of ``buckets`` numbers, a parameter, whatever the input.  The draw sorts short rows by ranges of score and id and adds up
task totals, so no task holds all.
"""

from __future__ import annotations

import zlib
from array import array
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F

from .common import bounded_batches, cut, pick

BUCKETS, GRAM, LONG = 10_000, 2, 256
SCALE, PERCENT, MIN_WORDS, SEED = 1000, 25, 20, 7
#: Bytes of text whose features are hashed together.
TEXT_BYTES = 8 << 20
#: Words are runs of digits, letters a-z and everything beyond ASCII.
_TO_WORDS = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 32 for b in range(256))


def crc_table() -> np.ndarray:
    """CRC-32 of the reflected polynomial 0xEDB88320, a byte a step."""
    table = np.arange(256, dtype=np.uint32)
    for _ in range(8):
        table = np.where(table & 1, (table >> 1) ^ np.uint32(0xEDB88320), table >> 1).astype(np.uint32)
    return table


_TABLE = crc_table()


class Features:
    """Distinct features: the bytes of all, one after the other with a space behind each, and where each starts and how
    long it is."""

    def __init__(self, flat: np.ndarray, start: np.ndarray, size: np.ndarray) -> None:
        self.flat, self.start, self.size = flat, start, size

    @classmethod
    def of(cls, names: list[bytes]) -> Features:
        size = np.fromiter(map(len, names), np.int64, len(names))
        flat = np.frombuffer(b" ".join([*names, b""]), np.uint8)
        return cls(flat, np.cumsum(size + 1) - size - 1, size)

    def matrices(self, longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """The features of each length: which they are, and their bytes, a column each."""
        for at, size in by_size(self.size, longest):
            yield at, np.stack([self.flat[self.start[at] + j] for j in range(size)])

    def name(self, i: int) -> bytes:
        return self.flat[self.start[i]:self.start[i] + self.size[i]].tobytes()


class Runs(Features):
    """Each of ``heads`` and, behind a space, each of ``tails``: the bytes are taken from theirs, a length at a time."""

    def __init__(self, heads: Features, head: np.ndarray, tails: Features, tail: np.ndarray) -> None:
        self.heads, self.head, self.tails, self.tail = heads, head, tails, tail
        self.size = heads.size[head] + 1 + tails.size[tail]

    def matrices(self, longest: int | None = None) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        behind = len(self.heads.flat)
        flat = np.concatenate([self.heads.flat, self.tails.flat])
        for at, size in by_size(self.size, longest):
            begin, first = self.heads.start[self.head[at]], self.heads.size[self.head[at]]
            after = behind + self.tails.start[self.tail[at]] - first - 1
            yield at, np.stack([flat[np.where(j <= first, begin, after) + j] for j in range(size)])

    def name(self, i: int) -> bytes:
        return self.heads.name(self.head[i]) + b" " + self.tails.name(self.tail[i])

    def gathered(self) -> Features:
        start = np.cumsum(self.size + 1) - self.size - 1
        flat = np.full(int(self.size.sum()) + len(self.size), 0x20, np.uint8)
        for at, columns in self.matrices():
            for j, column in enumerate(columns):
                flat[start[at] + j] = column
        return Features(flat, start, self.size)


def by_size(size: np.ndarray, longest: int | None = None) -> Iterator[tuple[np.ndarray, int]]:
    """Which are of each length, up to the ``longest`` that counts."""
    order = np.argsort(size, kind="stable")
    if longest is not None:
        order = order[:np.searchsorted(size[order], longest, "right")]
    edges = np.flatnonzero(np.diff(size[order], prepend=-1, append=-1))
    for begin, end in zip(edges[:-1].tolist(), edges[1:].tolist(), strict=True):
        yield order[begin:end], int(size[order[begin]])


def crc_columns(columns: np.ndarray) -> np.ndarray:
    """CRCs of equally long byte strings, given a column of all of them after the other: each moves all on together."""
    crc = np.full(columns.shape[1], 0xFFFFFFFF, np.uint32)
    for column in columns:
        crc = _TABLE[(crc ^ column) & np.uint32(0xFF)] ^ (crc >> np.uint32(8))
    return ~crc


def crcs(features: Features, long: int = LONG) -> np.ndarray:
    """CRC-32 of each feature, none of them empty: one matrix per length, results scattered back."""
    out = np.empty(len(features.size), np.uint32)
    for i in np.flatnonzero(features.size > long).tolist():
        out[i] = zlib.crc32(features.name(i))
    for at, columns in features.matrices(long):
        out[at] = crc_columns(columns)
    return out


def words_of(text: str | None) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_TO_WORDS).split() if text else []


class _Numbers(dict):
    """Numbers things in the order in which they are first looked up."""

    def __missing__(self, key: bytes) -> int:
        out = self[key] = len(self)
        return out


def buckets_of(texts: list[str | None], buckets: int = BUCKETS, gram: int = GRAM) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bucket of every feature and the text it is of, and the number of words of each text."""
    number, word = _Numbers(), array("q")
    counts = np.zeros(len(texts), np.int64)
    for i, text in enumerate(texts):
        found = words_of(text)
        counts[i] = len(found)
        word.extend(map(number.__getitem__, found))
    word = np.frombuffer(word, np.int64)
    text_of = np.repeat(np.arange(len(texts)), counts)
    words = Features.of(list(number))
    found, owners = [(crcs(words) % np.uint32(buckets))[word]], [text_of]
    heads, run = words, word  # the run of n - 1 words that starts at each place
    for n in range(2, gram + 1):
        starts = np.flatnonzero(text_of[:max(0, len(word) - n + 1)] == text_of[n - 1:])
        kinds, which = np.unique(run[starts] * len(number) + word[starts + n - 1], return_inverse=True)
        runs = Runs(heads, kinds // max(1, len(number)), words, kinds % max(1, len(number)))
        found.append((crcs(runs) % np.uint32(buckets))[which])
        owners.append(text_of[starts])
        if n < gram:
            heads, run = runs.gathered(), np.zeros(len(word), np.int64)
            run[starts] = which
    return np.concatenate(found), np.concatenate(owners), counts


def _groups(batch: pa.RecordBatch, column: str) -> Iterator[tuple[int, list]]:
    """Consecutive texts of about ``TEXT_BYTES`` together, with the place of the first."""
    some, held, at = [], 0, 0
    for i, text in enumerate(batch.column(column).to_pylist()):
        if some and held + len(text or "") > TEXT_BYTES:
            yield at, some
            some, held, at = [], 0, i
        some.append(text)
        held += len(text or "")
    if some:
        yield at, some


def bucket_counts(texts: DataFrame, buckets: int = BUCKETS, gram: int = GRAM) -> DataFrame:
    """bucket, n: how many features of all texts fall into each bucket that has any."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(buckets, np.int64)
        for batch in batches:
            for _, some in _groups(batch, "text"):
                total += np.bincount(buckets_of(some, buckets, gram)[0], minlength=buckets)
        met = np.flatnonzero(total)
        yield pa.RecordBatch.from_arrays([pa.array(met), pa.array(total[met])], ["bucket", "n"])

    return texts.select("text").mapInArrow(count, "bucket long, n long").groupBy("bucket").agg(F.sum("n").alias("n"))


def gains(own: np.ndarray, target: np.ndarray) -> np.ndarray:
    """floor(SCALE * ln(smoothed share in the target / smoothed share in the documents)) of each bucket, in doubles."""
    own, target = own.astype(np.float64), target.astype(np.float64)
    ratio = (target + 1) * (own.sum() + len(own)) / ((own + 1) * (target.sum() + len(own)))
    return np.floor(SCALE * np.log(ratio)).astype(np.int64)


def noise(doc_id: Column, seed: int = SEED) -> Column:
    """Gumbel noise from a hash of the seed and the id, floored; null without an id."""
    h = F.conv(F.substring(F.sha2(F.concat(F.lit(f"{seed}:"), doc_id.cast("string")), 256), 1, 8), 16, 10).cast("double")
    return F.floor(-SCALE * F.log(-F.log((h + 0.5) / 4294967296.0))).cast("long")


def weights(docs: DataFrame, target: DataFrame, buckets: int = BUCKETS, gram: int = GRAM, id_col: str = "doc_id", text_col: str = "text",
            target_col: str = "text") -> DataFrame:
    """doc_id, n_words, n_features, weight of every row of ``docs``."""
    from pyspark.sql.pandas.types import to_arrow_type

    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    sides = []
    for texts in (src, pick(target, text=target_col)):
        found = bucket_counts(texts, buckets, gram).toArrow()  # at most ``buckets`` rows
        total = np.zeros(buckets, np.int64)
        total[found["bucket"].to_numpy()] = found["n"].to_numpy()
        sides.append(total)
    gain = gains(*sides)
    id_type = to_arrow_type(src.schema["doc_id"].dataType)

    def weigh(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at, some in _groups(batch, "text"):
                bucket, owner, words = buckets_of(some, buckets, gram)
                n = np.bincount(owner, minlength=len(some))
                total = np.zeros(len(some), np.int64)
                np.add.at(total, owner, gain[bucket])
                weight = np.where(n > 0, total // np.maximum(n, 1), 0)
                yield pa.RecordBatch.from_arrays([batch.column("doc_id").slice(at, len(some)).cast(id_type), *map(pa.array, (words, n, weight))],
                                                 ["doc_id", "n_words", "n_features", "weight"])

    return src.mapInArrow(weigh, f"doc_id {src.schema['doc_id'].dataType.simpleString()}, n_words long, n_features long, weight long")


def resample(docs: DataFrame, target: DataFrame, percent: int = PERCENT, min_words: int = MIN_WORDS, seed: int = SEED, **options) -> DataFrame:
    """doc_id, n_features, weight, score, rank of every row of ``docs``; rank is null for rows that are not drawn.

    Of the rows with an id and at least ``min_words`` words, floor(percent / 100) of them are drawn, highest score first,
    ties to the smaller id."""
    found = weights(docs, target, **options)
    found = cut(found.withColumn("score", F.col("weight") + noise(F.col("doc_id"), seed)), "weights")
    able = F.coalesce((F.col("n_words") >= min_words) & F.col("score").isNotNull(), F.lit(False))
    drawn = percent * found.where(able).count() // 100
    cols = ["doc_id", "n_features", "weight", "score"]
    order = ["down", "doc_id", "n_features", "weight"]
    # ranges of the order are tasks; the rows of the tasks before are added to a row's place in its own
    spread = found.where(able).withColumn("down", -F.col("score")).repartitionByRange(*order).sortWithinPartitions(*order)
    placed = cut(spread.select(*cols, F.spark_partition_id().alias("task"), F.monotonically_increasing_id().alias("row")), "places")
    tasks = placed.groupBy("task").agg(F.min("row").alias("first"), F.count(F.lit(1)).alias("n"))
    before = F.coalesce(F.sum("n").over(Window.orderBy("task").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    place = F.col("row") - F.col("first") + F.col("before") + 1
    ranked = placed.join(tasks.select("task", "first", before.alias("before")), "task").select(
        *cols, F.when(place <= drawn, place).cast("long").alias("rank"))
    return ranked.unionByName(found.where(~able).select(*cols, F.lit(None).cast("long").alias("rank")))


def sql() -> str:
    """The same, with the default parameters and both texts' features hashed byte by byte, as DuckDB's SQL."""
    step = "case when {0} & 1 = 1 then xor({0} >> 1, 3988292384) else {0} >> 1 end"
    entry = "i"
    for _ in range(8):
        entry = f"(select {step.format('v')} from (select {entry} as v))"
    code = "('0x' || hex[2 * j + 1:2 * j + 2])::bigint"
    crc = f"list_reduce(list_transform(range(0, len(hex) // 2), lambda j: {code}), lambda c, b: xor(tab[(xor(c, b) & 255) + 1], c >> 8), 4294967295)"
    runs = "select side, key, unnest(ws) as f from w union all select side, key, unnest(list_transform(range(1, len(ws)), lambda j: ws[j] || ' ' || ws[j + 1])) from w"
    lower = "translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz')"
    words = rf"regexp_extract_all({lower}, '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')"
    return rf"""
    with tab as (select list({entry} order by i) as tab from range(0, 256) r(i)),
         d as (select row_number() over () as key, doc_id, text from documents),
         w as (select 0 as side, key, {words} as ws from d union all select 1, 0, {words} from benchmark),
         f as ({runs}),
         k as (select f, xor({crc}, 4294967295) % {BUCKETS} as bucket from (select distinct f, hex(encode(f)) as hex from f), tab),
         c as (select r.i as bucket, count(*) filter (where side = 0) as s, count(*) filter (where side = 1) as t
               from range(0, {BUCKETS}) r(i) left join (f join k using (f)) on bucket = r.i group by 1),
         g as (select bucket, floor({SCALE} * ln((t + 1)::double * ((select count(*) from f where side = 0) + {BUCKETS})::double
                 / ((s + 1)::double * ((select count(*) from f where side = 1) + {BUCKETS})::double)))::bigint as gain from c),
         m as (select key, count(*) as n_features, floor(sum(gain) / count(*)::double)::bigint as weight from f join k using (f) join g using (bucket) where side = 0 group by key),
         a as (select doc_id, len(ws) as n_words, coalesce(n_features, 0)::bigint as n_features, coalesce(weight, 0)::bigint as weight,
                 ('0x' || sha256('{SEED}:' || doc_id)[1:8])::bigint as h from d join w on d.key = w.key and side = 0 left join m on m.key = d.key),
         b as (select *, weight + floor(-{SCALE} * ln(-ln((h + 0.5e0) / 4294967296e0)))::bigint as score from a),
         o as (select *, row_number() over (partition by n_words >= {MIN_WORDS} and score is not null order by score desc, doc_id, n_features, weight) as place,
                 count(*) filter (where n_words >= {MIN_WORDS} and score is not null) over () as n from b)
    select doc_id, n_features, weight, score, case when n_words >= {MIN_WORDS} and score is not null and place <= {PERCENT} * n // 100 then place end as rank from o"""
