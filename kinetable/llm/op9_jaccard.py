"""N-gram Jaccard join by prefix filters under several global orders of the tokens.

Tokens are 64-bit hashes of a document's distinct 5-word shingles.  Two sets of Jaccard similarity t or more share a
token among the first n - ceil(t n) + 1 tokens of each, under any order of all tokens.  Here tokens known to be frequent
come last, by their document frequency, and the others by a hash; each order has a hash of its own.  A pair is verified
only if it shares such a prefix token under every order.

Lists of the first order meet inside tasks.  A pair leaves the task only if the sizes allow similarity and the
parity sketches differ in few bits: a bit is the parity of the tokens that fall on it, so at least as many tokens are on one
side alone as bits differ, and similar sets have at most a ninth of their sizes' sum there.  Then the prefixes under the
second order must intersect.  All three are exact bounds; what is left is verified from the texts.

Components need no pair inside what is linked already.  So there are rounds: in the first ones each list names leaders, and
a row that passes with a leader joins it and meets no other row of the list; verified links are joined to components, and
a list names leaders again until a round finds few links.  In the last one all pairs of the lists that lie in different
components and were not verified yet are compared.

Near copies share many tokens, so many lists hold the same documents.  One of each such group of lists is kept, as the others
name the same pairs.

Scale, in passes over the texts:
1. Tokens leave each batch sorted, counted and packed by hash range, and are counted per range.  Of those in more than ``FREQUENT`` documents the ``KNOWN`` most frequent (a bound on what tasks get) steer
   the orders; without them results would be the same.
2. Signatures, sketches and second prefixes of the sets, and first prefixes.  Frequent tokens become rows at once: no task gathers their lists; counts are
   combined in the map tasks.  Others go packed by range, to keep those that occur twice.
3. Lists are dealt over hash buckets; one of more than ``BLOCK`` rows becomes tiles of two blocks each.  Pairs of such a list are
   still compared in memory one by one, where its rows are of many components; only those that pass leave.
4. Texts of documents in a pair, found through a semi-join, broadcast only below a checked number of ids.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import at_work, bounded_batches, cut, pick, rows_of
from .components import components

WORDS, NUMERATOR, DENOMINATOR, ORDERS = 5, 4, 5, 2
FREQUENT, KNOWN = 16, 1 << 20
#: Tokens of one hash range, on average, and of a document, to choose the number of ranges.
RANGE_TOKENS, DOC_TOKENS = 1 << 20, 512
#: Rows of one block of a list, of one bucket of lists, and pairs compared at once.
BLOCK, BUCKET_ROWS, PAIRS = 1 << 14, 1 << 15, 1 << 17
#: 64-bit words of a parity sketch: at least two bits a token between these sizes.  It goes with each token of a prefix.
SKETCH_WORDS = (2, 16)
#: Words whose hashes a worker keeps, and the longest of them.
KEPT_WORDS, KEPT_BYTES = 1 << 17, 48
#: Links for each set below which a round with leaders is the last of them.
FEW_LINKS = 0.01
#: Ids that a semi-join broadcasts at most: 32 MB of them.
BROADCAST_IDS = 1 << 22
_MIX = np.array([0xBF58476D1CE4E5B9, 0x94D049BB133111EB], np.uint64)
_ODD = 0xD1342543DE82EF95


class _WordHashes(dict):
    def __missing__(self, word: bytes) -> int:
        import xxhash

        out = xxhash.xxh3_64_intdigest(word)
        if len(word) <= KEPT_BYTES:
            self[word] = out
        return out


_WORDS = _WordHashes()


def mix(x: np.ndarray, seed: int = 0) -> np.ndarray:
    """A one-to-one scrambling of 64-bit numbers."""
    x = x + np.uint64(0x9E3779B97F4A7C15 * (2 * seed + 1) & 0xFFFFFFFFFFFFFFFF)
    x = (x ^ (x >> np.uint64(30))) * _MIX[0]
    x = (x ^ (x >> np.uint64(27))) * _MIX[1]
    return x ^ (x >> np.uint64(31))


def words_of(text: str | None) -> list[bytes]:
    """Runs of other bytes between the six ASCII white-space characters; bytes.lower() changes A-Z alone."""
    return text.encode("utf-8", "surrogatepass").lower().split() if text else []


def shingles(text: str | None, words: int = WORDS) -> np.ndarray:
    """Sorted distinct hashes of the shingles; with fewer words, of the whole sequence; without words none."""
    found = words_of(text)
    if not found:
        return np.zeros(0, np.uint64)
    if len(_WORDS) > KEPT_WORDS:
        _WORDS.clear()
    h = np.fromiter(map(_WORDS.__getitem__, found), np.uint64, len(found))
    if len(h) < words:
        return mix(np.array([_fold(h)], np.uint64), len(h))
    total = h[:len(h) - words + 1].copy()
    for i in range(1, words):  # word hashes are random, so a sum of odd multiples tells their orders apart
        total += h[i:len(h) - words + 1 + i] * np.uint64(_ODD ** i & 0xFFFFFFFFFFFFFFFF)
    total = mix(total)
    total.sort()
    return total[np.concatenate([[True], total[1:] != total[:-1]])]


def _fold(h: np.ndarray) -> np.uint64:
    out = np.zeros(1, np.uint64)
    for i in range(len(h)):
        out = mix(out + h[i:i + 1], i)
    return out[0]


def prefix_size(n: int) -> int:
    return n - -(-n * NUMERATOR // DENOMINATOR) + 1


def similar(a: np.ndarray, b: np.ndarray) -> bool:
    small, large = sorted((len(a), len(b)))
    if not small or DENOMINATOR * small < NUMERATOR * large:
        return False
    both = len(np.intersect1d(a, b, assume_unique=True))
    return DENOMINATOR * both >= NUMERATOR * (small + large - both)


def _batches(rows: list[tuple], names: list[str], types: list[pa.DataType]) -> pa.RecordBatch:
    cols = zip(*rows, strict=True) if rows else [[] for _ in names]
    return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], names)


def _pack(x: np.ndarray) -> bytes:
    return pa.compress(np.ascontiguousarray(x).tobytes(), codec="zstd", asbytes=True)


def _unpack(data: bytes, n: int, kind: str) -> np.ndarray:
    return np.frombuffer(pa.decompress(data, n * np.dtype(kind).itemsize, codec="zstd", asbytes=True), kind)


def place(tokens: np.ndarray, ranges: int) -> np.ndarray:
    """range * 2^32 + 32 bits: the hash range of each token and what tells it apart there.  Tokens that fall together are
    counted as one, which steers the orders a little and changes no result."""
    where = ((tokens >> np.uint64(32)) * np.uint64(ranges)) >> np.uint64(32)
    return ((where << np.uint64(32)) | (tokens & np.uint64(0xFFFFFFFF))).astype(np.int64)


def _by_range(keys: np.ndarray) -> Iterator[tuple[int, slice]]:
    """The ranges that occur in sorted keys, and where."""
    found, first = np.unique(keys >> 32, return_index=True)
    for r, start, end in zip(found.tolist(), first.tolist(), [*first[1:].tolist(), len(keys)], strict=True):
        yield r, slice(start, end)


def sketch_of(s: np.ndarray) -> bytes:
    """Parity bits of the tokens by their low bits, little-endian."""
    words = SKETCH_WORDS[0]
    while words < SKETCH_WORDS[1] and 32 * words < len(s):
        words *= 2
    odd = np.bincount((s & np.uint64(64 * words - 1)).astype(np.int64), minlength=64 * words) & 1
    return np.packbits(odd.astype(np.uint8), bitorder="little").tobytes()


def frequent(docs: DataFrame, ranges: int) -> dict[int, int]:
    """Document counts of the most frequent tokens, by range and bits: range * 2^32 + bits."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard", _WORDS.clear)
        for b in batches:
            sets = [shingles(t) for t in b.column(1).to_pylist()]
            keys, n = np.unique(place(np.concatenate(sets) if sets else np.zeros(0, np.uint64), ranges), return_counts=True)
            rows = []
            for r, part in _by_range(keys):
                steps = np.diff(keys[part], prepend=r << 32).astype(np.uint32)
                rows.append((r, len(steps), _pack(steps), _pack(n[part].astype(np.uint16))))
            yield _batches(rows, ["range", "n", "steps", "counts"], [pa.int64(), pa.int64(), pa.binary(), pa.binary()])

    def total(group: pa.Table) -> pa.Table:
        r = group["range"][0].as_py()
        keys = np.concatenate([np.cumsum(_unpack(s, n, "uint32"), dtype=np.int64) for s, n in zip(group["steps"].to_pylist(), group["n"].to_pylist(), strict=True)])
        times = np.concatenate([_unpack(s, n, "uint16") for s, n in zip(group["counts"].to_pylist(), group["n"].to_pylist(), strict=True)])
        order = np.argsort(keys)
        keys, times = keys[order], times[order]
        first = np.flatnonzero(np.diff(keys, prepend=-1))
        sums = np.add.reduceat(times.astype(np.int64), first) if len(first) else times
        keep = sums > FREQUENT
        return pa.table({"token": keys[first][keep] + (r << 32), "df": sums[keep]})

    packed = docs.mapInArrow(count, "range long, n long, steps binary, counts binary")
    found = cut(packed.groupBy("range").applyInArrow(total, "token long, df long"), "frequent")
    top = found.orderBy(F.desc("df"), "token").limit(KNOWN).toArrow()
    return dict(zip(top["token"].to_pylist(), top["df"].to_pylist(), strict=True))


def postings(docs: DataFrame, known: dict[int, int], ranges: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """doc_id, n_shingles and the two halves of a signature that equal sets share, of every row; one row a distinct set: node
    (its signature), a doc_id, n, sketch, second (32 bits of its tokens in the prefix of the second order); and token, node:
    tokens of the first order's prefixes that more than one document has there, one for those that the same documents have."""
    tokens = np.array(sorted(known), np.int64)
    counts = np.array([known[t] for t in tokens.tolist()], np.int64)
    frequency = docs.sparkSession.sparkContext.broadcast((tokens, counts))
    # rows of three kinds: of a document (sig1), of a frequent token (token), of a range of others (range)
    schema = "range long, token long, doc_id long, n long, sig1 long, sig2 long, sketch binary, second array<int>, tokens binary, nodes binary"
    names, types = [x.split()[0] for x in schema.split(", ")], [*[pa.int64()] * 6, pa.binary(), pa.list_(pa.int32()), *[pa.binary()] * 2]

    def prefixes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("jaccard", _WORDS.clear)
        tokens, counts = frequency.value
        for b in batches:
            seen: set[tuple] = set()
            light: list[np.ndarray] = []
            held: list[tuple[int, int]] = []
            rows: list[tuple] = []
            for doc_id, text in zip(b.column(0).to_pylist(), b.column(1).to_pylist(), strict=True):
                s = shingles(text)
                sums = tuple(int(mix(s, k).sum(dtype=np.uint64).astype(np.int64)) for k in (7, 8))
                if not len(s) or doc_id is None or sums in seen:  # of copies within a batch the first one stands for all
                    rows.append((None, None, doc_id, len(s), *sums, None, None, None, None))
                    continue
                seen.add(sums)
                key = place(s, ranges)
                at = np.minimum(np.searchsorted(tokens, key), max(0, len(tokens) - 1))
                df = np.where(tokens[at] == key, counts[at], 0) if len(tokens) else np.zeros(len(s), np.int64)
                size = prefix_size(len(s))
                first, second = ((np.minimum(df, (1 << 24) - 1).astype(np.uint64) << np.uint64(40)) | (mix(s, 11 + o) >> np.uint64(24)) for o in range(ORDERS))
                first, second = np.argpartition(first, size - 1)[:size], np.argpartition(second, size - 1)[:size]
                low = s[second].astype(np.uint32).view(np.int32)
                rows.append((None, None, doc_id, len(s), *sums, sketch_of(s), low, None, None))
                rows += [(None, k, None, None, sums[0], *[None] * 5) for k in key[first[df[first] > 0]].tolist()]
                rare = key[first[df[first] == 0]]
                if len(rare):
                    light.append(rare)
                    held.append((sums[0], len(rare)))
                if len(rows) > 20_000:
                    yield _batches(rows, names, types)
                    rows = []
            if light:
                key = np.concatenate(light)
                node = np.repeat(np.array([h[0] for h in held], np.int64), [h[1] for h in held])
                order = np.argsort(key >> 32, kind="stable")
                key, node = key[order], node[order]
                for r, part in _by_range(key):
                    rows.append((r, None, None, part.stop - part.start, *[None] * 4, _pack((key[part] & 0xFFFFFFFF).astype(np.uint32)), _pack(node[part])))
            yield _batches(rows, names, types)

    def repeated(group: pa.Table) -> pa.Table:
        r, n = group["range"][0].as_py(), group["n"].to_pylist()
        token = np.concatenate([_unpack(x, k, "uint32") for x, k in zip(group["tokens"].to_pylist(), n, strict=True)]).astype(np.int64)
        node = np.concatenate([_unpack(x, k, "int64") for x, k in zip(group["nodes"].to_pylist(), n, strict=True)])
        order = np.lexsort((node, token))
        token, node = token[order], node[order]
        new = np.append(True, (np.diff(token) != 0) | (np.diff(node) != 0))[:len(token)]
        token, node = token[new], node[new]
        first = np.flatnonzero(np.diff(token, prepend=-1))
        size = np.diff(np.append(first, len(token)))
        several = np.flatnonzero(size > 1)
        if len(several):  # one of the lists of equal documents
            sums = [np.add.reduceat(mix(node.view(np.uint64), k), first)[several] for k in (5, 6)]
            _, one = np.unique(np.stack([size[several].astype(np.uint64), *sums], 1), axis=0, return_index=True)
            several = several[np.sort(one)]
        keep = np.isin(np.repeat(np.arange(len(first)), size), several)
        return pa.table({"token": token[keep] + (r << 32), "node": node[keep]})

    every = cut(docs.mapInArrow(prefixes, schema), "prefixes")
    rare = every.where("range IS NOT NULL").select("range", "n", "tokens", "nodes").groupBy("range").applyInArrow(repeated, "token long, node long")
    often = every.where("token IS NOT NULL").select("token", F.col("sig1").alias("node")).distinct()
    of_docs = every.where("sig2 IS NOT NULL")
    about = of_docs.select("doc_id", F.col("n").alias("n_shingles"), "sig1", "sig2")
    sets = of_docs.where("sketch IS NOT NULL").select(F.col("sig1").alias("node"), "doc_id", "n", "sketch", "second").dropDuplicates(["node"])
    return about, cut(sets, "sets"), cut(distinct_lists(cut(rare.unionByName(often), "postings")), "lists")


def distinct_lists(lists: DataFrame) -> DataFrame:
    """token, node of the lists of several nodes, one of those that hold the same nodes."""
    held = [F.bit_xor(F.xxhash64("node", F.lit(k))) for k in range(2)]
    about = lists.groupBy("token").agg(F.count(F.lit(1)).alias("size"), *[h.alias(f"held{k}") for k, h in enumerate(held)]).where("size > 1")
    one = cut(about.groupBy("size", "held0", "held1").agg(F.min("token").alias("token")).select("token"), "distinct-lists")
    return lists.join(one, "token", "left_semi")


class _Rows:
    """Rows of a bucket of lists, by list, and which pairs of them may be similar."""

    def __init__(self, group: pa.Table) -> None:
        cols = {c: group[c].to_numpy() for c in ("token", "low", "high", "own", "doc_id", "n", "component")}
        order = np.lexsort((cols["component"], cols["high"], cols["low"], cols["token"]))
        for c, x in cols.items():
            setattr(self, c, x[order])
        change = (np.diff(self.token) != 0) | (np.diff(self.low) != 0) | (np.diff(self.high) != 0)
        self.list = np.concatenate([[0], np.cumsum(change)])[:len(order)]
        sketch = group["sketch"].take(pa.array(order)).to_pylist()
        self.words = np.array([len(x) // 8 for x in sketch], np.int64)
        self.level: dict[int, tuple[np.ndarray, np.ndarray]] = {}
        for w in np.unique(self.words).tolist():  # sizes of a pair that passes are alike, so its sketches differ by one halving at most
            own, twice = np.flatnonzero(self.words == w), np.flatnonzero(self.words == 2 * w)
            bits = [np.frombuffer(b"".join(sketch[i] for i in own), np.uint64).reshape(-1, w)]
            if len(twice):
                double = np.frombuffer(b"".join(sketch[i] for i in twice), np.uint64).reshape(-1, 2 * w)
                bits.append(double[:, :w] ^ double[:, w:])
            at = np.zeros(len(order), np.int64)
            at[own], at[twice] = np.arange(len(own)), len(own) + np.arange(len(twice))
            self.level[w] = at, np.concatenate(bits)

    def passing(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Indexes of the pairs that sizes and sketches let through."""
        n, m = self.n[a], self.n[b]
        ok = np.flatnonzero((self.component[a] != self.component[b]) & (DENOMINATOR * n >= NUMERATOR * m) & (DENOMINATOR * m >= NUMERATOR * n))
        keep = []
        width = np.minimum(self.words[a[ok]], self.words[b[ok]])
        for w in np.unique(width).tolist():
            at, bits = self.level[w]
            these = ok[width == w]
            for i in range(0, len(these), 1 + PAIRS // w):
                part = these[i:i + 1 + PAIRS // w]
                apart = np.bitwise_count(bits[at[a[part]]] ^ bits[at[b[part]]]).sum(1, dtype=np.int64)
                # of n + m, at most (1 - t) / (1 + t) lie on one side alone
                keep.append(part[(NUMERATOR + DENOMINATOR) * apart <= (DENOMINATOR - NUMERATOR) * (n[part] + m[part])])
        return np.concatenate(keep) if keep else ok

    def led(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """In each list the first row leads; rows that pass with it leave, and so on with the rest."""
        left = np.arange(len(self.list))
        while len(left):
            first = np.append(True, np.diff(self.list[left]) != 0)
            leader = left[np.flatnonzero(first)[np.cumsum(first) - 1]]
            a, b = leader[~first], left[~first]
            got = self.passing(a, b)
            yield a[got], b[got]
            left = np.delete(b, got)

    def pairs(self) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """All pairs of the lists that lie in different components; of a tile, those across its blocks."""
        same = np.flatnonzero(np.append(True, (np.diff(self.list) != 0) | (np.diff(self.component) != 0))[:len(self.list)])
        run_end = np.repeat(np.append(same[1:], len(self.list)), np.diff(np.append(same, len(self.list))))
        count = np.searchsorted(self.list, self.list, "right") - run_end  # rows of the list behind a row's own component
        total = np.cumsum(count)
        row = 0
        while row < len(count):
            end = max(row + 1, int(np.searchsorted(total, (total[row - 1] if row else 0) + PAIRS, "right")))
            a = np.repeat(np.arange(row, end), count[row:end])
            b = run_end[a] + np.arange(len(a)) - np.repeat(total[row:end] - count[row:end] - (total[row - 1] if row else 0), count[row:end])
            across = (self.low[a] == self.high[a]) | (self.own[a] != self.own[b])
            a, b = a[across], b[across]
            got = self.passing(a, b)
            yield a[got], b[got]
            row = end


def candidates(lists: DataFrame, sets: DataFrame, parts: DataFrame, every: bool) -> DataFrame:
    """src < dst of different components that share a list and pass all bounds: all of them, or those with a leader.

    ``lists`` has token, node; ``sets`` node, doc_id, n, sketch, second; ``parts`` node, component."""
    count = F.count(F.lit(1)).alias("size")
    several = lists.join(parts, "node").groupBy("token").agg(
        count, F.min("component").alias("least"), F.max("component").alias("most"))
    blocks = F.ceil(F.col("size") / BLOCK)
    open_ = cut(several.where("least < most").select("token", blocks.alias("blocks"), (F.col("size") * blocks).alias("rows")), "open")
    rows = open_.agg(F.coalesce(F.sum("rows"), F.lit(0))).first()[0]
    tiles = lists.join(open_.select("token", "blocks"), "token").withColumn("own", F.pmod(F.xxhash64("node"), "blocks"))
    tiles = tiles.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    tiles = tiles.select("token", "node", "own", F.least("own", "other").alias("low"), F.greatest("own", "other").alias("high"))
    tiles = tiles.withColumn("bucket", F.pmod(F.xxhash64("token", "low", "high"), F.lit(max(1, int(rows) // BUCKET_ROWS))))

    def meet(group: pa.Table) -> pa.Table:
        held = _Rows(group)
        found = [(held.doc_id[a], held.doc_id[b]) for a, b in (held.pairs() if every else held.led()) if len(a)]
        out = [np.concatenate(x) for x in zip(*found, strict=True)] or [np.zeros(0, np.int64)] * 2
        both = np.unique(np.stack([np.minimum(*out), np.maximum(*out)], 1), axis=0)
        return pa.table({"src": both[:, 0], "dst": both[:, 1]})

    held = sets.select("node", "doc_id", "n", "sketch").join(parts, "node")
    met = tiles.join(held, "node").drop("node").groupBy("bucket").applyInArrow(meet, "src long, dst long")
    met = cut(met.where("src <> dst").distinct(), "met")
    second = _of_pairs(sets.select("doc_id", "second"), met)
    both = met.join(second.select(F.col("doc_id").alias("src"), F.col("second").alias("a")), "src").join(
        second.select(F.col("doc_id").alias("dst"), F.col("second").alias("b")), "dst")
    return both.where(F.arrays_overlap("a", "b")).select("src", "dst").distinct()


def _of_pairs(rows: DataFrame, pairs: DataFrame) -> DataFrame:
    """Rows whose doc_id is in a pair."""
    ids = cut(pairs.select(F.col("src").alias("doc_id")).union(pairs.select("dst")).distinct(), "ids")
    few = ids.count() <= BROADCAST_IDS
    return cut(rows.join(F.broadcast(ids) if few else ids, "doc_id", "left_semi"), "of-pairs")


@lru_cache(16)
def _set_of(text: str) -> np.ndarray:
    return shingles(text)


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """src, dst of the pairs whose texts are similar; ``docs`` has doc_id and text."""
    pairs = cut(pairs.select("src", "dst"), "pairs")
    texts = _of_pairs(docs, pairs)

    @F.pandas_udf("boolean")
    def linked(a, b):
        import pandas as pd
        return pd.Series([similar(_set_of(x), _set_of(y)) for x, y in zip(a, b, strict=True)], dtype=bool)

    both = pairs.join(texts.select(F.col("doc_id").alias("dst"), F.col("text").alias("b")), "dst").join(
        texts.select(F.col("doc_id").alias("src"), F.col("text").alias("a")), "src")
    return cut(both.where(linked("a", "b")).select("src", "dst"), "links")


def join(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id, n_shingles, component_id of every row of ``docs``; ids are long.

    Null and empty texts and texts without words have no shingles and link with nothing.  Rows that share an id are one
    node of the graph.  A null id has a null component and links with nothing."""
    spark = docs.sparkSession
    bounded_batches(spark)
    src = docs.select(F.col(f"`{id_col}`").cast("long").alias("doc_id"), F.col(f"`{text_col}`").alias("text"))
    ranges = max(8, src.count() * DOC_TOKENS // RANGE_TOKENS)
    about, sets, lists = postings(src, frequent(src, ranges), ranges)
    full = about.where("n_shingles > 0 AND doc_id IS NOT NULL")
    first = full.groupBy("sig1", "sig2", "n_shingles").agg(F.min("doc_id").alias("first"))
    copies = cut(full.join(first, ["sig1", "sig2", "n_shingles"]).where("doc_id <> first").select(
        F.col("doc_id").alias("src"), F.col("first").alias("dst")).distinct(), "copies")
    parts, links, tried = sets.select("node", F.col("doc_id").alias("component")), copies, None
    few = sets.count() * FEW_LINKS
    while True:  # each round with links leaves fewer components
        pairs = candidates(lists, sets, parts, every=False)
        pairs = cut(pairs if tried is None else pairs.join(tried, ["src", "dst"], "left_anti"), "tried")
        found = verified(pairs, src)
        links, tried = links.unionByName(found), pairs if tried is None else tried.unionByName(pairs)
        labels = components(links).withColumnRenamed("node", "doc_id")
        parts = cut(sets.select("node", "doc_id").join(labels, "doc_id", "left").select("node", F.coalesce("component", "doc_id").alias("component")), "parts")
        if found.count() <= few:
            break
    more = candidates(lists, sets, parts, every=True).join(tried, ["src", "dst"], "left_anti")
    links = links.unionByName(verified(more, src))
    labels = components(links).withColumnsRenamed({"node": "doc_id", "component": "component_id"})
    out = about.select("doc_id", "n_shingles").join(labels, "doc_id", "left")
    return out.withColumn("component_id", F.coalesce("component_id", "doc_id"))
