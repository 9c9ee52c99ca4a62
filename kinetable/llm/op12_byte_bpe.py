"""Byte-level BPE by overlapping chunks: pre-tokenise chunks in parallel, stitch where they agree, encode the pieces.

Where a pre-token starts decides, with the text behind it, where it ends.  So two runs of the pre-tokeniser over one text
that have a boundary in common have all later ones in common.  A long text is cut into chunks that overlap; every chunk is
pre-tokenised by itself, from its first character on, which may lie inside a pre-token.  Neighbours resynchronise at the
first boundary that both have in their overlap, and there the text may be cut into pieces: by induction from the first
chunk each such place is a true boundary.  Near its end a chunk does not see what follows, so boundaries count there only
if no further text could move them, nor behind white space, which is divided by what follows it.  Chunks without a common boundary (a pre-token longer than the overlap) are merged and
tried again, at the utmost until the text is one chunk.  A text no longer than a chunk is one piece.

Pieces are pre-tokenised from a true start, each pre-token is merged by the ranks, and ids are put in order.  Decoding
concatenates the bytes of the tokens.

Definite results: null and empty texts have no ids and decode to nothing; repeated rows and rows that share an id, or have
none, are encoded each for itself; other columns are not read.

Scale: texts of one chunk are a narrow pass.  Chunks of longer ones are rows of their own, dealt over all tasks by text and
chunk, so one very long text is not the work of one task; only boundaries near the overlaps are compared.  A text's ids
meet again in one row, as the text itself is one.  A worker's memory of pre-tokens is emptied at a number of bytes.
"""

from __future__ import annotations

import base64
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from .common import bounded_batches, cut, pick, rows_of

#: Characters of a chunk, and those of the next one that it shares.
CHUNK, OVERLAP = 1 << 14, 1 << 9
#: Bytes of pre-tokens that a worker remembers, and of one that it does.
MEMORY, REMEMBERED = 24 << 20, 64
#: Characters that decide whether a pre-token is a contraction: an apostrophe and two letters.
AHEAD = 3
_CODERS: dict[str, Coder] = {}


def members(cls: str) -> str:
    """The characters of a class as ranges, as tiktoken's own patterns have it: libraries follow different Unicode
    versions.  tiktoken encodes nothing but what its pattern matches, so the class is what comes back."""
    import tiktoken

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    matcher = tiktoken.Encoding("class", pat_str=cls, mergeable_ranks={bytes([b]): b for b in range(256)}, special_tokens={})
    found = np.frombuffer(matcher.decode_bytes(matcher.encode_ordinary(every)).decode().encode("utf-32-le"), "<u4").astype(np.int64)
    first = np.flatnonzero(np.diff(found, prepend=-2) != 1)
    last = np.append(first[1:] - 1, len(found) - 1)
    return "".join(f"\\U{a:08x}-\\U{b:08x}" for a, b in zip(found[first].tolist(), found[last].tolist(), strict=True))


def splitter(letters: str, digits: str, space: str) -> re.Pattern:
    return re.compile(f"'(?:[sdmt]|ll|ve|re)| ?[{letters}]+| ?[{digits}]+| ?[^{space}{letters}{digits}]+|[{space}]+(?![^{space}])|[{space}]+")


class Coder:
    def __init__(self, path: str, memory: int = MEMORY) -> None:
        import tiktoken

        with open(path, "rb") as f:
            ranks = {base64.b64decode(token): int(rank) for token, rank in map(bytes.split, f)}
        self.ascii = splitter("A-Za-z", "0-9", "\t-\r ")
        self.full = splitter(members(r"\p{L}"), members(r"\p{N}"), members(r"\s"))
        #: takes its whole input as one pre-token
        self.merge = tiktoken.Encoding("pre-token", pat_str=r"[\s\S]+", mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        table = [b""] * (max(ranks.values()) + 1)
        for token, rank in ranks.items():
            table[rank] = token
        self.table = np.frombuffer(b"".join(table), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(t) for t in table])])
        self.known: dict[str, bytes] = {}
        self.memory, self.held = memory, 0

    @classmethod
    def of(cls, path: str) -> Coder:
        if path not in _CODERS:
            _CODERS[path] = cls(path)
        return _CODERS[path]

    def pretokens(self, text: str) -> list[str]:
        """Consecutive parts of the whole text."""
        return (self.ascii if text.isascii() else self.full).findall(text)

    def _ids(self, pretoken: str) -> bytes:
        return np.array(self.merge(pretoken), "<u4").tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers of a text that starts where a pre-token does."""
        parts, known = self.pretokens(text), self.known
        found = list(map(known.get, parts))
        if None in found:
            if self.held > self.memory:
                known.clear()
                self.held = 0
            extra: dict[str, bytes] = {}  # of this text alone
            for part in {*parts}.difference(known):
                ids = self._ids(part)
                if len(part) <= REMEMBERED:
                    known[part] = ids
                    self.held += len(part) + len(ids) + 200
                else:
                    extra[part] = ids
            found = [known[p] if p in known else extra[p] for p in parts] if extra else map(known.__getitem__, parts)
        return b"".join(found)

    def decode(self, ids: bytes) -> bytes:
        if not ids:
            return b""
        at = np.frombuffer(ids, "<u4").astype(np.int64)
        begin, size = self.offsets[at], self.offsets[at + 1] - self.offsets[at]
        place = np.repeat(begin - (np.cumsum(size) - size), size) + np.arange(int(size.sum()))
        return self.table[place].tobytes()

    def boundaries(self, text: str, ends: bool) -> tuple[np.ndarray, np.ndarray]:
        """Where pre-tokens start in ``text``, 0 included, and those places where it may be cut whatever follows (or,
        where the text ``ends`` here, nothing follows).

        White space is divided by what comes behind it, so a text is not cut behind white space."""
        parts = self.pretokens(text)
        stop = np.cumsum(np.fromiter(map(len, parts), np.int64, len(parts)))
        start = stop - np.fromiter(map(len, parts), np.int64, len(parts))
        settled = ends | ((stop < len(text)) & (start + AHEAD <= len(text)))
        dark = ~np.fromiter((p[-1].isspace() for p in parts), bool, len(parts))
        return (start if len(start) else np.zeros(1, np.int64)), stop[settled & dark]


def _long_chunks(docs: DataFrame, chunk: int, overlap: int) -> DataFrame:
    """key, part, begin, stop, last, text: chunks of the texts; text goes on behind ``stop`` by the overlap."""
    def slices(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for key, text in rows_of(batches, "key", "text"):
            n = len(text)
            cuts = [*range(0, max(1, n - overlap), chunk), n]
            for at in range(0, len(cuts) - 1, 256):
                some = range(at, min(at + 256, len(cuts) - 1))
                yield pa.RecordBatch.from_pydict({
                    "key": pa.array([key] * len(some), pa.int64()), "part": pa.array(some, pa.int64()),
                    "begin": pa.array([cuts[i] for i in some], pa.int64()), "stop": pa.array([cuts[i + 1] for i in some], pa.int64()),
                    "last": pa.array([i + 2 == len(cuts) for i in some]),
                    "text": pa.array([text[cuts[i]:min(n, cuts[i + 1] + overlap)] for i in some], pa.string())})

    return docs.mapInArrow(slices, "key long, part long, begin long, stop long, last boolean, text string").repartition("key", "part")


def _places(chunks: DataFrame, vocabulary: str, overlap: int) -> DataFrame:
    """key, part, last and the places that decide: ``head`` among the boundaries of the chunk's first characters, ``tail``
    among the settled ones of those it shares with the next chunk."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(vocabulary)
        for batch in batches:
            heads, tails = [], []
            for begin, stop, last, text in zip(*[batch.column(c).to_pylist() for c in ("begin", "stop", "last", "text")], strict=True):
                every, fixed = coder.boundaries(text, last)
                heads.append((every[every <= overlap] + begin).tolist())
                fixed = fixed + begin
                tails.append([] if last else fixed[fixed >= stop].tolist())
            places = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([*[batch.column(c) for c in ("key", "part", "last")], pa.array(heads, places), pa.array(tails, places)],
                                             ["key", "part", "last", "head", "tail"])

    return chunks.mapInArrow(run, "key long, part long, last boolean, head array<long>, tail array<long>")


def stitched(chunks: DataFrame, vocabulary: str, overlap: int = OVERLAP) -> DataFrame:
    """key, part, text: consecutive pieces of the texts of ``chunks``, each of which starts where a pre-token does."""
    done: DataFrame | None = None
    in_text = Window.partitionBy("key").orderBy("part")
    while True:
        chunks = cut(chunks, "chunks")
        meet = F.array_min(F.array_intersect("tail", F.lead("head").over(in_text)))
        places = _places(chunks, vocabulary, overlap).select("key", "part", "last", meet.alias("to"))
        places = places.withColumn("apart", F.max(F.col("to").isNull() & ~F.col("last")).over(Window.partitionBy("key")))
        places = cut(places.withColumn("from", F.lag("to").over(in_text)), "places")
        settled = chunks.join(places.where("NOT apart").select("key", "part", "from", "to"), ["key", "part"])
        first = F.coalesce("from", "begin")
        piece = F.substring("text", (first - F.col("begin") + 1).cast("int"), (F.coalesce("to", "stop") - first).cast("int"))
        pieces = settled.select("key", "part", piece.alias("text"))
        done = pieces if done is None else done.unionByName(pieces)
        if places.where("apart").isEmpty():
            return done
        # a chunk that does not meet the next one is joined to it
        left = places.where("apart").select("key", "part", (F.col("from").isNull() & (F.col("part") > 0)).alias("joined"))
        runs = left.withColumn("run", F.sum(F.when(F.col("joined"), 0).otherwise(1)).over(in_text)).select("key", "part", "run")
        own = F.substring("text", F.lit(1), (F.col("stop") - F.col("begin")).cast("int"))
        merged = chunks.join(runs, ["key", "part"]).groupBy("key", "run").agg(
            F.min("begin").alias("begin"), F.max("stop").alias("stop"), F.max("last").alias("last"),
            F.array_sort(F.collect_list(F.struct("part", own.alias("own"), F.expr("substring(text, cast(stop - begin + 1 as int))").alias("more")))).alias("parts"))
        text = F.concat(F.array_join(F.transform("parts", lambda p: p["own"]), ""), F.element_at("parts", -1)["more"])
        chunks = merged.select("key", (F.col("run") - 1).alias("part"), "begin", "stop", "last", text.alias("text")).repartition("key", "part")


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True,
           chunk: int = CHUNK, overlap: int = OVERLAP) -> DataFrame:
    """doc_id, ids (binary: little-endian unsigned 32-bit) and, if ``decoded``, the bytes that these ids decode to.

    ``vocabulary`` is a file of ranks.  ``overlap`` is at most ``chunk``."""
    if not AHEAD < overlap <= chunk:
        raise ValueError("the overlap is longer than what decides a pre-token and at most a chunk")
    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col).withColumn("text", F.coalesce("text", F.lit("")))
    one = F.length("text") <= chunk
    short = _encoded(src.where(one), vocabulary, decoded)
    long = cut(src.where(~one).withColumn("key", F.monotonically_increasing_id()), "long-texts")
    pieces = stitched(_long_chunks(long.select("key", "text"), chunk, overlap), vocabulary, overlap)
    coded = _encoded(pieces.select(F.struct("key", "part").alias("doc_id"), "text"), vocabulary, False)

    def together(group: pa.Table) -> pa.Table:
        rows = sorted(zip(*[group[c].to_pylist() for c in ("part", "ids")], strict=True))
        return pa.table({"key": group["key"].slice(0, 1), "ids": pa.array([b"".join(ids for _, ids in rows)], pa.binary())})

    whole = coded.select("doc_id.key", "doc_id.part", "ids").groupBy("key").applyInArrow(together, "key long, ids binary")
    whole = long.select("key", "doc_id").join(whole, "key").select("doc_id", "ids")
    return short.unionByName(decode(whole, vocabulary) if decoded else whole)


def _encoded(texts: DataFrame, vocabulary: str, decoded: bool) -> DataFrame:
    """doc_id (of any type), ids, decoded; each text is one piece."""
    from pyspark.sql.pandas.types import to_arrow_type

    kind = texts.schema["doc_id"].dataType
    id_type = to_arrow_type(kind)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Coder.of(vocabulary)
        names, types = ["doc_id", "ids", *["decoded"] * decoded], [id_type, pa.binary(), *[pa.binary()] * decoded]
        out, held = [[] for _ in names], 0
        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = coder.encode(text)
            for col, v in zip(out, (doc_id, ids, *[coder.decode(ids)] * decoded), strict=True):
                col.append(v)
            held += len(ids)
            if held > 4 << 20:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)
                out, held = [[] for _ in names], 0
        if out[0]:
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, types, strict=True)], names)

    return texts.select("doc_id", "text").mapInArrow(run, f"doc_id {kind.simpleString()}, ids binary" + ", decoded binary" * decoded)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the bytes of the tokens, one after another, to rows with ids (binary); null ids decode to null."""
    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("binary")
    def raw(ids):
        coder = Coder.of(vocabulary)
        return ids.map(lambda x: None if x is None else coder.decode(bytes(x)))

    return encoded.withColumn(out_col, raw(F.col(f"`{ids_col}`")))
