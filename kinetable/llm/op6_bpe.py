"""BPE by backtracking: longest token matches, kept only if every neighbouring pair is one that merging would leave apart.

An Aho-Corasick automaton gives all tokens that start at each place of a word.  Going left to right, the longest is
tried first; it stays if it is compatible with the token before it, that is, if replaying the merges of both never joins
anything across their border.  Tokens that are pairwise compatible are exactly what merging yields, and the prefix of a
word has one such encoding only, so a place that leads nowhere is never tried twice and the work is linear in the word.
Decoding gathers token strings from one byte table by offsets.

The vocabulary is a word-end BPE file: texts are composed (NFC), lower-cased character by character, cut into letters'
runs, single digits and other runs; white space is dropped, special tokens in the text are themselves.

Scale: narrow, one pass over the texts, no shuffle.  Chunks between white space repeat, so most are looked up; the cache
of a worker is emptied when it passes a limit.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator
from functools import lru_cache

import ahocorasick
import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .common import bounded_batches, byte_symbols, pick, rows_of

#: White space of the vocabulary's patterns; str.split() has four control characters more.
_SPACE = re.compile("[\t-\r \x85\xa0  -     　]+")
_CONTROLS = re.compile("[\x1c-\x1f]")
_CODECS: dict[str, Codec] = {}


def _category(name: str) -> str:
    """The characters of a Unicode category as ranges of a character class, as the vocabulary's library has them: other
    libraries follow other Unicode versions."""
    from tokenizers import Regex, pre_tokenizers

    every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x40000)]))  # the planes beyond hold neither
    runs = pre_tokenizers.Split(Regex(rf"[^\p{{{name}}}]+"), "removed").pre_tokenize_str(every)
    return "".join(f"{re.escape(run[0])}-{re.escape(run[-1])}" for run, _ in runs)


def word_pattern() -> re.Pattern:
    letters, digits, space = _category("L"), _category("N"), _SPACE.pattern[1:-2]
    return re.compile(f"'s|'t|'re|'ve|'m|'ll|'d|[{letters}]+|[{digits}]|[^{space}{letters}{digits}]+")


class Codec:
    def __init__(self, path: str, limit: int = 1 << 18) -> None:
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        self.limit, self.suffix = limit, model["end_of_word_suffix"]
        vocab: dict[str, int] = model["vocab"]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self._special = re.compile("|".join(f"({re.escape(s)})" for s in sorted(self.special, key=len, reverse=True)))
        from tokenizers import normalizers

        self.symbols, self.words = byte_symbols(), word_pattern()
        self.normalize = normalizers.Sequence([normalizers.NFC(), normalizers.Lowercase()]).normalize_str
        self.order = {i: -1 for i in vocab.values()}  # when the merge that makes a token comes; -1: there from the start
        self.halves: dict[int, tuple[int, int]] = {}
        self.joined: dict[tuple[int, int], int] = {}
        for rank, pair in enumerate(model["merges"]):
            left, right = pair.split(" ") if isinstance(pair, str) else pair
            made = vocab[left + right]
            self.halves[made], self.order[made] = (vocab[left], vocab[right]), rank
            self.joined[vocab[left], vocab[right]] = made
        self.end = "\n"  # no byte's symbol; stands for the word end
        self.automaton = ahocorasick.Automaton()
        keys = {t.removesuffix(self.suffix) + self.end if t.endswith(self.suffix) else t: i for t, i in vocab.items()}
        self.size = [0] * (max(keys.values()) + 1)
        self.shorter = [-1] * len(self.size)  # the longest token that is a proper prefix
        for key, i in keys.items():
            self.size[i] = len(key)
            self.shorter[i] = next((keys[key[:n]] for n in range(len(key) - 1, 0, -1) if key[:n] in keys), -1)
            self.automaton.add_word(key, i)
        self.automaton.make_automaton()
        names = {**{i: t for t, i in vocab.items()}, **{i: t for t, i in self.special.items()}}
        parts = [(names.get(i, "") + " ").encode() for i in range(max(names) + 1)]
        self.table = np.frombuffer(b"".join(parts), np.uint8)
        self.offsets = np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        self.known: dict[str, tuple[bytes, int]] = {}
        self.compatible = lru_cache(1 << 18)(self._compatible)
        self.word = lru_cache(1 << 18)(self._word)

    @classmethod
    def of(cls, path: str) -> Codec:
        if path not in _CODECS:
            _CODECS[path] = cls(path)
        return _CODECS[path]

    def _compatible(self, left: int, right: int) -> bool:
        """Whether merging leaves the border between two tokens alone.

        Walk back in time: undo whichever of the two was made later, until both are single symbols.  At each step the
        two that meet at the border live until the merges they went into; a merge of the pair that comes sooner would
        have crossed.  Equal merges apply from left to right, hence < on the left side and <= on the right one."""
        left_until = right_until = len(self.order) + 1
        while True:
            made = self.joined.get((left, right))
            if made is not None and self.order[made] < left_until and self.order[made] <= right_until:
                return False
            a, b = self.order[left], self.order[right]
            if a < 0 and b < 0:
                return True
            if a > b:
                left, left_until = self.halves[left][1], a
            else:
                right, right_until = self.halves[right][0], b

    def _word(self, word: str) -> tuple[int, ...]:
        text = "".join([self.symbols[b] for b in word.encode()]) + self.end
        size, shorter, compatible, n = self.size, self.shorter, self.compatible, len(text)
        longest = [-1] * n
        for last, token in self.automaton.iter(text):  # by their ends: the last one put at a place is its longest
            longest[last - size[token] + 1] = token
        ids: list[int] = []
        dead: set[int] = set()
        at, token = 0, longest[0]
        while at < n:
            if token < 0:  # nothing from here reaches the end: take the token before back
                dead.add(at)
                if not ids:
                    raise ValueError(f"the vocabulary can't spell {word!r}")
                token = ids.pop()
                at -= size[token]
                token = shorter[token]
            elif at + size[token] in dead or ids and not compatible(ids[-1], token):
                token = shorter[token]
            else:
                ids.append(token)
                at += size[token]
                token = longest[at] if at < n else -1
        return tuple(ids)

    def _chunk(self, chunk: str) -> bytes:
        ids: list[int] = []
        for part in self._special.split(chunk) if self.special else [chunk]:
            if part in self.special:
                ids.append(self.special[part])
            elif part:
                lowered = part.lower() if part.isascii() else self.normalize(part)
                for word in self.words.findall(lowered):
                    ids += self.word(word)
        return array("I", ids).tobytes()

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit numbers."""
        known = self.known
        if len(known) > self.limit:
            known.clear()
        chunks = _SPACE.split(text) if _CONTROLS.search(text) else text.split()
        for chunk in {*chunks}.difference(known):
            known[chunk] = self._chunk(chunk)
        return b"".join(map(known.__getitem__, chunks))

    def decode(self, ids: np.ndarray) -> str:
        """Token strings joined by spaces."""
        if not len(ids):
            return ""
        ids = ids.astype(np.int64)
        begin, size = self.offsets[ids], self.offsets[ids + 1] - self.offsets[ids]
        at = np.cumsum(size) - size
        place = np.repeat(begin - at, size) + np.arange(int(size.sum()))
        return self.table[place].tobytes()[:-1].decode()


def encode(docs: DataFrame, vocabulary: str, id_col: str = "doc_id", text_col: str = "text", decoded: bool = True) -> DataFrame:
    """doc_id, ids (array of int) and, if ``decoded``, the text that these ids decode to.

    Null and empty texts have no ids and decode to an empty text; repeated rows are encoded each for itself; a null
    doc_id stays null; other columns are not read."""
    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type
    id_type = to_arrow_type(src.schema["doc_id"].dataType)
    kind = src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        codec = Codec.of(vocabulary)
        names, held = ["doc_id", "ids", *["decoded"] * decoded], 0
        out: list[list] = [[] for _ in names]

        def batch() -> pa.RecordBatch:
            sizes = np.cumsum([0, *map(len, out[1])], dtype=np.int64) // 4
            flat = np.frombuffer(b"".join(out[1]), "<i4")
            cols = [pa.array(out[0], id_type), pa.ListArray.from_arrays(pa.array(sizes, pa.int32()), pa.array(flat, pa.int32()))]
            return pa.RecordBatch.from_arrays([*cols, *[pa.array(c, pa.string()) for c in out[2:]]], names)

        for doc_id, text in rows_of(batches, "doc_id", "text"):
            ids = codec.encode(text or "")
            for col, v in zip(out, (doc_id, ids, *[codec.decode(np.frombuffer(ids, "<u4"))] * decoded), strict=True):
                col.append(v)
            held += len(ids)
            if held > 4 << 20:
                yield batch()
                out, held = [[] for _ in names], 0
        if out[0]:
            yield batch()

    return src.mapInArrow(run, f"doc_id {kind}, ids array<int>" + ", decoded string" * decoded)


def decode(encoded: DataFrame, vocabulary: str, ids_col: str = "ids", out_col: str = "decoded") -> DataFrame:
    """Adds the decoded text to rows with an array of ids; null ids decode to null."""
    from pyspark.sql import functions as F

    bounded_batches(encoded.sparkSession)

    @F.pandas_udf("string")
    def texts(ids):
        codec = Codec.of(vocabulary)
        return ids.map(lambda x: None if x is None else codec.decode(np.asarray(x)))

    return encoded.withColumn(out_col, texts(F.col(f"`{ids_col}`")))
