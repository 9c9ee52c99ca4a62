"""Packing, BPE, language, token counts: against the libraries, brute force and held-out texts."""

import random
import zlib

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import op4_packing, op6_bpe, op7_language, op8_token_counts
from kinetable.llm.queries import vocabulary

from .conftest import sentence

ALPHABET = "aàbcΣİeé1২ '\"<|>$#&\n\t \x1c\x85　日本한ab́cde'sll"


def texts(n):
    r = random.Random(5)
    out = ["".join(r.choice(ALPHABET) for _ in range(r.randint(0, 30))) for _ in range(n)]
    return out + ["a<|endoftext|> b<|startoftext|>", "a" * 3000, "ab" * 999, "  two   three    four ", "it's they'll '' 's", ""]


@pytest.fixture(scope="module")
def library():
    from tokenizers import Tokenizer
    return {n: Tokenizer.from_file(vocabulary(n)) for n in ("byte_bpe_50k.json", "word_bpe_49k.json")}


def test_encoders_equal_the_library(library):
    quick = op4_packing.ChunkEncoder.of(vocabulary("byte_bpe_50k.json"))
    own = op6_bpe.Codec.of(vocabulary("word_bpe_49k.json"))
    for t in texts(3000):
        assert np.frombuffer(quick.encode(t), "<u4").tolist() == library["byte_bpe_50k.json"].encode(t, add_special_tokens=False).ids, t
        ids = library["word_bpe_49k.json"].encode(t, add_special_tokens=False).ids
        assert np.frombuffer(own.encode(t), "<u4").tolist() == ids, t
        assert own.decode(np.array(ids)) == library["word_bpe_49k.json"].decode(ids, skip_special_tokens=False)


def test_encoder_cache_may_empty():
    small = op4_packing.ChunkEncoder(vocabulary("byte_bpe_50k.json"), limit=2)
    full = op4_packing.ChunkEncoder.of(vocabulary("byte_bpe_50k.json"))
    assert all(small.encode(t) == full.encode(t) for t in texts(50))


def test_bpe_operator(docs, odd, library):
    got = op6_bpe.encode(docs(odd), vocabulary("word_bpe_49k.json")).collect()
    want = [library["word_bpe_49k.json"].encode(t or "", add_special_tokens=False).ids for _, t in odd]
    assert sorted((r["doc_id"] or 0, r["ids"]) for r in got) == sorted((i or 0, w) for (i, _), w in zip(odd, want, strict=True))
    again = op6_bpe.decode(op6_bpe.encode(docs(odd), vocabulary("word_bpe_49k.json")).drop("decoded").withColumnRenamed("ids", "x"), vocabulary("word_bpe_49k.json"), "x")
    assert {(r["doc_id"], r["decoded"]) for r in again.collect()} == {(r["doc_id"], r["decoded"]) for r in got}
    assert op6_bpe.encode(docs([]), vocabulary("word_bpe_49k.json")).count() == 0


def test_cuts_fill_their_classes():
    for n in range(1, 5000, 7):
        parts = list(op4_packing.cuts(n))
        assert sum(parts) == n
        assert all(p * (2048 // p) >= 2048 * (1 - op4_packing.WASTE) or p * (2048 // p) >= 2048 - 2048 // p for p in parts)


def test_packing(docs, odd, library):
    rows = odd + [(100 + i, sentence(i, 5 + 37 * i % 900)) for i in range(120)]
    pieces = op4_packing.pieces(docs(rows), vocabulary("byte_bpe_50k.json"))
    packed = op4_packing.pack(pieces.withColumn("extra", F.lit("x")), bucket_rows=20).collect()
    full = sorted([*library["byte_bpe_50k.json"].encode(t or "", add_special_tokens=False).ids, 1] for _, t in rows)
    bins = {}
    for p in packed:
        bins.setdefault(p["sequence_id"], []).append((p["offset"], p["length"]))
    for parts in bins.values():
        at = 0
        for offset, n in sorted(parts):
            assert offset == at
            at += n
        assert at <= 2048
    by_doc = {}
    for p in packed:
        by_doc.setdefault((p["doc_id"], p["doc_tokens"]), []).append((p["start"], np.frombuffer(p["ids"], "<u4").tolist()))
    # a repeated row gives the same pieces twice
    unique = sorted({tuple(x) for parts in by_doc.values() for x in [sum((ids for _, ids in sorted({(s, tuple(i)) for s, i in parts})), ())]})
    assert unique == sorted({tuple(x) for x in full})
    total = sum(map(len, full))
    assert sum(p["length"] for p in packed) == total
    assert len(bins) <= 1.02 * total / 2048 + 1
    seqs = op4_packing.sequences(op4_packing.pack(pieces)).collect()
    assert all(len(s["ids"]) == 4 * 2048 or len(s["ids"]) == 4 * s["n_tokens"] and s["n_tokens"] & (s["n_tokens"] - 1) == 0 for s in seqs)
    assert op4_packing.pack(op4_packing.pieces(docs([]), vocabulary("byte_bpe_50k.json"))).count() == 0


def test_packing_digests(docs):
    from kinetable.llm.queries import pack_digests
    row = pack_digests(docs([(1, None)])).first()
    assert (row["length"], row["ids_crc32"], row["doc_tokens"], row["offset"]) == (1, zlib.crc32(np.array([1], "<u4").tobytes()), 1, 0)


LANGS = {"aa": "barum tokel vasin", "bb": "žilo čeků řada", "cc": "quon xyl wyrm"}


def labelled(n):
    r = random.Random(3)
    rows = []
    for i in range(n):
        lang = r.choice([*LANGS])
        rows.append((i, " ".join(r.choice(LANGS[lang].split()) + r.choice("xyz") for _ in range(r.randint(3, 30))), lang))
    return rows


def test_language(docs, odd):
    rows = labelled(300)
    table = docs(rows + [(1000 + k, t, None) for k, (_, t) in enumerate(odd)])
    model = op7_language.train(table, ~op7_language.held_out())
    got = {r["doc_id"]: r for r in op7_language.predict(table, model).collect()}
    held = [(i, lang) for i, _, lang in rows if zlib.crc32(str(i).encode()) % 5 == 0]
    assert np.mean([got[i]["lang_pred"] == lang for i, lang in held]) > 0.97
    for k, (_, t) in enumerate(odd):
        letters = any(c.isalpha() for c in t or "")
        assert (got[1000 + k]["lang_pred"] == "und") == (not letters)
        assert letters or got[1000 + k]["rejected"]
    assert all(0 <= r["score"] <= 1 for r in got.values())
    kept = {r["doc_id"] for r in op7_language.keep_known(table, model).select("doc_id").collect()}
    assert {i for i, *_ in rows} <= kept


def test_language_without_rows(docs):
    empty = docs([])
    model = op7_language.train(empty, ~op7_language.held_out())
    assert op7_language.predict(empty, model).count() == 0
    assert op7_language.predict(docs([(1, "some text")]), model).first()["lang_pred"] == "und"


def test_token_counts(docs, odd):
    path = vocabulary("piece_bpe_32k.model")
    scores = op8_token_counts.piece_scores(path)
    byte = min(scores.values()) - 1

    def brute(word):
        w, best = op8_token_counts.MARK + word, [(0.0, 0)]
        for i in range(1, len(w) + 1):
            n = len(w[i - 1].encode())
            options = [(best[i - 1][0] + byte * n, -best[i - 1][1] - n)]
            options += [(best[k][0] + scores[w[k:i]], -best[k][1] - 1) for k in range(max(0, i - 40), i) if w[k:i] in scores]
            s, t = max(options)
            best.append((s, -t))
        return best[-1][1]

    rows = odd + [(200 + i, t) for i, t in enumerate(texts(200))]
    known = {w: brute(w) for _, t in rows for w in (t or "").split() if len(w) < 200}
    got = op8_token_counts.token_counts(docs(rows), path).collect()
    want = sorted((len((t or "").split()), sum(known[w] for w in (t or "").split())) for _, t in rows if all(len(w) < 200 for w in (t or "").split()))
    assert [x for x in sorted((r["n_pretokens"], r["n_tokens"]) for r in got) if x in set(want)] == want
    assert len(got) == len(rows)


