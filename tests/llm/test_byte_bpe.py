"""Overlapping chunk encoding against the tiktoken library."""

import base64
import random

import numpy as np
import pytest

from kinetable.llm import op12_byte_bpe as op
from kinetable.llm.queries import vocabulary

from .conftest import sentence

RANKS = vocabulary("byte_bpe_50k.tiktoken")
ALPHABET = "aàbcΣİeé1২ '\"<|>$#&\n\t \x1c\x85　日本한ab́cde'sll' re ve😀\U0001e900𝟘ꟍ"


@pytest.fixture(scope="module")
def library():
    import public_tokenizers
    import tiktoken
    ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(RANKS, "rb"))}
    return tiktoken.Encoding("own", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={})


def ids_of(data) -> list[int]:
    return np.frombuffer(data, "<u4").tolist()


def random_texts(n: int, longest: int, seed: int = 3) -> list[str]:
    r = random.Random(seed)
    return ["".join(r.choice(ALPHABET) * r.choice((1, 1, 1, 2, 9)) for _ in range(r.randint(0, longest))) for _ in range(n)]


def test_coder_equals_the_library(library):
    coder = op.Coder.of(RANKS)
    every = "".join(chr(c) + " x" for c in [*range(0xD800), *range(0xE000, 0x20000, 3)])
    for t in [*random_texts(2000, 40), "", "it's they'll 'sx '", "a" * 5000, " " * 5000 + "b", "<|endoftext|>", every[:200_000], sentence(1, 3000)]:
        assert ids_of(coder.encode(t)) == library.encode_ordinary(t), t[:50]
        assert coder.decode(coder.encode(t)) == t.encode()
    small = op.Coder(RANKS, memory=300)
    assert all(small.encode(t) == coder.encode(t) for t in random_texts(50, 40))


def test_settled_boundaries_stay(library):
    """What is said of a part of a text holds for all that may follow it."""
    coder, r = op.Coder.of(RANKS), random.Random(8)
    for t in random_texts(1500, 12, 9):
        more = "".join(r.choice(ALPHABET) for _ in range(r.randint(0, 6)))
        whole = coder.pretokens(t + more)
        for at in coder.boundaries(t, False)[1].tolist():
            assert coder.pretokens(t[:at]) + coder.pretokens((t + more)[at:]) == whole, (t, more, at)


@pytest.mark.parametrize("chunk,overlap", [(64, 16), (16, 16), (50, 4)])
def test_chunks_stitch(docs, library, chunk, overlap):
    texts = [*random_texts(60, 300, chunk), "a" * 500, "x" * 100 + " " * 200 + "y" * 100, "ab cd " * 200, "''''r" * 90, " " * 400, "a'" * 200, "ab12" * 100]
    rows = [(i % 50, t) for i, t in enumerate(texts)]
    got = op.encode(docs(rows), RANKS, chunk=chunk, overlap=overlap).collect()
    want = sorted((i, library.encode_ordinary(t), t.encode()) for i, t in rows)
    assert sorted((g["doc_id"], ids_of(g["ids"]), bytes(g["decoded"])) for g in got) == want


def test_operator_on_odd_rows(docs, odd, library):
    got = op.encode(docs(odd), RANKS).collect()
    assert sorted((r["doc_id"] or 0, ids_of(r["ids"])) for r in got) == sorted((i or 0, library.encode_ordinary(t or "")) for i, t in odd)
    assert all(bytes(r["decoded"]).decode() in {t or "" for _, t in odd} for r in got)
    assert op.encode(docs([]), RANKS).count() == 0
    plain = op.encode(docs(odd), RANKS, decoded=False).withColumnRenamed("ids", "x")
    assert {(r["doc_id"], bytes(r["y"])) for r in op.decode(plain, RANKS, "x", "y").collect()} == {(r["doc_id"], bytes(r["decoded"])) for r in got}


def test_whole_table(spark, library):
    from hashlib import sha256

    from kinetable.llm.queries import SPARK
    sf = "/root/testdata/sf0.001"
    got = {r["doc_id"]: r for r in SPARK["op12_byte_bpe"](spark, sf).collect()}
    rows = spark.read.parquet(f"{sf}/documents.parquet").select("doc_id", "text").collect()
    assert len(got) == len(rows)
    for i, t in rows:
        ids = library.encode_ordinary(t or "")
        data = np.array(ids, "<u4").tobytes()
        assert (got[i]["n_tokens"], got[i]["ids_sha256"], got[i]["decoded_sha256"]) == (len(ids), sha256(data).hexdigest(), sha256((t or "").encode()).hexdigest())
