"""What operators keep in a worker is forgotten when another one starts there; the encoder's small cache changes no ids."""

import numpy as np

from kinetable.llm import common
from kinetable.llm.op4_packing import KEPT_CHARS, ChunkEncoder
from kinetable.llm.queries import vocabulary


def test_other_operators_caches_are_forgotten(monkeypatch):
    monkeypatch.setattr(common, "_KEPT", {})
    monkeypatch.setattr(common, "_AT_WORK", [])
    first, second = {"a": 1}, {"b": 2}
    common.at_work("first", first.clear)
    common.at_work("first", first.clear)
    assert first
    common.at_work("second", second.clear)
    assert not first and second
    common.at_work("third")
    assert not second


def test_a_full_cache_changes_no_ids():
    path = vocabulary("byte_bpe_50k.json")
    small, tokenizer = ChunkEncoder(path, limit=4), ChunkEncoder(path).tokenizer
    long = "x" * (KEPT_CHARS + 1)
    for text in ["", "a b c d e f g h", f"a {long} b {long} é ü", "i j k a b  c\nd", "l m n o p q r s t a b c"] * 2:
        ids = np.frombuffer(small.encode(text), "<u4").tolist()
        assert ids == tokenizer.encode(text, add_special_tokens=False).ids
        assert all(len(c) <= KEPT_CHARS for c in small.known)


def test_texts_of_common_characters_are_encoded_whole():
    path = vocabulary("byte_bpe_50k.json")
    encoder = ChunkEncoder(path)
    same = lambda t: np.frombuffer(encoder.encode(t), "<u4").tolist() == encoder.tokenizer.encode(t, add_special_tokens=False).ids
    for c in map(chr, [*range(0x250), *range(0x2010, 0x2028)]):
        assert same("".join(f"{a}{c}{a}{c}{c} {c}{a} {a}{c}  {c}" for a in ("a", "1", ".", " ", "\n", "'", "\u00e9"))), hex(ord(c))
    assert not encoder.known
    long = "x" * (KEPT_CHARS + 1)
    assert all(same(f"a {long} b \u65e5\u672c c\u00e9 {t} d  e\nf g ") for t in ("", "h i", "\u65e5 j", " k"))
    assert encoder.known
