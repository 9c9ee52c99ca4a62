"""WARC round trips, personal data, the pipeline."""

import hashlib
import re

import numpy as np

from kinetable.llm import op2_warc, op10_pii
from kinetable.llm.queries import page_digests, span_digests
from kinetable.plans.lineage import state_dir

from .conftest import sentence

BLANK = "\r\n\r\n"


def test_framing_takes_any_cut():
    bodies = [b"", b"\r\n", b"a" + BLANK.encode(), BLANK.encode() * 3, b"WARC/1.1\r\nContent-Length: 3\r\n\r\nabc\r\n\r\nWARC/1.1", b"x\r", b"\r\n\r"]
    stream = b"".join(b"WARC/1.1\r\nWARC-Type: resource\r\nContent-Length: %d\r\n\r\n%s\r\n\r\n" % (len(b), b) for b in bodies)
    framer, got = op2_warc._Framer(), []
    for piece in stream.split(BLANK.encode())[:-1]:
        got += [block for _, block in framer.feed(piece)]
    assert got == bodies and framer.fields is None


def test_warc_round_trip(spark, tmp_path):
    big = "<p>" + "é" * 40_000
    nested = f"text{BLANK}WARC/1.1\r\nWARC-Type: response\r\nContent-Length: 5{BLANK}abcde{BLANK}" + "z" * 100
    pages = [(1, "http://a/", big), (2, None, big), (3, "http://b/\r\nX: y", None), (4, "u", ""), (5, "u", "short"), (6, "u", "short"),
             (7, "u", nested), (8, "u", nested), (9, "u", "a" * 99), (10, "u", "a" * 99), (11, "u", "b" * 100), (12, "u", "b" * 100),
             (13, "u", "twice" * 30), (13, "u", "twice" * 30), (None, "u", big), (14, "u", "\r\n"), (15, "u", "end\r\n\r\n")]
    df = spark.createDataFrame(pages, "page_id long, url string, html string").selectExpr("*", "1 as digest", "2 as first", "3 as value")
    path = f"{state_dir(spark)}/warc-test-{tmp_path.name}"
    op2_warc.write(df, path)
    records = op2_warc.read(spark, path)
    assert records.count() == 3 * len(pages)
    captures = op2_warc.captures(records)
    rows = captures.collect()
    assert len(rows) == len(pages) and all(len(r["requests"]) == len(r["metadata"]) == 1 for r in rows)
    got = sorted((r["page_id"] or 0, r["payload_bytes"], r["payload_digest"], r["record_type"], r["refers_to"] or 0) for r in page_digests(captures).collect())
    first = {}
    for i, _, h in sorted(pages, key=lambda p: p[0] or 10 ** 9):
        if i is not None:
            first.setdefault(h or "", i)
    want = []
    for i, _, h in pages:
        body = (h or "").encode()
        again = i is not None and len(body) >= 100 and i > first[h or ""]
        want.append((i or 0, len(body), hashlib.sha256(body).hexdigest(), "revisit" if again else "response", first[h or ""] if again else 0))
    assert got == sorted(want)
    bodies = {(bytes(r["response"]["payload"]).decode()) for r in rows if r["response"]["type"] == "response"}
    assert bodies == {h or "" for *_, h in pages}
    assert op2_warc.captures(op2_warc.read(spark, path).where("type <> 'response'").where("type <> 'revisit'")).count() == 0


def test_warc_chains(spark):
    rows = [("a", "response", None), ("b", "request", "a"), ("c", "metadata", "b"), ("d", "metadata", "none")]
    records = spark.createDataFrame(rows, "record_id string, type string, concurrent_to string").selectExpr(
        "*", *[f"cast(null as {k}) as {n}" for n, k in (f.split() for f in op2_warc.RECORD.split(", ")) if n not in ("record_id", "type", "concurrent_to")])
    one = op2_warc.captures(records, hops=2).collect()
    assert len(one) == 1 and [m["record_id"] for m in one[0]["metadata"]] == ["c"]


def test_empty_archive(spark, tmp_path):
    path = f"{state_dir(spark)}/warc-empty-{tmp_path.name}"
    op2_warc.write(spark.createDataFrame([], "page_id long, url string, html string"), path)
    assert page_digests(op2_warc.captures(op2_warc.read(spark, path))).count() == 0


PATTERNS = [r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", r"[0-9]([\x20-]?[0-9])+", r"\+[0-9][\x20().0-9-]+[0-9]"]


def plain(t):
    out = []
    for k, p in enumerate(PATTERNS):
        for m in re.finditer(p, t):
            digits = re.sub("[^0-9]", "", m.group())
            if k == 1 and max(map(int, m.group().split("."))) > 255 or k == 2 and not (12 <= len(digits) <= 19 and op10_pii.luhn(digits)) or k == 3 and not 9 <= len(digits) <= 15:
                continue
            out.append((m.start(), k, m.end()))
    return sorted(out)


def test_base_spans():
    import random
    r = random.Random(2)
    for _ in range(15000):
        t = "".join(r.choice("a1 2.@+-(3)%0é@") for _ in range(r.randint(0, 40)))
        if r.random() < 0.3:
            t += r.choice(["4111111111111111", "+1 (988) 555-2485", "1.2.3.4", "a.b@c.de@f.g"]) + t
        assert op10_pii.base_spans(t) == plain(t), t


def test_long_runs_stay_linear():
    field = op10_pii.fit([])
    for t in ["a" * 100_000, "1" * 100_000, "+1" + " " * 100_000, "@" * 50_000, "a@" * 50_000, "1.1." * 30_000, "1 " * 50_000, "555-1234567 " * 5000]:
        op10_pii.all_spans(t, field)


def test_pii(docs, odd):
    repeated = "Call +1 (988) 555-2485 today, or (988) 555-2485 after six. Mail ab.c@d-e.org or ab.c [at] d-e.org. Host 10.0.0.255, 10.0.0.256."
    clean = "Version 4.0 of 2024, build 1234, chapter 12.3."
    rows = odd + [(50, repeated), (51, clean), (52, "4111 1111 1111 1111 and 4111-1111-1111-1112")]
    table = docs(rows)
    field = op10_pii.train(table)
    found = op10_pii.find(table, field)
    got = {r["doc_id"]: r for r in span_digests(found).where("doc_id >= 50").collect()}
    base = [(op10_pii.KINDS[k], a, b) for a, k, b in plain(repeated)]
    assert got[50]["base_sha256"] == hashlib.sha256(",".join(f"{k}:{a}:{b}" for k, a, b in base).encode()).hexdigest()
    assert (got[50]["n_email"], got[50]["n_ip"], got[50]["n_card"], got[50]["n_phone"]) == (1, 1, 0, 1)
    a = repeated.index("(988) 555-2485 after")
    b = repeated.index("ab.c [at]")
    assert f"phone:{a}:{a + 14}" in got[50]["spans"] and f"email:{b}:{b + 17}" in got[50]["spans"]
    assert got[51]["spans"] == "" and got[51]["base_sha256"] == hashlib.sha256(b"").hexdigest()
    assert span_digests(found).count() == len(rows)
    masked = {r["doc_id"]: r["text"] for r in op10_pii.redact(table, field).where("doc_id >= 50 or doc_id < 3").collect()}
    assert masked[1] is None and masked[2] == "" and masked[51] == clean
    assert masked[50].startswith("Call <PHONE> today, or <PHONE> after six. Mail <EMAIL> or <EMAIL>. Host <IP>,")
    assert op10_pii.find(docs([]), op10_pii.train(docs([]))).count() == 0


def agreeing():
    """A field that knows nothing of form: only what repeats or resembles decides."""
    n = op10_pii.NONE + 1
    return op10_pii.Field(np.zeros((op10_pii.WIDTH, n)), np.zeros((n, n)), 10.0 * np.eye(n))


def test_fifty_repeats_of_one_base_span():
    text = "Call +1 (988) 555-2485" + ", or (988) 555-2485 then" * 50
    base, added = op10_pii.all_spans(text, agreeing())
    assert len(base) == 1 and added == [(m.start(), 3, m.end()) for m in re.finditer(r"\(988\) 555-2485", text)][1:]
    before = "Mail " + "ab.c [at] d-e.org, " * 50 + "that is ab.c@d-e.org."
    assert [k for _, k, _ in op10_pii.all_spans(before, agreeing())[1]] == [0] * 50


def test_numbers_beside_other_numbers():
    number = "(988) 555-2485"
    for after in (" 24 hours", ". 3 rooms", " 2nd floor", " 1999 2000 2001", ". 10.0.0.255 is the host", " 988 555 2485"):
        text = f"Call +1 {number}, or {number}{after}."
        added = op10_pii.all_spans(text, agreeing())[1]
        assert (a := text.rindex(number), 3, a + len(number)) in added, (after, added)
    text = f"Call +1 {number}. Hosts 10.0.0.255 {number} 7"  # the run starts with a base span
    assert (a := text.rindex(number), 3, a + len(number)) in op10_pii.all_spans(text, agreeing())[1]
    two = "7536784127813050 4845168114407329"
    assert op10_pii.candidates(two, op10_pii.base_spans(two)) == [(0, 16), (17, 33)]
    for alone in ("1-800-555-2485", "4111-1111-1111-1112"):  # nothing of it is known: whole, also beside one that starts alike
        text = f"{alone}, 1-800-555-9999, 4111 1111 1111 1111"
        assert op10_pii.candidates(text, op10_pii.base_spans(text))[0] == (0, len(alone))


def test_messages_reach_the_end_of_a_chain():
    n, kinds = 200, op10_pii.NONE + 1
    edges = np.array([(i, i + 1) for i in range(n - 1)])
    g = op10_pii.Graph([(i, i + 1) for i in range(n)], np.array([3] + [op10_pii.NONE] * (n - 1)), np.zeros((n, op10_pii.WIDTH)), np.zeros((0, 2), int), edges)
    turn = np.exp(10.0 * np.eye(kinds))
    exact = [np.linalg.matrix_power(turn / turn.sum(1), i)[3] for i in range(n)]
    assert np.allclose(agreeing().marginals(g), exact, atol=1e-4)


def test_pipeline(spark, docs, odd, tmp_path):
    import corpus_pipeline as p
    rows = [(i or None, t, "en", "s", len(t or "")) for i, t in odd] + [(20 + i, sentence(i, 80) + f" mail a{i}@b.org", "en", "s", 1) for i in range(20)]
    out = docs(rows)
    names = out.columns
    for k, (_, stage) in enumerate(p.STAGES):
        path = f"{state_dir(spark)}/stage-{tmp_path.name}-{k}"
        stage(spark, out, "").write.parquet(path)
        out = spark.read.parquet(path)
        if k < len(p.STAGES) - 1:
            assert out.columns == names
        if k == 1:
            ids = sorted(r["doc_id"] for r in out.select("doc_id").collect() if r["doc_id"] is not None)
            assert ids == sorted({4, 6, 7, 8, 10, *range(20, 40)})
        if k == 2:
            assert all("@" not in r["text"] for r in out.select("text").collect())
    assert out.count() >= len(ids)
