"""Personal data by fixed patterns and a skip-chain conditional random field that keeps a document's labels consistent.

Base spans come from four patterns (email, ip, card, phone) with their checks.  The nodes of the field are these spans,
whose labels are given, and the other candidates of the document: runs of numbers with at least seven digits, cut where
a part of 7 to 19 digits is a number that stands elsewhere, and words with an at sign, also a spelt one.  Nodes have features of form and of the words before them; a chain joins each to the
next, and skip edges join candidates that repeat or resemble each other (equal digits, equal last seven digits, equal
addresses) to their last occurrence before and to the nearest base span.  Sum-product message passing on this loopy
graph, until no message moves by more than ``SETTLED``, gives every candidate's label; those that come out as a kind with
``sure`` or more are added to the base spans.

The weights are trained by stochastic gradient descent on the pseudo-likelihood of a bounded sample of documents
(``SAMPLE_DOCS``): a base span teaches its kind, and so does a candidate that repeats or resembles one; others teach
"none".

Scale: one narrow pass; a round is linear in a document's candidates, as a repeated form links to the one before and to
one base span only.  Rounds go on as far as evidence still travels.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import at_work, bounded_batches, pick, rows_of

KINDS = ("email", "ip", "card", "phone")
NONE = len(KINDS)
SAMPLE_DOCS, EPOCHS, RATE, SURE, SETTLED = 4000, 6, 0.1, 0.6, 1e-6
#: Where training starts: equal labels over skip edges, and "none" for a candidate of which nothing is known.
AGREE, DOUBT = 4.0, 3.0

_LOCAL = re.compile(r"[A-Za-z0-9._%+-]")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+")
# a run of digits matches from its start or not at all, so the look-behind changes no match; it saves retries within it
_IP = re.compile(r"(?<![0-9])[0-9]++(\.[0-9]++)(\.[0-9]++)(\.[0-9]++)")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])++")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
# groups of digits; the run ends before a group that a letter or an at sign follows
_NUMBERS = re.compile(r"(?<![A-Za-z0-9@])\+?\(?[0-9]++(?![A-Za-z@])(?:[\x20().-]{1,2}[0-9]++(?![A-Za-z@]))*+")
_GROUP = re.compile("[0-9]+")
_AT_WORD = re.compile(r"@|[\[(] ?at ?[\])]", re.IGNORECASE)
_CUES = ({"email", "e-mail", "mail", "contact"}, {"ip", "host", "address", "server"}, {"card", "visa", "credit", "payment"},
         {"phone", "tel", "call", "fax", "mobile"})
Span = tuple[int, int, int]  # start, kind, end


def luhn(digits: str) -> bool:
    total = 0
    for i, d in enumerate(map(int, reversed(digits))):
        total += d if i % 2 == 0 else 2 * d - 9 * (d > 4)
    return total % 10 == 0


def base_spans(text: str) -> list[Span]:
    """Spans of the four patterns by start, then kind."""
    out: list[Span] = []
    done, at = 0, text.find("@")
    while at >= 0:
        start = at
        while start > done and _LOCAL.match(text, start - 1):
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            out.append((start, 0, m.end()))
            done = m.end()
        else:
            done = at + 1  # no local part reaches over an at sign
        at = text.find("@", done)
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
            out.append((m.start(), 1, m.end()))
    for m in _CARD.finditer(text):
        digits = re.sub("[^0-9]", "", m.group())
        if 12 <= len(digits) <= 19 and luhn(digits):
            out.append((m.start(), 2, m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 9 <= len(re.sub("[^0-9]", "", m.group())) <= 15:
                out.append((m.start(), 3, m.end()))
    return sorted(out)


Groups = list[tuple[int, int]]
LEAST, MOST, PREFIX = 7, 19, 4  # digits of a number, and of what may stand before it elsewhere, as a country's code


def _digits(text: str, groups: Groups) -> str:
    return "".join(text[a:b] for a, b in groups)


def _runs(text: str, base: list[Span]) -> list[tuple[int, Groups]]:
    """Runs of groups of digits and where they start, without the groups that a base span covers."""
    out: list[tuple[int, Groups]] = []
    i, reach = 0, 0
    for m in _NUMBERS.finditer(text):
        run: Groups = []
        for d in _GROUP.finditer(text, m.start(), m.end()):
            while i < len(base) and base[i][0] < d.end():
                reach = max(reach, base[i][2])
                i += 1
            if d.start() >= reach:
                run.append(d.span())
            elif run:
                out.append((m.start(), run))
                run = []
        out.append((m.start(), run))
    return [(a, run) for a, run in out if sum(e - s for s, e in run) >= LEAST]


def _tails(number: str) -> list[str]:
    return [number[k:] for k in range(PREFIX + 1) if len(number) - k >= LEAST]


def _parts(text: str, run: Groups, numbers: Counter, tails: Counter) -> list[Groups]:
    """The run in parts: those known from elsewhere, with most digits and then most of them equal, and what lies between.

    A part is known if its digits, without zeros in front, end in another number or the reverse, but for ``PREFIX`` digits
    at most."""
    n = len(run)
    own = _digits(text, run).lstrip("0")
    mine = set(_tails(own)) if len(own) <= MOST else set()
    best: list[tuple[int, int, int]] = [(0, 0, 0)] * (n + 1)  # digits covered, of these equal, parts less
    take = [0] * n
    for i in range(n - 1, -1, -1):
        best[i] = best[i + 1]
        digits = ""
        for j in range(i, n):
            digits += text[run[j][0]:run[j][1]]
            if len(digits) > MOST:
                break
            bare = digits.lstrip("0")
            equal = numbers[bare] > (bare == own)
            if equal or tails[bare] > (bare in mine) or any(numbers[t] > (t == own) for t in _tails(bare)):
                covered, same, less = best[j + 1]
                got = (covered + len(digits), same + len(digits) * equal, less - 1)
                if got > best[i]:
                    best[i], take[i] = got, j + 1
    out: list[Groups] = []
    i, rest = 0, []
    while i < n:
        if take[i]:
            out += [rest, run[i:take[i]]]
            i, rest = take[i], []
        else:
            rest.append(run[i])
            i += 1
    return [part for part in [*out, rest] if sum(e - s for s, e in part) >= LEAST]


def _numbers(text: str, base: list[Span]) -> list[tuple[int, int]]:
    runs = _runs(text, base)
    spans = [run for _, run in runs] + [[m.span() for m in _GROUP.finditer(text, a, b)] for a, k, b in base if k >= 2]
    numbers = Counter(d.lstrip("0") for d in (_digits(text, groups) for groups in spans) if len(d.lstrip("0")) >= LEAST and len(d) <= MOST)
    tails: Counter = Counter()
    for number, times in numbers.items():
        for t in _tails(number):
            tails[t] += times
    out = []
    for start, run in runs:
        for part in _parts(text, run, numbers, tails):
            wide = sum(e - s for s, e in part) > MOST
            # too long for one number: its groups that may be one each
            split = [[g] for g in part if LEAST <= g[1] - g[0] <= MOST] if wide else []
            for piece in split or [part]:
                a, b = piece[0][0], piece[-1][1]
                for before in "(+":
                    a -= a > start and text[a - 1] == before
                out.append((a, b))
    return out


def candidates(text: str, base: list[Span]) -> list[tuple[int, int]]:
    """Further spans that may be personal data, clear of the base spans, in order."""
    found = _numbers(text, base)
    done = 0
    while m := _AT_WORD.search(text, done):
        a, b = m.start(), m.end()
        if text[a] in "[(":  # the words on both sides of a spelt at sign
            while a > done and text[a - 1] == " ":
                a -= 1
            while b < len(text) and text[b] == " ":
                b += 1
        while a > done and not text[a - 1].isspace():
            a -= 1
        while b < len(text) and not text[b].isspace():
            b += 1
        done = b
        while b > a and text[b - 1] in ".,;:!?)]>\"'":
            b -= 1
        while a < b and text[a] in "([<\"'":
            a += 1
        if a < b:
            found.append((a, b))
    out: list[tuple[int, int]] = []
    i, reach = 0, 0
    for a, b in sorted(set(found)):
        while i < len(base) and base[i][0] < b:
            reach = max(reach, base[i][2])
            i += 1
        if a >= reach and (not out or a >= out[-1][1]):
            out.append((a, b))
    return out


def keys(span: str) -> list[str]:
    """What a span shares with spans that repeat or resemble it."""
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    if "@" in span or _AT_WORD.search(span):
        plain = re.sub(r" ?[\[(] ?dot ?[\])] ?", ".", re.sub(r" ?[\[(] ?at ?[\])] ?", "@", span.lower()))
        return ["a" + re.sub(r"\s", "", plain)]
    return ["d" + digits, "t" + digits[-7:]] if len(digits) >= 7 else ["x" + span]


WIDTH = 24


def features(text: str, start: int, end: int) -> list[float]:
    span = text[start:end]
    n = sum(c.isdigit() for c in span)
    digits = "".join(c for c in span if c.isdigit() and c.isascii())
    groups = len(re.findall("[0-9]+", span))
    before = {w.strip(".,:;!?()\"'").lower() for w in text[max(0, start - 40):start].split()[-3:]}
    out = [1.0, "@" in span, bool(_AT_WORD.search(span)), span[:1] == "+", n < 7, 7 <= n <= 8, 9 <= n <= 11, 12 <= n <= 15,
           16 <= n <= 19, n > 19, luhn(digits) and n > 11, groups == 1, groups in (2, 3), groups == 4, groups > 4,
           "." in span, "-" in span, " " in span, "(" in span, bool(_IP.fullmatch(span)), *[bool(before & c) for c in _CUES]]
    return [float(x) for x in out]


@dataclass
class Graph:
    """Nodes by start; edges point from the earlier node to the later one; label NONE where nothing is given."""

    spans: list[tuple[int, int]]
    given: np.ndarray
    x: np.ndarray
    chain: np.ndarray
    skip: np.ndarray


def graph(text: str, base: list[Span]) -> Graph | None:
    """None if no candidate is free."""
    free = candidates(text, base)
    if not free:
        return None
    nodes = sorted([(a, b, k) for a, k, b in base] + [(a, b, NONE) for a, b in free])
    shared = [keys(text[a:b]) for a, b, _ in nodes]
    last: dict[str, int] = {}
    skip = set()
    for i, of in enumerate(shared):
        for key in of:
            if key in last:
                skip.add((last[key], i))
            last[key] = i
    near: dict[tuple[int, str], int] = {}  # a free node and its key to the nearest base span with it
    for order in (range(len(nodes)), range(len(nodes) - 1, -1, -1)):
        given: dict[str, int] = {}
        for i in order:
            for key in shared[i]:
                if nodes[i][2] < NONE:
                    given[key] = i
                elif key in given and abs(given[key] - i) < abs(near.get((i, key), -len(nodes)) - i):
                    near[i, key] = given[key]
    skip |= {(min(i, j), max(i, j)) for (i, _), j in near.items()}
    return Graph([(a, b) for a, b, _ in nodes], np.array([k for *_, k in nodes]),
                 np.array([features(text, a, b) for a, b, _ in nodes]),
                 np.array([(i, i + 1) for i in range(len(nodes) - 1)], int).reshape(-1, 2), np.array(sorted(skip), int).reshape(-1, 2))


def targets(g: Graph) -> np.ndarray:
    """What each node teaches: its given kind, else that of a node it repeats or resembles, over any number of edges."""
    y = g.given.copy()
    for edges in (g.skip, g.skip[::-1]):
        for a, b in edges:
            if y[a] == NONE:
                y[a] = y[b]
            elif y[b] == NONE:
                y[b] = y[a]
    return y


@dataclass
class Field:
    unary: np.ndarray  # features x labels
    chain: np.ndarray  # labels x labels, earlier node first
    skip: np.ndarray

    def marginals(self, g: Graph) -> np.ndarray:
        """Sum-product messages over chain and skip edges, both ways at once, averaged with the ones before until settled.

        Where they circle instead, for longer than evidence needs through the whole graph, smaller steps are taken."""
        node = g.x @ self.unary
        fixed = g.given < NONE
        node[fixed] = -50.0
        node[fixed, g.given[fixed]] = 0.0
        edges = np.concatenate([g.chain, g.skip])
        pair = np.concatenate([np.broadcast_to(self.chain, (len(g.chain), NONE + 1, NONE + 1)),
                               np.broadcast_to(self.skip, (len(g.skip), NONE + 1, NONE + 1))])
        src, dst = np.concatenate([edges[:, 0], edges[:, 1]]), np.concatenate([edges[:, 1], edges[:, 0]])
        pair = np.concatenate([pair, pair.transpose(0, 2, 1)])
        back = np.concatenate([np.arange(len(edges)) + len(edges), np.arange(len(edges))])
        message = np.zeros((len(src), NONE + 1))
        step, least, waited = 0.5, np.inf, 0
        while len(src):
            belief = node.copy()
            np.add.at(belief, dst, message)
            out = np.logaddexp.reduce((belief[src] - message[back])[:, :, None] + pair, axis=1)
            change = out - out.max(1, keepdims=True) - message
            message += step * change
            most = np.abs(change).max()
            if most <= SETTLED or step < 1e-6:
                break
            least, waited = (most, 0) if most < least / 2 else (least, waited + 1)
            if waited > 4 * len(node) + 64:
                step, least, waited = step / 2, most, 0
        belief = node.copy()
        np.add.at(belief, dst, message)
        e = np.exp(belief - belief.max(1, keepdims=True))
        return e / e.sum(1, keepdims=True)


def fit(graphs: list[Graph], seed: int = 11) -> Field:
    """Stochastic gradient on the pseudo-likelihood: each node given its neighbours' targets, one graph a step."""
    rng = np.random.default_rng(seed)
    n = NONE + 1
    out = Field(np.zeros((WIDTH, n)), np.zeros((n, n)), AGREE * np.eye(n))
    out.unary[0, NONE] = DOUBT
    graphs = sorted(graphs, key=lambda g: (len(g.spans), g.spans))
    ys = [targets(g) for g in graphs]
    for epoch in range(EPOCHS):
        for t in rng.permutation(len(graphs)):
            g, y = graphs[t], ys[t]
            score = g.x @ out.unary
            for edges, pair in ((g.chain, out.chain), (g.skip, out.skip)):
                np.add.at(score, edges[:, 1], pair[y[edges[:, 0]]])
                np.add.at(score, edges[:, 0], pair.T[y[edges[:, 1]]])
            e = np.exp(score - score.max(1, keepdims=True))
            error = e / e.sum(1, keepdims=True)
            error[np.arange(len(y)), y] -= 1
            error *= RATE / (1 + epoch) / len(y)
            out.unary -= g.x.T @ error
            for edges, pair in ((g.chain, out.chain), (g.skip, out.skip)):
                np.add.at(pair, y[edges[:, 0]], -error[edges[:, 1]])
                np.add.at(pair.T, y[edges[:, 1]], -error[edges[:, 0]])
    return out


def train(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", sample_docs: int = SAMPLE_DOCS, seed: int = 11) -> Field:
    """Weights from about ``sample_docs`` documents, drawn by a hash of their ids; without any, all weights are zero."""
    bounded_batches(docs.sparkSession)
    total = max(1, docs.count())
    draw = F.pmod(F.xxhash64(F.col(f"`{id_col}`").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))
    sample = docs.where(draw < sample_docs / total) if total > sample_docs else docs

    def nodes(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[tuple] = []
        for (text,) in rows_of(batches, "text"):
            base = base_spans(text or "")
            g = _taught(text or "", base)
            if g is not None:
                out.append(([v for s in g.spans for v in s], g.given.tolist(), g.x.ravel().tolist(), g.chain.ravel().tolist(), g.skip.ravel().tolist()))
        cols = zip(*out, strict=True) if out else [[]] * 5
        types = [pa.list_(pa.int64()), pa.list_(pa.int64()), pa.list_(pa.float64()), pa.list_(pa.int64()), pa.list_(pa.int64())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types, strict=True)], ["spans", "given", "x", "chain", "skip"])

    schema = "spans array<long>, given array<long>, x array<double>, chain array<long>, skip array<long>"
    got = pick(sample, text=text_col).mapInArrow(nodes, schema).toArrow().to_pylist()
    pairs = lambda v: np.array(v, int).reshape(-1, 2)
    return fit([Graph([tuple(p) for p in pairs(r["spans"]).tolist()], np.array(r["given"]), np.array(r["x"]).reshape(-1, WIDTH),
                      pairs(r["chain"]), pairs(r["skip"])) for r in got], seed)


def _taught(text: str, base: list[Span]) -> Graph | None:
    """As ``graph``, also where base spans alone are there to learn from."""
    g = graph(text, base)
    if g is None and base:
        nodes = sorted((a, b, k) for a, k, b in base)
        g = Graph([(a, b) for a, b, _ in nodes], np.array([k for *_, k in nodes]), np.array([features(text, a, b) for a, b, _ in nodes]),
                  np.array([(i, i + 1) for i in range(len(nodes) - 1)], int).reshape(-1, 2), np.zeros((0, 2), int))
    return g


def all_spans(text: str, field: Field, sure: float = SURE) -> tuple[list[Span], list[Span]]:
    """Base spans, and those that the field adds, by start, then kind."""
    base = base_spans(text)
    g = graph(text, base)
    if g is None:
        return base, []
    p = field.marginals(g)
    added = [(a, int(p[i, :NONE].argmax()), b) for i, (a, b) in enumerate(g.spans) if g.given[i] == NONE and p[i, :NONE].max() >= sure]
    return base, added


SPANS = "array<struct<kind:string,start:long,end:long,base:boolean>>"


def find(docs: DataFrame, field: Field, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """doc_id and its spans (kind, start, end, base) by start, then kind; null and empty texts have none."""
    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    kind = src.schema["doc_id"].dataType.simpleString()
    struct = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64()), ("base", pa.bool_())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("personal data")
        for b in batches:
            rows = []
            for text in b.column(1).to_pylist():
                base, added = all_spans(text or "", field)
                every = sorted([(a, k, e, True) for a, k, e in base] + [(a, k, e, False) for a, k, e in added])
                rows.append([{"kind": KINDS[k], "start": a, "end": e, "base": by} for a, k, e, by in every])
            yield pa.RecordBatch.from_arrays([b.column(0), pa.array(rows, struct)], ["doc_id", "spans"])

    return src.mapInArrow(run, f"doc_id {kind}, spans {SPANS}")


def redact(docs: DataFrame, field: Field, text_col: str = "text") -> DataFrame:
    """``docs`` with every span in the text replaced by its kind in angle brackets; overlapping spans become one, named
    after the first.  A null text stays null; all rows and other columns stay."""
    bounded_batches(docs.sparkSession)

    at = docs.columns.index(text_col)

    def masked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("personal data")
        for b in batches:
            texts = pa.array([t if t is None else mask(t, field) for t in b.column(at).to_pylist()], b.schema.field(at).type)
            yield pa.RecordBatch.from_arrays([*b.columns[:at], texts, *b.columns[at + 1:]], schema=b.schema)

    return docs.mapInArrow(masked, docs.schema)


def mask(text: str, field: Field) -> str:
    base, added = all_spans(text, field)
    out, at, until = [], 0, 0
    for start, kind, end in sorted(base + added):
        if start >= until:
            out += [text[at:start], f"<{KINDS[kind].upper()}>"]
            at = until = end
        elif end > until:
            at = until = end
    return "".join([*out, text[at:]])
