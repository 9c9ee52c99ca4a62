"""Language identification: averaged embeddings of hashed subwords under a linear softmax.

A text's vector is the mean of the embeddings of its words' character n-grams (with word borders), hashed into a fixed
number of buckets; a linear layer and a softmax give the languages.  Embeddings and layer are trained by stochastic
gradient descent in numpy on a bounded sample: about ``per_label`` labelled texts of each label, chosen by a hash of
their id (documented bound; the rest of the labelled rows is not needed for a model of this size).  A part of the sample
is held back to fit the softmax temperature and the score below which a prediction is rejected, set so that at most
``reject_rate`` of the held-back texts fall below it.

Scale: training texts become sparse feature rows in tasks; the driver gets only those.  Prediction is one narrow pass.
As mean and layer are linear, each bucket carries its label scores directly, and a word seen before is one lookup.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import at_work, bounded_batches, cut, pick, rows_of

BUCKETS, DIM, GRAMS = 1 << 15, 16, (2, 3, 4)
PER_LABEL, EPOCHS, RATE, REJECT_RATE = 500, 8, 0.5, 0.001
UNKNOWN = "und"
#: Chunks longer than this are not kept in the cache.
LONG = 64


def grams(chunk: str) -> list[int]:
    """Buckets of all n-grams of the words (runs of letters) of a chunk of text."""
    low = chunk.lower()
    words = [low] if low.isalpha() else "".join([c if c.isalpha() else " " for c in low]).split()
    out = []
    for w in words:
        marked = f"<{w}>".encode("utf-32-le")
        for n in GRAMS:
            out += [zlib.crc32(marked[i:i + 4 * n]) % BUCKETS for i in range(0, len(marked) - 4 * n + 1, 4)]
    return out


@dataclass
class Model:
    labels: list[str]
    scores: np.ndarray  # of each bucket for each label
    bias: np.ndarray
    temperature: float = 1.0
    threshold: float = 0.0
    known: dict[str, int] = field(default_factory=dict)
    sums: np.ndarray = field(default_factory=lambda: np.zeros((0, 0)))

    def __getstate__(self) -> dict:
        return self.__dict__ | {"known": {}, "sums": np.zeros((0, 0))}

    def _rows(self, chunks: list[str]) -> np.ndarray:
        """For each chunk its n-grams' label scores, summed, and their number."""
        found = [grams(c) for c in chunks]
        sizes = np.array([len(f) for f in found])
        out = np.zeros((len(chunks), len(self.labels) + 1))
        if sizes.any():
            flat = self.scores[np.concatenate([np.array(f, np.int64) for f in found if f])].astype(np.float64)
            full = sizes > 0
            out[full, :-1] = np.add.reduceat(flat, (np.cumsum(sizes) - sizes)[full], axis=0)
        out[:, -1] = sizes
        return out

    def learn(self, chunks: set[str], limit: int = 1 << 17) -> None:
        """Put chunks into the cache, which is emptied first when it is full."""
        if len(self.known) > limit:
            self.known, self.sums = {}, self.sums[:0]
        if new := list(chunks.difference(self.known)):
            rows, n = self._rows(new), len(self.known)
            if n + len(new) > len(self.sums):
                grown = np.zeros((max(2 * len(self.sums), n + len(new)), len(self.labels) + 1))
                grown[:n] = self.sums[:n] if n else 0
                self.sums = grown
            self.sums[n:n + len(new)] = rows
            self.known.update(zip(new, range(n, n + len(new)), strict=True))

    def predict(self, text: str) -> tuple[str, float]:
        """Label and score; without a letter, or without any label learned, ``und`` and 0."""
        if not self.labels:
            return UNKNOWN, 0.0
        chunks = text.split()
        long = [c for c in chunks if len(c) > LONG]
        if long:
            chunks = [c for c in chunks if len(c) <= LONG]
        self.learn({*chunks})
        total = self.sums[np.fromiter(map(self.known.__getitem__, chunks), np.int64, len(chunks))].sum(0) if chunks else 0
        for c in long:
            total = total + self._rows([c])[0]
        if not len(text) or np.ndim(total) == 0 or not total[-1]:
            return UNKNOWN, 0.0
        p = softmax((total[:-1] / total[-1] + self.bias) / self.temperature)
        return self.labels[int(p.argmax())], float(p.max())


def softmax(x: np.ndarray) -> np.ndarray:
    e = np.exp(x - x.max(-1, keepdims=True))
    return e / e.sum(-1, keepdims=True)


def train(docs: DataFrame, may_learn: Column, id_col: str = "doc_id", text_col: str = "text", label_col: str = "lang",
          per_label: int = PER_LABEL, seed: int = 7) -> Model:
    """A model from the rows of ``docs`` where ``may_learn`` holds and text and label are not null.

    Every label that occurs is learned, from about ``per_label`` texts.  Texts without a letter teach nothing; without any
    usable row the model knows no label and predicts ``und``."""
    spark = docs.sparkSession
    bounded_batches(spark)
    rows = docs.where(may_learn & F.col(label_col).isNotNull() & F.col(text_col).isNotNull())
    rows = pick(rows, id=id_col, text=text_col, label=label_col)
    # a row per label, written, so that it is joined at its true size
    counts = cut(rows.groupBy("label").agg((F.lit(float(per_label)) / F.count(F.lit(1))).alias("share")), "labels")
    draw = F.pmod(F.xxhash64(F.col("id").cast("string"), F.lit(seed)), F.lit(1 << 30)) / F.lit(float(1 << 30))

    def features(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out: list[list] = [[], [], []]
        for label, text in rows_of(batches, "label", "text"):
            ids, n = np.unique(np.array(grams(text), np.int64), return_counts=True)
            if len(ids):
                for col, v in zip(out, (label, ids.astype(np.int32), (n / n.sum()).astype(np.float32)), strict=True):
                    col.append(v)
        yield pa.RecordBatch.from_arrays([pa.array(out[0], pa.string()), pa.array(out[1], pa.list_(pa.int32())),
                                          pa.array(out[2], pa.list_(pa.float32()))], ["label", "ids", "part"])

    got = rows.join(counts, "label").where(draw < F.col("share")).select("label", "text").mapInArrow(features, "label string, ids array<int>, part array<float>").toArrow()
    labels = sorted(r["label"] for r in counts.select("label").collect())
    if not labels:
        return Model([], np.zeros((BUCKETS, 0), np.float32), np.zeros(0))
    return fit([labels.index(x) for x in got["label"].to_pylist()],
               [(i.values.to_numpy(), p.values.to_numpy()) for i, p in zip(got["ids"], got["part"], strict=True)], labels, seed)


def fit(y: list[int], x: list[tuple[np.ndarray, np.ndarray]], labels: list[str], seed: int = 7) -> Model:
    """Stochastic gradient descent, one text a step, in a random order; every fifth text calibrates."""
    rng = np.random.default_rng(seed)
    order = np.lexsort([[len(i) for i, _ in x], [int(i.sum()) for i, _ in x], y]) if y else np.zeros(0, int)
    order = rng.permutation(order)  # the same whatever the order in which tasks gave the rows
    held, used = order[::5], np.setdiff1d(order, order[::5], assume_unique=True)
    embed = rng.normal(0, 0.1, (BUCKETS, DIM))
    layer, bias = np.zeros((DIM, len(labels))), np.zeros(len(labels))
    steps, at = EPOCHS * max(1, len(used)), 0
    weight = len(y) / (len(labels) * np.maximum(1, np.bincount(y, minlength=len(labels)))) if y else np.ones(len(labels))
    for _ in range(EPOCHS):
        for t in rng.permutation(used):
            ids, part = x[t]
            mean = part @ embed[ids]
            error = softmax(mean @ layer + bias)
            error[y[t]] -= 1
            error *= weight[y[t]] * RATE * (1 - at / steps)
            back = layer @ error
            layer -= np.outer(mean, error)
            bias -= 0.1 * error
            embed[ids] -= 10 * np.outer(part, back)
            at += 1
    scores = (embed @ layer).astype(np.float32)
    out = Model(labels, scores, bias)
    if len(held):
        raw = np.array([x[t][1] @ scores[x[t][0]] for t in held]) + bias
        truth = np.array([y[t] for t in held])
        loss = {c: -np.log(softmax(raw / c)[np.arange(len(held)), truth] + 1e-12).mean() for c in np.geomspace(1, 20, 40)}
        out.temperature = float(min(loss, key=loss.__getitem__))
        out.threshold = float(min(0.5, np.quantile(softmax(raw / out.temperature).max(1), REJECT_RATE)))
    return out


def predict(docs: DataFrame, model: Model, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Adds lang_pred (a learned label, or ``und`` if the text is null or has no letter), score (0 to 1) and rejected
    (``und``, or a score below the model's threshold) to doc_id.  Repeated rows are predicted each for itself."""
    bounded_batches(docs.sparkSession)
    src = pick(docs, doc_id=id_col, text=text_col)
    from pyspark.sql.pandas.types import to_arrow_type
    id_type, kind = to_arrow_type(src.schema["doc_id"].dataType), src.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language")
        for b in batches:
            got = [model.predict(t or "") for t in b.column(1).to_pylist()]
            label, score = [g[0] for g in got], [g[1] for g in got]
            gone = [name == UNKNOWN or s < model.threshold for name, s in got]
            yield pa.RecordBatch.from_arrays([b.column(0).cast(id_type), pa.array(label, pa.string()), pa.array(score, pa.float64()),
                                              pa.array(gone, pa.bool_())], ["doc_id", "lang_pred", "score", "rejected"])

    return src.mapInArrow(run, f"doc_id {kind}, lang_pred string, score double, rejected boolean")


def keep_known(docs: DataFrame, model: Model, text_col: str = "text") -> DataFrame:
    """``docs`` without the rows that the model rejects; all columns and copies stay."""
    bounded_batches(docs.sparkSession)

    at = docs.columns.index(text_col)

    def kept(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        at_work("language")
        for b in batches:
            got = [model.predict(t or "") for t in b.column(at).to_pylist()]
            yield b.filter(pa.array([name != UNKNOWN and s >= model.threshold for name, s in got], pa.bool_()))

    return docs.mapInArrow(kept, docs.schema)


def held_out(id_col: str = "doc_id") -> Column:
    """The fold that is never learned from: crc32 of the id as text divisible by 5; a null id belongs to no fold."""
    return F.coalesce(F.crc32(F.col(id_col).cast("string")) % 5 == 0, F.lit(False))
