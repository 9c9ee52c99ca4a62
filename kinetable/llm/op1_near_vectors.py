"""Near-duplicate vectors by collision-counting projections.

Vectors are projected on many random directions.  For unit vectors of cosine c the two values on one direction are
normal with correlation c, whatever the data, so the number of directions where a pair collides is known in law.  A pair
collides on a direction if both values are in its tail (above ``tail``) and within a window around each other: in the
middle of a projection every vector meets a constant share of all others, which tells nothing, while a tail holds few.
Each direction's tail, upper and lower, is a sorted list; pairs within each other's window there are counted, and those
with at least ``LEAST`` collisions are verified by cosine in double precision.  ``calibrate`` sets the tail so that a
pair just at the threshold passes with probability ``RECALL``; nearer pairs pass more surely.

Scale: directions grow with the rows, so a list keeps about ``LIST_ROWS`` of them.  Copies of one vector are one row with
a weight.  A list above ``BLOCK`` rows (a large group of near copies is in the same lists) is split into blocks, and
every pair of blocks is a group of its own.  Pairs never become rows: a group puts out each vector's weighted number of
links and one edge to the smallest vector it reaches in the group.  A pair is counted in the first of its lists only.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import bounded_batches, cut
from .components import components

THRESHOLD, LEAST, RECALL, WINDOW = 0.9, 2, 0.998, 3.0
LIST_ROWS, MIN_DIRECTIONS, BLOCK, GROUP_ROWS = 128, 512, 1024, 4096
SEED = 5


def tail_collision(tail: float, c: float, width: float) -> float:
    """Chance that two standard normals of correlation c are both above ``tail`` and at most ``width`` apart."""
    x = np.linspace(tail, tail + 8, 1601)
    s = math.sqrt(1 - c * c)
    cdf = np.vectorize(lambda v: 0.5 * (1 + math.erf(v / math.sqrt(2))))
    inside = cdf((x + width - c * x) / s) - cdf((np.maximum(tail, x - width) - c * x) / s)
    y = np.exp(-x * x / 2) / math.sqrt(2 * math.pi) * inside
    return float(((y[1:] + y[:-1]) / 2).sum() * (x[1] - x[0]))


@lru_cache
def calibrate(directions: int, c: float = THRESHOLD) -> tuple[float, float]:
    """Tail and window for which a pair of cosine c reaches ``LEAST`` collisions with probability ``RECALL``."""
    width = WINDOW * math.sqrt(2 - 2 * c)
    low, high = 0.0, 6.0
    for _ in range(40):
        tail = (low + high) / 2
        mean = 2 * directions * tail_collision(tail, c, width)
        passed = 1 - sum(math.exp(-mean) * mean ** k / math.factorial(k) for k in range(LEAST))
        low, high = (tail, high) if passed >= RECALL else (low, tail)
    return low, width


def directions_for(rows: int) -> int:
    """A power of two for which a list has about ``LIST_ROWS`` rows, at some sixteen lists a vector."""
    return max(MIN_DIRECTIONS, 1 << max(0, math.ceil(math.log2(max(1, rows * 16 / (2 * LIST_ROWS))))))


def usable(vector: str = "embedding"):
    """Not null, no null or non-finite component, not zero."""
    good = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return F.coalesce(F.col(vector).isNotNull() & good & F.exists(vector, lambda x: x != 0), F.lit(False))


@lru_cache(4)
def _directions(dim: int, count: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((count, dim))


LISTED = "list long, vec_id long, value double, weight long, dim int, vector binary, lists binary, places binary"


def _listed(count: int, tail: float):
    names = [x.split()[0] for x in LISTED.split(", ")]
    types = [pa.int64(), pa.int64(), pa.float64(), pa.int64(), pa.int32(), *[pa.binary()] * 3]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            rows: list[tuple] = []
            for vec_id, vector, weight in zip(*[c.to_pylist() for c in b.columns], strict=True):
                v = np.asarray(vector, np.float64)
                v = v / np.abs(v).max()
                u = v / np.linalg.norm(v)
                p = _directions(len(u), count) @ u
                hit = np.flatnonzero(np.abs(p) > tail)
                lists = np.sort(2 * hit + (p[hit] < 0)) + (len(u) << 40)
                value = np.abs(p[(lists - (len(u) << 40)) // 2])
                packed = (u.tobytes(), lists.tobytes(), value.tobytes())
                rows += [(x, vec_id, y, weight, len(u), *packed) for x, y in zip(lists.tolist(), value.tolist(), strict=True)]
                if len(rows) > 4000:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)
                    rows = []
            if rows:
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), types, strict=True)], names)

    return run


def _pairs(rows: dict[str, np.ndarray], a: np.ndarray, b: np.ndarray, this: int, width: float, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """Links between the rows a and b of one list (both the same: each pair once) that are counted in this list."""
    same = a is b
    flat = np.concatenate([rows["lists"][i] for i in a] + ([] if same else [rows["lists"][i] for i in b]))
    names, times = np.unique(flat, return_counts=True)
    names = names[times > 1]
    column = lambda part: _incidence([rows["lists"][i] for i in part], names)
    left = column(a)
    right = left if same else column(b)
    out_a, out_b = [], []
    for i in range(0, len(a), 256):
        met = left[i:i + 256] @ right.T >= LEAST
        met &= np.abs(rows["value"][a[i:i + 256]][:, None] - rows["value"][b][None, :]) <= width
        x, y = np.nonzero(met)
        x = x + i
        if same:
            x, y = x[x < y], y[x < y]
        for j in range(0, len(x), 8192):
            p, q = a[x[j:j + 8192]], b[y[j:j + 8192]]
            keep = np.einsum("ij,ij->i", rows["vector"][p], rows["vector"][q]) >= threshold if len(p) else np.zeros(0, bool)
            keep[keep] = _first_is(rows, p[keep], q[keep], this, width)
            out_a.append(p[keep])
            out_b.append(q[keep])
    none = np.zeros(0, np.int64)
    return np.concatenate([none, *out_a]), np.concatenate([none, *out_b])


def _incidence(lists: list[np.ndarray], names: np.ndarray) -> np.ndarray:
    out = np.zeros((len(lists), len(names)), np.float32)
    for i, own in enumerate(lists):
        at = np.searchsorted(names, own)
        at = at[(at < len(names)) & (names[np.minimum(at, len(names) - 1)] == own)] if len(names) else at[:0]
        out[i, at] = 1
    return out


def _first_is(rows: dict[str, np.ndarray], p: np.ndarray, q: np.ndarray, this: int, width: float) -> np.ndarray:
    """Whether pairs have ``LEAST`` collisions within the window, the first of them in the list ``this``."""
    out = np.zeros(len(p), bool)
    for i in range(0, len(p), 512):
        a, b = p[i:i + 512], q[i:i + 512]
        both = (rows["padded"][a][:, :, None] == rows["padded"][b][:, None, :]) & (rows["padded"][a] >= 0)[:, :, None]
        both &= np.abs(rows["at"][a][:, :, None] - rows["at"][b][:, None, :]) <= width
        met = both.any(2)
        first = rows["padded"][a, met.argmax(1)]
        out[i:i + 512] = (met.sum(1) >= LEAST) & (first == this)
    return out


def _padded(parts: list[np.ndarray], fill: float) -> np.ndarray:
    out = np.full((len(parts), max(map(len, parts), default=0)), fill, parts[0].dtype if parts else float)
    for i, part in enumerate(parts):
        out[i, :len(part)] = part
    return out


def _labels(n: int, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    label = np.arange(n)
    while True:
        low = np.minimum(label[a], label[b])
        new = label.copy()
        np.minimum.at(new, a, low)
        np.minimum.at(new, b, low)
        np.minimum.at(new, label[a], low)
        np.minimum.at(new, label[b], low)
        new = new[new]
        if (new == label).all():
            return label
        label = new


def _count_group(width: float, threshold: float):
    def run(group: pa.Table) -> pa.Table:
        group = group.sort_by([("list", "ascending"), ("value", "ascending"), ("vec_id", "ascending")])
        x, y = group["x"][0].as_py(), group["y"][0].as_py()
        lists, ids = group["list"].to_numpy(), group["vec_id"].to_numpy()
        raw = group["vector"].to_pylist()
        values = group["value"].to_numpy()
        listed = [np.frombuffer(v, np.int64) for v in group["lists"].to_pylist()]
        places = [np.frombuffer(v, np.float64) for v in group["places"].to_pylist()]
        weight, block = group["weight"].to_numpy(), group["block"].to_numpy()
        links, smallest = np.zeros(len(ids), np.int64), ids.copy()
        edges = np.append(np.flatnonzero(np.diff(lists, prepend=-1)), len(lists))
        for lo, hi in zip(edges, edges[1:], strict=False):
            if hi - lo < 2:
                continue
            own = {"value": values[lo:hi], "lists": listed[lo:hi], "padded": _padded(listed[lo:hi], -1),
                   "at": _padded(places[lo:hi], 0.0), "vector": np.array([np.frombuffer(v, np.float64) for v in raw[lo:hi]])}
            every = np.arange(hi - lo)
            a, b = (every, every) if x == y else (every[block[lo:hi] == x], every[block[lo:hi] == y])
            if x == y:
                b = a
            p, q = _pairs(own, a, b, int(lists[lo]), width, threshold)
            if len(p):
                np.add.at(links, p + lo, weight[q + lo])
                np.add.at(links, q + lo, weight[p + lo])
                order = np.argsort(ids[lo:hi], kind="stable")
                rank = np.empty_like(order)
                rank[order] = every
                smallest[lo:hi] = ids[lo:hi][order][_labels(hi - lo, rank[p], rank[q])[rank]]
        keep = links > 0
        return pa.table({"vec_id": ids[keep], "links": links[keep], "peer": smallest[keep]})

    return run


def near_vectors(vectors: DataFrame, id_col: str = "vec_id", vector_col: str = "embedding", threshold: float = THRESHOLD) -> DataFrame:
    """vec_id, n_links, component_id, kept for every row.

    Null, zero and partly null or non-finite vectors link with nothing; vectors of different length neither.  Copies link
    with each other.  A row is a vector: of rows that share an id each has the links of its own vector, to other rows; in
    components an id is one node."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"))
    takes_part = usable() & F.col("vec_id").isNotNull()
    keys = {"k1": F.when(takes_part, F.xxhash64("embedding")), "k2": F.when(takes_part, F.xxhash64(F.lit(1), "embedding"))}
    keyed = src.withColumns(keys)
    first = keyed.where("k1 IS NOT NULL").groupBy("k1", "k2").agg(
        F.min("vec_id").alias("first"), F.count(F.lit(1)).alias("weight"), F.any_value("embedding").alias("embedding"))
    # a vector has a number of its own: two of them may have one smallest id
    first = cut(first.withColumn("node", F.monotonically_increasing_id()), "vectors")
    count = directions_for(first.count())
    tail, width = calibrate(count, threshold)
    listed = cut(first.select("node", "embedding", "weight").mapInArrow(_listed(count, tail), LISTED), "lists")
    sizes = cut(listed.groupBy("list").agg(F.count(F.lit(1)).alias("size")).where("size > 1"), "sizes")
    groups = max(1, listed.count() // GROUP_ROWS)
    blocks = F.ceil(F.col("size") / F.lit(BLOCK)).cast("int")
    placed = listed.join(sizes, "list").withColumn("_blocks", blocks).withColumn(
        "block", F.pmod(F.xxhash64("vec_id", "list"), F.col("_blocks")).cast("int"))
    placed = placed.withColumn("_other", F.explode(F.sequence(F.lit(0), F.col("_blocks") - 1)))
    group = F.when(F.col("_blocks") == 1, F.pmod(F.xxhash64("list"), F.lit(groups))).otherwise(F.col("list") + groups)
    placed = placed.select("list", "vec_id", "value", "weight", "vector", "lists", "places", "block", group.alias("group"),
                           F.least("block", "_other").alias("x"), F.greatest("block", "_other").alias("y"))
    counted = cut(placed.groupBy("group", "x", "y").applyInArrow(_count_group(width, threshold), "vec_id long, links long, peer long"), "links")
    links = counted.groupBy("vec_id").agg(F.sum("links").alias("links"))
    found = cut(first.select("node", "k1", "k2", "first", "weight").join(links.withColumnRenamed("vec_id", "node"), "node", "left").select(
        "node", "k1", "k2", "first", (F.coalesce("links", F.lit(0)) + F.col("weight") - 1).alias("n_links")), "found")
    smallest = lambda node, name: found.select(F.col("node").alias(node), F.col("first").alias(name))
    across = counted.select("vec_id", "peer").join(smallest("vec_id", "src"), "vec_id").join(smallest("peer", "dst"), "peer").select("src", "dst")
    good = keyed.where("k1 IS NOT NULL").select("vec_id", "k1", "k2").join(found, ["k1", "k2"])
    labels = components(across.unionByName(good.select(F.col("vec_id").alias("src"), F.col("first").alias("dst")).where("src <> dst")))
    rest = keyed.where("k1 IS NULL").select("vec_id", F.lit(0).cast("long").alias("n_links"))
    out = good.select("vec_id", F.col("n_links").cast("long").alias("n_links")).unionByName(rest)
    out = out.join(labels.withColumnRenamed("node", "vec_id"), "vec_id", "left")
    component = F.coalesce("component", "vec_id")
    return out.select("vec_id", "n_links", component.alias("component_id"), (F.col("vec_id") == component).alias("kept"))
