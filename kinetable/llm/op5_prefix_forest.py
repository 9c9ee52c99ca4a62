"""Approximate nearest neighbours by a hash-prefix forest.

Each of ``TREES`` trees gives a vector a string of ``BITS`` bits, the sides of random hyperplanes; a tree is its strings
in sorted order, and the vectors that share a prefix are a range of it.  A query starts at its longest prefixes and goes
up in all trees at once, one level at a time, until the ranges of all trees together hold ``enough`` vectors or the
level is reached at which the forest finds what it should.  That level is fitted: for a bounded sample of queries
(``SAMPLE``) the true neighbours are found by brute force, and the deepest level whose ranges hold ``RECALL`` of them is
taken.  A query in a crowded part stops deeper, as its ranges fill sooner.  Candidates are scored by inner product in
double precision.

Largest inner products become smallest angles by one more component, sqrt(L^2 - |x|^2) with L the largest length, which
queries have as zero.

Scale: rows go to (tree, prefix at the fitted level); a prefix with more than ``BLOCK`` rows is split into blocks, which
every query of the prefix visits.  Of copies of one vector only the smallest ids can be among the nearest, so more than
k + 1 of them never leave their map task.  Each group returns at most k rows a query.  Queries that end up with fewer
than k candidates are compared with all rows, in blocks.  Tables with a row per query, vector or prefix are joined by
shuffles: their files are small, their rows in a driver are not.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from ..plans.ranking import top_k
from .common import bounded_batches, cut
from .op1_near_vectors import usable

TREES, BITS, SAMPLE, RECALL = 48, 24, 128, 0.96
#: Levels at which queries look for enough candidates, above the fitted one.
STRIDE, CROWD, BLOCK = 3, 4.0, 4096
#: Cells of all trees up to which their numbers of blocks may be sent to all tasks.
CELLS = 1 << 14
SEED = 17


@lru_cache(4)
def _planes(dim: int) -> np.ndarray:
    return np.random.default_rng(SEED + dim).standard_normal((TREES * BITS, dim + 1))


def codes(x: np.ndarray, length: float, query: bool) -> np.ndarray:
    """Strings of the rows of x as integers, rows by trees."""
    rest = np.zeros(len(x)) if query else np.sqrt(np.maximum(0, length ** 2 - (x * x).sum(1)))
    sides = np.column_stack([x, rest]) @ _planes(x.shape[1]).T > 0
    return sides.reshape(len(x), TREES, BITS) @ (1 << np.arange(BITS - 1, -1, -1, dtype=np.int64))


def _coded(df: DataFrame, dim: int, length: float, query: bool) -> DataFrame:
    """vec_id, vector (binary doubles), codes (array by tree) of the rows of ``dim`` components."""
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x = b.column(1).flatten().to_numpy().reshape(-1, dim)
            for i in range(0, len(x), 1000):
                c = codes(x[i:i + 1000], length, query)
                offsets = pa.array(np.arange(len(c) + 1) * TREES, pa.int32())
                yield pa.RecordBatch.from_arrays(
                    [b.column(0)[i:i + 1000], pa.array([v.tobytes() for v in x[i:i + 1000]], pa.binary()),
                     pa.ListArray.from_arrays(offsets, pa.array(c.ravel(), pa.int64()))], ["vec_id", "vector", "codes"])

    return df.select("vec_id", "embedding").mapInArrow(run, "vec_id long, vector binary, codes array<long>")


def _prefix(code: str, level: Column) -> Column:
    return F.call_function("shiftright", F.col(code), (F.lit(BITS) - level).cast("int"))


def _best(scores: np.ndarray, ids: np.ndarray, k: int, distinct: bool = True) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids; of an id that is not ``distinct`` the largest alone."""
    if not distinct:
        order = np.lexsort([ids, -scores])
        return order[np.sort(np.unique(ids[order], return_index=True)[1])[:k]]
    if len(scores) > 4 * k:
        at = np.flatnonzero(scores >= np.partition(scores, len(scores) - k)[len(scores) - k])
    else:
        at = np.arange(len(scores))
    return at[np.lexsort([ids[at], -scores[at]])[:k]]


def _score(k: int):
    """Scores each query of a group against the rows that share its prefix, a range of the rows sorted by code."""
    def run(data: pa.Table, queries: pa.Table) -> pa.Table:
        out: list[list[np.ndarray]] = [[], [], []]
        if len(data) and len(queries):
            data = data.sort_by([("code", "ascending"), ("vec_id", "ascending")])
            code, ids = data["code"].to_numpy(), data["vec_id"].to_numpy()
            distinct = len(np.unique(ids)) == len(ids)
            x = np.array([np.frombuffer(v, np.float64) for v in data["vector"].to_pylist()])
            for q, vector, own, level in zip(*[queries[c].to_pylist() for c in ("query_id", "vector", "code", "level")], strict=True):
                low = own >> (BITS - level) << (BITS - level)
                a, b = np.searchsorted(code, [low, low + (1 << (BITS - level))])
                # one product a row, whatever rows stand beside it: the same bits in every tree
                s = np.einsum("ij,j->i", x[a:b], np.frombuffer(vector, np.float64))
                near = _best(np.where(ids[a:b] == q, -np.inf, s), ids[a:b], k, distinct)
                near = near[ids[a:b][near] != q]
                for col, v in zip(out, (np.full(len(near), q), ids[a:b][near], s[near]), strict=True):
                    col.append(v)
        kinds = (np.int64, np.int64, np.float64)
        cols = [np.concatenate([np.zeros(0, t), *c]).astype(t) for c, t in zip(out, kinds, strict=True)]
        return pa.table(dict(zip(("query_id", "vec_id", "score"), cols, strict=True)))

    return run


def _search(data: DataFrame, queries: DataFrame, k: int) -> DataFrame:
    """Best rows of each group (tree, cell, block) for each query that names it."""
    keys = ["tree", "cell", "block"]
    return data.groupBy(*keys).cogroup(queries.groupBy(*keys)).applyInArrow(_score(k), "query_id long, vec_id long, score double")


def _merge(found: DataFrame, k: int) -> DataFrame:
    once = found.groupBy("query_id", "vec_id").agg(F.max("score").alias("score"))
    return top_k(once, ["query_id"], [F.desc("score"), F.col("vec_id")], k, "rank")


def _levels(rows: DataFrame, queries: DataFrame, length: float, dim: int, k: int) -> int:
    """The deepest level at which the sample's true neighbours, all trees together, share a prefix with their query."""
    sample = queries.orderBy(F.xxhash64("vec_id", F.lit(SEED)), "vec_id").limit(SAMPLE).toArrow()
    if not len(sample):
        return 0
    q, own = sample["embedding"].combine_chunks().flatten().to_numpy().reshape(-1, dim), sample["vec_id"].to_numpy()
    mine = codes(q, length, True)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            x, ids = b.column(1).flatten().to_numpy().reshape(-1, dim), b.column(0).to_numpy()
            scores, other = q @ x.T, codes(x, length, False)
            scores[own[:, None] == ids[None, :]] = -np.inf
            out: list[list] = [[], [], []]
            for i in range(len(q)):
                near = _best(scores[i], ids, k)
                same = np.bitwise_xor(other[near], mine[i]).min(1)
                depth = BITS - np.ceil(np.log2(same + 1)).astype(np.int64)
                for col, v in zip(out, (np.full(len(near), i), scores[i][near], depth), strict=True):
                    col.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(c)) for c in out], ["q", "score", "depth"])

    found = rows.select("vec_id", "embedding").mapInArrow(run, "q long, score double, depth long").where(F.col("score") > float("-inf"))
    depth = np.sort(np.array([r["depth"] for r in top_k(found, ["q"], [F.desc("score"), F.desc("depth")], k).select("depth").collect()]))
    return int(depth[int((1 - RECALL) * len(depth))]) if len(depth) else 0


def nearest(vectors: DataFrame, is_query: Column, k: int = 20, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """query_id, rank, vec_id, score: for each row where ``is_query`` holds its k nearest other rows by inner product.

    Vectors that are null, zero or partly null or non-finite, null ids, and vectors of another length than the most
    common one take no part.  Of rows that repeat an id, each is a candidate, and a result lists an id once, by its
    nearest row; a query whose id repeats has the nearest of all its rows.  With fewer than k other ids all are returned; an empty table gives an empty result."""
    spark = vectors.sparkSession
    bounded_batches(spark)
    src = vectors.select(F.col(f"`{id_col}`").cast("long").alias("vec_id"), F.col(f"`{vector_col}`").cast("array<double>").alias("embedding"),
                         F.coalesce(is_query, F.lit(False)).alias("is_query"))
    good = src.where(usable() & F.col("vec_id").isNotNull())
    shape = good.groupBy(F.size("embedding").alias("dim")).agg(
        F.count(F.lit(1)).alias("n"), F.max(F.aggregate("embedding", F.lit(0.0), lambda a, x: a + x * x)).alias("l")).orderBy(F.desc("n"), "dim").first()
    if shape is None:
        return src.select(F.col("vec_id").alias("query_id"), F.lit(0).alias("rank"), "vec_id", F.lit(0.0).alias("score")).limit(0)
    dim, length = shape["dim"], shape["l"] ** 0.5
    good = good.where(F.size("embedding") == dim)
    # of copies of one vector only the k + 1 smallest ids can be among a query's nearest
    keyed = good.withColumns({"k1": F.xxhash64("embedding"), "k2": F.xxhash64(F.lit(1), "embedding")}).dropDuplicates(["k1", "k2", "vec_id"])
    rows = cut(top_k(keyed, ["k1", "k2"], ["vec_id"], k + 1), "vectors")
    n, others = rows.agg(F.count(F.lit(1)), F.count_distinct("vec_id")).first()
    level = _levels(rows, good.where("is_query"), length, dim, k)
    data = _coded(rows, dim, length, False)
    queries = _coded(good.where("is_query"), dim, length, True).withColumnRenamed("vec_id", "query_id")
    spread = lambda df: df.select("*", F.posexplode("codes").alias("tree", "code")).drop("codes")
    data, queries = cut(spread(data).withColumn("cell", _prefix("code", F.lit(level))), "forest"), cut(spread(queries), "queries")
    # ascend in all trees at once: the deepest level that holds enough, else the fitted one
    stops = list(range(level, BITS + 1, STRIDE))
    enough = CROWD * TREES * n / 2 ** level
    deepest = data.groupBy("tree", _prefix("code", F.lit(stops[-1])).alias("at")).agg(F.count(F.lit(1)).alias("n"))
    crowd = cut(deepest.withColumn("level", F.lit(stops[-1])), "crowd")
    counts = crowd
    for stop, above in zip(stops[-2::-1], stops[:0:-1], strict=True):
        up = F.call_function("shiftright", F.col("at"), F.lit(above - stop))
        crowd = crowd.groupBy("tree", up.alias("at")).agg(F.sum("n").alias("n")).withColumn("level", F.lit(stop))
        counts = counts.unionByName(crowd)
    at = queries.select("query_id", "tree", "code", F.explode(F.array(*map(F.lit, stops))).alias("level"))
    at = at.withColumn("at", _prefix("code", F.col("level"))).join(counts.hint("merge"), ["tree", "level", "at"])
    stop = at.groupBy("query_id", "level").agg(F.sum("n").alias("n")).groupBy("query_id").agg(
        F.max(F.when((F.col("n") >= enough) | (F.col("level") == level), F.col("level"))).alias("level"))
    queries = queries.join(stop.hint("merge"), "query_id").withColumn("cell", _prefix("code", F.lit(level)))
    blocks = cut(data.groupBy("tree", "cell").agg(F.ceil(F.count(F.lit(1)) / F.lit(BLOCK)).cast("int").alias("blocks")), "blocks")
    blocks = blocks if blocks.count() <= CELLS else blocks.hint("merge")
    data = data.join(blocks, ["tree", "cell"]).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.col("blocks")).cast("int"))
    visits = queries.join(blocks, ["tree", "cell"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    found = cut(_merge(_search(data.drop("blocks"), visits.drop("blocks"), k), k), "found")
    # queries with too few candidates: all rows, in blocks
    full = good.where("is_query").select(F.col("vec_id").alias("query_id")).distinct()
    short = cut(full.join(found.groupBy("query_id").agg(F.count(F.lit(1)).alias("n")).hint("merge"), "query_id", "left").where(
        F.coalesce("n", F.lit(0)) < min(k, others - 1)).select("query_id"), "short")
    if short.limit(1).count():
        split = max(1, n // BLOCK)
        one = data.where("tree = 0").withColumn("cell", F.lit(0).cast("long")).withColumn("block", F.pmod(F.xxhash64("vec_id"), F.lit(split)).cast("int"))
        short = short.hint("merge")
        ask = queries.where("tree = 0").join(short, "query_id").withColumn("cell", F.lit(0).cast("long")).withColumn("level", F.lit(0)).withColumn(
            "block", F.explode(F.sequence(F.lit(0), F.lit(split - 1))))
        found = found.join(short, "query_id", "left_anti").unionByName(_merge(_search(one.drop("blocks"), ask, k), k))
    return found.select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
