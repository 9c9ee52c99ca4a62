"""Connected components by contraction: nothing but edge and label tables, all of them distributed.

Each round begins with what its tasks can do alone: up to ``CHUNK`` edges as they are read become stars around the smallest
node of each of their components, which links the same nodes.  Then every node points to its neighbour of smallest rank, if
that is below its own; pointers are followed once more, the edges are renamed by them, and what became a loop goes.  Every other round has new random ranks, so
an expected constant share of the nodes goes in it, whatever the shape of the graph; in the others, the first one among
them, the ids are the ranks, so stars around their smallest node go at once.  A star's centre is the key of a
minimum only, combined in the map tasks, and of joins whose large partitions Spark splits.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from .common import cut

#: Edges that a task makes stars of at a time.
CHUNK = 1 << 20


def _stars(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    held, rows = [], 0
    for b in batches:
        held.append(b)
        rows += b.num_rows
        if rows >= CHUNK:
            yield _star(held)
            held, rows = [], 0
    if rows:
        yield _star(held)


def _star(batches: list[pa.RecordBatch]) -> pa.RecordBatch:
    both = pa.Table.from_batches(batches)
    nodes, ends = np.unique(np.concatenate([both["src"].to_numpy(), both["dst"].to_numpy()]), return_inverse=True)
    a, b = ends.reshape(2, -1)
    root = np.arange(len(nodes))
    while True:
        x, y = root[a], root[b]
        if (x == y).all():
            break
        np.minimum.at(root, np.maximum(x, y), np.minimum(x, y))
        while (root != root[root]).any():
            root = root[root]
    leaf = np.flatnonzero(root != np.arange(len(nodes)))
    return pa.RecordBatch.from_arrays([pa.array(nodes[root[leaf]], pa.int64()), pa.array(nodes[leaf], pa.int64())], ["src", "dst"])


def components(edges: DataFrame) -> DataFrame:
    """node, component (the smallest node reachable) for every node of an edge; ``edges`` has src and dst.

    Loops and nulls count for nothing; repeated edges are one."""
    edges = cut(edges.where("src <> dst").select(F.col("src").cast("long").alias("src"), F.col("dst").cast("long").alias("dst")), "edges")
    maps: list[DataFrame] = []
    while not edges.isEmpty():
        edges = cut(edges.mapInArrow(_stars, "src long, dst long"), "stars")
        rank = lambda c: F.struct((F.xxhash64(c, F.lit(len(maps))) if len(maps) % 2 else F.lit(0)).alias("r"), F.col(c).alias("id"))
        both = edges.select("src", rank("dst").alias("to")).unionByName(
            edges.select(F.col("dst").alias("src"), rank("src").alias("to")))
        least = both.groupBy("src").agg(F.min("to").alias("to"))
        up = cut(least.select(F.col("src").alias("node"), F.least("to", rank("src"))["id"].alias("root")), "pointers")
        further = up.select(F.col("node").alias("root"), F.col("root").alias("further"))
        up = cut(up.join(further, "root").select("node", F.col("further").alias("root")), "pointers")
        maps.append(up)
        for side in ("src", "dst"):
            to = up.select(F.col("node").alias(side), F.col("root").alias("_root"))
            edges = edges.join(to, side).drop(side).withColumnRenamed("_root", side)
        edges = cut(edges.where("src <> dst").select(F.least("src", "dst").alias("src"), F.greatest("src", "dst").alias("dst")).distinct(), "edges")
    if not maps:
        return edges.select(F.col("src").alias("node"), F.col("dst").alias("component"))
    # the first map has every node; a root that lives on is a node of the next one
    out = maps[0]
    for later in maps[1:]:
        later = later.select(F.col("node").alias("root"), F.col("root").alias("_root"))
        out = out.join(later, "root", "left").select(
            "node", F.coalesce("_root", "root").alias("root"))
    out = cut(out, "roots")
    smallest = out.groupBy("root").agg(F.min("node").alias("component"))
    return out.join(smallest, "root").select("node", "component")
