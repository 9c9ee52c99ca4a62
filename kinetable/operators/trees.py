"""Affinity graphs and skeleton trees.

Tables: ``affinity(graph_id, n, src, dst, w)``, ``edges(graph_id, src, dst)`` with both directions,
``bones(skeleton_id, k, parent)``.  A graph has as many nodes as a skeleton has joints (tens), so K * K rows per
graph are bounded; the number of graphs is not.  Graphs of at most ``SMALL`` nodes are walked in a task each; if there is a
larger one, every loop step advances all graphs in one job, by joins that send no table to the driver.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window, functions as F, types as T

from ..functions.rotation import matmul3, matvec3
from ..functions.space import hash_unit, softplus
from ..plans.lineage import cut
from ..plans.ranking import top_k
from ..schema import FRAME
from .tracks import influence

FAR = 1e4      # distance of unreachable nodes
TIE = 1e-5     # extra length that separates equally central nodes
G = "graph_id"
SMALL = 128    # nodes of a graph that is walked in one task


# ---- affinity parameters to weights
def _row(c="_e"):
    return F.sum(c).over(Window.partitionBy(G, "n", "src"))


def _softmax(df: DataFrame, value: str) -> DataFrame:
    top = F.max(value).over(Window.partitionBy(G, "n", "src"))
    e = df.withColumn("_e", F.exp(F.col(value) - top))
    return e.withColumn("w", F.col("_e") / _row()).drop("_e", value)


def softmax_affinity(params: DataFrame, ver: int = 0, nodes: int | None = None, seed: int = 0) -> DataFrame:
    """Parameters ``params(graph_id, n, src, dst, p)`` to row weights w.

    0: row softmax.  1: softplus, times its own transpose, diagonal removed, row normalised (+ 1e-6).
    2: softplus, diagonal set to 0, row softmax (the diagonal keeps the mass of e^0).
    3: ``dst`` runs over K - 1 columns; row softmax, then a zero diagonal is inserted, which shifts the columns at
    and right of it by one.  4: as 3 on p - log(-log u) with u drawn from a hash.
    """
    if ver == 0:
        return _softmax(params, "p")
    if ver == 1:
        s = params.select(G, "n", "src", "dst", softplus(F.col("p")).alias("s"))
        other = s.select(G, "n", F.col("src").alias("row2"), "dst", F.col("s").alias("s2"))
        prod = s.join(other, [G, "n", "dst"]).where(F.col("src") != F.col("row2")).groupBy(
            G, "n", "src", F.col("row2").alias("dst")).agg(F.sum(F.col("s") * F.col("s2")).alias("_e"))
        return prod.withColumn("w", F.col("_e") / (_row() + F.lit(1e-6))).drop("_e")
    if ver == 2:
        s = params.withColumn("p", F.when(F.col("src") == F.col("dst"), 0.0).otherwise(softplus(F.col("p"))))
        return _softmax(s, "p")
    if ver in (3, 4):
        p = params
        if ver == 4:
            u = F.greatest(hash_unit(F.col(G), F.col("n"), F.col("src"), F.col("dst"), F.lit(seed)), F.lit(1e-12))
            p = p.withColumn("p", F.col("p") - F.log(-F.log(u)))
        w = _softmax(p, "p").withColumn("dst", F.col("dst") + (F.col("dst") >= F.col("src")).cast("long"))
        diagonal = w.select(G, "n", "src").distinct().select(G, "n", "src", F.col("src").alias("dst"), F.lit(0.0).alias("w"))
        return w.select(G, "n", "src", "dst", "w").unionByName(diagonal)
    raise ValueError(ver)


def binary_adjacency(affinity: DataFrame, neighbors: int) -> DataFrame:
    """Each node with its ``neighbors`` most influential nodes, both directions present once."""
    best = top_k(influence(affinity), [G, "src"], [F.desc("infl"), "dst"], neighbors).select(G, "src", "dst")
    return best.unionByName(best.select(G, F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct()


def parent_adjacency(bones: DataFrame, key: str = "skeleton_id") -> DataFrame:
    """Symmetric 0/1 adjacency of a parent table."""
    e = bone_edges(bones)
    return e.select(key, F.col("k").alias("src"), F.col("parent").alias("dst")).unionByName(
        e.select(key, F.col("parent").alias("src"), F.col("k").alias("dst"))).distinct()


def bone_edges(bones: DataFrame) -> DataFrame:
    """Child - parent edges without roots and self links."""
    return bones.where((F.col("parent") >= 0) & (F.col("parent") != F.col("k")))


# ---- distances
def _largest(nodes: DataFrame) -> int:
    """Nodes of the largest graph."""
    return nodes.groupBy(G).count().agg(F.max("count")).first()[0] or 0


def _lengths(nodes: pa.Table, edges: pa.Table) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Ids of a graph's nodes, which of them are in ``nodes``, and the shortest edge from each to each (infinite without one)."""
    k, src, dst = nodes["k"].to_numpy(), edges["mid"].to_numpy(), edges["dst"].to_numpy()
    ids = np.unique(np.concatenate([k, src, dst]).astype(np.int64))
    length = np.full((len(ids), len(ids)), np.inf)
    np.minimum.at(length, (np.searchsorted(ids, src), np.searchsorted(ids, dst)), edges["len"].to_numpy())
    return ids, np.searchsorted(ids, np.unique(k)), length


def _walked(length: np.ndarray) -> np.ndarray:
    """Length of the shortest path from each node to each, summed edge by edge from its start."""
    d = np.full(length.shape, np.inf)
    np.fill_diagonal(d, 0.0)
    while True:
        grown = d.copy()
        for mid in range(len(d)):
            np.minimum(grown, d[:, mid, None] + length[None, mid], out=grown)
        if (grown == d).all():
            return d
        d = grown


def _of_graph(nodes: pa.Table, n: int) -> pa.Array:
    graph = nodes.column(G)
    return pa.repeat(graph[0], n) if n else graph.slice(0, 0)


def shortest_paths(nodes: DataFrame, edges: DataFrame, weight: str | None = None) -> DataFrame:
    """All-pairs path length (hops, or the sum of ``weight``); reachable pairs only.

    Small graphs are walked in tasks.  Otherwise each round joins the pairs that improved with the edges, so the work shrinks
    as paths settle; it ends when no pair improves.
    """
    w = F.col(weight) if weight else F.lit(1.0)
    nodes = cut(nodes.select(G, "k").distinct(), "paths-nodes")
    e = cut(edges.select(G, F.col("src").alias("mid"), "dst", w.cast("double").alias("len")), "paths-edges")
    if _largest(nodes) <= SMALL:
        schema = T.StructType([nodes.schema[G], *[T.StructField(c, T.LongType()) for c in ("src", "dst")], T.StructField("d", T.DoubleType())])

        def walk(nodes: pa.Table, edges: pa.Table) -> pa.Table:
            ids, own, length = _lengths(nodes, edges)
            d = _walked(length)[own]
            src, dst = np.nonzero(np.isfinite(d))
            return pa.table({G: _of_graph(nodes, len(src)), "src": ids[own][src], "dst": ids[dst], "d": d[src, dst]})

        return nodes.groupBy(G).cogroup(e.groupBy(G)).applyInArrow(walk, schema)
    dist = cut(nodes.select(G, F.col("k").alias("src"), F.col("k").alias("dst"), F.lit(0.0).alias("d")), "paths")
    fresh = dist
    while True:
        grown = fresh.withColumnRenamed("dst", "mid").join(e.hint("merge"), [G, "mid"]).groupBy(G, "src", "dst").agg(
            F.min(F.col("d") + F.col("len")).alias("nd"))
        both = dist.join(grown, [G, "src", "dst"], "full_outer")
        better = F.col("nd").isNotNull() & (F.col("d").isNull() | (F.col("nd") < F.col("d")))
        state = cut(both.select(G, "src", "dst", F.least("d", "nd").alias("d"), better.alias("better")), "paths")
        dist, fresh = state.drop("better"), state.where("better").drop("better")
        if fresh.isEmpty():
            return dist


def dense_paths(nodes: DataFrame, paths: DataFrame) -> DataFrame:
    """Every node pair; unreachable pairs get the distance 1e4."""
    pairs = nodes.select(G, F.col("k").alias("src")).join(nodes.select(G, F.col("k").alias("dst")), G)
    return pairs.join(paths, [G, "src", "dst"], "left").withColumn("d", F.coalesce("d", F.lit(FAR)))


def all_pairs_hops(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    return dense_paths(nodes, shortest_paths(nodes, edges))


def centrality(dense: DataFrame) -> DataFrame:
    return dense.groupBy(G, F.col("src").alias("k")).agg(F.sum("d").alias("total"))


def most_central(dense: DataFrame) -> DataFrame:
    """Node with the smallest distance sum per graph; the lowest id wins a tie."""
    return centrality(dense).groupBy(G).agg(F.min_by("k", F.struct("total", "k")).alias("root"))


def connect_components(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Edges that make every graph connected, and the dense hop table of the result.

    While some node cannot be reached from the most central one, the most central unreachable node is linked to
    it.  Small graphs are mended in a task each.  Otherwise each round mends one component of every unconnected graph; only
    those graphs are walked again.
    """
    nodes = cut(nodes.select(G, "k").distinct(), "connect-nodes")
    if _largest(nodes) <= SMALL:
        return _connect_small(nodes, edges)
    paths = cut(all_pairs_hops(nodes, edges), "connect")
    while True:
        root = most_central(paths)
        cut_off = paths.join(root, G).where((F.col("src") == F.col("root")) & (F.col("d") >= FAR)).select(
            G, "root", F.col("dst").alias("k"))
        link = cut_off.join(centrality(paths), [G, "k"]).groupBy(G, "root").agg(F.min_by("k", F.struct("total", "k")).alias("k"))
        link = cut(link, "connect-link")
        if link.isEmpty():
            return edges, paths
        new = link.select(G, F.col("root").alias("src"), F.col("k").alias("dst")).unionByName(
            link.select(G, F.col("k").alias("src"), F.col("root").alias("dst")))
        edges = cut(edges.unionByName(new).distinct(), "connect-edges")
        open_ = link.select(G)
        again = all_pairs_hops(nodes.join(open_, G, "left_semi"), edges.join(open_, G, "left_semi"))
        paths = cut(paths.join(open_, G, "left_anti").unionByName(again), "connect")


def _connect_small(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Links have no distance; the other rows are the dense hop table."""
    edges = cut(edges.select(G, "src", "dst"), "connect-edges")
    ends = [T.StructField(c, T.LongType()) for c in ("src", "dst")]
    schema = T.StructType([nodes.schema[G], *ends, T.StructField("d", T.DoubleType())])

    def mend(nodes: pa.Table, edges: pa.Table) -> pa.Table:
        ids, own, length = _lengths(nodes, edges)
        links: list[tuple[int, int]] = []
        while len(own):
            d = _walked(length)[np.ix_(own, own)]
            d[np.isinf(d)] = FAR
            total = d.sum(axis=1)
            root = int(total.argmin())
            off = np.flatnonzero(d[root] >= FAR)
            if not len(off):
                break
            far = int(off[total[off].argmin()])
            for a, b in ((own[root], own[far]), (own[far], own[root])):
                length[a, b] = 1.0
                links.append((int(ids[a]), int(ids[b])))
        n = len(own)
        src, dst = np.repeat(ids[own], n), np.tile(ids[own], n)
        a, b = np.array(links, np.int64).reshape(-1, 2).T
        return pa.table({G: _of_graph(nodes, n * n + len(links)), "src": np.concatenate([src, a]), "dst": np.concatenate([dst, b]),
                         "d": pa.array([*(d.ravel().tolist() if n else []), *[None] * len(links)], pa.float64())})

    hops = edges.select(G, F.col("src").alias("mid"), "dst", F.lit(1.0).alias("len"))
    made = cut(nodes.groupBy(G).cogroup(hops.groupBy(G)).applyInArrow(mend, schema), "connect")
    return edges.unionByName(made.where("d IS NULL").drop("d")).distinct(), made.where("d IS NOT NULL")


def tie_break_weights(edges: DataFrame, dense: DataFrame, infl: DataFrame) -> DataFrame:
    """Edge lengths 1, plus 1e-5 for each pair of equally central nodes with a common neighbour n on the edge
    between n and the less influential node of the pair."""
    total = centrality(dense)
    a = total.select(G, F.col("k").alias("p"), "total")
    b = total.select(G, F.col("k").alias("q"), F.col("total").alias("total2"))
    twins = a.join(b, G).where((F.col("p") < F.col("q")) & (F.col("total") == F.col("total2")))
    near = edges.select(G, F.col("src").alias("p"), F.col("dst").alias("n")).join(twins, [G, "p"]).join(
        edges.select(G, F.col("src").alias("q"), F.col("dst").alias("n")), [G, "q", "n"])
    iv = lambda name, other: infl.select(G, F.col("src").alias("n"), F.col("dst").alias(other), F.col("infl").alias(name))
    scored = near.join(iv("ip", "p"), [G, "n", "p"], "left").join(iv("iq", "q"), [G, "n", "q"], "left")
    zero = lambda c: F.coalesce(c, F.lit(0.0))
    loser = F.when(zero("ip") > zero("iq"), F.col("q")).otherwise(F.col("p"))
    adds = scored.select(G, "n", loser.alias("l"))
    adds = adds.select(G, F.col("n").alias("src"), F.col("l").alias("dst")).unionByName(
        adds.select(G, F.col("l").alias("src"), F.col("n").alias("dst"))).groupBy(G, "src", "dst").agg(F.count(F.lit(1)).alias("_c"))
    return edges.join(adds, [G, "src", "dst"], "left").select(
        G, "src", "dst", (F.lit(1.0) + F.coalesce("_c", F.lit(0)) * TIE).alias("len"))


def root_and_parents(nodes: DataFrame, edges: DataFrame, dense: DataFrame, infl: DataFrame) -> DataFrame:
    """(graph_id, k, parent, rank): root is the most central node and its own parent.

    Rank is the distance from the root.  A node's parent is its neighbour with the largest rank still below its
    own, the more influential one on ties; a neighbour n of equal rank takes over when the lowest-ranked common
    neighbour c below both influences n more than the node (the last such n wins); without any, the root.
    """
    root = most_central(dense)
    rank = dense.join(root, G).where(F.col("src") == F.col("root")).select(
        G, F.col("dst").alias("k"), F.round("d", 9).alias("rank"), "root")
    e = edges.where(F.col("src") != F.col("dst")).select(G, F.col("src").alias("k"), F.col("dst").alias("n"))
    near = e.join(rank, [G, "k"]).join(rank.select(G, F.col("k").alias("n"), F.col("rank").alias("n_rank")), [G, "n"])
    near = near.join(infl.select(G, F.col("src").alias("k"), F.col("dst").alias("n"), "infl"), [G, "k", "n"], "left")
    below = near.where(F.col("n_rank") < F.col("rank"))
    first = top_k(below, [G, "k"], [F.desc("n_rank"), F.desc("infl"), "n"], 1).select(G, "k", F.col("n").alias("parent"))
    level = near.where(F.col("n_rank") == F.col("rank")).select(G, "k", "n", "rank")
    common = level.join(e.select(G, "k", F.col("n").alias("c")), [G, "k"]).join(
        e.select(G, F.col("k").alias("n"), F.col("n").alias("c")), [G, "n", "c"]).join(
        rank.select(G, F.col("k").alias("c"), F.col("rank").alias("c_rank")), [G, "c"]).where(F.col("c_rank") < F.col("rank"))
    lowest = common.groupBy(G, "k", "n").agg(F.min_by("c", F.struct("c_rank", "c")).alias("c"))
    on = lambda other, name: infl.select(G, F.col("src").alias("c"), F.col("dst").alias(other), F.col("infl").alias(name))
    wins = lowest.join(on("n", "in_"), [G, "c", "n"], "left").join(on("k", "ik"), [G, "c", "k"], "left").where(
        F.coalesce("in_", F.lit(0.0)) > F.coalesce("ik", F.lit(0.0))).groupBy(G, "k").agg(F.max("n").alias("over"))
    return rank.join(first, [G, "k"], "left").join(wins, [G, "k"], "left").select(
        G, "k", F.when(F.col("k") == F.col("root"), F.col("root")).otherwise(F.coalesce("over", "parent", "root")).alias("parent"), "rank")


def skeleton_from_affinity(affinity: DataFrame, neighbors: int = 2) -> DataFrame:
    """Adjacency, connection, tie break, weighted distances, root and parents: (graph_id, k, parent, rank)."""
    affinity = cut(affinity, "skeleton")
    infl = cut(influence(affinity), "skeleton-influence")
    nodes = affinity.select(G, F.col("src").alias("k")).distinct()
    edges, dense = connect_components(nodes, cut(binary_adjacency(affinity, neighbors), "skeleton-edges"))
    weighted = cut(tie_break_weights(edges, dense, infl), "skeleton-lengths")
    final = cut(dense_paths(nodes, shortest_paths(nodes, weighted, "len")), "skeleton-paths")
    return root_and_parents(nodes, edges, final, infl)


# ---- parent tables
def tree_order(bones: DataFrame) -> DataFrame:
    """(skeleton_id, k, parent, depth) from the roots down; nodes on or below a cycle never appear."""
    b = cut(bones.select("skeleton_id", "k", "parent"), "tree")
    level = b.where((F.col("parent") < 0) | (F.col("parent") == F.col("k"))).withColumn("depth", F.lit(0))
    done, depth = [], 0
    kids = bone_edges(b)
    while True:
        level = cut(level, "tree-level")
        if level.isEmpty():
            break
        done.append(level)
        depth += 1
        up = level.select("skeleton_id", F.col("k").alias("parent"))
        level = kids.join(up, ["skeleton_id", "parent"]).select("skeleton_id", "k", "parent", F.lit(depth).alias("depth"))
    out = done[0] if done else level
    for d in done[1:]:
        out = out.unionByName(d)
    return out


def on_cycle(bones: DataFrame) -> DataFrame:
    """Bones that lie on a parent cycle: (skeleton_id, k, low) with the smallest bone of the cycle.

    Pointer jumping: each round doubles the distance every bone looks ahead and carries the smallest bone seen on
    the way, so ceil(log2 K) self joins cover any cycle.  A bone is on a cycle when it is the image of some bone
    after at least K steps.
    """
    b = bones.select("skeleton_id", "k", F.when((F.col("parent") < 0) | (F.col("parent") == F.col("k")), F.lit(None))
                     .otherwise(F.col("parent")).alias("to"))
    # tables of bones are joined by shuffles: their files are small, their rows in a driver are not
    b = cut(b.withColumn("low", F.col("k")), "cycle")
    most = b.groupBy("skeleton_id").count().agg(F.max("count")).first()[0] or 1
    span = 1
    while span < most:
        nxt = b.select("skeleton_id", F.col("k").alias("to"), F.col("to").alias("to2"), F.col("low").alias("low2"))
        b = cut(b.join(nxt.hint("merge"), ["skeleton_id", "to"], "left").select(
            "skeleton_id", "k", F.col("to2").alias("to"), F.least("low", "low2").alias("low")), "cycle")
        span *= 2
    marks = b.where(F.col("to").isNotNull()).select("skeleton_id", F.col("to").alias("k")).distinct()
    return marks.join(b.select("skeleton_id", "k", "low").hint("merge"), ["skeleton_id", "k"])


def has_cycle(bones: DataFrame) -> DataFrame:
    marks = on_cycle(bones).select("skeleton_id").distinct().withColumn("has_cycle", F.lit(True))
    return bones.select("skeleton_id").distinct().join(marks.hint("merge"), "skeleton_id", "left").select(
        "skeleton_id", F.coalesce("has_cycle", F.lit(False)).alias("has_cycle"))


def sanitize_parents(bones: DataFrame) -> DataFrame:
    """Self-parents become roots, and each cycle is opened at its smallest bone."""
    cuts = on_cycle(bones).where(F.col("k") == F.col("low")).select("skeleton_id", "k").withColumn("_cut", F.lit(True))
    root = (F.col("parent") == F.col("k")) | F.coalesce("_cut", F.lit(False))
    return bones.join(cuts.hint("merge"), ["skeleton_id", "k"], "left").select(
        "skeleton_id", "k", F.when(root, -1).otherwise(F.col("parent")).cast("long").alias("parent"))


def forward_kinematics(rotations: DataFrame, tree: DataFrame, offsets: DataFrame, roots: DataFrame, inverse: bool = False) -> DataFrame:
    """Global rotation and position of every joint.

    ``rotations(seq_id, frame_id, k, r)``, ``tree(k, parent, depth)``, ``offsets(seq_id, k, ox, oy, oz)``,
    ``roots(seq_id, frame_id, x, y, z)``.  R(child) = R(parent) R_local (reversed when ``inverse``);
    position(child) = R(child) offset + position(parent).  A joint whose parent a frame lacks is left out.

    The few joints of a frame are packed by depth, and one fold from the roots down adds each to a map of those before
    it: one shuffle, however deep the tree.
    """
    local = rotations.join(tree.select("k", "parent", "depth"), "k").join(offsets, ["seq_id", "k"], "left")
    packed = local.groupBy(*FRAME).agg(F.array_sort(F.collect_list(F.struct("depth", "k", "parent", "r", "ox", "oy", "oz"))).alias("_js"))
    kind = "struct<rg:array<double>,x:double,y:double,z:double>"
    key = local.schema["k"].dataType.simpleString()

    def placed(e: Column, up: Column) -> Column:
        pair = (e["r"], up["rg"]) if inverse else (up["rg"], e["r"])

        def child(rg: Column) -> Column:
            moved = matvec3(rg, e["ox"], e["oy"], e["oz"])
            return F.struct(rg.alias("rg"), *[(v + up[c]).alias(c) for c, v in zip("xyz", moved)])

        return F.transform(F.array(matmul3(*pair)), child)[0]

    def step(done: Column, e: Column) -> Column:
        root = F.struct(e["r"].alias("rg"), F.col("x"), F.col("y"), F.col("z"))
        below = F.transform(F.array(F.try_element_at(done, e["parent"])), lambda up: F.when(up.isNotNull(), placed(e, up)))[0]
        return F.map_concat(done, F.create_map(e["k"], F.when(e["depth"] == 0, root).otherwise(below)))

    none = F.map_from_arrays(F.array().cast(f"array<{key}>"), F.array().cast(f"array<{kind}>"))
    met = packed.join(roots.select(*FRAME, "x", "y", "z"), FRAME).select(*FRAME, F.aggregate("_js", none, step).alias("_done"))
    return met.select(*FRAME, F.explode("_done").alias("k", "_j")).where("_j IS NOT NULL").select(*FRAME, "k", "_j.rg", "_j.x", "_j.y", "_j.z")


def bone_offsets(directions: DataFrame, lengths: DataFrame) -> DataFrame:
    """Unit direction of each bone (1e-10 guard) times its median length."""
    from ..functions.space import unit3
    d = directions.join(lengths, "k")
    u = unit3(F.col("dx"), F.col("dy"), F.col("dz"))
    return d.select("seq_id", "k", *[(v * F.col("median_length")).alias(f"o{c}") for c, v in zip("xyz", u)])
