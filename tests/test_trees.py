"""Skeleton extraction against a plain Python statement of the rules, and tree invariants."""

import itertools

import numpy as np

from kinetable.operators import tracks, trees

FAR, TIE = 1e4, 1e-5


def floyd(n, length):
    d = np.full((n, n), FAR)
    np.fill_diagonal(d, 0)
    for (a, b), w in length.items():
        d[a, b] = min(d[a, b], w)
    for m in range(n):
        d = np.minimum(d, d[:, m:m + 1] + d[m:m + 1])
    return np.where(d >= FAR, FAR, d)


def expected(aff, neighbors):
    infl = aff.max(0)
    n = len(infl)
    edges = set()
    for i in range(n):
        for j in sorted((j for j in range(n) if j != i), key=lambda j: (-infl[i, j], j))[:neighbors]:
            edges |= {(i, j), (j, i)}
    while True:
        d = floyd(n, dict.fromkeys(edges, 1.0))
        total = d.sum(1)
        root = min(range(n), key=lambda i: (total[i], i))
        lost = [k for k in range(n) if d[root, k] >= FAR]
        if not lost:
            break
        k = min(lost, key=lambda i: (total[i], i))
        edges |= {(root, k), (k, root)}
    length = dict.fromkeys(edges, 1.0)
    for p, q in itertools.combinations(range(n), 2):
        if total[p] == total[q]:
            for m in range(n):
                if (p, m) in edges and (q, m) in edges:
                    low = q if infl[m, p] > infl[m, q] else p
                    length[(m, low)] += TIE
                    length[(low, m)] += TIE
    d = floyd(n, length)
    total = d.sum(1)
    root = min(range(n), key=lambda i: (round(total[i], 7), i))
    rank = np.round(d[root], 9)
    parents = {}
    for k in range(n):
        if k == root:
            parents[k] = root
            continue
        near = [j for j in range(n) if (k, j) in edges]
        below = [j for j in near if rank[j] < rank[k]]
        best = max(below, key=lambda j: (rank[j], infl[k, j], -j)) if below else root
        for j in near:
            if rank[j] == rank[k]:
                both = [c for c in near if (j, c) in edges and rank[c] < rank[j]]
                if both:
                    c = min(both, key=lambda c: (rank[c], c))
                    if infl[c, j] > infl[c, k]:
                        best = j
        parents[k] = best
    return root, edges, parents


def table(spark, affs):
    rows = [(g, n, i, j, float(a[n, i, j])) for g, a in affs.items() for n in range(a.shape[0])
            for i in range(a.shape[1]) for j in range(a.shape[1]) if i != j]
    return spark.createDataFrame(rows, "graph_id long, n long, src long, dst long, w double")


def test_skeletons(spark):
    rng = np.random.default_rng(0)
    affs = {g: rng.uniform(0.01, 1, (2, 9, 9)) for g in range(4)}
    for k in (1, 2):
        aff = table(spark, affs)
        got = trees.skeleton_from_affinity(aff, k).collect()
        for g, a in affs.items():
            root, edges, parents = expected(a, k)
            mine = {r.k: r.parent for r in got if r.graph_id == g}
            assert mine == parents
            assert sum(p != c for c, p in mine.items()) == len(mine) - 1


def test_connect_adds_edges_until_whole(spark):
    rng = np.random.default_rng(1)
    affs = {g: rng.uniform(0.01, 1, (1, 12, 12)) for g in range(3)}
    aff = table(spark, affs)
    nodes = aff.selectExpr("graph_id", "src as k").distinct()
    edges, dense = trees.connect_components(nodes, trees.binary_adjacency(aff, 1))
    assert dense.where(f"d >= {FAR}").count() == 0
    for g, a in affs.items():
        assert {(r.src, r.dst) for r in edges.where(f"graph_id = {g}").collect()} == expected(a, 1)[1]


def test_cycles_are_cut_once(spark):
    bones = spark.createDataFrame([(0, 0, 0), (0, 1, 2), (0, 2, 3), (0, 3, 1), (0, 4, 3), (1, 0, -1), (1, 1, 0)],
                                  "skeleton_id long, k long, parent long")
    assert {r.skeleton_id: r.has_cycle for r in trees.has_cycle(bones).collect()} == {0: True, 1: False}
    fixed = trees.sanitize_parents(bones)
    assert {(r.skeleton_id, r.k): r.parent for r in fixed.collect()} == {
        (0, 0): -1, (0, 1): -1, (0, 2): 3, (0, 3): 1, (0, 4): 3, (1, 0): -1, (1, 1): 0}
    assert trees.tree_order(fixed).count() == 7
    assert not any(r.has_cycle for r in trees.has_cycle(fixed).collect())


def test_gumbel_rows_sum_to_one(spark):
    rows = [(0, 0, i, j, float(i - j)) for i in range(5) for j in range(4)]
    w = trees.softmax_affinity(spark.createDataFrame(rows, "graph_id long, n long, src long, dst long, p double"), 4, seed=3)
    sums = {r.src: r.s for r in w.groupBy("src").agg({"w": "sum"}).withColumnRenamed("sum(w)", "s").collect()}
    assert all(abs(s - 1) < 1e-12 for s in sums.values())
    assert w.where("src = dst and w <> 0").count() == 0 and w.count() == 25


def test_small_graphs_need_no_table_per_round(spark, monkeypatch):
    """the tables written do not depend on the rounds, none is broadcast; the same as by joins."""
    rng = np.random.default_rng(4)
    affs = {g: rng.uniform(0.01, 1, (1, 14, 14)) for g in range(3)}
    aff = table(spark, affs)
    nodes, edges = aff.selectExpr("graph_id", "src as k").distinct(), trees.binary_adjacency(aff, 1)
    labels, real = [], trees.cut
    monkeypatch.setattr(trees, "cut", lambda df, label="state", by=None: labels.append(label) or real(df, label, by))
    rows = lambda df: sorted(tuple(r) for r in df.collect())
    linked, dense = trees.connect_components(nodes, edges)
    lengths = edges.withColumn("len", edges.src * 0.1 + edges.dst)
    paths = trees.shortest_paths(nodes, lengths, "len")
    found = [rows(df) for df in (linked, dense.select("graph_id", "src", "dst", "d"), paths)]
    assert sorted(set(labels)) == sorted(labels) and len(labels) == 5
    assert "Broadcast" not in paths._jdf.queryExecution().executedPlan().toString()
    monkeypatch.setattr(trees, "SMALL", 0)
    linked, dense = trees.connect_components(nodes, edges)
    assert found == [rows(df) for df in (linked, dense.select("graph_id", "src", "dst", "d"), trees.shortest_paths(nodes, lengths, "len"))]
