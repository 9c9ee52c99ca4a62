"""Near vectors, neighbours, Jaccard join, components, sharding: against brute force."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from kinetable.llm import op1_near_vectors, op3_sharding, op5_prefix_forest, op9_jaccard
from kinetable.llm.components import components

from .conftest import sentence

SCHEMA = "vec_id long, embedding array<float>, label int"


def roots(nodes, edges):
    up = {n: n for n in nodes}

    def find(x):
        while up[x] != x:
            x = up[x]
        return x

    for a, b in edges:
        a, b = sorted((find(a), find(b)))
        up[b] = a
    return {n: find(n) for n in nodes}


@pytest.fixture(scope="module")
def cloud():
    rng = np.random.default_rng(4)
    x = rng.standard_normal((400, 24)).astype(np.float32)
    for i in range(0, 120, 3):
        x[i + 1] = x[i] + 0.15 * rng.standard_normal(24)
    x[200:230] = x[200] + 0.05 * rng.standard_normal((30, 24)).astype(np.float32)
    x[300:310] = x[300]
    x[310] = 3 * x[300]
    return x


@pytest.fixture(scope="module")
def vectors(spark, cloud):
    rows = [(i, v.tolist(), None) for i, v in enumerate(cloud)]
    bad = [None, [], [0.0] * 24, [float("nan")] * 24, [float("inf")] + [1.0] * 23, [None] + [1.0] * 23, [1.0, 2.0]]
    rows += [(1000 + i, v, None) for i, v in enumerate(bad)]
    return spark.createDataFrame(rows, SCHEMA).withColumn("list", F.lit(1)).withColumn("block", F.lit("x"))


def test_components(spark):
    r = random.Random(2)
    edges = [(i, i + 1) for i in range(100, 160)] + [(5, i) for i in range(200, 260)] + [(r.randrange(1000, 1200), r.randrange(1000, 1200)) for _ in range(90)]
    want = roots({x for e in edges for x in e}, edges)
    loose = {a for a, b in edges if a == b} - {x for a, b in edges if a != b for x in (a, b)}
    got = components(spark.createDataFrame(edges + edges[:5] + [(7, 7)], "src long, dst long"))
    assert {r["node"]: r["component"] for r in got.collect()} == {k: v for k, v in want.items() if k not in loose}
    assert components(spark.createDataFrame([], "src long, dst long")).count() == 0


def test_calibration():
    tail, width = op1_near_vectors.calibrate(2048)
    rng = np.random.default_rng(1)
    c, n, passed = op1_near_vectors.THRESHOLD, 2048, 0
    for _ in range(300):
        a = rng.standard_normal(n)
        b = c * a + np.sqrt(1 - c * c) * rng.standard_normal(n)
        met = (np.minimum(np.abs(a), np.abs(b)) > tail) & (np.abs(a - b) <= width)
        passed += met.sum() >= op1_near_vectors.LEAST
    assert passed >= 294


def test_near_vectors(vectors, cloud, monkeypatch):
    monkeypatch.setattr(op1_near_vectors, "BLOCK", 8)  # hot lists split into blocks
    got = {r["vec_id"]: r for r in op1_near_vectors.near_vectors(vectors).collect()}
    u = cloud.astype(np.float64)
    u /= np.linalg.norm(u, axis=1)[:, None]
    linked = u @ u.T >= 0.9
    np.fill_diagonal(linked, False)
    want = roots(range(400), list(zip(*np.nonzero(linked), strict=True)))
    assert {i: got[i]["n_links"] for i in range(400)} == {i: int(linked[i].sum()) for i in range(400)}
    assert {i: got[i]["component_id"] for i in range(400)} == want
    assert all(got[i]["kept"] == (want[i] == i) for i in range(400))
    assert all((got[i]["n_links"], got[i]["component_id"], got[i]["kept"]) == (0, i, True) for i in range(1000, 1007))
    assert len(got) == 407


def test_near_vectors_of_nothing(spark):
    assert op1_near_vectors.near_vectors(spark.createDataFrame([], SCHEMA)).count() == 0


def test_nearest(vectors, cloud):
    got = op5_prefix_forest.nearest(vectors, F.col("vec_id") % 20 == 0, 20).collect()
    x, hits = cloud.astype(np.float64), 0
    for q in range(0, 400, 20):
        own = sorted([r for r in got if r["query_id"] == q], key=lambda r: r["rank"])
        s = x @ x[q]
        s[q] = -np.inf
        assert [r["rank"] for r in own] == list(range(1, 21))
        assert all(abs(r["score"] - s[r["vec_id"]]) < 1e-12 for r in own)
        order = [(-r["score"], r["vec_id"]) for r in own]
        assert order == sorted(order) and len({r["vec_id"] for r in own}) == 20
        hits += len({r["vec_id"] for r in own} & set(np.lexsort([np.arange(400), -s])[:20].tolist()))
    assert hits / 400 >= 0.9
    assert {r["query_id"] for r in got} == set(range(0, 400, 20))


def test_nearest_of_few(spark):
    few = spark.createDataFrame([(0, [1.0, 0.0], 1), (20, [0.0, 2.0], 1), (21, [1.0, 1.0], 1), (22, [1.0, 1.0], 1), (40, None, 1)], SCHEMA)
    got = sorted((r["query_id"], r["rank"], r["vec_id"], r["score"]) for r in op5_prefix_forest.nearest(few, F.col("vec_id") % 20 == 0).collect())
    assert got == [(0, 1, 21, 1.0), (0, 2, 22, 1.0), (0, 3, 20, 0.0), (20, 1, 21, 2.0), (20, 2, 22, 2.0), (20, 3, 0, 0.0)]
    assert op5_prefix_forest.nearest(spark.createDataFrame([], SCHEMA), F.lit(True)).count() == 0


def test_nearest_sends_no_table_of_rows_to_the_driver(spark, vectors, monkeypatch):
    """what has a row per query, vector or prefix is joined by shuffles, however small its files are."""
    plans = []

    def cut(df, *a, **k):
        plans.append(df._jdf.queryExecution().executedPlan().toString())
        return real(df, *a, **k)

    real = op5_prefix_forest.cut
    monkeypatch.setattr(op5_prefix_forest, "cut", cut)
    monkeypatch.setattr(op5_prefix_forest, "CELLS", 0, raising=False)
    got = op5_prefix_forest.nearest(vectors, F.col("vec_id") % 20 == 0, 20)
    assert sum("SortMergeJoin" in p for p in plans) and not any("Broadcast" in p for p in plans)
    few = spark.createDataFrame([(i, [float(i), 1.0], 1) for i in range(0, 100, 20)], SCHEMA)
    short = op5_prefix_forest.nearest(few, F.col("vec_id") % 20 == 0, 20)
    assert len(short.collect()) == 20 and not any("Broadcast" in d._jdf.queryExecution().executedPlan().toString() for d in (got, short))


def edited(seed, base, n):
    r = random.Random(seed)
    words = base.split()
    for _ in range(n):
        words[r.randrange(len(words))] = f"new{r.randrange(10 ** 6)}"
    return " ".join(words)


def test_jaccard(docs, odd):
    base, common = sentence(50, 300), sentence(51, 60)
    rows = odd + [(100 + i, edited(i, base, i % 9)) for i in range(60)]
    rows += [(300 + i, sentence(400 + i, 40) + " " + common) for i in range(60)]
    rows += [(500 + i, sentence(500 + i // 2, 8)) for i in range(40)] + [(600, base.upper()), (601, "One Two"), (602, "one  two"), (603, "one two three")]

    def sets(t):
        w = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or "").encode().split()
        return {tuple(w[i:i + 5]) for i in range(len(w) - 4)} or ({tuple(w)} if w else set())

    known = [(i, sets(t)) for i, t in rows if i is not None]
    edges = [(i, j) for k, (i, a) in enumerate(known) for j, b in known[:k] if a and b and 100 * len(a & b) >= 80 * len(a | b)]
    want = roots({i for i, _ in known}, edges)
    got = op9_jaccard.join(docs(rows)).collect()
    assert len(got) == len(rows)
    assert all(r["component_id"] == (None if r["doc_id"] is None else want[r["doc_id"]]) for r in got)
    assert sorted((r["doc_id"], r["n_shingles"]) for r in got if r["doc_id"] is not None) == sorted((i, len(s)) for i, s in known)
    assert op9_jaccard.join(docs([])).count() == 0


def test_jaccard_lists_of_equal_documents(docs):
    base = sentence(70, 300)
    pair = docs([(1, base), (2, edited(1, base, 1)), (3, sentence(71, 300))]).select("doc_id", "text")
    assert op9_jaccard.postings(pair, {}, 8)[2].count() == 2


def test_jaccard_leaders_until_settled(docs, monkeypatch):
    """Copies of copies: leaders of several rounds link them, so that few pairs are left for the comparison of all."""
    texts = [sentence(72, 120)]
    for i in range(1, 300):
        texts.append(edited(i, texts[random.Random(i).randrange(max(0, i - 12), i)], 1))
    passed = []
    whole = op9_jaccard.candidates

    def counted(*args, **kwargs):
        found = op9_jaccard.cut(whole(*args, **kwargs), "counted")
        passed.append((kwargs["every"], found.count()))
        return found

    monkeypatch.setattr(op9_jaccard, "candidates", counted)
    rows = list(enumerate(texts))
    got = {r["doc_id"]: r["component_id"] for r in op9_jaccard.join(docs(rows)).collect()}
    sets = [{tuple(w[j:j + 5]) for j in range(len(w) - 4)} for w in (t.split() for t in texts)]
    edges = [(i, j) for i in range(300) for j in range(i) if 100 * len(sets[i] & sets[j]) >= 80 * len(sets[i] | sets[j])]
    assert got == roots(range(300), edges)
    assert [e for e, _ in passed].count(False) > 1 and passed[-1][0]
    assert passed[-1][1] < 300


def test_shards(docs, odd):
    rows = odd + [(100 + i, sentence(i, i % 200)) for i in range(400)] + [(9999, "same row " * 30)] * 50
    limit = 4000
    got = op3_sharding.shards(docs(rows), limit).collect()
    assert len(got) == len(rows)
    shards = {}
    for r in got:
        shards.setdefault((r["shard"], r["part"]), []).append(r)
    names = sorted({s for s, _ in shards})
    assert not any(b.startswith(a) for a, b in zip(names, names[1:], strict=False))
    for (shard, _), own in shards.items():
        assert len(shard) == own[0]["depth"]
        assert sum(r["n_bytes"] for r in own) == own[0]["shard_bytes"] and len(own) == own[0]["shard_docs"]
        assert own[0]["shard_bytes"] <= limit or len(own) == 1
    for parent in {s[:-1] for s in names if s and len(s) < 60}:
        assert sum(r["n_bytes"] for r in got if r["shard"].startswith(parent)) > limit
    assert op3_sharding.shards(docs([]), limit).count() == 0


def test_components_of_stars_and_paths_take_few_rounds(spark, monkeypatch):
    import importlib
    module = importlib.import_module("kinetable.llm.components")
    labels, real = [], module.cut
    monkeypatch.setattr(module, "cut", lambda df, label="state", by=None: labels.append(label) or real(df, label, by))
    edges = [(1000 * g + 500, 1000 * g + i) for g in range(4) for i in range(300)] + [(9000 + i, 9001 + i) for i in range(400)]
    got = {r.node: r.component for r in module.components(spark.createDataFrame(edges, "src long, dst long").repartition(4)).collect()}
    assert got == {n: 9000 if n >= 9000 else n // 1000 * 1000 for e in edges for n in e}
    assert labels.count("pointers") <= 6
