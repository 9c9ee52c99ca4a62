"""Repeated and missing ids, clashing names, many labels."""

import numpy as np
from pyspark.sql import functions as F

from kinetable.llm import op1_near_vectors as op1, op4_packing as op4, op5_prefix_forest as op5, op7_language as op7


def vectors(spark, rows):
    return spark.createDataFrame([(i, None if v is None else [float(x) for x in v]) for i, v in rows], "vec_id long, embedding array<double>")


def some_rows():
    rng = np.random.default_rng(2)
    base = rng.normal(size=(60, 8))
    rows = [(i, v) for i, v in enumerate(base)]
    rows += [(100 + i, base[i % 6] + 0.01 * rng.normal(size=8)) for i in range(25)]
    rows += [(1, base[1])] * 12 + [(1, base[1] + 0.01 * rng.normal(size=8)) for _ in range(13)]  # equal and other vectors
    return [*rows, (5, base[20]), (5, -base[20]), (30, base[20]), (None, base[3]), (7, None), (7, np.zeros(8))]


def test_links_of_repeated_ids(spark):
    rows = some_rows()
    got = sorted((r["vec_id"] is None, r["vec_id"] or 0, r["n_links"], r["component_id"]) for r in op1.near_vectors(vectors(spark, rows)).collect())
    good = [(i, np.asarray(v) / np.linalg.norm(v)) if i is not None and v is not None and np.any(v) else None for i, v in rows]
    linked = [[j for j, b in enumerate(good) if b and a and j != i and a[1] @ b[1] >= 0.9] for i, a in enumerate(good)]
    label = {i: i for i, _ in rows if i is not None}
    for _ in rows:
        for i, others in enumerate(linked):
            for j in others:
                label[rows[i][0]] = label[rows[j][0]] = min(label[rows[i][0]], label[rows[j][0]])
    assert got == sorted((i is None, i or 0, len(o), label.get(i)) for (i, _), o in zip(rows, linked, strict=True))


def test_neighbours_of_repeated_ids(spark):
    rows, hits = [(i, v) for i, v in some_rows() if v is not None and np.any(v)], []
    for rows in (rows, [(1, rows[0][1])] * 25 + [(2, rows[0][1])] + rows[:60]):
        got = {}
        for r in op5.nearest(vectors(spark, rows), F.col("vec_id") % 20 == 0, 20).collect():
            got.setdefault(r["query_id"], []).append((r["rank"], r["vec_id"], r["score"]))
        for q in {i for i, _ in rows if i is not None and i % 20 == 0}:
            best = {}
            for i, v in rows:
                if i is not None and i != q:
                    best[i] = max([best.get(i, -np.inf), *[float(np.dot(v, w)) for j, w in rows if j == q]])
            want = sorted(best.items(), key=lambda x: (-x[1], x[0]))[:20]
            mine = sorted(got[q])
            assert [r for r, _, _ in mine] == list(range(1, len(want) + 1))
            assert len({i for _, i, _ in mine}) == len(want) and all(s <= best[i] + 1e-9 for _, i, s in mine)
            hits.append(len({i for _, i, _ in mine} & {i for i, _ in want}) / len(want))
    assert np.mean(hits) >= 0.9


def test_pieces_without_ids_fill_all_buckets(spark):
    pieces = spark.range(4000).select(F.lit(None).cast("long").alias("doc_id"), F.lit(0).cast("long").alias("start"), F.lit(100).cast("long").alias("length"),
                                      *[F.col("id").alias(c) for c in ("_rank", "_k", "_bucket", "_n", "_row", "_full", "_salt", "c1", "_all")])
    out = op4.pack(pieces, bucket_rows=200)
    assert out.columns == [*pieces.columns, "sequence_id", "offset"] and out.select("_rank").distinct().count() == 4000
    assert out.groupBy("sequence_id").count().where("count > 20").count() == 0 and out.select("sequence_id", "offset").distinct().count() == 4000


def test_many_labels_are_learned(docs):
    letters = "abcdefghijklmnopqrstuvwxyz"
    rows = [(n * 10 + i, " ".join([letters[n % 26] * 3 + letters[n // 26] * 3] * 5), f"l{n}") for n in range(70) for i in range(4)]
    model = op7.train(docs(rows), F.lit(True))
    assert len(model.labels) == 70
    got = op7.predict(docs(rows), model).join(docs(rows).select("doc_id", "lang"), "doc_id")
    assert got.where("lang_pred = lang").count() > 250
