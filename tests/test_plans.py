"""Positions, sums, neighbours and tiles that are computed in bounded pieces."""

import numpy as np
from pyspark.sql import functions as F

from kinetable.plans.ranking import position_by_id, position_in_order, running_sum_by_id, with_previous
from kinetable.plans.tiles import tile_join


def test_position_by_id(spark):
    rng = np.random.default_rng(0)
    ids = rng.permutation(500)
    rows = [("hot" if i % 3 else f"k{i % 5}", int(i)) for i in ids]
    df = position_by_id(spark.createDataFrame(rows, "g string, id long"), ["g"], ["id"], "pos", width=32)
    for g in {r[0] for r in rows}:
        got = [r.pos for r in sorted((r for r in df.collect() if r.g == g), key=lambda r: r.id)]
        assert got == list(range(len(got)))


def test_position_in_order(spark):
    names = [(g, f"n{i:03d}") for g in ("a", "b") for i in range(200)]
    df = position_in_order(spark.createDataFrame(names, "g string, name string").repartition(5), ["g"], ["name"], "pos")
    assert {(r.g, r.name, r.pos) for r in df.collect()} == {(g, n, int(n[1:])) for g, n in names}


def test_running_sum(spark):
    rows = [("a", i, float(i % 7)) for i in range(300)]
    df = running_sum_by_id(spark.createDataFrame(rows, "g string, id long, v double"), ["g"], "id", "v", "s", width=16)
    want = np.cumsum([r[2] for r in rows])
    assert [r.s for r in df.orderBy("id").collect()] == list(want)


def test_with_previous_crosses_runs(spark):
    rows = [("a", i, float(i * i)) for i in range(50)]
    df = with_previous(spark.createDataFrame(rows, "g string, f long, v double"), ["g"], "f", {1: {"v": "v1"}, 2: {"v": "v2"}}, width=8)
    got = df.orderBy("f").collect()
    assert len(got) == 50
    assert [r.v1 for r in got] == [None] + [float(i * i) for i in range(49)]
    assert [r.v2 for r in got] == [None, None] + [float(i * i) for i in range(48)]


def test_tile_join_is_complete(spark):
    left = spark.range(37).select(F.lit("a").alias("seq_id"), F.col("id").alias("v"))
    right = spark.range(23).select(F.lit("a").alias("seq_id"), F.col("id").alias("f"))
    got = {(r.v, r.f) for r in tile_join(left, right, "v", "f", left_width=8, right_width=4).collect()}
    assert got == {(v, f) for v in range(37) for f in range(23)}
