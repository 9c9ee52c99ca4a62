"""Meeting every vertex with every frame of its sequence without one task per sequence."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from .lineage import sized

TASK_ROWS = 1 << 17  # result rows of a task, about: Spark counts the bytes that go in, which are far fewer


def tile_join(left: DataFrame, right: DataFrame, left_id: str, right_id: str, group: str = "seq_id",
              left_width: int = 1024, right_width: int = 64) -> DataFrame:
    """All (left, right) rows of a group, computed in tiles of left_width x right_width ids.

    The result is that large by definition.  A join on the group alone would build a whole sequence in one task;
    here a left row is copied once per run of right ids and a right row once per run of left ids (under 2 % and
    0.1 % of the result), and the tiles are spread evenly however long a sequence is.  Ids are dense.
    """
    def runs(df, ident, width, name):
        return sized(df.groupBy(group).agg(F.floor(F.max(ident) / F.lit(width)).alias(name), F.count(F.lit(1)).alias(f"{name}_n")), "runs")

    each = lambda name: F.explode(F.sequence(F.lit(0).cast("long"), F.col(name)))
    of_left, of_right = runs(left, left_id, left_width, "_lt"), runs(right, right_id, right_width, "_rt")
    rows = of_left.join(of_right, group).agg(F.sum(F.col("_lt_n") * F.col("_rt_n"))).first()[0] or 0
    lhs = left.join(of_right.drop("_rt_n"), group).withColumn("_rt", each("_rt"))
    lhs = lhs.withColumn("_lt", F.floor(F.col(left_id) / F.lit(left_width)))
    rhs = right.join(of_left.drop("_lt_n"), group).withColumn("_lt", each("_lt"))
    rhs = rhs.withColumn("_rt", F.floor(F.col(right_id) / F.lit(right_width)))
    lhs = lhs.repartition(max(1, -(-rows // TASK_ROWS)), group, "_lt", "_rt")
    return lhs.join(rhs, [group, "_lt", "_rt"]).drop("_lt", "_rt")
