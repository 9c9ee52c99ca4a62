"""Positions, running sums and neighbour rows that never gather one hot group in a single task.

``row_number() over (partition by g order by id)`` sorts all of ``g`` in one task.  Here a group is cut into
ranges of its integer id; a range holds at most ``width`` ids, so every window partition is bounded no matter
how many rows one group owns.  Only the per-range totals (rows / width of them) are summed across ranges.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from .lineage import cut

ID_RANGE = 1 << 18


def same(left: DataFrame, right: DataFrame, names: list[str]) -> Column:
    return reduce(lambda a, b: a & b, [left[n] == right[n] for n in names])


def position_by_id(df: DataFrame, keys: list[str], order: list[str], out: str, width: int = ID_RANGE) -> DataFrame:
    """0-based position of each row inside ``keys`` ordered by ``order``; ``order[0]`` is an integer id.

    The id must be unique up to a bounded multiplicity inside a group (the rest of ``order`` breaks ties).
    The join is an outer one on unique keys, so a query that never uses ``out`` pays neither for it nor the window.
    """
    ranged = df.withColumn("_range", F.floor(F.col(order[0]) / F.lit(width)))
    starts = range_starts(ranged, keys, F.count(F.lit(1)), "_before").groupBy(*keys, "_range").agg(F.max("_before").alias("_before"))
    inside = Window.partitionBy(*keys, "_range").orderBy(*order)
    return (
        ranged.withColumn("_pos", F.row_number().over(inside))
        .join(starts, [*keys, "_range"], "left")
        .withColumn(out, (F.col("_before") + F.col("_pos") - 1).cast("long"))
        .drop("_range", "_pos", "_before")
    )


def range_starts(ranged: DataFrame, keys: list[str], total: Column, out: str) -> DataFrame:
    """Exclusive running total over the id ranges of each group: one row per (group, range)."""
    before = Window.partitionBy(*keys).orderBy("_range").rowsBetween(Window.unboundedPreceding, -1)
    sums = ranged.groupBy(*keys, "_range").agg(total.alias("_total"))
    zero = F.lit(0).cast(sums.schema["_total"].dataType)
    return sums.select(*keys, "_range", F.coalesce(F.sum("_total").over(before), zero).alias(out))


def running_sum_by_id(df: DataFrame, keys: list[str], id_col: str, value: str, out: str, width: int = ID_RANGE) -> DataFrame:
    """Inclusive running sum of ``value`` in ``id_col`` order inside ``keys``."""
    ranged = df.withColumn("_range", F.floor(F.col(id_col) / F.lit(width)))
    starts = range_starts(ranged, keys, F.sum(value), "_before")
    inside = Window.partitionBy(*keys, "_range").orderBy(id_col).rowsBetween(Window.unboundedPreceding, 0)
    return (
        ranged.withColumn("_run", F.sum(value).over(inside))
        .join(starts, [*keys, "_range"])
        .withColumn(out, F.col("_before") + F.col("_run"))
        .drop("_range", "_run", "_before")
    )


def position_in_order(df: DataFrame, keys: list[str], order: list[str], out: str) -> DataFrame:
    """0-based position inside ``keys`` for any sortable order (file names, hashes).

    A range shuffle on (keys, order) spreads one hot group over many tasks; the sorted rows are written once
    with their row number inside the task, and the counts of the earlier tasks of the same group are added.
    Meant for listings with one short row per file, frame or sequence.  ``order`` must be unique within a group.
    """
    spread = df.repartitionByRange(*keys, *order).sortWithinPartitions(*keys, *order)
    placed = cut(
        spread.withColumn("_task", F.spark_partition_id()).withColumn("_row", F.monotonically_increasing_id()), "order"
    )
    pieces = placed.groupBy(*keys, "_task").agg(F.min("_row").alias("_first"), F.count(F.lit(1)).alias("_n"))
    earlier = Window.partitionBy(*keys).orderBy("_task").rowsBetween(Window.unboundedPreceding, -1)
    pieces = pieces.withColumn("_before", F.coalesce(F.sum("_n").over(earlier), F.lit(0)))
    return (
        placed.join(pieces, [*keys, "_task"])
        .withColumn(out, (F.col("_row") - F.col("_first") + F.col("_before")).cast("long"))
        .drop("_task", "_row", "_first", "_n", "_before")
    )


def with_previous(df: DataFrame, keys: list[str], frame: str, back: dict[int, dict[str, str]], width: int = 4096) -> DataFrame:
    """Attach columns of earlier frames: ``back = {1: {"x": "x1"}, 2: {"x": "x2"}}``.

    A run of ``width`` frames plus the ``max(back)`` frames before it is all a window needs.  Of a frame that is missing,
    or follows a missing one, the columns are null.
    Those few halo rows are copied into the next run and dropped afterwards: one shuffle, bounded tasks.
    """
    halo = max(back)
    runs = F.array(F.floor(F.col(frame) / F.lit(width)), F.floor((F.col(frame) + F.lit(halo)) / F.lit(width)))
    placed = df.withColumn("_run", F.explode(F.array_distinct(runs)))
    w = Window.partitionBy(*keys, "_run").orderBy(frame)
    there = lambda n: F.lag(frame, n).over(w) == F.col(frame) - n
    cols = [F.when(there(n), F.lag(c, n).over(w)).alias(name) for n, names in back.items() for c, name in names.items()]
    return (
        placed.select("*", *cols)
        .where(F.col("_run") == F.floor(F.col(frame) / F.lit(width)))
        .drop("_run")
    )


def top_k(df: DataFrame, keys: list[str], order: list, k: int, rank: str | None = None) -> DataFrame:
    """First ``k`` rows of every group.  Spark limits each group inside the map tasks before it shuffles
    (partial window group limit), so a hot group sends at most ``k`` rows per task."""
    w = Window.partitionBy(*keys).orderBy(*order)
    out = df.withColumn("_rank", F.row_number().over(w)).where(F.col("_rank") <= k)
    return out.withColumnRenamed("_rank", rank) if rank else out.drop("_rank")
