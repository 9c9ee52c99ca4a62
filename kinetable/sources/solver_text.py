"""Text exchange with skinning solvers."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from ..functions.names import base_name

# Solver settings written when none are given.
SOLVER_SETTINGS = {"nIters": 5, "nInitIters": 1, "nTransIters": 1, "nWeightsIters": 1, "nnz": 4, "weightsSmooth": 0.001}


def solver_lines(points: DataFrame, bones: DataFrame, settings: dict | None = None) -> DataFrame:
    """(seq_id, section, a, b, value): header, parents, rest vertices (frame 0), animated vertices in order.

    ``points`` has the same vertices in every frame; ``bones(k, parent)`` is one skeleton for all sequences.
    """
    s = {**SOLVER_SETTINGS, **(settings or {})}
    zero = F.lit(0).cast("long")
    size = points.groupBy("seq_id").agg((F.max("vertex_id") + 1).alias("nv"), F.max("frame_id").alias("nf"))
    n_bones = bones.agg(F.count(F.lit(1))).scalar()
    head = [F.concat(F.lit("nV "), F.col("nv")), F.concat(F.lit("nB "), n_bones), F.concat(F.lit("nF "), F.col("nf")), F.lit("nS 1")]
    head += [F.lit(f"{k} {v}") for k, v in s.items()]
    header = size.select("seq_id", F.posexplode(F.array(*head)).alias("a", "value")).select(
        "seq_id", F.lit(0).alias("section"), F.col("a").cast("long").alias("a"), zero.alias("b"), "value")
    packed = bones.agg(F.sort_array(F.collect_list(F.struct("k", "parent")))).scalar()  # one small array
    parents = size.select("seq_id", F.explode(packed).alias("p")).select(
        "seq_id", F.lit(1).alias("section"), F.col("p.k").alias("a"), zero.alias("b"),
        F.format_string("parent %d %d", "p.k", "p.parent").alias("value"))
    starts = size.select("seq_id", F.posexplode(F.array(F.lit("fStart 0"), F.lit("subjectID 0"))).alias("a", "value")).select(
        "seq_id", F.lit(2).alias("section"), F.col("a").cast("long").alias("a"), zero.alias("b"), "value")
    first = F.col("frame_id") == 0
    tag = F.when(first, "v").otherwise("a")
    verts = points.select("seq_id", F.when(first, 3).otherwise(4).alias("section"), F.col("frame_id").alias("a"),
                          F.col("vertex_id").alias("b"), F.format_string("%s %.6f %.6f %.6f", tag, "x", "y", "z").alias("value"))
    return header.unionByName(parents).unionByName(starts).unionByName(verts)


def write_solver_text(points: DataFrame, bones: DataFrame, path: str, settings: dict | None = None) -> None:
    """Text under ``seq_id=...``.  Range partitions keep the order over the part files of a sequence, so a long
    sequence is written by many tasks; the parts read in name order are the file."""
    order = ["seq_id", "section", "a", "b"]
    lines = solver_lines(points, bones, settings).repartitionByRange(*order).sortWithinPartitions(*order)
    lines.select("seq_id", "value").write.partitionBy("seq_id").text(path)


def read_weight_text(spark: SparkSession, path: str, n_bones: int) -> DataFrame:
    """Solver output: ``w`` lines with one value per bone and line per vertex; comments, blanks and lines with too
    few values are skipped.  Rows are (seq_id, vertex_id, k, w), normalised, zeros left out."""
    from ..operators.weights import normalize_weights

    text = spark.read.text(path, wholetext=True).select(
        base_name(F.url_decode(F.col("_metadata.file_path")), r"\.[^.]*$").alias("seq_id"), "value")
    lines = F.filter(F.transform(F.split("value", r"\r?\n"), lambda s: F.trim(s)), lambda s: s.rlike(r"^(w\s)?\s*[-+0-9.]"))
    tokens = F.filter(F.transform(lines, lambda s: F.split(F.regexp_replace(s, r"^w\s+", ""), r"\s+")), lambda t: F.size(t) >= n_bones)
    rows = text.select("seq_id", F.posexplode(tokens).alias("vertex_id", "t")).select(
        "seq_id", F.col("vertex_id").cast("long").alias("vertex_id"), F.posexplode(F.slice("t", 1, n_bones)).alias("k", "w"))
    w = rows.select("seq_id", "vertex_id", F.col("k").cast("long").alias("k"), F.col("w").cast("double").alias("w"))
    return normalize_weights(w).where("w <> 0")
