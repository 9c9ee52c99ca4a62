"""Frame and file names."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def frame_index(name: Column, default: int = 93) -> Column:
    """0-based index from a name such as ``Frame_00012_...``; ``default`` when the name has no such part."""
    digits = F.regexp_extract(name, r"Frame_(\d+)_", 1)
    return F.when(digits != "", digits.cast("long") - 1).otherwise(F.lit(default).cast("long"))


def base_name(path: Column, suffix: str = r"\.obj$") -> Column:
    """Last path part without its suffix."""
    return F.regexp_replace(F.element_at(F.split(path, "/"), -1), suffix, "")


def step_file(i: Column, t: Column) -> Column:
    return F.format_string("interpolated_%03d_t%.3f.obj", i, t)


def segments(text: Column) -> Column:
    """``"0,10;20,30"`` to an array of (frame_a, frame_b)."""
    return F.transform(F.split(text, ";"), lambda s: F.struct(
        F.trim(F.split(s, ",")[0]).cast("long").alias("frame_a"),
        F.trim(F.split(s, ",")[1]).cast("long").alias("frame_b")))
