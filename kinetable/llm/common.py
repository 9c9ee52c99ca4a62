"""Helpers shared by the corpus operators: written tables, Arrow batch bounds, column picking."""

from __future__ import annotations

import ctypes
import gc
from collections.abc import Callable, Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..plans.lineage import cut  # noqa: F401 - the operators take it from here

#: Rows and bytes of one Arrow batch: texts of 100 kB each must not gather ten thousand at a time in a worker.
BATCH_ROWS, BATCH_BYTES = 1000, 16 << 20


def bounded_batches(spark: SparkSession) -> None:
    """Keep Arrow batches of whole texts small; a session that asks for less keeps its own value."""
    for key, value in (("spark.sql.execution.arrow.maxRecordsPerBatch", BATCH_ROWS),
                       ("spark.sql.execution.arrow.maxBytesPerBatch", BATCH_BYTES)):
        now = int(spark.conf.get(key).rstrip("b"))
        if now <= 0 or now > value:
            spark.conf.set(key, str(value))


#: What each operator keeps in a worker between tasks, and the operator that worked there last.
_KEPT: dict[str, Callable[[], None]] = {}
_AT_WORK: list[str] = []


def at_work(owner: str, forget: Callable[[], None] | None = None) -> None:
    """Called in a worker before an operator's first batch.  Workers outlive their tasks, so what other operators keep
    there is forgotten and its memory given back; ``forget`` empties what this one keeps."""
    if forget:
        _KEPT[owner] = forget
    if _AT_WORK == [owner]:
        return
    for other, clear in _KEPT.items():
        if other != owner:
            clear()
    _AT_WORK[:] = [owner]
    gc.collect()
    pa.default_memory_pool().release_unused()
    if trim := getattr(ctypes.CDLL(None), "malloc_trim", None):
        trim(0)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def pick(df: DataFrame, **columns: str) -> DataFrame:
    """Only the named columns, under the operator's own names: other columns can't clash with anything."""
    return df.select(*[F.col(f"`{src}`").alias(out) for out, src in columns.items()])


def rows_of(batches: Iterator[pa.RecordBatch], *names: str) -> Iterator[tuple]:
    """Rows of Arrow batches as Python values, a batch at a time."""
    for b in batches:
        yield from zip(*[b.column(b.schema.get_field_index(n)).to_pylist() for n in names], strict=True)


def byte_symbols() -> list[str]:
    """The printable symbol of each byte: itself where it is printable, else the next character from 256 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    spare = iter(range(256, 512))
    return [chr(b) if b in shown else chr(next(spare)) for b in range(256)]
