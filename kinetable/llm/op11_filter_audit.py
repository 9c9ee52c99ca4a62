"""Filter interaction audit: what each filter removes in every order of all filters, by a Gray-code walk over subsets.

A document fails some of the filters: a mask of bits.  Documents of one part (a source) with one mask are alike to every
order, so they become one *mask cell* with a few counts.  The subsets of active filters are walked in Gray-code order:
each step toggles one filter.  Every cell has a counter of the active filters it fails; where the counter leaves zero the
cell's counts leave the running survivors, where it returns to zero they come back.  The survivors after each step are
stored: 2^n states.  Everything else is a difference of two of them: a filter at step i of an order removes the survivors
of the i - 1 filters before it less those with it, whatever the order of those.

Definite results: a null text is an empty one, a null source is the part ''.  Rows without an id are never copies of a
smaller id, nor is any row a copy of them; rows that share an id and a text are no copies of each other.  Of several
``labels`` of an id each counts (any quality 1, any toxic 1).  An empty table gives no rows.  Other columns are not read.

Scale: texts are read once, by Spark expressions, and leave as a digest, a mask and a part.  Copies meet by digest in an
aggregate that the map tasks combine; the way back joins on (id, digest), so a text that a third of all rows have is no
hot key, and rows without id take no part in a join.  Cells are one row per part and mask, again combined in the map tasks.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from itertools import permutations
from math import factorial

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, functions as F

from .common import cut, pick

#: White space between words (a fixed value); words are the runs between.
SPACE = r"[\x20\x09-\x0D]+"
MIN_WORDS, DISTINCT_PERCENT, UPPER_PERCENT = 50, 65, 5
SIGNS = r"[#$%&*|]"
MEASURES = ("docs", "good", "toxic")
COUNTS = ("kept", "removed", "redundant", "unique_fails", "good_lost", "toxic_lost", "shapley")
#: Rows of one Arrow batch of the report.
REPORT_ROWS = 60_000


def text_filters() -> dict[str, Callable[[Column], Column]]:
    """Conditions on a text, not null, under which it fails the filter."""
    def words(text: Column) -> Column:
        return F.array_remove(F.split(text, SPACE), "")

    return {
        "A": lambda t: F.size(words(t)) < MIN_WORDS,
        "B": lambda t: 100 * F.size(F.array_distinct(words(t))) < DISTINCT_PERCENT * F.size(words(t)),
        "C": lambda t: 100 * (F.length(t) - F.length(F.regexp_replace(t, "[A-Z]+", ""))) > UPPER_PERCENT * F.length(t),
        "D": lambda t: t.rlike(SIGNS),
    }


#: The filter that needs the whole table: a copy of a smaller id's text.
COPY = "E"


def masks(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] | None = None,
          id_col: str = "doc_id", text_col: str = "text", part_col: str = "source") -> DataFrame:
    """part, mask, good, toxic of every document; bit i of the mask is the i-th filter, the last bit the copies."""
    filters = text_filters() if filters is None else filters
    src = pick(docs, doc_id=id_col, text=text_col, part=part_col)
    text = F.coalesce("text", F.lit(""))
    bits = [F.when(fails(text), 1 << i).otherwise(0) for i, fails in enumerate(filters.values())]
    mask = bits[0]
    for b in bits[1:]:
        mask = mask + b
    rows = cut(src.select("doc_id", F.coalesce(F.col("part").cast("string"), F.lit("")).alias("part"),
                          F.unhex(F.sha2(text.cast("binary"), 256)).alias("digest"), mask.cast("long").alias("mask")), "masks")
    named = rows.where("doc_id IS NOT NULL")
    first = named.groupBy("digest").agg(F.min("doc_id").alias("doc_id")).withColumn("first", F.lit(True))
    about = pick(labels, doc_id="doc_id", quality="quality", toxic="toxic").where("doc_id IS NOT NULL").groupBy("doc_id").agg(
        F.max((F.coalesce("quality", F.lit(0)) == 1).cast("long")).alias("good"),
        F.max((F.coalesce("toxic", F.lit(0)) == 1).cast("long")).alias("toxic"))
    copies = F.when(F.col("first").isNull(), 1 << len(filters)).otherwise(0)
    zero = F.lit(0).cast("long")
    named = named.join(first, ["doc_id", "digest"], "left").join(about, "doc_id", "left").select(
        "part", (F.col("mask") + copies).alias("mask"), F.coalesce("good", zero).alias("good"), F.coalesce("toxic", zero).alias("toxic"))
    return named.unionByName(rows.where("doc_id IS NULL").select("part", "mask", zero.alias("good"), zero.alias("toxic")))


def cells(masked: DataFrame) -> DataFrame:
    """part and its cells: (mask, docs, good, toxic), at most 2^n of them."""
    counted = masked.groupBy("part", "mask").agg(F.count(F.lit(1)).alias("docs"), F.sum("good").alias("good"), F.sum("toxic").alias("toxic"))
    return counted.groupBy("part").agg(F.collect_list(F.struct("mask", *MEASURES)).alias("cells"))


def gray_toggles(n: int) -> list[int]:
    """The bit that each step of a Gray-code walk over n bits toggles: the lowest set bit of the step's number."""
    return [(step & -step).bit_length() - 1 for step in range(1, 1 << n)]


def survivors(counts: np.ndarray, n: int) -> np.ndarray:
    """[subset, part, measure] from counts [part, mask, measure]: what is left of a part under each subset of filters."""
    every = np.arange(1 << n)
    active_failures = np.zeros(1 << n, np.int64)
    left = counts.sum(axis=1)
    out = np.empty((1 << n, *left.shape), np.int64)
    subset, out[0] = 0, left
    for bit in gray_toggles(n):
        touched = every[(every >> bit) & 1 == 1]
        if subset >> bit & 1:
            active_failures[touched] -= 1
            left = left + counts[:, touched[active_failures[touched] == 0]].sum(axis=1)
        else:
            left = left - counts[:, touched[active_failures[touched] == 0]].sum(axis=1)
            active_failures[touched] += 1
        subset ^= 1 << bit
        out[subset] = left
    return out


def steps(states: np.ndarray, n: int) -> np.ndarray:
    """[part, order, step, count] with the counts of ``COUNTS``, from differences of states."""
    whole = (1 << n) - 1
    docs = states[:, :, 0]
    fails = np.stack([docs[0] - docs[1 << f] for f in range(n)])
    unique = np.stack([docs[whole ^ 1 << f] - docs[whole] for f in range(n)])
    shapley = np.zeros_like(fails)
    for f in range(n):
        for before in range(1 << n):
            if not before >> f & 1:
                size = before.bit_count()
                shapley[f] += factorial(size) * factorial(n - 1 - size) * (docs[before] - docs[before | 1 << f])
    rows = []
    for order in permutations(range(n)):
        subset = 0
        for f in order:
            gone, subset = states[subset] - states[subset | 1 << f], subset | 1 << f
            rows.append(np.stack([docs[subset], gone[:, 0], fails[f] - gone[:, 0], unique[f], gone[:, 1], gone[:, 2], shapley[f]], axis=1))
    return np.stack(rows, axis=1)


def audit(docs: DataFrame, labels: DataFrame, filters: dict[str, Callable[[Column], Column]] | None = None, **columns: str) -> DataFrame:
    """part, filter_order, step and the counts of ``COUNTS``: a row per part, order and step, zeros included.

    ``filters`` names conditions on a text; the copies come as a last filter, ``COPY``.  Work per part is 2^n states and
    n! orders, so n is small."""
    filters = text_filters() if filters is None else filters
    names = [*filters, COPY]
    n = len(names)
    orders = ["".join(names[f] for f in o) for o in permutations(range(n))]
    per_part = len(orders) * n
    labels_of = pa.array(np.repeat(orders, n))
    step_of = np.tile(np.arange(1, n + 1, dtype=np.int32), len(orders))

    def walk(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, max(1, REPORT_ROWS // per_part)):
                some = batch.slice(at, max(1, REPORT_ROWS // per_part))
                parts = some.column("part")
                counts = np.zeros((len(parts), 1 << n, len(MEASURES)), np.int64)
                for i, found in enumerate(some.column("cells").to_pylist()):
                    for c in found:
                        counts[i, c["mask"]] = [c[m] for m in MEASURES]
                table = steps(survivors(counts, n), n).reshape(-1, len(COUNTS))
                order = labels_of.take(pa.array(np.tile(np.arange(per_part), len(parts))))
                yield pa.RecordBatch.from_arrays(
                    [parts.take(pa.array(np.repeat(np.arange(len(parts)), per_part))), order, pa.array(np.tile(step_of, len(parts))),
                     *[pa.array(table[:, i]) for i in range(len(COUNTS))]], ["part", "filter_order", "step", *COUNTS])

    schema = "part string, filter_order string, step int, " + ", ".join(f"{c} long" for c in COUNTS)
    return cells(masks(docs, labels, filters, **columns)).mapInArrow(walk, schema)


def sql() -> str:
    """The same for the five filters as DuckDB's SQL."""
    return rf"""
    with w as (select coalesce(source, '') as part, doc_id, coalesce(text, '') as t, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') as ws from documents),
         l as (select doc_id, max(case when quality = 1 then 1 else 0 end) as good, max(case when toxic = 1 then 1 else 0 end) as toxic from labels group by 1),
         f as (select part, coalesce(good, 0) as good, coalesce(toxic, 0) as toxic,
                 case when len(ws) < {MIN_WORDS} then 1 else 0 end
               + case when 100 * len(list_distinct(ws)) < {DISTINCT_PERCENT} * len(ws) then 2 else 0 end
               + case when 100 * length(regexp_replace(t, '[^A-Z]', '', 'g')) > {UPPER_PERCENT} * length(t) then 4 else 0 end
               + case when regexp_matches(t, '{SIGNS}') then 8 else 0 end
               + case when w.doc_id > min(w.doc_id) over (partition by t) then 16 else 0 end as mask
               from w left join l on w.doc_id = l.doc_id),
         b as (select i, 1 << i as bit, substr('ABCDE', i + 1, 1) as name from range(0, 5) r(i)),
         o as (select p.name || q.name || r.name || s.name || u.name as filter_order, [p.i, q.i, r.i, s.i, u.i] as seq
               from b p join b q on q.i <> p.i join b r on r.i not in (p.i, q.i) join b s on s.i not in (p.i, q.i, r.i)
               join b u on u.i not in (p.i, q.i, r.i, s.i)),
         e as (select filter_order, k as step, seq[k] as i, coalesce(list_sum(list_transform(seq[1:k - 1], lambda x: 1 << x)), 0)::bigint as before
               from o, range(1, 6) s(k)),
         n as (select part, i, count(*) filter (where mask & bit > 0 and mask & before = 0) as removed, before,
                 count(*) filter (where mask & (before | bit) = 0) as kept,
                 count(*) filter (where mask & bit > 0 and mask & before > 0) as redundant,
                 count(*) filter (where mask = bit) as unique_fails,
                 count(*) filter (where mask & bit > 0 and mask & before = 0 and good = 1) as good_lost,
                 count(*) filter (where mask & bit > 0 and mask & before = 0 and toxic = 1) as toxic_lost
               from f, (select distinct e.i, e.before, b.bit from e join b using (i)) x group by part, i, before),
         h as (select part, i, sum(removed)::bigint as shapley from n join e using (i, before) group by 1, 2)
    select part, filter_order, step::integer as step, kept, removed, redundant, unique_fails, good_lost, toxic_lost, shapley
    from e join n using (i, before) join h using (part, i)"""
