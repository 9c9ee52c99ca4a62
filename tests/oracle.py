"""Run registered queries and compare them with their SQL in DuckDB: python -m tests.oracle [sf] [name ...]"""

from __future__ import annotations

import sys
import time
import traceback

import duckdb
import pandas as pd

TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def normal(df: pd.DataFrame) -> pd.DataFrame:
    df = df[sorted(df.columns)]
    for c in df.columns:
        if df[c].dtype == object:
            df[c] = df[c].map(lambda v: tuple(v) if hasattr(v, "__len__") and not isinstance(v, str) else v)
    return df.sort_values(list(df.columns), ignore_index=True)


def compare(spark_df, con, sql: str) -> str:
    got = spark_df.toPandas()
    want = con.execute(sql).df()
    if sorted(got.columns) != sorted(want.columns):
        return f"columns {sorted(got.columns)} != {sorted(want.columns)}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    a, b = normal(got), normal(want)
    notes = []
    for c in a.columns:
        if a[c].dtype.kind != b[c].dtype.kind and not {a[c].dtype.kind, b[c].dtype.kind} <= set("OTU"):
            notes.append(f"{c}: type {a[c].dtype} vs {b[c].dtype}")
        bad = ~((a[c] == b[c]) | (a[c].isna() & b[c].isna()))
        if bad.any():
            i = bad.idxmax()
            notes.append(f"{c}: {int(bad.sum())} differ, e.g. {a[c][i]!r} vs {b[c][i]!r}")
    return "; ".join(notes)


def main() -> int:
    from kinetable.plans.session import session
    from kinetable.queries import load

    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    sf_dir = f"/root/testdata/sf{sf}"
    reg = load()
    names = [n for n in reg.spark if not sys.argv[2:] or any(a in n for a in sys.argv[2:])]
    spark = session("local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.enabled": "false", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(sf_dir)
    failed = 0
    for n in names:
        t = time.time()
        try:
            df = reg.spark[n](spark, sf_dir)
            if n in reg.sql:
                note = compare(df, con, reg.sql[n])
                state = "ok" if not note else "DIFF " + note
            else:
                state = f"rows {df.count()}"
                note = ""
        except Exception as e:  # noqa: BLE001 - the report names every failing query
            note = state = "FAIL " + "\n".join(str(e).splitlines()[:6])
            if "-v" in sys.argv:
                traceback.print_exc()
        failed += bool(note)
        print(f"{n:32s} {time.time() - t:6.2f}s {state}", flush=True)
    print(f"{len(names)} queries, {failed} not equal")
    return failed


if __name__ == "__main__":
    sys.exit(1 if main() else 0)
