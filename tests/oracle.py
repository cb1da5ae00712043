"""Compare registered queries with their SQL in DuckDB.

Usage: python tests/oracle.py [folder] [query …]
"""

from __future__ import annotations

import datetime as dt
import math
import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

import duckdb

import __spark_entry__ as registry
from trustkpi.session import local_session

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(folder: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(value, float):
        return "nan" if math.isnan(value) else (value + 0.0)
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, (int, str)):
        return value
    return f"{type(value).__name__}:{value}"


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def compare(spark, con, folder: str, name: str) -> tuple[bool, str]:
    df = registry.queries()[name](spark, folder)
    got = rows_of(df.columns, df.collect())
    sql = registry.oracle_sql().get(name)
    if sql is None:
        return True, f"{len(got)} rows (no SQL)"
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    want = rows_of(columns, cur.fetchall())
    if sorted(columns) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(columns)}"
    if got != want:
        bad = [(g, w) for g, w in zip(got, want) if g != w][:2]
        return False, f"rows {len(got)} vs {len(want)}; sorted {sorted(columns)}; first differences {bad}"
    return True, f"{len(got)} rows"


if __name__ == "__main__":
    folder = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(registry.queries())
    spark = local_session("8")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = []
    for name in names:
        start = time.time()
        try:
            ok, note = compare(spark, con, folder, name)
        except Exception as exc:  # a broken query must not hide the others
            ok, note = False, f"{type(exc).__name__}: {str(exc)[:700]}"
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.1f}s {note[:1500]}", flush=True)
        if not ok:
            failed.append(name)
    print(f"{len(names) - len(failed)}/{len(names)} agree; failed: {failed}")
    sys.exit(bool(failed))
