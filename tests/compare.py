"""Run registered queries next to their SQL in DuckDB and compare every value.

``python -m tests.compare [folder] [name ...]``
"""

from __future__ import annotations

import decimal
import sys
import time
from collections import Counter
from pathlib import Path

import duckdb

ROOT = Path(__file__).resolve().parent.parent
sys.path.insert(0, str(ROOT))
TABLES = "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations".split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def plain(value):
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, bool) or value is None or isinstance(value, str):
        return repr(value)
    if isinstance(value, float):
        return repr(value + 0.0)
    return repr(value)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], Counter(tuple(plain(r[i]) for i in order) for r in rows)


spent = {"spark": 0.0}


def compare(spark, con, folder, job, sql):
    """Returns (row count, problem or None)."""
    start = time.time()
    df = job(spark, folder)
    got_cols, got = rows_of(df.columns, df.collect())
    spent["spark"] = time.time() - start
    n = sum(got.values())
    if sql is None:
        return n, None
    cur = con.execute(sql)
    want_cols, want = rows_of([d[0] for d in cur.description], cur.fetchall())
    if got_cols != want_cols:
        return n, f"columns {got_cols} != {want_cols}"
    if got != want:
        only, miss = list((got - want).elements()), list((want - got).elements())
        return n, f"{len(only)} extra, {len(miss)} missing of {sum(want.values())}\n   spark {sorted(only)[:3]}\n   sql   {sorted(miss)[:3]}"
    return n, None


def main() -> None:
    from cutlens.session import local_session
    from queries import oracle_sql, queries

    args = sys.argv[1:]
    folder = args.pop(0) if args and "/" in args[0] else "/root/testdata/sf0.01"
    spark = local_session(8)
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    jobs, sqls = queries(), oracle_sql()
    bad = []
    for name in args or jobs:
        start = time.time()
        try:
            n, problem = compare(spark, con, folder, jobs[name], sqls.get(name))
        except Exception as error:  # noqa: BLE001 - report and go on
            n, problem = 0, f"{type(error).__name__}: {str(error)[:900]}"
        mark = "FAIL" if problem else ("rows" if name not in sqls else "ok")
        print(f"{mark:5} {name:32} {n:8} rows {time.time() - start:6.1f}s (spark {spent['spark']:.1f}s)" + (f"\n   {problem}" if problem else ""), flush=True)
        if problem or n == 0:
            bad.append(name)
    print("bad or empty:", bad)


if __name__ == "__main__":
    main()
