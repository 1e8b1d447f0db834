"""Run registered queries against their SQL twins: python tests/check.py [sf] [name-prefix ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb

ROOT = os.environ.get("TESTDATA", "/root/testdata")
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings "
          "pages benchmark labels conversations").split()


def connect(sf: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{ROOT}/sf{sf}/{t}.parquet'")
    return con


def _cell(v):
    if v is None or (isinstance(v, float) and math.isnan(v)):
        return "NULL"
    if isinstance(v, bool):
        return str(v)
    if isinstance(v, float):
        return repr(v + 0.0)
    return str(v)


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(_cell(r[i]) for i in order) for r in rows)


def compare(spark, con, name, fn, sql, sf):
    """None when both agree, else a short description."""
    return compare_rows(fn(spark, f"{ROOT}/sf{sf}"), con, sql)


def compare_rows(out, con, sql):
    got = out.collect()
    if sql is None:
        return None if got else "no rows"
    rel = con.sql(sql)
    want_cols, want = rel.columns, rel.fetchall()
    if sorted(out.columns) != sorted(want_cols):
        return f"columns {sorted(out.columns)} != {sorted(want_cols)}"
    if len(got) != len(want):
        return f"{len(got)} rows != {len(want)}"
    a, b = rows_of(out.columns, got), rows_of(want_cols, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y]
    return f"{len(bad)} rows differ, first: {bad[0]}" if bad else None


if __name__ == "__main__":
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as E
    from weftlog.session import build_session

    spark = build_session("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g", "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("ERROR")
    sf = sys.argv[1] if len(sys.argv) > 1 else "0.01"
    picks = sys.argv[2:]
    con, oracle, fails = connect(sf), E.oracle_sql(), 0
    for name, fn in E.queries().items():
        if picks and not any(name.startswith(p) for p in picks):
            continue
        t = time.time()
        try:
            problem = compare(spark, con, name, fn, oracle.get(name), sf)
        except Exception as e:  # report and go on with the next query
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        fails += problem is not None
        print(f"{'ok  ' if problem is None else 'FAIL'} {name:34s} {time.time() - t:6.2f}s {problem or ''}", flush=True)
    print("failures:", fails)
