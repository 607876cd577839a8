"""Run the registered queries against their DuckDB oracles: ``python tests/oracle.py [sf] [name…]``."""

from __future__ import annotations

import math
import os
import sys
import time
from collections import Counter

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings"
    " pages benchmark labels conversations"
).split()


def _plain(v):
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return v + 0.0
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_plain(x) for x in v)
    return v


def rows_of(frame, columns):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [tuple(_plain(r[i]) for i in order) for r in frame]


def duck(sf):
    import duckdb

    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf}/{t}.parquet'")
    return con


def compare(spark, con, sf, name, fn, sql):
    """(ok, message) for one query."""
    t0 = time.time()
    df = fn(spark, sf)
    got = rows_of([tuple(r) for r in df.collect()], df.columns)
    took = time.time() - t0
    if sql is None:
        return True, f"rows {len(got)} (no oracle) {took:.1f}s"
    res = con.execute(sql)
    cols = [d[0] for d in res.description]
    want = rows_of(res.fetchall(), cols)
    if sorted(cols) != sorted(df.columns):
        return False, f"columns {sorted(df.columns)} != {sorted(cols)}"
    a, b = Counter(got), Counter(want)
    if a == b:
        return True, f"rows {len(got)} {took:.1f}s"
    names = sorted(cols)
    only_a, only_b = list((a - b).elements()), list((b - a).elements())
    return False, (
        f"{len(got)} vs {len(want)} rows, {len(only_a)} differ {took:.1f}s\n   {names}"
        f"\n   spark {sorted(map(str, only_a))[:3]}\n   duck  {sorted(map(str, only_b))[:3]}"
    )


def main():
    from __spark_entry__ import oracle_sql, queries
    from plantloom.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:]
    spark = build_session(
        "oracle", "local[8]", spark__sql__shuffle__partitions=8, spark__driver__memory="8g",
        spark__ui__enabled="false", spark__ui__showConsoleProgress="false",
    )
    spark.sparkContext.setLogLevel("ERROR")
    con, sqls, bad = duck(sf), oracle_sql(), []
    for name, fn in queries().items():
        if names and name not in names:
            continue
        try:
            ok, text = compare(spark, con, sf, name, fn, sqls.get(name))
        except Exception as exc:  # noqa: BLE001 - report and go on
            ok, text = False, f"{type(exc).__name__}: {str(exc)[:600]}"
        if not ok:
            bad.append(name)
        print("OK  " if ok else "FAIL", name, text, flush=True)
    print(f"{len(bad)} failed: {bad}")
    spark.stop()


if __name__ == "__main__":
    main()
