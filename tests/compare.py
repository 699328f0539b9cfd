"""Run registered queries in Spark and their SQL in DuckDB and compare all values.

    [GROUP_ROW_CAP=50] python tests/compare.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str):
    con = duckdb.connect()
    con.execute("SET TimeZone='UTC'")
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if isinstance(v, bool) or v is None:
        return repr(v)
    if isinstance(v, float):
        return "NaN" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, int):
        return repr(v)
    if isinstance(v, datetime.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(plain(x) for x in v) + "]"
    if isinstance(v, dict):
        return "{" + ",".join(f"{k}:{plain(x)}" for k, x in v.items()) + "}"
    return repr(v)


def table_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted(tuple(plain(r[i]) for i in order) for r in rows)


def check(spark, con, name, fn, sql, sf_dir):
    df = fn(spark, sf_dir)
    cols, rows = table_of(df.columns, [tuple(r) for r in df.collect()])
    if sql is None:
        return len(rows), None
    rel = con.sql(sql)
    want_cols, want = table_of(list(rel.columns), rel.fetchall())
    if cols != want_cols:
        return len(rows), f"columns {cols} vs {want_cols}"
    if rows != want:
        extra = [r for r in rows if r not in set(want)][:3]
        missing = [r for r in want if r not in set(rows)][:3]
        return len(rows), f"rows {len(rows)} vs {len(want)}\n  spark  {extra}\n  oracle {missing}"
    return len(rows), None


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from trialframe.session import local_session

    args = sys.argv[1:]
    sf_dir = args[0] if args else "/root/testdata/sf0.01"
    names = args[1:]
    spark, con = local_session(8, "compare"), connect(sf_dir)
    if os.environ.get("GROUP_ROW_CAP"):  # exercise the plans for oversized groups
        spark.conf.set("trialframe.groupRowCap", os.environ["GROUP_ROW_CAP"])
    sql, bad = oracle_sql(), []
    for name, fn in queries().items():
        if names and not any(n in name for n in names):
            continue
        start = time.time()
        try:
            n, problem = check(spark, con, name, fn, sql.get(name), sf_dir)
        except Exception as e:  # report and go on
            n, problem = -1, f"{type(e).__name__}: {str(e)[:1500]}"
        state = "FAIL" if problem else ("ok" if name in sql else "rows")
        print(f"{state:5s} {name} rows={n} {time.time() - start:.1f}s", flush=True)
        if problem:
            bad.append(name)
            print("   ", problem, flush=True)
    print("failed:", bad)


if __name__ == "__main__":
    main()
