"""Run registered queries on Spark and their SQL on DuckDB and compare all values.

python tests/oracle_check.py --sf 0.01 [name ...]
"""
from __future__ import annotations

import argparse
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ("region nation customer supplier part orders lineitem events documents "
          "embeddings pages benchmark labels conversations").split()


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def norm(v):
    if v is None:
        return "NULL"
    if hasattr(v, "item"):
        v = v.item()
    if isinstance(v, bool):
        return f"b:{v}"
    if isinstance(v, float):
        if math.isnan(v):
            return "NaN"
        return repr(v + 0.0)
    if isinstance(v, int):
        return f"{v}"
    return f"{type(v).__name__}:{v}"


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return [cols[i] for i in order], sorted(tuple(norm(r[i]) for i in order) for r in rows)


LAST = {"spark": 0.0}


def compare(spark, con, name, fn, sql, sf_dir):
    """None when equal, otherwise a short description."""
    t0 = time.time()
    df = fn(spark, sf_dir)
    cols, got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    LAST["spark"] = time.time() - t0
    if sql is None:
        return None if got else "no rows"
    cur = con.execute(sql)
    ecols, want = rows_of([c[0] for c in cur.description], cur.fetchall())
    if cols != ecols:
        return f"columns {cols} != {ecols}"
    if len(got) != len(want):
        return f"rows {len(got)} != {len(want)}"
    diff = [(a, b) for a, b in zip(got, want) if a != b]
    if diff:
        return f"{len(diff)}/{len(got)} differ, e.g.\n   spark {diff[0][0]}\n   duck  {diff[0][1]}"
    if not got:
        return "no rows"
    return None


def main():
    ap = argparse.ArgumentParser()
    ap.add_argument("--sf", default="0.01")
    ap.add_argument("--times", action="store_true")
    ap.add_argument("names", nargs="*")
    a = ap.parse_args()
    from cladeloom.session import get_spark
    import __spark_entry__ as entry
    spark = get_spark("check", "local[8]", **{"spark.sql.shuffle.partitions": "8", "spark.driver.memory": "12g",
                                              "spark.ui.showConsoleProgress": "false"})
    spark.sparkContext.setLogLevel("OFF")
    sf_dir = f"/root/testdata/sf{a.sf}"
    con = duck(sf_dir)
    qs, sqls = entry.queries(), entry.oracle_sql()
    names = []
    for n in qs:
        mod = qs[n].__module__.split(".")[-1]
        if not a.names or n in a.names or mod in a.names:
            names.append(n)
    bad = 0
    for n in names:
        t = time.time()
        try:
            msg = compare(spark, con, n, qs[n], sqls.get(n), sf_dir)
        except Exception as e:  # noqa: BLE001
            msg = f"{type(e).__name__}: {str(e)[:700]}"
        spark.catalog.clearCache()
        dt = time.time() - t
        if msg:
            bad += 1
            print(f"FAIL {n} ({dt:.1f}s): {msg}", flush=True)
        elif a.times or dt > 8:
            print(f"ok   {n} ({dt:.1f}s, spark {LAST['spark']:.1f}s)", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok; {sum(n in sqls for n in names)} with SQL", flush=True)


if __name__ == "__main__":
    main()
