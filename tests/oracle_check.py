"""Run registered queries in Spark and their oracle SQL in DuckDB, compare.

Mirrors the driver's check: row count, column names, and an order-insensitive
comparison of the values (floats rounded to 9 significant digits).
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return "<null>"
    if isinstance(v, float):
        if math.isnan(v):
            return "<null>"
        return f"{v:.9g}"
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return "[" + ",".join(_norm(x) for x in v) + "]"
    return str(v)


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    return sorted(tuple(_norm(r[i]) for i in order) for r in rows), [cols[i] for i in order]


def compare(spark, name, fn, sql, sf_dir, con=None, show=3):
    con = con or duck(sf_dir)
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    dcols = rel.columns
    drows = rel.fetchall()
    t2 = time.time()
    s, sc = rows_of(sdf.columns, srows)
    d, dc = rows_of(dcols, drows)
    ok = (sc == dc) and (s == d)
    msg = f"{name}: spark {len(s)} rows {t1 - t0:.1f}s, duckdb {len(d)} rows {t2 - t1:.1f}s -> {'MATCH' if ok else 'DIFF'}"
    if not ok:
        if sc != dc:
            msg += f"\n  columns spark={sc}\n          duck ={dc}"
        else:
            ss, dd = set(s), set(d)
            only_s = sorted(ss - dd)[:show]
            only_d = sorted(dd - ss)[:show]
            msg += f"\n  only spark ({len(ss - dd)}): {only_s}\n  only duck ({len(dd - ss)}): {only_d}"
    return ok, msg


if __name__ == "__main__":
    sys.path.insert(0, ".")
    from conflictlake.session import get_spark
    import __spark_entry__ as E
    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    names = sys.argv[2:] or list(E.oracle_sql())
    spark = get_spark("local[8]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    q, o = E.queries(), E.oracle_sql()
    con = duck(sf)
    bad = 0
    for n in names:
        try:
            ok, msg = compare(spark, n, q[n], o[n], sf, con)
        except Exception as ex:  # noqa: BLE001
            ok, msg = False, f"{n}: ERROR {type(ex).__name__}: {str(ex)[:800]}"
        bad += not ok
        print(msg, flush=True)
    print(f"{len(names) - bad}/{len(names)} match")
