"""Run a registered query on Spark and its oracle SQL on DuckDB and compare
row count, column names and an order-insensitive value fingerprint.

Usage: python tests/oracle_harness.py [sf_dir] [name-substring ...]
"""

from __future__ import annotations

import datetime as _dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir):
    import duckdb
    con = duckdb.connect()
    for t in TABLES:
        p = f"{sf_dir}/{t}.parquet"
        if os.path.exists(p):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{p}')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return None
        return round(v, 4) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 4) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, _dt.datetime):
        return v.replace(tzinfo=None).isoformat()
    if isinstance(v, _dt.date):
        return v.isoformat()
    if hasattr(v, "item"):
        return _norm(v.item())
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), x if x is not None else 0) for x in r))


def compare(spark, con, name, fn, sql, sf_dir):
    t0 = time.time()
    sdf = fn(spark, sf_dir)
    scols = sdf.columns
    srows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    res = {"name": name, "spark_rows": len(srows), "spark_s": round(t1 - t0, 2)}
    if sql is None:
        res["status"] = "rows-only"
        return res
    d = con.execute(sql)
    dcols = [c[0] for c in d.description]
    drows = d.fetchall()
    res["duck_rows"] = len(drows)
    if sorted(scols) != sorted(dcols):
        res["status"] = f"COLUMNS spark={sorted(scols)} duck={sorted(dcols)}"
        return res
    a, b = rows_of(scols, srows), rows_of(dcols, drows)
    if len(a) != len(b):
        res["status"] = "ROWCOUNT"
        return res
    if a != b:
        bad = [(x, y) for x, y in zip(a, b) if x != y][:3]
        res["status"] = f"VALUES {bad}"
        return res
    res["status"] = "ok"
    return res


def main():
    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    pats = [a for a in args if not a.startswith("/")]
    from payscope.session import get_spark
    import __spark_entry__ as E
    spark = get_spark("local[8]", 8)
    qs, orc = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    n_ok = n_bad = 0
    for name, fn in qs.items():
        if pats and not any(p in name for p in pats):
            continue
        try:
            r = compare(spark, con, name, fn, orc.get(name), sf_dir)
        except Exception as e:  # report and go on
            r = {"name": name, "status": f"ERROR {type(e).__name__}: {str(e)[:300]}"}
        ok = r["status"] in ("ok", "rows-only")
        n_ok += ok
        n_bad += not ok
        print(("  " if ok else "!!"), r, flush=True)
    print(f"ok={n_ok} bad={n_bad}")


if __name__ == "__main__":
    main()
