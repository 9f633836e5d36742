"""Run a registered Spark query and its DuckDB oracle side by side and compare them.

Mirrors the driver's check: same row count, same column names, and the same
multiset of rows (floats rounded to 6 places, columns sorted by name).
Usage: python tests/oracle_check.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import os
import sys
import time

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
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
        return round(v, 6) + 0.0
    if isinstance(v, decimal.Decimal):
        return round(float(v), 6) + 0.0
    if isinstance(v, bool):
        return int(v)
    if isinstance(v, int):
        return v
    if isinstance(v, dt.datetime):
        return v.replace(tzinfo=None).isoformat(sep=" ")
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if isinstance(v, dict):
        return tuple(sorted((str(k), _norm(x)) for k, x in v.items()))
    if hasattr(v, "asDict"):
        return _norm(v.asDict())
    return str(v)


def rows_of_spark(df):
    cols = sorted(df.columns)
    return cols, [tuple(_norm(r[c]) for c in cols) for r in df.collect()]


def rows_of_duck(con, sql):
    res = con.execute(sql)
    names = [d[0] for d in res.description]
    data = res.fetchall()
    order = sorted(range(len(names)), key=lambda i: names[i])
    return [names[i] for i in order], [tuple(_norm(r[i]) for i in order) for r in data]


def _key(row):
    return tuple((x is None, str(type(x)), x if x is not None else 0) for x in row)


def compare(spark, sf_dir, name, fn, sql, con=None):
    con = con or duck(sf_dir)
    t0 = time.time()
    scols, srows = rows_of_spark(fn(spark, sf_dir))
    t1 = time.time()
    dcols, drows = rows_of_duck(con, sql)
    ok_cols = scols == dcols
    ok_n = len(srows) == len(drows)
    ok_vals = sorted(srows, key=_key) == sorted(drows, key=_key)
    return {"name": name, "ok": ok_cols and ok_n and ok_vals, "cols": ok_cols, "rows": ok_n,
            "values": ok_vals, "n_spark": len(srows), "n_duck": len(drows), "spark_s": round(t1 - t0, 2),
            "spark_cols": scols, "duck_cols": dcols,
            "sample_spark": sorted(srows, key=_key)[:3], "sample_duck": sorted(drows, key=_key)[:3]}


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    import __spark_entry__ as E
    from sparklog.session import get_session
    spark = get_session("local[8]")
    qs, sqls = E.queries(), E.oracle_sql()
    con = duck(sf_dir)
    bad = 0
    for name in (names or list(qs)):
        if name not in sqls:
            df = qs[name](spark, sf_dir)
            n = df.count()
            print(f"[rows-only] {name}: {n} rows")
            continue
        try:
            r = compare(spark, sf_dir, name, qs[name], sqls[name], con)
        except Exception as e:  # noqa: BLE001
            bad += 1
            print(f"[ERROR] {name}: {type(e).__name__}: {str(e)[:600]}")
            continue
        if r["ok"]:
            print(f"[ok] {name}: {r['n_spark']} rows {r['spark_s']}s")
        else:
            bad += 1
            print(f"[MISMATCH] {name}: {r}")
    print(f"{bad} failing of {len(names or qs)}")
    return bad


if __name__ == "__main__":
    sys.exit(1 if main(sys.argv) else 0)
