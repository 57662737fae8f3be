"""Run registered queries in Spark and their SQL oracle in DuckDB on the same
Parquet tables; compare row count, column names/types and the multiset of
rows (columns sorted by name, as the external check does).

    python tools/check_oracle.py [sf_dir] [name ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import math
import sys
import time

import duckdb

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str):
    con = duckdb.connect()
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


def _norm(v):
    if v is None:
        return None
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return repr(v + 0.0)
    if isinstance(v, decimal.Decimal):
        return repr(float(v))
    if isinstance(v, (dt.date, dt.datetime)):
        return v.isoformat()
    return v


def _kind(t: str) -> str:
    t = t.lower()
    if t in ("bigint", "long", "int64"):
        return "int64"
    if t in ("int", "integer", "int32"):
        return "int32"
    if t in ("double", "float64"):
        return "double"
    if t in ("string", "varchar"):
        return "string"
    if t in ("date",):
        return "date"
    if t.startswith("timestamp"):
        return "timestamp"
    if t in ("boolean",):
        return "bool"
    return t


def compare(spark, con, name: str, sf_dir: str, spark_df_fn, sql: str) -> dict:
    t0 = time.time()
    sdf = spark_df_fn(spark, sf_dir)
    s_types = {f.name: _kind(f.dataType.simpleString()) for f in sdf.schema.fields}
    s_rows = [tuple(r) for r in sdf.collect()]
    t1 = time.time()
    rel = con.sql(sql)
    d_types = {c: _kind(str(t)) for c, t in zip(rel.columns, rel.types)}
    d_rows = rel.fetchall()
    t2 = time.time()
    s_cols, d_cols = list(s_types), list(d_types)
    out = {"name": name, "spark_rows": len(s_rows), "duck_rows": len(d_rows), "spark_s": round(t1 - t0, 2),
           "duck_s": round(t2 - t1, 2)}
    if sorted(s_cols) != sorted(d_cols):
        out["error"] = f"columns differ: spark-only {set(s_cols) - set(d_cols)}, duck-only {set(d_cols) - set(s_cols)}"
        return out
    bad_types = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    if bad_types:
        out["type_mismatch"] = bad_types
    order = sorted(s_cols)
    si = [s_cols.index(c) for c in order]
    di = [d_cols.index(c) for c in order]
    key = lambda r: tuple((x is None, str(x)) for x in r)
    a = sorted((tuple(_norm(r[i]) for i in si) for r in s_rows), key=key)
    b = sorted((tuple(_norm(r[i]) for i in di) for r in d_rows), key=key)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:2]
        cols_diff = set()
        for x, y in zip(a, b):
            for c, u, v in zip(order, x, y):
                if u != v:
                    cols_diff.add(c)
        out["error"] = f"values differ in {sorted(cols_diff)[:8]}; e.g. {diffs[:1]}"
    return out


def main(argv):
    sf_dir = argv[1] if len(argv) > 1 and argv[1].startswith("/") else "/root/testdata/sf0.01"
    names = [a for a in argv[1:] if not a.startswith("/")]
    sys.path.insert(0, ".")
    from acqspark.session import build_session
    from acqspark.plans.registry import queries
    from acqspark.plans.oracle import oracle_sql
    spark = build_session()
    q, o = queries(), oracle_sql()
    con = duck(sf_dir)
    names = names or list(o)
    n_ok = 0
    for n in names:
        try:
            r = compare(spark, con, n, sf_dir, q[n], o[n])
        except Exception as e:  # report and go on
            r = {"name": n, "error": f"{type(e).__name__}: {str(e)[:400]}"}
        ok = "error" not in r and "type_mismatch" not in r
        n_ok += ok
        print(("OK  " if ok else "BAD ") + str(r), flush=True)
    print(f"{n_ok}/{len(names)} match")


if __name__ == "__main__":
    main(sys.argv)
