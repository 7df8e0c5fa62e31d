"""Run registered queries in Spark and their DuckDB twins; compare results.

    python tools/oracle_check.py [sf_dir] [name ...]

Comparison: same column names, same row count, and equal rows as a multiset
after rounding doubles to 9 significant digits.
"""

from __future__ import annotations

import math
import sys
import time

import duckdb

sys.path.insert(0, str(__import__("pathlib").Path(__file__).resolve().parents[1]))

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events", "documents",
          "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET TimeZone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from read_parquet('{sf_dir}/{t}.parquet')")
    return con


_SPARK2DUCK = {"LongType": "BIGINT", "IntegerType": "INTEGER", "DoubleType": "DOUBLE", "StringType": "VARCHAR",
               "DateType": "DATE", "BooleanType": "BOOLEAN", "TimestampNTZType": "TIMESTAMP",
               "FloatType": "FLOAT", "ShortType": "SMALLINT", "ByteType": "TINYINT"}


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return float(f"{v:.9g}")
    if hasattr(v, "isoformat"):
        return v.isoformat()
    if isinstance(v, (list, tuple)):
        return tuple(_norm(x) for x in v)
    if hasattr(v, "tolist"):
        return _norm(v.tolist())
    if isinstance(v, dict):
        return tuple(sorted((k, _norm(x)) for k, x in v.items()))
    return v


def rows_of(cols, rows):
    order = sorted(range(len(cols)), key=lambda i: cols[i])
    out = [tuple(_norm(r[i]) for i in order) for r in rows]
    return sorted(out, key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r))


def check(spark, con, q, sf_dir: str) -> tuple[bool, str]:
    t0 = time.time()
    sdf = q.build(spark, sf_dir)
    s_rows = [tuple(r) for r in sdf.collect()]
    s_cols = sdf.columns
    t1 = time.time()
    if q.sql is None:
        return True, f"rows={len(s_rows)} (no oracle) {t1 - t0:.1f}s"
    res = con.execute(q.sql)
    d_cols = [d[0] for d in res.description]
    d_rows = res.fetchall()
    if sorted(s_cols) != sorted(d_cols):
        return False, f"columns differ: spark={sorted(s_cols)} duck={sorted(d_cols)}"
    s_types = {f.name: _SPARK2DUCK.get(type(f.dataType).__name__, type(f.dataType).__name__) for f in sdf.schema.fields}
    d_types = {d[0]: str(d[1]) for d in res.description}
    tdiff = {c: (s_types[c], d_types[c]) for c in s_cols if s_types[c] != d_types[c]}
    if tdiff:
        return False, f"types differ: {tdiff}"
    if len(s_rows) != len(d_rows):
        return False, f"row count spark={len(s_rows)} duck={len(d_rows)}"
    a, b = rows_of(s_cols, s_rows), rows_of(d_cols, d_rows)
    if a != b:
        diffs = [(x, y) for x, y in zip(a, b) if x != y][:3]
        return False, f"values differ, first: {diffs}"
    return True, f"rows={len(s_rows)} spark {t1 - t0:.1f}s"


def main(argv):
    from postlens.plans.catalog import REGISTRY
    from postlens.session import local_session

    sf_dir = argv[1] if len(argv) > 1 else "/root/testdata/sf0.01"
    names = argv[2:] or list(REGISTRY)
    spark = local_session(8, 8)
    con = duck(sf_dir)
    bad = 0
    for n in names:
        q = REGISTRY[n]
        try:
            ok, msg = check(spark, con, q, sf_dir)
        except Exception as e:  # report and continue
            ok, msg = False, f"ERROR {type(e).__name__}: {str(e)[:400]}"
        bad += not ok
        print(f"{'OK ' if ok else 'BAD'} {n:40s} {msg}", flush=True)
    print(f"{len(names) - bad}/{len(names)} ok")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv))
