"""Compare registered Spark queries with their DuckDB oracle (rows, columns, values)."""

from __future__ import annotations

import math
import os
import sys

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)

TABLES = ["region", "nation", "customer", "supplier", "part", "orders", "lineitem", "events",
          "documents", "embeddings", "pages", "benchmark", "labels", "conversations"]


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for t in TABLES:
        path = f"{sf_dir}/{t}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {t} AS SELECT * FROM read_parquet('{path}')")
    return con


def _norm(v):
    if isinstance(v, float):
        if math.isnan(v):
            return "nan"
        return round(v, 9)
    if hasattr(v, "item"):
        return _norm(v.item())
    return v


def canon(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    cols = [columns[i] for i in order]
    out = sorted((tuple(_norm(r[i]) for i in order) for r in rows), key=repr)
    return cols, out


def compare(spark, name: str, sf_dir: str, query, sql: str):
    df = query(spark, sf_dir)
    s_cols, s_rows = canon(df.columns, [tuple(r) for r in df.collect()])
    con = duck(sf_dir)
    rel = con.sql(sql)
    d_cols, d_rows = canon(rel.columns, rel.fetchall())
    problems = []
    if s_cols != d_cols:
        problems.append(f"columns spark={s_cols} duck={d_cols}")
    if len(s_rows) != len(d_rows):
        problems.append(f"rows spark={len(s_rows)} duck={len(d_rows)}")
    if not problems and s_rows != d_rows:
        diff = [(a, b) for a, b in zip(s_rows, d_rows) if a != b][:3]
        problems.append(f"values differ, e.g. {diff}")
    return problems, len(s_rows)


if __name__ == "__main__":
    import time
    from markscope.session import build_session
    import __spark_entry__ as E
    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    only = sys.argv[2:]
    spark = build_session("local[8]", 8)
    qs, oracle = E.queries(), E.oracle_sql()
    bad = 0
    for name, q in qs.items():
        if only and name not in only:
            continue
        t = time.time()
        if name not in oracle:
            n = q(spark, sf_dir).count()
            print(f"{name:24s} ROWS-ONLY rows={n} {time.time()-t:.1f}s", flush=True)
            continue
        try:
            problems, n = compare(spark, name, sf_dir, q, oracle[name])
        except Exception as e:  # report and continue
            problems, n = [f"ERROR {type(e).__name__}: {str(e)[:400]}"], -1
        bad += bool(problems)
        print(f"{name:24s} {'OK ' if not problems else 'BAD'} rows={n} {time.time()-t:.1f}s {problems}", flush=True)
    print("mismatches:", bad)
