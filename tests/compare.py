"""Compare every registered query with its checking SQL: ``python tests/compare.py [sf_dir] [name | prefix* ...]``."""

from __future__ import annotations

import datetime as dt
import math
import os
import sys
import time

import duckdb

ROOT = os.path.dirname(os.path.dirname(os.path.abspath(__file__)))
sys.path.insert(0, ROOT)
TABLES = ("region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
          "conversations").split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for table in TABLES:
        con.execute(f"CREATE VIEW {table} AS SELECT * FROM '{sf_dir}/{table}.parquet'")
    return con


def normal(value):
    """Plain values; integers and floats stay apart, and so do dates and timestamps."""
    if isinstance(value, float):
        return None if math.isnan(value) else value + 0.0
    if isinstance(value, dt.datetime):
        return value.replace(tzinfo=None)
    return value


def sorted_rows(names: list[str], rows) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    plain = [tuple(normal(r[i]) for i in order) for r in rows]
    return sorted(plain, key=lambda r: tuple((v is None, str(type(v)), v if v is not None else 0) for v in r))


def difference(df, con, sql: str) -> str | None:
    """None when equal, else a short account."""
    got_names, got = df.columns, [tuple(r) for r in df.collect()]
    con.execute(sql)
    want_names, want = [d[0] for d in con.description], con.fetchall()
    if sorted(got_names) != sorted(want_names):
        return f"columns {sorted(set(got_names) ^ set(want_names))}"
    if len(got) != len(want):
        return f"{len(got)} rows, expected {len(want)}"
    a, b = sorted_rows(got_names, got), sorted_rows(want_names, want)
    bad = [(x, y) for x, y in zip(a, b) if x != y or [type(v) for v in x] != [type(v) for v in y]]
    return None if not bad else f"{len(bad)} rows differ, first {bad[0]} (columns {sorted(got_names)})"


def main() -> int:
    from __spark_entry__ import oracle_sql, queries
    from ledgerscope.session import build_session

    args = sys.argv[1:]
    sf_dir = args[0] if args and args[0].startswith("/") else "/root/testdata/sf0.01"
    parts = [a for a in args if not a.startswith("/")]
    spark = build_session("compare", master="local[4]", shuffle_partitions=8)
    spark.sparkContext.setLogLevel("ERROR")
    con, sql, failed = connect(sf_dir), oracle_sql(), 0
    for name, build in queries().items():
        if parts and not any(p == name or (p.endswith("*") and name.startswith(p[:-1])) for p in parts):
            continue
        started = time.perf_counter()
        try:
            df = build(spark, sf_dir)
            found = difference(df, con, sql[name]) if name in sql else None
            note = "ok" if name in sql else f"rows only: {len(df.collect())}"
        except Exception as exc:
            causes = [line.strip() for line in str(exc).splitlines() if "Caused by" in line or "- object" in line or "- field" in line]
            found = f"{type(exc).__name__}: {str(exc)[:300]} {causes[:12]}"
        seconds = time.perf_counter() - started
        failed += found is not None
        print(f"{'FAIL' if found else 'pass'} {seconds:6.2f}s {name} {found or note}", flush=True)
    unmatched = sorted(set(sql) - set(queries()))
    print("failed:", failed, "SQL without query:", unmatched)
    return 1 if failed or unmatched else 0


if __name__ == "__main__":
    raise SystemExit(main())
