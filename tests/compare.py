"""Run queries beside their SQL: python tests/compare.py SF_DIR [NAME...]."""

import math
import os
import sys
import time
from pathlib import Path

import duckdb

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))


def plain(x):
    """A value that compares and sorts alike from either engine."""
    if isinstance(x, dict):
        return tuple(plain(v) for v in x.values())
    if isinstance(x, (list, tuple)):
        return tuple(map(plain, x))
    if isinstance(x, float):
        return None if math.isnan(x) else float(f"{x:.9g}")
    if isinstance(x, (bytearray, bytes)):
        return bytes(x)
    return x


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def oracle_rows(sf_dir: str, sql: str):
    con = duckdb.connect(config={"temp_directory": "", "memory_limit": "8GB"})
    for p in Path(sf_dir).iterdir():
        con.execute(f"CREATE VIEW {p.name.split('.')[0]} AS SELECT * FROM read_parquet('{p / '*' if p.is_dir() else p}')")
    done = con.execute(sql)
    return [c[0] for c in done.description], done.fetchall()


def same(spark, sf_dir: str, query, sql: str | None):
    """(equal or None without SQL, rows, seconds, first differences)."""
    began = time.time()
    df = query(spark, sf_dir)
    got = [tuple(r) for r in df.collect()]
    took = time.time() - began
    if sql is None:
        return None, len(got), took, []
    columns, rows = oracle_rows(sf_dir, sql)
    if sorted(columns) != sorted(df.columns):
        return False, len(got), took, [sorted(columns), sorted(df.columns)]
    a, b = rows_of(df.columns, got), rows_of(columns, rows)
    return a == b, len(got), took, [(x, y) for x, y in zip(a + [None], b + [None]) if x != y][:2]


def main() -> None:
    import __spark_entry__ as entry
    from corpuscle.session import local_session

    spark = local_session(int(os.environ.get("BENCH_CPUS", "8")))
    spark.sparkContext.setLogLevel("ERROR")
    queries, oracles = entry.queries(), entry.oracle_sql()
    for name in sys.argv[2:] or queries:
        try:
            equal, n, took, diff = same(spark, sys.argv[1], queries[name], oracles.get(name))
            print(f"{name:28} {'rows only' if equal is None else 'ok' if equal else 'DIFFERS'} {n} rows {took:.1f} s", *diff, flush=True)
        except Exception as e:
            print(f"{name:28} ERROR {str(e)[:1200]}", flush=True)


if __name__ == "__main__":
    main()
