"""Runs registered queries next to their SQL and compares names, types, rows and values."""

from __future__ import annotations

import sys
import time
from pathlib import Path

sys.path.insert(0, str(Path(__file__).resolve().parents[1]))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()
TYPES = {
    "bigint": "BIGINT",
    "int": "INTEGER",
    "double": "DOUBLE",
    "string": "VARCHAR",
    "boolean": "BOOLEAN",
}


def connect(folder: str):
    import duckdb

    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet'")
    return con


def compare(df, sql: str, con) -> str | None:
    """None where both agree, else what differs."""
    rel = con.sql(sql)
    want_types = {n: str(t) for n, t in zip(rel.columns, rel.types)}
    have_types = {n: TYPES.get(t, t) for n, t in df.dtypes}
    if want_types != have_types:
        return f"types: spark {have_types}, sql {want_types}"
    names = sorted(want_types)
    have = sorted(map(repr, (tuple(r[n] for n in names) for r in df.collect())))
    order = [rel.columns.index(n) for n in names]
    want = sorted(map(repr, (tuple(r[i] for i in order) for r in rel.fetchall())))
    if len(have) != len(want):
        return f"rows: spark {len(have)}, sql {len(want)}"
    wrong = [(a, b) for a, b in zip(have, want) if a != b]
    return f"{len(wrong)} values differ, first {wrong[0]}" if wrong else None


def main() -> int:
    import __spark_entry__ as entry
    from keytally.session import build_session

    folder = "/root/testdata/sf0.01"
    pick = sys.argv[1:]
    spark = build_session("local[8]")
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    sql = entry.oracle_sql()
    bad = 0
    for name, query in entry.queries().items():
        if pick and not any(p in name for p in pick):
            continue
        start = time.time()
        try:
            df = query(spark, folder)
            if name in sql:
                fault = compare(df, sql[name], con)
            else:
                fault = None if df.count() else "no rows"
        except Exception as e:
            fault = f"{type(e).__name__}: {str(e)[:600]}"
        bad += fault is not None
        print(f"{name:36s} {time.time() - start:6.2f}s {'ok' if not fault else fault}", flush=True)
    print(f"{bad} faults")
    return bad


if __name__ == "__main__":
    raise SystemExit(main())
