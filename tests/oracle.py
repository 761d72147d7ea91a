"""Run registered queries against their DuckDB oracles on the same Parquet tables.

Usage: python -m tests.oracle [sf_dir] [key ...]
"""

from __future__ import annotations

import datetime as dt
import decimal
import os
import sys
import time

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _plain(value):
    if isinstance(value, dt.datetime):
        return value.isoformat()
    if isinstance(value, dt.date):
        return value.isoformat()
    if isinstance(value, decimal.Decimal):
        return f"decimal {value}"
    return value


def normal(columns: list[str], rows) -> list[str]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(repr([_plain(row[i]) for i in order]) for row in rows)


def compare(spark, con, key: str, build, sql: str, sf_dir: str) -> tuple[bool, str]:
    df = build(spark, sf_dir)
    got_columns, got = df.columns, [tuple(r) for r in df.collect()]
    cursor = con.execute(sql)
    want_columns = [d[0] for d in cursor.description]
    want = cursor.fetchall()
    if sorted(got_columns) != sorted(want_columns):
        return False, f"columns {sorted(got_columns)} / {sorted(want_columns)}"
    a, b = normal(got_columns, got), normal(want_columns, want)
    if len(a) != len(b):
        return False, f"rows {len(a)} / {len(b)}"
    for x, y in zip(a, b):
        if x != y:
            return False, f"\n   spark  {x[:400]}\n   oracle {y[:400]}"
    return True, f"{len(a)} rows"


def main(argv: list[str]) -> int:
    sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    import __spark_entry__ as entry
    from garbline.session import local_session

    sf_dir = argv[0] if argv else "/root/testdata/sf0.01"
    spark = local_session()
    con = connect(sf_dir)
    builders, oracles = entry.queries(), entry.oracle_sql()
    bad = []
    for key in argv[1:] or list(builders):
        start = time.time()
        try:
            if key in oracles:
                ok, note = compare(spark, con, key, builders[key], oracles[key], sf_dir)
            else:
                ok, note = True, f"{len(builders[key](spark, sf_dir).collect())} rows, no oracle"
        except Exception as error:  # noqa: BLE001 - report and go on
            ok, note = False, f"{type(error).__name__}: {str(error)[:600]}"
        print(f"{'ok  ' if ok else 'FAIL'} {key:28s} {time.time() - start:6.2f}s  {note}", flush=True)
        if not ok:
            bad.append(key)
    print(f"{len(bad)} failures: {bad}")
    return 1 if bad else 0


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
