"""Runs registered queries next to their SQL twins and compares whole results.

``python tests/compare.py [sf_dir] [name-prefix ...]`` prints one line per query.
"""

from __future__ import annotations

import datetime
import decimal
import math
import os
import sys
import time

import duckdb

sys.path.insert(0, os.path.dirname(os.path.dirname(os.path.abspath(__file__))))

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels "
    "conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("set timezone = 'UTC'")
    for t in TABLES:
        con.execute(f"create view {t} as select * from '{sf_dir}/{t}.parquet'")
    return con


def plain(v):
    if v is None or isinstance(v, (str, bool, bytes)):
        return v
    if isinstance(v, decimal.Decimal):
        return float(v)
    if isinstance(v, float):
        return "nan" if math.isnan(v) else v + 0.0
    if isinstance(v, (datetime.date, datetime.datetime)):
        return str(v)
    if isinstance(v, dict):
        return tuple(sorted((k, plain(x)) for k, x in v.items()))
    if isinstance(v, (list, tuple)):
        return tuple(plain(x) for x in v)
    return v


def table(columns: list[str], rows) -> tuple[list[str], list[tuple]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    out = [tuple(plain(r[i]) for i in order) for r in rows]
    return [columns[i] for i in order], sorted(out, key=repr)


def compare(spark, con, query, sql: str | None, sf_dir: str) -> tuple[bool, str]:
    df = query(spark, sf_dir)
    columns, rows = table(df.columns, df.collect())
    if sql is None:
        return True, f"{len(rows)} rows, no SQL twin"
    cursor = con.execute(sql)
    want_columns, want = table([d[0] for d in cursor.description], cursor.fetchall())
    if columns != want_columns:
        return False, f"columns {columns} against {want_columns}"
    if len(rows) != len(want):
        return False, f"{len(rows)} rows against {len(want)}"
    different = [(a, b) for a, b in zip(rows, want) if a != b]
    if different:
        a, b = different[0]
        cells = [(c, x, y) for c, x, y in zip(columns, a, b) if x != y]
        return False, f"{len(different)} rows differ, first: {str(cells)[:300]}"
    return True, f"{len(rows)} rows"


def main() -> None:
    from __spark_entry__ import oracle_sql, queries
    from flowloom.session import local_session

    sf_dir = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    prefixes = tuple(sys.argv[2:])
    spark = local_session(cores="8")
    con = connect(sf_dir)
    sqls = oracle_sql()
    bad = 0
    for name, query in queries().items():
        if prefixes and not name.startswith(prefixes):
            continue
        start = time.time()
        try:
            ok, note = compare(spark, con, query, sqls.get(name), sf_dir)
        except Exception as e:  # a broken query must not hide the others
            ok, note = False, f"{type(e).__name__}: {str(e)[:600]}"
        bad += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {name} {time.time() - start:.2f}s {note}", flush=True)
    print(f"{bad} failed")


if __name__ == "__main__":
    main()
