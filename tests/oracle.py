"""Runs queries next to their SQL and compares rows. ``python tests/oracle.py [sf] [name part ...]``"""

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
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark "
    "labels conversations"
).split()


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{folder}/{name}.parquet')")
    return con


def _plain(v):
    if isinstance(v, decimal.Decimal):
        return f"decimal {v}"
    if isinstance(v, float):
        return "nan" if math.isnan(v) else repr(v + 0.0)
    if isinstance(v, datetime.datetime):
        return v.isoformat()
    return v


def rows_of(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(
        (tuple(_plain(r[i]) for i in order) for r in rows), key=lambda r: tuple((x is None, str(type(x)), str(x)) for x in r)
    )


KINDS = {
    "bigint": "BIGINT", "int": "INTEGER", "double": "DOUBLE", "string": "VARCHAR", "boolean": "BOOLEAN",
    "float": "FLOAT",
}


def compare(df, con, text: str) -> str:
    """Empty when equal, else what differs."""
    cur = con.execute(text)
    names = [d[0] for d in cur.description]
    types = dict(zip(names, [str(d[1]) for d in cur.description]))
    want = rows_of(names, cur.fetchall())
    got = rows_of(df.columns, [tuple(r) for r in df.collect()])
    if sorted(names) != sorted(df.columns):
        return f"columns {sorted(df.columns)} != {sorted(names)}"
    bad = [(c, k, types[c]) for c, k in df.dtypes if KINDS.get(k, k) != types[c]]
    if got != want:
        extra = [r for r in got if r not in want][:3] if len(got) < 5000 else []
        lack = [r for r in want if r not in got][:3] if len(got) < 5000 else []
        return f"rows {len(got)} vs {len(want)}; only spark {extra}; only sql {lack}"
    return f"types {bad}" if bad else ""


def main(argv):
    from labelflow.catalog import ORACLES, QUERIES
    from labelflow.session import get_spark

    sf = argv[0] if argv else "0.01"
    wanted = argv[1:]
    folder = f"/root/testdata/sf{sf}"
    spark = get_spark()
    spark.sparkContext.setLogLevel("ERROR")
    con = connect(folder)
    failed = 0
    for name, fn in QUERIES.items():
        if wanted and not any(w in name for w in wanted):
            continue
        start = time.time()
        try:
            df = fn(spark, folder)
            problem = compare(df, con, ORACLES[name]) if name in ORACLES else f"rows only: {df.count()}"
        except Exception as e:  # noqa: BLE001 - reported
            problem = f"{type(e).__name__}: {str(e)[:600]}"
        ok = problem == "" or problem.startswith("rows only")
        failed += not ok
        print(f"{'ok  ' if ok else 'FAIL'} {time.time() - start:6.2f}s {name} {problem}", flush=True)
    print("failed:", failed)
    return failed


if __name__ == "__main__":
    sys.exit(main(sys.argv[1:]))
