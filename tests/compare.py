"""Run registered queries and their SQL side by side: python -m tests.compare [sf_dir] [name ...]"""

from __future__ import annotations

import math
import os
import sys
import time

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = os.path.join(sf_dir, f"{name}.parquet")
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def _cell(value):
    if value is None or value is pd.NA or (isinstance(value, float) and math.isnan(value)):
        return ""
    if isinstance(value, float) and value == int(value):
        return str(int(value))
    return str(value)


def rows_of(frame) -> list[tuple]:
    frame = frame[sorted(frame.columns)]
    return sorted(tuple(_cell(v) for v in row) for row in frame.itertuples(index=False, name=None))


def compare(spark, con, name: str, sf_dir: str) -> str:
    from __spark_entry__ import oracle_sql, queries

    started = time.time()
    actual = queries()[name](spark, sf_dir).toPandas()
    spent = time.time() - started
    sql = oracle_sql().get(name)
    if sql is None:
        return f"rows {len(actual)} ({spent:.1f}s)"
    started = time.time()
    expected = con.execute(sql).fetchdf()
    took = time.time() - started
    if sorted(actual.columns) != sorted(expected.columns):
        return f"COLUMNS {sorted(actual.columns)} {sorted(expected.columns)}"
    a, e = rows_of(actual), rows_of(expected)
    if a == e:
        return f"ok {len(a)} ({spent:.1f}s, sql {took:.1f}s)"
    only_a, only_e = set(a) - set(e), set(e) - set(a)
    return f"DIFFERENT {len(a)} {len(e)}\n  spark {sorted(only_a)[:3]}\n  sql   {sorted(only_e)[:3]}"


if __name__ == "__main__":
    from __spark_entry__ import queries
    from logtrends.session import build_session

    sf = sys.argv[1] if len(sys.argv) > 1 else "/root/testdata/sf0.01"
    session = build_session()
    session.sparkContext.setLogLevel("ERROR")
    connection = connect(sf)
    for key in sys.argv[2:] or list(queries()):
        try:
            print(f"{key:26s}", compare(session, connection, key, sf)[:3000], flush=True)
        except Exception as error:  # show every key
            print(f"{key:26s} ERROR {type(error).__name__} {str(error)[:1500]}", flush=True)
