"""Compare a query with its SQL: row count, column names, values in any order."""

from __future__ import annotations

import datetime
import math
import os

import duckdb
import pandas as pd

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        path = f"{sf_dir}/{name}.parquet"
        if os.path.exists(path):
            con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{path}'")
    return con


def cell(value) -> str:
    if value is None or value is pd.NaT:
        return "null"
    if isinstance(value, bool):
        return str(value)
    if isinstance(value, float):
        return "nan" if math.isnan(value) else repr(value + 0.0)
    if isinstance(value, (bytes, bytearray)):
        return bytes(value).hex()
    if isinstance(value, datetime.datetime):
        return value.isoformat()
    return str(value)


def rows_of(columns, records) -> list[tuple[str, ...]]:
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return sorted(tuple(cell(r[i]) for i in order) for r in records)


def compare(spark, con, sf_dir, name, run, sql) -> str | None:
    """None if equal, else a short description of the difference."""
    df = run(spark, sf_dir)
    got_columns = df.columns
    got = rows_of(got_columns, [tuple(r) for r in df.collect()])
    result = con.execute(sql)
    want_columns = [d[0] for d in result.description]
    want = rows_of(want_columns, result.fetchall())
    if sorted(got_columns) != sorted(want_columns):
        return f"columns {sorted(got_columns)} against {sorted(want_columns)}"
    if len(got) != len(want):
        return f"{len(got)} rows against {len(want)}; first {got[:2]} against {want[:2]}"
    if got != want:
        odd = [(a, b) for a, b in zip(got, want) if a != b]
        return f"{len(odd)} of {len(got)} rows differ in {sorted(got_columns)}: {odd[:2]}"
    return None
