"""Runs named queries on Spark and DuckDB and compares the rows."""

from __future__ import annotations

import datetime
import math

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings pages "
    "benchmark labels conversations"
).split()


def connect(sf_dir: str) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for name in TABLES:
        con.execute(f"CREATE VIEW {name} AS SELECT * FROM '{sf_dir}/{name}.parquet'")
    return con


def _cell(x):
    if isinstance(x, bool) or x is None:
        return x
    if isinstance(x, float):
        return None if math.isnan(x) else f"{x:.6f}"
    if isinstance(x, int):
        return f"{x:d}"
    if isinstance(x, datetime.datetime):
        return x.isoformat()
    return str(x)


def _key(row):
    return tuple((c is None, str(c)) for c in row)


def rows_of_spark(df):
    names = sorted(df.columns)
    return names, sorted((tuple(_cell(r[n]) for n in names) for r in df.collect()), key=_key)


def rows_of_duck(con, sql):
    cur = con.execute(sql)
    columns = [d[0] for d in cur.description]
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    rows = [tuple(_cell(r[i]) for i in order) for r in cur.fetchall()]
    return [columns[i] for i in order], sorted(rows, key=_key)


def difference(spark_df, con, sql) -> str | None:
    """None when equal, else a short account of the first difference."""
    names, left = rows_of_spark(spark_df)
    names2, right = rows_of_duck(con, sql)
    if names != names2:
        return f"columns {names} / {names2}"
    if len(left) != len(right):
        extra = sorted(set(left) - set(right))[:2], sorted(set(right) - set(left))[:2]
        return f"rows {len(left)} / {len(right)}; only left, only right: {extra}"
    wrong = [(a, b) for a, b in zip(left, right) if a != b]
    if wrong:
        return f"{len(wrong)} of {len(left)} rows differ; first {wrong[0]}"
    return None
