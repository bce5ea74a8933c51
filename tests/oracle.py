"""Rows of a query and of its SQL in a form that compares across engines."""

import math
from pathlib import Path

import duckdb

SF = "/root/testdata/sf0.001"


def connect(sf_dir: str = SF) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    con.execute("SET timezone = 'UTC'")
    for p in Path(sf_dir).glob("*.parquet"):
        con.execute(f"CREATE VIEW {p.stem} AS SELECT * FROM read_parquet('{p / '*.parquet' if p.is_dir() else p}')")
    return con


def plain(value):
    if value is None or isinstance(value, float) and math.isnan(value):
        return None
    if isinstance(value, bool) or isinstance(value, str):
        return value
    if isinstance(value, int | float):
        return float(value)
    return str(value)


def table(columns, rows):
    order = sorted(range(len(columns)), key=lambda i: columns[i])
    return [columns[i] for i in order], sorted((tuple(plain(r[i]) for i in order) for r in rows), key=repr)


def of_frame(df):
    return table(df.columns, [tuple(r) for r in df.collect()])


def of_sql(con, sql):
    found = con.sql(sql)
    return table(found.columns, found.fetchall())
