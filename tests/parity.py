"""Comparison of a query with its SQL equivalent on the same tables."""

import decimal
from pathlib import Path

import duckdb

DATA = "/root/testdata/sf0.001"


def connect(folder: str = DATA) -> duckdb.DuckDBPyConnection:
    con = duckdb.connect()
    for file in Path(folder).glob("*.parquet"):
        con.sql(f"create view {file.stem} as select * from '{file}'")
    return con


def plain(value):
    if isinstance(value, float | decimal.Decimal):
        return round(float(value), 6)
    if isinstance(value, list):
        return tuple(map(plain, value))
    return value


def rows_of(df) -> list[tuple]:
    columns = sorted(df.columns)
    return sorted((tuple(plain(row[c]) for c in columns) for row in df.collect()), key=repr)


def rows_of_sql(con, sql: str) -> tuple[list[str], list[tuple]]:
    result = con.sql(sql)
    columns = sorted(result.columns)
    at = [result.columns.index(c) for c in columns]
    return columns, sorted((tuple(plain(row[i]) for i in at) for row in result.fetchall()), key=repr)
