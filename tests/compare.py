"""Spark and DuckDB results side by side."""

from __future__ import annotations

import math
from pathlib import Path

import duckdb

TABLES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


def duck(sf_dir: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for name in TABLES:
        path = Path(sf_dir) / f"{name}.parquet"
        connection.execute(f"CREATE VIEW {name} AS SELECT * FROM read_parquet('{path}')")
    return connection


def _cell(value):
    if isinstance(value, float):
        return None if math.isnan(value) else value
    return value


def rows_by_name(columns, rows):
    order = sorted(range(len(columns)), key=lambda place: columns[place])
    names = [columns[place] for place in order]
    cells = [tuple(_cell(row[place]) for place in order) for row in rows]
    return names, sorted(cells, key=lambda row: tuple((cell is None, str(type(cell)), str(cell)) for cell in row))


def spark_rows(df):
    return rows_by_name(df.columns, [tuple(row) for row in df.collect()])


def duck_rows(connection, sql):
    result = connection.execute(sql)
    return rows_by_name([column[0] for column in result.description], result.fetchall())
