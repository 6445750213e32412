"""Comparison of a named query with its SQL: names, types of values and all rows."""

from __future__ import annotations

import datetime
import decimal
import glob
import math
import os

import duckdb


def connect(folder: str) -> duckdb.DuckDBPyConnection:
    connection = duckdb.connect()
    for path in glob.glob(f"{folder}/*.parquet"):
        connection.execute(f"CREATE VIEW {os.path.basename(path)[:-8]} AS SELECT * FROM '{path}'")
    return connection


def _plain(value):
    if isinstance(value, bool) or value is None:
        return value
    if isinstance(value, float):
        return "nan" if math.isnan(value) else value + 0.0
    if isinstance(value, decimal.Decimal):
        return ("decimal", str(value))
    if isinstance(value, datetime.datetime):
        return value.replace(tzinfo=None).isoformat()
    if isinstance(value, datetime.date):
        return value.isoformat()
    return value


def _table(names: list[str], rows: list[tuple]) -> list[tuple]:
    order = sorted(range(len(names)), key=lambda i: names[i])
    return sorted((tuple(_plain(row[i]) for i in order) for row in rows), key=repr)


def compare(frame, connection, sql: str) -> str | None:
    """None when equal, otherwise the first difference."""
    result = connection.execute(sql)
    names = [column[0] for column in result.description]
    expected = _table(names, result.fetchall())
    if sorted(frame.columns) != sorted(names):
        return f"columns differ: {sorted(frame.columns)} and {sorted(names)}"
    actual = _table(frame.columns, [tuple(row) for row in frame.collect()])
    if len(actual) != len(expected):
        return f"{len(actual)} rows, expected {len(expected)}"
    for mine, theirs in zip(actual, expected):
        if repr(mine) != repr(theirs):
            parts = [(name, a, b) for name, a, b in zip(sorted(names), mine, theirs) if repr(a) != repr(b)]
            return f"{sum(repr(a) != repr(b) for a, b in zip(actual, expected))} rows differ, first: {str(parts)[:700]}"
    return None
