"""Column names for intermediate columns that a table does not have yet."""

from __future__ import annotations

from pyspark.sql import DataFrame


def unused(table: DataFrame, name: str) -> str:
    taken = {column.lower() for column in table.columns}
    while name.lower() in taken:
        name = f"_{name}"
    return name
