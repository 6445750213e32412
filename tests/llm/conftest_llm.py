"""Tables read without Spark, for brute-force versions."""

import duckdb


def rows(folder, table, columns):
    return duckdb.sql(f"SELECT {columns} FROM '/root/testdata/{folder}/{table}.parquet'").fetchall()


def documents(folder):
    return rows(folder, "documents", "doc_id, text")
