"""Typed CSV in and out, and the five source tables as files."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from profilum.schemas import SOURCES


def read_csv(spark: SparkSession, path: str, schema: str, strict: bool = True) -> DataFrame:
    """CSV with a header under an explicit schema; a bad row fails the job when ``strict``,
    otherwise it is kept in ``_bad_row``."""
    reader = spark.read.option("header", True).option("escape", '"').option("multiLine", False)
    if strict:
        return reader.option("mode", "FAILFAST").option("enforceSchema", False).schema(schema).csv(path)
    return reader.option("mode", "PERMISSIVE").option("columnNameOfCorruptRecord", "_bad_row").schema(f"{schema}, _bad_row string").csv(path)


def write_csv(frame: DataFrame, path: str, mode: str = "errorifexists") -> None:
    frame.write.mode(mode).option("header", True).option("escape", '"').csv(path)


def load_sources(spark: SparkSession, folder: str, tables: dict[str, str] = SOURCES) -> dict[str, DataFrame]:
    """The source tables out of ``<folder>/<table>.csv`` under their schemas."""
    return {name: read_csv(spark, f"{folder}/{name}.csv", schema) for name, schema in tables.items()}


def save_sources(frames: dict[str, DataFrame], folder: str, mode: str = "errorifexists") -> None:
    """The source tables as ``<folder>/<table>.csv``."""
    for name, frame in frames.items():
        write_csv(frame, f"{folder}/{name}.csv", mode)
