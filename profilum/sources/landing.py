"""Loading landed extracts of the upstream tables into store tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.fixed_values import LANDED_TABLES
from profilum.sources.store import merge_insert


def landed_tables(spark) -> DataFrame:
    """The upstream tables that feed the lake and how often they sync."""
    rows = [(source, table, minutes) for source, (minutes, tables) in LANDED_TABLES.items() for table in (tables or ["*"])]
    return spark.createDataFrame(rows, "source string, table string, sync_minutes int")


def incremental_load(target: DataFrame, landings: list[DataFrame], key: str, order: list[Column] | None = None) -> DataFrame:
    """Apply landings one after the other: a key keeps the row of the landing that brought it first."""
    numbered = [landing.withColumn("_landing", F.lit(number)) for number, landing in enumerate(landings)]
    arrived = numbered[0]
    for landing in numbered[1:]:
        arrived = arrived.unionByName(landing)
    return merge_insert(target, arrived, key, [F.col("_landing"), *(order or [])]).drop("_landing")
