"""The document store: insert-only merges, column updates and the partitioned layout.

Parquet has no MERGE, so a merge is a join that yields the rows to append or the next version of
the table. A version is written whole to a new folder and never over the one being read.
"""

from __future__ import annotations

import uuid

from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.operators.metrics import top_per_group
from profilum.session import fresh_path


def latest_per_key(rows: DataFrame, key: str, order: list[Column]) -> DataFrame:
    """One row per key, the first under ``order``; copies are dropped before the shuffle."""
    return top_per_group(rows, [key], order, 1, "_rank").drop("_rank")


def missing_rows(target: DataFrame, source: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """Source rows whose key the target lacks, once per key. Copies are dropped before the join, so
    that a key repeated in much of the source does not meet the target in one task."""
    return latest_per_key(source, key, order or [F.col(key)]).join(target.select(key), key, "left_anti")


def merge_insert(target: DataFrame, source: DataFrame, key: str, order: list[Column] | None = None) -> DataFrame:
    """The target with unseen source rows added; known rows stay as they are."""
    return target.unionByName(missing_rows(target, source, key, order), allowMissingColumns=True)


def append_missing(spark: SparkSession, path: str, source: DataFrame, key: str, order: list[Column] | None = None) -> None:
    """Append the unseen rows of ``source`` to a parquet table."""
    missing_rows(spark.read.parquet(path), source, key, order).write.mode("append").parquet(path)


def merge_update(target: DataFrame, updates: DataFrame, key: str, columns: list[str], order: list[Column] | None = None) -> DataFrame:
    """The target with ``columns`` replaced where an update exists; updates never add rows."""
    renamed = latest_per_key(updates, key, order or [F.col(key)]).select(
        F.col(key), *[F.col(name).alias(f"_new_{name}") for name in columns], F.lit(True).alias("_updated")
    )
    joined = target.join(renamed, key, "left")
    kept = [
        F.when(F.col("_updated"), F.col(f"_new_{name}")).otherwise(F.col(name) if name in target.columns else F.lit(None)).alias(name)
        if name in columns
        else F.col(name)
        for name in [*target.columns, *[name for name in columns if name not in target.columns]]
    ]
    return joined.select(*kept)


def write_version(frame: DataFrame, name: str) -> DataFrame:
    """Write a table to a new folder of the shared folder and read it back."""
    spark = frame.sparkSession
    path = fresh_path(spark, name)
    frame.write.parquet(path)
    return spark.read.schema(frame.schema).parquet(path)


def commit(frame: DataFrame, root: str) -> int:
    """Write a table as the next current version under ``root``; its number. The version is whole before the log
    names it, and earlier versions stay as they are."""
    spark = frame.sparkSession
    number = (_newest(spark, root) or (0, ""))[0] + 1
    path = f"{root}/version-{number}-{uuid.uuid4().hex}"
    frame.write.parquet(path)
    # Of two writers of the same number the second fails.
    spark.createDataFrame([(path,)], "path string").coalesce(1).write.mode("errorifexists").parquet(f"{root}/log/number={number}")
    return number


def current(spark: SparkSession, root: str) -> DataFrame | None:
    """The version committed last, or None."""
    newest = _newest(spark, root)
    return spark.read.parquet(newest[1]) if newest else None


def version(spark: SparkSession, root: str, number: int) -> DataFrame:
    """An earlier version by its number."""
    path = spark.read.schema(LOG).parquet(f"{root}/log").filter(F.col("number") == number).first().path
    return spark.read.parquet(path)


LOG = "number bigint, path string"


def _newest(spark: SparkSession, root: str) -> tuple[int, str] | None:
    try:
        row = spark.read.schema(LOG).parquet(f"{root}/log").orderBy(F.desc("number"), F.desc("path")).first()
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return None
    return (row.number, row.path) if row else None


def write_partitioned(frame: DataFrame, path: str, day_of: str = "created_at", cluster: tuple[str, ...] = ("customer_email", "status")) -> None:
    """Write by creation date, clustered inside the files.

    The rebalance hint sizes the writing tasks at run time: small dates share one and a date that
    holds much of the table is split over several files.
    """
    dated = frame.withColumn("created_date", F.to_date(day_of))
    dated.hint("rebalance", F.col("created_date")).sortWithinPartitions("created_date", *cluster).write.partitionBy("created_date").parquet(path)


def write_clustered(frame: DataFrame, path: str, key: str, day_of: str = "created_at", cluster: tuple[str, ...] = ("customer_email", "status"), row_group_bytes: int = 16 << 20) -> None:
    """Write by creation date so that files and row groups hold ranges of the cluster columns.

    The whole table is ordered in ranges of date, cluster columns and key, found from a sample (a second pass over
    those columns). A reader that asks for a value of the first cluster column skips files and row groups by their
    bounds, and by a Bloom filter of that column where bounds overlap. The key splits a value that holds much of a
    date. Rows with a null in ``day_of`` go to the default partition.
    """
    dated = frame.withColumn("created_date", F.to_date(day_of))
    order = ["created_date", *cluster, key]
    writer = dated.repartitionByRange(*order).sortWithinPartitions(*order).write.partitionBy("created_date")
    writer.option(f"parquet.bloom.filter.enabled#{cluster[0]}", "true").option("parquet.block.size", row_group_bytes).parquet(path)
