"""A stored table in key-hash buckets whose merges write only what changes.

A version is a small table that lists, per bucket, the folders that hold its rows: one base and later deltas. A row of a
later folder replaces those of the same key before it. An update writes the changed rows of the buckets it touches as
a delta, an insert the new rows; nothing else is read or written, and earlier versions stay readable as they were.
``compact`` joins folders again.

Each bucket has a Bloom filter of its keys, kept with the version. An insert asks it first: rows it does not know
are new without a look at the table, and only the others meet the keys of their buckets.

Null keys are no keys: rows with one are refused by updates and inserts and kept as they are at creation.
"""

from __future__ import annotations

import uuid

import numpy as np
from pyspark.errors import AnalysisException
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.functions.membership import KeyFilter, word_rows
from profilum.sources.store import latest_per_key, write_version

BUCKETS, FILTER_BITS = 64, 1 << 18
_FOLDERS = "bucket int, place int, path string"


def bucket_of(key: str) -> Column:
    return F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")


class BucketTable:
    """The table under ``root``; ``number`` is the version read, the newest if not given."""

    def __init__(self, spark: SparkSession, root: str, key: str, schema: str, number: int | None = None) -> None:
        self.spark, self.root, self.key, self.schema = spark, root.rstrip("/"), key, schema
        self.number = self._newest() if number is None else number

    @classmethod
    def create(cls, frame: DataFrame, root: str, key: str) -> BucketTable:
        """Store a table with one row per key as version 0."""
        schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in frame.schema)
        table = cls(frame.sparkSession, root, key, schema, -1)
        folder = table._write(frame)
        table._commit([(bucket, 0, folder) for bucket in range(BUCKETS)], folder, None)
        return table

    def rows(self, buckets: list[int] | None = None, columns: list[str] | None = None) -> DataFrame:
        """The rows of this version, or of some of its buckets: a row of the newest folder that has its key."""
        listed = [row for row in self._folders() if buckets is None or row.bucket in buckets]
        by_place: dict[int, list] = {}
        for row in listed:
            by_place.setdefault(row.place, []).append(row)
        result = None
        # From the newest folder of each bucket back; at most as many steps as merges since the last compaction.
        for place in sorted(by_place, reverse=True):
            part = self._read(by_place[place])
            if result is None:
                result = part
            else:
                result = result.unionByName(part.join(result.select(self.key), self.key, "left_anti"))
        empty = self.spark.createDataFrame([], self.schema)
        result = empty if result is None else result
        return result.select(*columns) if columns else result

    def update(self, updates: DataFrame, columns: list[str], order: list[Column] | None = None) -> BucketTable:
        """The next version, with ``columns`` of known keys replaced; the first update of a key under ``order`` counts."""
        single = latest_per_key(updates.where(F.col(self.key).isNotNull()), self.key, order or [F.col(self.key)])
        renamed = write_version(single.select(self.key, *[F.col(name).alias(f"_new_{name}") for name in columns]), "updates")
        touched = self._touched(renamed)
        known = self.rows(touched).join(renamed, self.key)
        kinds = {field.name: field.dataType for field in self.spark.createDataFrame([], self.schema).schema}
        changed = known.select(*[F.col(f"_new_{name}").cast(kind).alias(name) if name in columns else F.col(f"`{name}`") for name, kind in kinds.items()])
        return self._append(changed, touched)

    def insert_missing(self, source: DataFrame, order: list[Column] | None = None) -> BucketTable:
        """The next version, with the rows of unknown keys added once each; known rows stay."""
        single = latest_per_key(source.where(F.col(self.key).isNotNull()), self.key, order or [F.col(self.key)])
        single = write_version(single.withColumn("_bucket", bucket_of(self.key)), "arrived")
        touched = self._touched(single)
        maybe = self._filter(touched).holds(self.spark, F.col(self.key), part=F.col("_bucket"), bits=FILTER_BITS)
        # The filter is asked again where its answer is needed, which reads a key; rows written with it would be written twice.
        doubtful = single.where(maybe)
        # Only buckets with a doubtful row are read at all.
        known = self.rows(self._touched(doubtful), [self.key])
        fresh = single.where(~maybe).unionByName(doubtful.join(known, self.key, "left_anti"))
        return self._append(fresh.select(*self._names()), touched)

    def fold(self, partial: DataFrame, sums: list[str], maxima: list[str]) -> BucketTable:
        """The next version, with partial results, one row per key, added to the rows of their keys. Other columns follow from the key."""
        arrived = write_version(partial.where(F.col(self.key).isNotNull()).select(*self._names()), "partials")
        touched = self._touched(arrived)
        known = self.rows(touched).join(arrived.select(self.key), self.key, "left_semi").select(*self._names())
        merged = [F.sum(name).alias(name) for name in sums] + [F.max(name).alias(name) for name in maxima]
        others = [F.any_value(F.col(name)).alias(name) for name in self._names() if name not in {self.key, *sums, *maxima}]
        combined = known.unionByName(arrived).groupBy(self.key).agg(*merged, *others)
        return self._append(combined.select(*[F.col(column.name).cast(column.dataType) for column in arrived.schema]), touched)

    def added(self) -> DataFrame:
        """The rows that this version wrote: all of version 0, the delta of a merge, none of a compaction."""
        before = BucketTable(self.spark, self.root, self.key, self.schema, self.number - 1)._folders()
        last = max((row.place for row in before), default=-1)
        fresh = [row for row in self._folders() if row.place > last]
        return self._read(fresh) if fresh else self.spark.createDataFrame([], self.schema)

    def compact(self) -> BucketTable:
        """The next version, with one folder per bucket."""
        folder = self._write(self.rows())
        following = BucketTable(self.spark, self.root, self.key, self.schema, self.number)
        following._commit([(bucket, 0, folder) for bucket in range(BUCKETS)], folder, None)
        return following

    def _append(self, rows: DataFrame, touched: list[int]) -> BucketTable:
        folder = self._write(rows)
        listed = [(row.bucket, row.place, row.path) for row in self._folders()]
        last = max((place for _, place, _ in listed), default=-1)
        following = BucketTable(self.spark, self.root, self.key, self.schema, self.number)
        following._commit([*listed, *[(bucket, last + 1, folder) for bucket in touched]], folder, touched)
        return following

    def _names(self) -> list[str]:
        return self.spark.createDataFrame([], self.schema).columns

    def _touched(self, rows: DataFrame) -> list[int]:
        # At most one row per bucket.
        return sorted(row.bucket for row in rows.select(bucket_of(self.key).alias("bucket")).distinct().collect())

    def _write(self, rows: DataFrame) -> str:
        path = f"{self.root}/rows/{uuid.uuid4().hex}"
        rows.withColumn("_bucket", bucket_of(self.key)).hint("rebalance", F.col("_bucket")).sortWithinPartitions("_bucket", self.key).write.partitionBy("_bucket").parquet(path)
        return path

    def _read(self, listed: list) -> DataFrame:
        wanted: dict[str, list[int]] = {}
        for row in listed:
            wanted.setdefault(row.path, []).append(row.bucket)
        parts = [self.spark.read.schema(f"{self.schema}, _bucket int").parquet(path).where(F.col("_bucket").isin(buckets)).drop("_bucket") for path, buckets in wanted.items()]
        result = parts[0]
        for part in parts[1:]:
            result = result.unionByName(part)
        return result

    def _folders(self) -> list:
        return self.spark.read.schema(_FOLDERS).parquet(f"{self.root}/versions/{self.number}").collect() if self.number >= 0 else []

    def _filter_rows(self, number: int) -> DataFrame:
        return self.spark.read.schema("bucket int, word bigint, value bigint").parquet(f"{self.root}/filters/{number}")

    def _filter(self, buckets: list[int]) -> KeyFilter:
        """The filters of all buckets in one, ``FILTER_BITS`` each."""
        found = self._filter_rows(self.number).where(F.col("bucket").isin(buckets)).toArrow()
        words = np.zeros(BUCKETS * FILTER_BITS // 64, dtype=np.int64)
        words[found["bucket"].to_numpy().astype(np.int64) * (FILTER_BITS // 64) + found["word"].to_numpy()] = found["value"].to_numpy()
        return KeyFilter(words.tobytes())

    def _commit(self, folders: list[tuple], folder: str, touched: list[int] | None) -> None:
        """Filters first, then the list of folders under the next number, which only one writer can create.
        The filters of the version before go on, unless ``touched`` is None: then ``folder`` holds the whole table. The keys are
        read from what was written."""
        number = self.number + 1
        placed = self.spark.read.schema(f"{self.schema}, _bucket int").parquet(folder).select(self.key, "_bucket")
        bits = word_rows(placed.withColumnRenamed("_bucket", "bucket"), [F.col(self.key)], FILTER_BITS, ["bucket"])
        if touched is not None:
            bits = bits.unionByName(self._filter_rows(self.number)).groupBy("bucket", "word").agg(F.bit_or("value").alias("value"))
        path = f"{self.root}/filters/{number}"
        bits.write.mode("errorifexists").parquet(path)
        self.spark.createDataFrame(folders, _FOLDERS).coalesce(1).write.mode("errorifexists").parquet(f"{self.root}/versions/{number}")
        self.number = number

    def _newest(self) -> int:
        number = -1
        while True:
            try:
                self.spark.read.schema(_FOLDERS).parquet(f"{self.root}/versions/{number + 1}").limit(0)
            except AnalysisException as error:
                if error.getCondition() != "PATH_NOT_FOUND":
                    raise
                return number
            number += 1
