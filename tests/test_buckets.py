"""The bucketed store against whole-table merges, and what its merges read and write."""

import pytest
from pyspark.errors import AnalysisException
from pyspark.sql import functions as F

from profilum.functions.embedders import hashing_embedder
from profilum.operators import embedding, sentiment
from profilum.session import fresh_path
from profilum.sources import buckets, store
from profilum.sources.buckets import BucketTable


@pytest.fixture()
def table(spark):
    frame = spark.range(1000).select(F.col("id").alias("key"), F.lit("old").alias("value"), (F.col("id") * 2).alias("other"))
    return BucketTable.create(frame, fresh_path(spark, "buckets"), "key")


def values(frame):
    return sorted(tuple(row) for row in frame.collect())


def test_update_writes_its_buckets_only(spark, table):
    before = values(table.rows())
    updates = spark.createDataFrame([(key, f"new{key}") for key in range(10)] + [(5000, "unknown"), (None, "no key")], "key long, value string")
    following = table.update(updates, ["value"])
    expected = [(key, f"new{key}" if key < 10 else "old", 2 * key) for key in range(1000)]
    assert values(following.rows()) == expected and values(table.rows()) == before
    added = {row.path for row in following._folders()} - {row.path for row in table._folders()}
    written = spark.read.parquet(added.pop())
    assert not added and written.count() == 10 and {row.bucket for row in following._folders() if row.place == 1} >= {row._bucket for row in written.select("_bucket").collect()}
    assert following.number == 1 and BucketTable(spark, table.root, "key", table.schema).number == 1
    # A second delta wins over the first, an earlier version can be opened, compaction changes nothing.
    again = following.update(updates.withColumn("value", F.lit("newest")).where("key < 3"), ["value"])
    latest = [(key, "newest" if key < 3 else value, other) for key, value, other in expected]
    assert values(again.rows()) == latest and values(again.compact().rows()) == latest
    assert values(BucketTable(spark, table.root, "key", table.schema, 1).rows()) == expected


@pytest.mark.parametrize("bits", [64, 1 << 18])
def test_insert_asks_the_filter_first(spark, bits, monkeypatch):
    """With 64 bits a bucket many new keys are doubtful; with enough bits new keys read no bucket."""
    monkeypatch.setattr(buckets, "FILTER_BITS", bits)
    frame = spark.range(3000).select(F.col("id").alias("key"), F.lit("known").alias("value"))
    known = BucketTable.create(frame.where("key < 2000"), fresh_path(spark, "buckets"), "key")
    read = []
    rows = BucketTable.rows
    monkeypatch.setattr(BucketTable, "rows", lambda self, buckets=None, columns=None: read.append(buckets) or rows(self, buckets, columns))
    arrived = frame.withColumn("value", F.lit("arrived")).where("key >= 2500")
    following = known.insert_missing(arrived.unionByName(arrived))
    assert [len(some) > 48 if bits == 64 else len(some) < 8 for some in read] == [True]
    last = following.insert_missing(frame.withColumn("value", F.lit("late")))
    monkeypatch.setattr(BucketTable, "rows", rows)
    assert values(last.rows()) == [(key, "known" if key < 2000 else "late" if key < 2500 else "arrived") for key in range(3000)]


def test_the_second_of_two_writers_fails(spark, table):
    updates = spark.createDataFrame([(1, "a")], "key long, value string")
    other = BucketTable(spark, table.root, "key", table.schema)
    table.update(updates, ["value"])
    with pytest.raises(AnalysisException):
        other.update(updates, ["value"])
    root = fresh_path(spark, "commits")
    assert [store.commit(spark.range(number), root) for number in (1, 2)] == [1, 2]
    assert store.current(spark, root).count() == 2 and store.version(spark, root, 1).count() == 1


def test_empty_tables(spark, table):
    nothing = spark.createDataFrame([], "key long, value string, other long")
    assert values(table.update(nothing, ["value"]).insert_missing(nothing).rows()) == values(table.rows())
    empty = BucketTable.create(nothing, fresh_path(spark, "buckets"), "key")
    assert empty.rows().count() == 0 and values(empty.insert_missing(table.rows()).rows()) == values(table.rows())


@pytest.mark.parametrize("ids", [1, 1 << 17])
def test_ids_inside_texts(spark, ids, monkeypatch):
    monkeypatch.setattr(sentiment, "AUTOMATON_IDS", ids)
    documents = spark.createDataFrame([(1, "customer 111 wrote"), (2, "id11"), (3, "1"), (4, None), (5, ""), (6, "none"), (6, "none")], "interaction_id long, content string")
    wanted = spark.createDataFrame([("1",), ("11",), ("111",), ("11",), ("",), (None,), ("e",)], "customer_id string")
    found = sentiment.docs_containing(documents, wanted).select("interaction_id", "wanted_id")
    assert values(found) == [(1, "1"), (1, "11"), (1, "111"), (1, "e"), (2, "1"), (2, "11"), (3, "1"), (6, "e"), (6, "e")]
    assert sentiment.docs_containing(documents, wanted.where("false")).count() == 0


def test_embedding_job_keeps_reasons(spark):
    def failing(texts):
        if any("bad" in text for text in texts):
            raise ValueError("no")
        return hashing_embedder(8)(texts)

    root = fresh_path(spark, "jobs")
    store.commit(spark.createDataFrame([(1, "a good long text"), (2, "a bad text, and long")], "ticket_id long, full_text string").withColumn("embedding", F.lit(None).cast("array<double>")), root)
    embedding.embedding_job(spark, root, "ticket_id", failing, "m", "2024-01-01 00:00:00")
    assert values(embedding.quarantined(spark, root)) == [(2, "ValueError: no")]


def test_rows_are_written_once(spark, monkeypatch):
    """A table is stored without a copy beside it, and what arrives is set down once before it is added."""
    names, write = [], buckets.write_version
    monkeypatch.setattr(buckets, "write_version", lambda frame, name: (names.append(name), write(frame, name))[1])
    rows = spark.range(100).select("id", F.lit("old").alias("v"))
    table = BucketTable.create(rows.where("id < 40"), fresh_path(spark, "once"), "id")
    assert names == []
    table = table.insert_missing(rows.withColumn("v", F.lit("new")))
    assert names == ["arrived"]
    assert {row.v: row.n for row in table.rows().groupBy("v").agg(F.count("*").alias("n")).collect()} == {"old": 40, "new": 60}
    table = table.insert_missing(rows)
    assert table.rows().count() == 100 and table.compact().rows().count() == 100
