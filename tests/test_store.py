"""Merges, files, landings, embedding runs."""

import numpy as np
import pytest
from pyspark.sql import functions as F

from profilum import schemas
from profilum.functions.embedders import hashing_embedder
from profilum.operators import embedding
from profilum.operators.documents import missing_columns
from profilum.session import fresh_path
from profilum.sources import files, landing, store


def rows(frame):
    return sorted(tuple(row) for row in frame.collect())


def test_insert_never_updates_and_is_idempotent(spark):
    target = spark.createDataFrame([(1, "old"), (2, "old")], "id bigint, v string")
    source = spark.createDataFrame([(2, "new"), (3, "new"), (3, "copy")], "id bigint, v string")
    once = store.merge_insert(target, source, "id", [F.col("v").desc()])
    assert rows(once) == [(1, "old"), (2, "old"), (3, "new")]
    assert rows(store.merge_insert(once, source, "id")) == rows(once)


def test_update_never_inserts_and_takes_the_first(spark):
    target = spark.createDataFrame([(1, "x", 1.0), (2, "y", 2.0)], "id bigint, v string, w double")
    updates = spark.createDataFrame([(2, None, 1), (2, "late", 2), (9, "stray", 1)], "id bigint, v string, at int")
    assert rows(store.merge_update(target, updates, "id", ["v"], [F.col("at").desc()])) == [(1, "x", 1.0), (2, "late", 2.0)]
    # A matched NULL overwrites.
    assert rows(store.merge_update(target, updates, "id", ["v"], [F.col("at")]).filter("id = 2")) == [(2, None, 2.0)]


def test_heavily_repeated_key(spark):
    source = spark.range(30_000).select(F.when(F.col("id") % 3 == 0, 7).otherwise(F.col("id")).alias("id"), F.col("id").alias("v"))
    merged = store.merge_insert(spark.createDataFrame([], "id bigint, v bigint"), source, "id", [F.col("v")])
    assert merged.count() == source.select("id").distinct().count()
    assert merged.filter("id = 7").first().v == 0


def test_append_missing(spark):
    path = fresh_path(spark, "append")
    spark.createDataFrame([(1, "a")], "id bigint, v string").write.parquet(path)
    for _ in range(2):
        store.append_missing(spark, path, spark.createDataFrame([(1, "b"), (2, "b")], "id bigint, v string"), "id")
    assert rows(spark.read.parquet(path)) == [(1, "a"), (2, "b")]


def test_partitioned_layout_prunes(spark):
    path = fresh_path(spark, "dated")
    frame = spark.range(200).select(
        F.col("id").alias("ticket_id"), F.lit("x@x").alias("customer_email"), F.lit("open").alias("status"),
        F.expr("timestampadd(DAY, cast(id % 10 as int), timestamp_ntz'2024-01-01 05:00:00')").alias("created_at"),
    )
    store.write_partitioned(frame, path)
    one = spark.read.parquet(path).filter(F.col("created_date") == F.lit("2024-01-03").cast("date"))
    assert one.count() == 20 and len(one.inputFiles()) >= 1
    assert "PartitionFilters: [isnotnull(created_date" in one._jdf.queryExecution().executedPlan().toString()


def test_csv_round_trip(spark):
    path = fresh_path(spark, "csv")
    source = spark.createDataFrame([("o1", "c", 'a "quoted", text', 1.25), ("o2", None, "", None)], "a string, b string, c string, d double")
    files.write_csv(source, path)
    back = files.read_csv(spark, path, "a string, b string, c string, d double")
    assert back.filter("a = 'o1'").first() == source.filter("a = 'o1'").first()


def test_csv_types_are_enforced(spark):
    path = fresh_path(spark, "bad")
    spark.createDataFrame([("1",), ("x",)], "n string").write.option("header", True).csv(path)
    with pytest.raises(Exception):
        files.read_csv(spark, path, "n bigint").collect()
    kept = files.read_csv(spark, path, "n bigint", strict=False).collect()
    assert sorted((row.n is None, row._bad_row) for row in kept) == [(False, None), (True, "x")]


def test_all_sources_round_trip(spark):
    folder = fresh_path(spark, "sources")
    import datetime as dt

    samples = {"string": "some text", "bigint": 3, "double": 1.5, "timestamp": dt.datetime(2024, 1, 2, 3, 4, 5)}
    frames = {}
    for name, ddl in schemas.SOURCES.items():
        struct = schemas.struct(ddl)
        full = tuple(samples[field.dataType.simpleString()] for field in struct.fields)
        frames[name] = spark.createDataFrame([full, (full[0], *[None] * (len(full) - 1))], struct)
    files.save_sources(frames, folder)
    for name, frame in files.load_sources(spark, folder).items():
        assert sorted(map(str, frame.collect())) == sorted(map(str, frames[name].collect()))


def test_landings(spark):
    empty = spark.createDataFrame([], "id bigint, v string")
    first = spark.createDataFrame([(1, "first")], "id bigint, v string")
    second = spark.createDataFrame([(1, "second"), (2, "second")], "id bigint, v string")
    assert rows(landing.incremental_load(empty, [first, second], "id")) == [(1, "first"), (2, "second")]
    assert landing.landed_tables(spark).filter("sync_minutes = 15").count() == 14


@pytest.fixture()
def documents(spark):
    return spark.createDataFrame(
        [(1, "a text of words", None), (2, "0123456789", None), (3, "01234567890", None), (4, None, None), (5, "has a vector", [1.0, 0.0]), (6, "poison inside", None)],
        "id bigint, full_text string, embedding array<double>",
    )


def test_backlog_bounds(documents):
    # Ten characters are too short, eleven are enough.
    assert sorted(row.id for row in embedding.embedding_backlog(documents).collect()) == [1, 3, 6]


def test_failed_texts_are_quarantined(documents):
    def embedder(texts):
        if any("poison" in text for text in texts):
            raise RuntimeError("no")
        return [np.array([len(text), 1.0]) for text in texts]

    run = embedding.embed_table(documents, "id", embedder, "sizes", "2024-01-01 00:00:00")
    table = {row.id: row for row in run.table.collect()}
    assert len(table) == 6
    assert table[1].embedding == [15.0, 1.0] and table[1].embedding_model == "sizes"
    assert table[6].embedding is None and table[5].embedding == [1.0, 0.0] and table[5].embedding_model is None
    assert rows(run.quarantine) == [(6, "RuntimeError: no")]
    full = embedding.embed_table(documents, "id", embedder, "sizes", "2024-01-01 00:00:00", mode="full")
    assert full.table.filter("embedding_model = 'sizes'").count() == 4


def test_calls_are_no_larger_than_asked(documents):
    def embedder(texts):
        if len(texts) > 2:
            raise ValueError("too many")
        return [np.array([1.0]) for _ in texts]

    done = embedding.embed_texts(documents.filter("full_text is not null").coalesce(1), "id", embedder, batch_size=2)
    assert done.filter("error is null").count() == 5


def test_hashing_embedder():
    embed = hashing_embedder(16)
    first, second, empty = embed(["Some words here", "here words  some", ""])
    assert np.allclose(first, second) and np.isclose(first @ first, 1.0) and not empty.any()


def test_required_columns(documents):
    assert missing_columns(documents, "tickets_embedded") == ["ticket_id"]
