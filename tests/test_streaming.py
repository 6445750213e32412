"""Streams against the batch results over the same rows."""

import datetime as dt

from pyspark.sql import functions as F

from profilum.operators.metrics import visited_pages, web_activity
from profilum.operators.sentiment import daily_sentiment, sentiment_trend, trend_of_sums
from profilum.plans.registry import QUERIES
from profilum.session import STATE_STORE, fresh_path
from profilum.streaming import current, upkeep

SCHEMA = "event_id bigint, user_id bigint, session_id string, event_timestamp timestamp_ntz"
START = dt.datetime(2024, 1, 1)


def land(spark, folder, rows, schema=SCHEMA):
    spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(folder)


def test_inserts_survive_restarts_and_copies(spark):
    folder, target, progress = (fresh_path(spark, name) for name in ("in", "out", "progress"))
    schema = "id bigint, v string"
    land(spark, folder, [(1, "a"), (2, "a"), (2, "a")], schema)
    upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema), target, progress, "id")
    land(spark, folder, [(2, "b"), (3, "b")], schema)
    for _ in range(2):
        upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema, per_trigger=1), target, progress, "id")
    found = sorted((row.id, row.v) for row in spark.read.parquet(target).collect())
    assert found == [(1, "a"), (2, "a"), (3, "b")]
    # A lost checkpoint replays everything into the same folders.
    upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema), target, fresh_path(spark, "again"), "id")
    assert spark.read.parquet(target).select("id").distinct().count() == 3


def test_inserts_skip_what_was_loaded_before(spark):
    folder, target, loaded = (fresh_path(spark, name) for name in ("in", "out", "loaded"))
    schema = "id bigint, v string"
    land(spark, loaded, [(1, "old")], schema)
    land(spark, folder, [(1, "new"), (2, "new")], schema)
    upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema), target, fresh_path(spark, "progress"), "id", loaded)
    assert [(row.id, row.v) for row in spark.read.parquet(target).collect()] == [(2, "new")]


def test_web_activity_counts_an_event_once(spark):
    folder, target, progress = (fresh_path(spark, name) for name in ("in", "out", "progress"))
    rows = [(i, i % 3, f"s{i % 5}", START + dt.timedelta(hours=i)) for i in range(200)]
    land(spark, folder, rows[:120])
    land(spark, folder, rows[100:])
    upkeep.web_activity(upkeep.landed_files(spark, folder, SCHEMA, per_trigger=1), target, progress)
    closed = START + dt.timedelta(hours=199 - 24)
    expected = {}
    for _, user, session, at in rows:
        day = at.replace(hour=0)
        if day + dt.timedelta(days=1) <= closed:
            views, sessions = expected.setdefault((user, day.date()), [0, set()])
            expected[(user, day.date())][0] += 1
            sessions.add(session)
    found = {(row.user_id, row.day): (row.total_page_views, row.total_sessions) for row in upkeep.daily_web_metrics(spark, target).collect()}
    assert found == {key: (views, len(sessions)) for key, (views, sessions) in expected.items()}


def test_daily_sentiment_equals_batch_on_closed_days(spark):
    folder, target, progress = (fresh_path(spark, name) for name in ("in", "out", "progress"))
    schema = "customer_id bigint, timestamp timestamp_ntz, sentiment_score double"
    rows = [(i % 4, START + dt.timedelta(hours=5 * i), ((i * 37) % 200 - 100) / 100) for i in range(100)]
    land(spark, folder, rows, schema)
    stream = upkeep.landed_files(spark, folder, schema)
    upkeep.daily_sentiment(stream, target, progress)
    closed = START + dt.timedelta(hours=5 * 99 - 24)
    batch = daily_sentiment(spark.createDataFrame(rows, schema), "2024-01-31", newest=1000).filter(F.date_add("date", 1) <= F.lit(closed.date()))
    assert sorted(map(str, spark.read.parquet(target).select(*batch.columns).collect())) == sorted(map(str, batch.collect()))


def test_table_of_several_files_and_empty_landing(spark):
    """All stream queries over a folder of three files, and over one without rows, equal those over one file."""
    names = ["stream_incremental_load", "stream_web_metrics", "stream_user_metrics", "stream_daily_sentiment", "stream_sessions", "stream_current_metrics"]
    events = spark.read.parquet("/root/testdata/sf0.001/events.parquet")
    whole, split, empty = (fresh_path(spark, name) for name in ("whole", "split", "empty"))
    events.coalesce(1).write.parquet(f"{whole}/events.parquet")
    events.repartition(3).write.parquet(f"{split}/events.parquet")
    events.limit(0).write.parquet(f"{empty}/events.parquet")
    for name in names:
        one, several = (sorted(map(str, QUERIES[name](spark, folder).collect())) for folder in (whole, split))
        assert one == several and one
        nothing = QUERIES[name](spark, empty)
        assert nothing.count() == 0 and nothing.columns == QUERIES[name](spark, whole).columns


def test_a_batch_reads_its_own_buckets(spark):
    folder, target, progress = (fresh_path(spark, name) for name in ("in", "out", "progress"))
    schema = "id bigint, v string"
    land(spark, folder, [(key, "a") for key in range(500)], schema)
    upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema), target, progress, "id")
    land(spark, folder, [(7, "b"), (1000, "b")], schema)
    upkeep.insert_new_rows(upkeep.landed_files(spark, folder, schema), target, progress, "id")
    stored = spark.read.parquet(target)
    assert stored.filter("batch_id = 1").select("id", "v").collect() == [(1000, "b")]
    assert stored.count() == 501 and stored.select("bucket").distinct().count() == upkeep.BUCKETS


def test_current_metrics_take_every_event_once(spark, monkeypatch):
    """Over landings with copies, old pages that come back, missing ids and a hot user: equal to the batch metrics."""
    monkeypatch.setattr(current, "FOLD_EVERY", 2)
    schema = f"{SCHEMA}, page_path string"
    rows = [(i, None if i % 11 == 0 else (7 if i % 3 else i % 5), f"s{i % 13}", START + dt.timedelta(minutes=7 * i), f"/p{i * i % 29}") for i in range(600)]
    rows += [(None, 7, "s1", START + dt.timedelta(minutes=4000), None), (9000, 7, None, START + dt.timedelta(minutes=4100), "/a")]
    batch = spark.createDataFrame(rows, schema)
    for by in ("name", "recent"):
        folder, target, progress = (fresh_path(spark, name) for name in ("in", "out", "progress"))
        for part in (rows[:300], rows[250:450], rows[400:]):
            land(spark, folder, part, schema)
            current.user_metrics(upkeep.landed_files(spark, folder, schema, per_trigger=1), target, progress, pages=5, by=by)
        found = {row.user_id: row for row in current.current_user_metrics(spark, target, 5, by).collect()}
        assert spark.read.parquet(f"{target}/log").count() >= 1
        activity = {row.user_id: row for row in web_activity(batch).collect()}
        pages = {row.user_id: row.visited_pages for row in visited_pages(batch, limit=5, by=by).collect()}
        assert found.keys() == activity.keys()
        for user, row in found.items():
            expected = activity[user]
            assert (row.total_sessions, row.total_page_views, row.visited_pages) == (expected.total_sessions, expected.total_page_views, pages[user])
            assert row.last_visit.replace(tzinfo=None) == expected.last_visit


def test_current_metrics_in_a_session_of_the_default_state_store(spark):
    """The stream brings its store along, and the session keeps its own."""
    other = spark.newSession()
    default = "org.apache.spark.sql.execution.streaming.state.HDFSBackedStateStoreProvider"
    other.conf.set(STATE_STORE, default)
    other.conf.set("spark.sql.session.timeZone", "UTC")
    assert QUERIES["stream_current_metrics"](other, "/root/testdata/sf0.001").count() > 0
    assert other.conf.get(STATE_STORE) == default


def test_current_metrics_open_few_stores_and_leave_out_late_events(spark, tmp_path):
    """Stores follow the cores, not the session's partitions; what is older than the watermark adds nothing, nor does an event sent again."""
    other = spark.newSession()
    other.conf.set("spark.sql.shuffle.partitions", "100")
    folder, target, progress = (str(tmp_path / name) for name in ("in", "out", "progress"))
    schema = f"{SCHEMA}, page_path string"
    first = [(1, 1, "a", START, "/a"), (1, 1, "a", START, "/a"), (None, 1, "b", START, "/b"), (2, 2, None, START, None)]
    later = [(3, 1, "c", START + dt.timedelta(days=9), "/c"), (4, 1, "c", START + dt.timedelta(days=9, hours=1), "/c")]
    again = [(5, 1, "late", START, "/0"), (4, 1, "c", START + dt.timedelta(days=9, hours=1), "/c"), (6, 1, "a", START + dt.timedelta(days=10), None)]
    for part in (first, later, again):
        land(other, folder, part, schema)
        current.user_metrics(upkeep.landed_files(other, folder, schema), target, progress)
    found = {row.user_id: (row.total_sessions, row.total_page_views, row.last_visit.replace(tzinfo=None), row.visited_pages) for row in current.current_user_metrics(other, target).collect()}
    assert found == {1: (3, 4, START + dt.timedelta(days=10), ["/a", "/b", "/c"]), 2: (0, 1, START, None)}
    stores = [path for operator in (tmp_path / "progress/state").iterdir() for path in operator.iterdir() if path.name.isdigit()]
    assert 0 < len(stores) <= 2 * current.STORES_PER_CORE * spark.sparkContext.defaultParallelism
    assert other.conf.get("spark.sql.shuffle.partitions") == "100"


def test_trends_of_kept_sums_equal_trends_of_days(spark):
    """Over three landings, and again after a batch is run twice."""
    folder, root, progress = (fresh_path(spark, name) for name in ("in", "sums", "progress"))
    schema = "customer_id bigint, timestamp timestamp_ntz, sentiment_score double"
    rows = [(i % 4, START + dt.timedelta(hours=5 * i), None if i % 4 == 3 else ((i * 37) % 200 - 100) / 100) for i in range(100)] + [(9, START, 0.5), (None, START, 0.1)]
    for part in (rows[100:] + rows[:40], rows[40:70], rows[70:100]):
        land(spark, folder, part, schema)
        table = upkeep.sentiment_trends(upkeep.landed_files(spark, folder, schema, per_trigger=1), root, progress)
    closed = START + dt.timedelta(hours=5 * 99 - 24)
    days = daily_sentiment(spark.createDataFrame(rows, schema), "2024-01-31", newest=1000).filter((F.date_add("date", 1) <= F.lit(closed.date())) & F.col("customer_id").isNotNull())
    batch = sentiment_trend(days, "2024-01-31")
    found = trend_of_sums(table.rows()).select(*batch.columns)
    assert sorted(map(str, found.collect())) == sorted(map(str, batch.collect()))
    # A lost checkpoint replays batches whose versions are there.
    before = table.number
    again = upkeep.sentiment_trends(upkeep.landed_files(spark, folder, schema), root, fresh_path(spark, "again"))
    assert again.number == before
