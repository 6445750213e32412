"""Web metrics per user as keyed state: every micro-batch costs the events it brings, and results are current.

Spark's own stateful operators hold what has to be remembered, each entry under its whole key, so that a user with a third
of all events is spread over all tasks. Event ids are remembered by day, so repeated events count once, until the watermark
is ``delay`` past the event (at least until it has passed the day, if the delay is a day or more); an event that is sent
again has the session it had. Sessions are remembered for good. Events older than the watermark do not count. A batch
writes what it adds: one row per user for new sessions, new views and the last visit, and one for each of a user's first or
newest pages up to a limit. Sums, maxima and first rows of such rows are those of all events.

Rows without a user are left out. An event without an id is no view, one without a session or page counts without
it. All rows read so far are in the result; nothing waits for the watermark. Folder and checkpoint belong together.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.operators.metrics import top_per_group
from profilum.session import ROCKSDB, STATE_STORE, setting
from profilum.streaming.upkeep import finish, written

SLICES = 16
DAY = 86_400_000_000
# A row without a page holds the sums of its user and the last visit, one with a page when that was seen last.
CHANGES = "user_id bigint, page_path string, of_page boolean, total_sessions bigint, total_page_views bigint, seen bigint"
ADDED = ["user_id", "page_path", "of_page", "total_sessions", "total_page_views", "seen"]
# After so many batches the rows of all batches are folded into one table, so that a read meets fewer changes than that many batches bring.
FOLD_EVERY = 16
# Opening a state store and writing it takes longer than a small batch, so a new stream has a few for each core.
STORES_PER_CORE = 4
PARTITIONS = "spark.sql.shuffle.partitions"


def _added(user: Column, page: Column | None = None, sessions: int = 0, views: int = 0, seen: Column | None = None) -> list[Column]:
    """A row of what an event adds."""
    values = [user, F.lit(None) if page is None else page, F.lit(page is not None), F.lit(sessions), F.lit(views), F.lit(None) if seen is None else seen]
    return [value.cast(kind.split()[1]).alias(name) for name, value, kind in zip(ADDED, values, CHANGES.split(", "))]


def _order(by: str) -> list[Column]:
    return [F.col("seen").desc(), F.col("page_path")] if by == "recent" else [F.col("page_path")]


def _folded(rows: DataFrame, pages: int, by: str) -> DataFrame:
    """Rows of changes together. A page that falls out never comes back by what is known of it."""
    summed = rows.groupBy("user_id", "page_path", "of_page").agg(*[F.sum(name).alias(name) for name in ("total_sessions", "total_page_views")], F.max("seen").alias("seen"))
    return top_per_group(summed, ["user_id", "of_page"], _order(by), pages).select(*ADDED)


def user_metrics(stream: DataFrame, target: str, checkpoint: str, delay: str = "1 day", pages: int = 10, by: str = "name") -> None:
    """Keep the web metrics per user current under ``target``; the pages are the first ten ``by`` name, or the ten most
    ``recent``. A batch owns its folders and replaces them when it is run again."""
    if by not in ("name", "recent"):
        raise ValueError(f"pages by name or recent, not {by}")
    session = F.col("session_id").cast("string")
    timed = stream.filter(F.col("user_id").isNotNull() & F.col("event_timestamp").isNotNull()).select(
        F.col("user_id").cast("bigint").alias("user_id"), F.pmod(F.xxhash64(session), F.lit(SLICES)).cast("int").alias("slice"), F.col("event_id").cast("string").alias("event_id"),
        session.alias("session_id"), F.col("page_path").cast("string").alias("page_path"), F.col("event_timestamp").cast("timestamp").alias("event_time"),
    ).withWatermark("event_time", delay)
    micros = F.unix_micros("event_time")
    # An event is a view by its id, and a visit by all else it says; the same visit twice says no more than once.
    none = F.lit(None).cast("string")
    view = F.struct(F.col("event_id"), none.alias("session_id"), none.alias("page_path"), F.lit(None).cast("bigint").alias("micros"))
    visit = F.struct(none.alias("event_id"), F.col("session_id"), F.col("page_path"), micros.alias("micros"))
    parts = F.when(F.col("event_id").isNotNull(), F.array(view, visit)).otherwise(F.array(visit))
    split = timed.select("user_id", "slice", "event_time", (micros - F.pmod(micros, F.lit(DAY))).alias("day"), F.explode(parts).alias("part")).select("user_id", "slice", "event_time", "day", "part.*")
    fresh = split.dropDuplicatesWithinWatermark(["user_id", "slice", "day", "event_id", "session_id", "page_path", "micros"])
    user, page, at = F.col("user_id"), F.col("page_path"), F.col("micros")
    seen = F.when(F.col("event_id").isNotNull(), F.array(F.struct(*_added(user, views=1)))).otherwise(
        F.when(page.isNull(), F.array(F.struct(*_added(user, seen=at)))).otherwise(F.array(F.struct(*_added(user, seen=at)), F.struct(*_added(user, page, seen=at))))
    )
    visits = fresh.select("event_time", F.explode(seen).alias("row")).select("event_time", "row.*")
    # The time of events is kept, as the operators look there for what is older than the watermark.
    sessions = timed.filter(F.col("session_id").isNotNull()).select("user_id", "session_id", "event_time").dropDuplicates(["user_id", "session_id"])
    added = visits.unionByName(sessions.select("event_time", *_added(user, sessions=1)))

    def keep(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        _folded(batch.select(*ADDED), pages, by).write.mode("overwrite").parquet(f"{target}/changes/batch_id={number}")
        if number % FOLD_EVERY == FOLD_EVERY - 1:
            _folded(_latest(session, target, before=number), pages, by).write.mode("overwrite").parquet(f"{target}/folded/upto={number}")
            # Readers take a folded table only once it is whole.
            session.range(1).coalesce(1).write.mode("overwrite").parquet(f"{target}/log/upto={number}")

    spark = stream.sparkSession
    stores = min(int(spark.conf.get(PARTITIONS)), STORES_PER_CORE * spark.sparkContext.defaultParallelism)
    # This store keeps state out of the heap, and a session made elsewhere need not have it; a stream takes what is set when it
    # starts. One that goes on keeps the number of stores it began with.
    with setting(spark, STATE_STORE, ROCKSDB), setting(spark, PARTITIONS, str(stores)):
        finish(added.writeStream.foreachBatch(keep).outputMode("append"), None, checkpoint)


def _latest(spark: SparkSession, target: str, before: int | None = None) -> DataFrame:
    """The rows of the table folded last (``before`` a batch) and of the changes after it."""
    logged = written(spark, f"{target}/log", "id bigint, upto bigint")
    if before is not None:
        logged = logged.filter(F.col("upto") < before)
    folded = logged.agg(F.max("upto")).first()[0]
    upto = -1 if folded is None else folded
    changes = written(spark, f"{target}/changes", f"{CHANGES}, batch_id bigint").filter(F.col("batch_id") > upto)
    base = written(spark, f"{target}/folded", f"{CHANGES}, upto bigint").filter(F.col("upto") == upto)
    return changes.select(*ADDED).unionByName(base.select(*ADDED))


def current_user_metrics(spark: SparkSession, target: str, pages: int = 10, by: str = "name") -> DataFrame:
    """The columns of :func:`profilum.operators.metrics.web_metrics` as they are after the last batch."""
    latest = _latest(spark, target)
    totals = latest.filter(~F.col("of_page")).groupBy("user_id").agg(
        F.sum("total_sessions").alias("total_sessions"), F.sum("total_page_views").alias("total_page_views"), F.timestamp_micros(F.max("seen")).alias("last_visit")
    )
    # At most the limit of pages per user and batch.
    visits = latest.filter("of_page").groupBy("user_id", "page_path").agg(F.max("seen").alias("seen"))
    first = top_per_group(visits, ["user_id"], _order(by), pages)
    listed = first.groupBy("user_id").agg(F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_path"))), lambda row: row["page_path"]).alias("visited_pages"))
    return totals.join(listed, "user_id", "left")
