"""Streams that keep batch results current.

Each writes to a folder and keeps its progress in a checkpoint folder, so a restarted run goes on
where the last one stopped. All run with ``availableNow``: they take what has landed and end, which
is how a periodic sync calls them.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from profilum.operators.metrics import top_per_group
from profilum.operators.sentiment import TREND_SUMS, trend_sums
from profilum.sources.buckets import BucketTable
from profilum.sources.store import missing_rows


# Key-hash buckets of the target of an insert-only merge.
BUCKETS = 64


def landed_files(spark: SparkSession, path: str, schema: str, per_trigger: int | None = None) -> DataFrame:
    """A stream over the parquet files that land in a folder, or over a table ``name.parquet`` of one or many files."""
    # A stream takes a single file only as the match of a pattern.
    head, dot, kind = path.rpartition(".")
    path = f"{head}[.]{kind}" if dot and "/" not in kind else path
    reader = spark.readStream.schema(schema)
    if per_trigger:
        reader = reader.option("maxFilesPerTrigger", per_trigger)
    return reader.parquet(path)


def written(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """What a stream has written so far; no rows if that is nothing yet."""
    try:
        return spark.read.schema(schema).parquet(target)
    except AnalysisException as error:
        if error.getCondition() != "PATH_NOT_FOUND":
            raise
        return spark.createDataFrame([], schema)


def finish(writer, target: str | None, checkpoint: str) -> None:
    """Run a stream over what has landed, then end it."""
    writer = writer.option("checkpointLocation", checkpoint).trigger(availableNow=True)
    (writer.start(target) if target else writer.start()).awaitTermination()


def insert_new_rows(stream: DataFrame, target: str, checkpoint: str, key: str, loaded: str | None = None) -> None:
    """Insert-only merge of every micro-batch. A batch owns one folder of the target and replaces it
    when it is replayed, so a retry neither loses nor repeats rows. Rows lie in buckets by a hash of
    their key, and a batch reads the known keys of its own buckets only. ``loaded`` names a parquet table
    that was filled before the stream began; its keys count as known."""
    schema = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in stream.schema)
    bucket = F.pmod(F.xxhash64(key), F.lit(BUCKETS)).cast("int")

    def merge(batch: DataFrame, number: int) -> None:
        session = batch.sparkSession
        placed = batch.withColumn("bucket", bucket)
        # At most one row per bucket.
        own = [row.bucket for row in placed.select("bucket").distinct().collect()]
        before = written(session, target, f"{schema}, batch_id bigint, bucket int").filter((F.col("batch_id") != number) & F.col("bucket").isin(own))
        known = before.select(key)
        if loaded:
            known = known.unionByName(session.read.parquet(loaded).select(key))
        missing_rows(known, placed, key).write.mode("overwrite").partitionBy("bucket").parquet(f"{target}/batch_id={number}")

    finish(stream.writeStream.foreachBatch(merge), None, checkpoint)


def inserted_rows(spark: SparkSession, target: str, schema: str) -> DataFrame:
    """The rows that :func:`insert_new_rows` has written, in the columns of ``schema``."""
    return written(spark, target, f"{schema}, batch_id bigint, bucket int").drop("batch_id", "bucket")


WEB_ACTIVITY = "user_id bigint, session_id string, page_path string, day date, views bigint, last_visit timestamp"
DAILY_SENTIMENT = "customer_id bigint, date date, avg_sentiment double, interactions bigint"
SESSIONS = "user_id bigint, session_start timestamp, session_end timestamp, events bigint"


def web_activity(stream: DataFrame, target: str, checkpoint: str, delay: str = "1 day") -> None:
    """Views per user, session, page and day. Events are counted once by id; a day is written when the
    watermark has passed it, so the days within ``delay`` of the newest event are still open."""
    if "page_path" not in stream.columns:
        stream = stream.withColumn("page_path", F.lit(None).cast("string"))
    timed = stream.withColumn("event_time", F.col("event_timestamp").cast("timestamp")).withWatermark("event_time", delay)
    counted = (
        timed.dropDuplicatesWithinWatermark(["event_id"])
        .groupBy("user_id", "session_id", "page_path", F.window("event_time", "1 day"))
        .agg(F.count("*").alias("views"), F.max("event_time").alias("last_visit"))
        .select("user_id", "session_id", "page_path", F.to_date("window.start").alias("day"), "views", "last_visit")
    )
    finish(counted.writeStream.format("parquet").option("path", target).outputMode("append"), None, checkpoint)


def daily_web_metrics(spark: SparkSession, target: str) -> DataFrame:
    """Distinct sessions, views and last visit per user and closed day out of :func:`web_activity`."""
    return written(spark, target, WEB_ACTIVITY).groupBy("user_id", "day").agg(
        F.countDistinct("session_id").alias("total_sessions"), F.sum("views").alias("total_page_views"), F.max("last_visit").alias("last_visit")
    )


def user_web_metrics(spark: SparkSession, target: str, pages: int = 10) -> DataFrame:
    """The web metrics of the profile per user, over all closed days out of :func:`web_activity`."""
    activity = written(spark, target, WEB_ACTIVITY).filter(F.col("user_id").isNotNull())
    totals = activity.groupBy("user_id").agg(
        F.countDistinct("session_id").alias("total_sessions"), F.sum("views").alias("total_page_views"), F.max("last_visit").alias("last_visit")
    )
    visited = top_per_group(activity.select("user_id", "page_path").distinct(), ["user_id"], [F.col("page_path")], pages)
    return totals.join(visited.groupBy("user_id").agg(F.sort_array(F.collect_list("page_path")).alias("visited_pages")), "user_id", "left")


def _daily_means(stream: DataFrame, delay: str) -> DataFrame:
    timed = stream.withColumn("event_time", F.col("timestamp").cast("timestamp")).withWatermark("event_time", delay)
    total = F.sum(F.col("sentiment_score").cast("decimal(38,6)"))
    return (
        timed.groupBy("customer_id", F.window("event_time", "1 day"))
        .agg(F.round(total.cast("double") / F.count("sentiment_score"), 3).alias("avg_sentiment"), F.count("*").alias("interactions"))
        .select("customer_id", F.to_date("window.start").alias("date"), "avg_sentiment", "interactions")
    )


def daily_sentiment(stream: DataFrame, target: str, checkpoint: str, delay: str = "1 day") -> None:
    """Mean sentiment per customer and closed day; days within ``delay`` of the newest row are still open."""
    means = _daily_means(stream, delay)
    finish(means.writeStream.format("parquet").option("path", target).outputMode("append"), None, checkpoint)


def sentiment_trends(stream: DataFrame, root: str, checkpoint: str, delay: str = "1 day") -> BucketTable:
    """The sums behind each customer's trend, kept in a table under ``root``: days that close are added to the
    rows of their customers, and the days themselves are not needed again. The version of the table is the number
    of the micro-batch, so a batch that is run again is not added twice; folder and checkpoint belong together."""

    def fold(batch: DataFrame, number: int) -> None:
        sums = trend_sums(batch)
        kept = _trend_table(batch.sparkSession, root, sums)
        if kept.number >= number:
            # The batch is read all the same, as its state has to be written again.
            sums.write.format("noop").mode("overwrite").save()
            return
        if kept.number < 0:
            BucketTable.create(sums, root, "customer_id")
        else:
            kept.fold(sums, TREND_SUMS, ["newest"])

    means = _daily_means(stream, delay)
    finish(means.writeStream.foreachBatch(fold).outputMode("append"), None, checkpoint)
    return _trend_table(stream.sparkSession, root, trend_sums(stream.sparkSession.createDataFrame([], DAILY_SENTIMENT)))


def _trend_table(spark: SparkSession, root: str, sums: DataFrame) -> BucketTable:
    return BucketTable(spark, root, "customer_id", ", ".join(f"`{column.name}` {column.dataType.simpleString()}" for column in sums.schema))


def sessions(stream: DataFrame, target: str, checkpoint: str, gap: str = "30 minutes", delay: str = "1 day") -> None:
    """Closed sessions per user by event-time gap; those within ``delay`` of the newest event are still open."""
    timed = stream.withColumn("event_time", F.col("event_timestamp").cast("timestamp")).withWatermark("event_time", delay)
    closed = (
        timed.groupBy("user_id", F.session_window("event_time", gap))
        .agg(F.count("*").alias("events"), F.min("event_time").alias("session_start"), F.max("event_time").alias("session_end"))
        .select("user_id", "session_start", "session_end", "events")
    )
    finish(closed.writeStream.format("parquet").option("path", target).outputMode("append"), None, checkpoint)
