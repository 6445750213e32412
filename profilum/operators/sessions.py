"""Sessions out of event times."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def sessionize(events: DataFrame, key: str = "user_id", moment: str = "event_timestamp", gap_minutes: int = 30) -> DataFrame:
    """Sessions per ``key``: a pause longer than the gap starts a new one.

    Events within one slot of the gap's width always share a session, so they are first reduced to
    one row per slot on the map side. The window then sees at most one row per user and slot, a number
    bounded by the time span and not by the events of a busy user.
    """
    seconds = gap_minutes * 60
    moment_micros = F.unix_micros(F.col(moment).cast("timestamp"))
    slots = events.filter(F.col(key).isNotNull() & F.col(moment).isNotNull()).groupBy(key, F.floor(moment_micros / F.lit(seconds * 1_000_000)).alias("slot")).agg(
        F.min(moment).alias("first_event"), F.max(moment).alias("last_event"), F.count("*").alias("events")
    )
    by_slot = Window.partitionBy(key).orderBy("slot")
    pause = F.unix_micros(F.col("first_event").cast("timestamp")) - F.unix_micros(F.lag("last_event").over(by_slot).cast("timestamp"))
    starts = slots.withColumn("starts", F.when(pause <= seconds * 1_000_000, 0).otherwise(1))
    numbered = starts.withColumn("session_no", F.sum("starts").over(by_slot.rowsBetween(Window.unboundedPreceding, Window.currentRow)))
    return numbered.groupBy(key, "session_no").agg(
        F.min("first_event").alias("session_start"), F.max("last_event").alias("session_end"), F.sum("events").alias("events")
    )
