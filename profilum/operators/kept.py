"""Profile metrics that are kept: a landing costs its own rows, not a pass over all facts.

Facts lie in a :class:`~profilum.sources.buckets.BucketTable` under their id, which takes every id once. Beside it
lie partial results per group (sums, counts, maxima) in another one. :func:`refresh` folds the rows that each version
of the facts added into the partials of the groups they belong to. Partials have the number of the facts version
they stand for, so a refresh that was lost between two commits is made up by the next, and none counts twice.

Distinct sessions and pages are groups of their own (user and session, user and page), so counting them is exact.
Sums of money and hours are decimals with six digits: the result is the same for every order of landings. Facts
without an id are not taken by the table. Facts that are updated in place are not followed: build the partials anew
under another root then. Empty landings change nothing.
"""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.fixed_values import OPEN_STATUSES
from profilum.operators.metrics import top_per_group
from profilum.sources.buckets import BucketTable

KEY = "_group"


@dataclass(frozen=True)
class Partials:
    """What is kept per group; rows whose first group column is null have no group."""

    group: list[str]
    sums: dict[str, Column] = field(default_factory=dict)
    maxima: dict[str, Column] = field(default_factory=dict)

    def of(self, facts: DataFrame) -> DataFrame:
        """The partial results of some facts, combined on the map side."""
        summed = [F.sum(value).alias(name) for name, value in self.sums.items()]
        greatest = [F.max(value).alias(name) for name, value in self.maxima.items()]
        known = facts.filter(F.col(self.group[0]).isNotNull()).groupBy(*self.group).agg(*summed, *greatest)
        return known.withColumn(KEY, F.to_json(F.struct(*self.group)))


def _amount(name: str) -> Column:
    return F.col(name).cast("decimal(38,6)")


def _present(name: str) -> Column:
    return F.col(name).isNotNull().cast("bigint")


def purchases(key: str = "customer_email") -> Partials:
    return Partials([key], {"orders": F.lit(1).cast("bigint"), "amount": _amount("total_amount"), "amounts": _present("total_amount")}, {"last_purchase_date": F.col("order_date")})


def support(key: str = "customer_email") -> Partials:
    sums = {"tickets": F.lit(1).cast("bigint"), "open": F.coalesce(F.col("status").isin(OPEN_STATUSES), F.lit(False)).cast("bigint")}
    for name in ("resolution_time_hours", "satisfaction_rating"):
        sums |= {f"{name}_sum": _amount(name), f"{name}_count": _present(name)}
    return Partials([key], sums, {"last_ticket_date": F.col("created_at")})


def visits(key: str = "user_id") -> Partials:
    return Partials([key, "session_id"], {"views": F.lit(1).cast("bigint")}, {"last_visit": F.col("event_timestamp")})


def pages(key: str = "user_id") -> Partials:
    return Partials([key, "page_path"], maxima={"seen": F.col("event_timestamp")})


def refresh(facts: BucketTable, root: str, partials: Partials) -> BucketTable:
    """The partials under ``root`` brought to the version of ``facts``; created if there are none."""
    schema = ", ".join(f"`{column.name}` {column.dataType.simpleString()}" for column in partials.of(facts.rows([])).schema)
    kept = BucketTable(facts.spark, root, KEY, schema)
    for number in range(kept.number + 1, facts.number + 1):
        arrived = partials.of(BucketTable(facts.spark, facts.root, facts.key, facts.schema, number).added())
        kept = kept.fold(arrived, list(partials.sums), list(partials.maxima)) if number else BucketTable.create(arrived, root, KEY)
    return kept


def _mean(total: str, count: str) -> Column:
    return F.col(total).cast("double") / F.nullif(F.col(count), F.lit(0))


def purchase_metrics(kept: BucketTable) -> DataFrame:
    """The columns of :func:`profilum.operators.metrics.purchase_metrics`."""
    return kept.rows().select(
        "customer_email", F.col("orders").alias("total_orders"), F.col("amount").cast("double").alias("lifetime_value"), "last_purchase_date", _mean("amount", "amounts").alias("avg_order_value")
    )


def support_metrics(kept: BucketTable) -> DataFrame:
    """The columns of :func:`profilum.operators.metrics.support_metrics` with stored hours."""
    return kept.rows().select(
        "customer_email", F.col("tickets").alias("total_tickets"), F.col("open").alias("open_tickets"),
        _mean("resolution_time_hours_sum", "resolution_time_hours_count").alias("avg_resolution_hours"),
        "last_ticket_date", _mean("satisfaction_rating_sum", "satisfaction_rating_count").alias("avg_satisfaction_score"),
    )


def web_metrics(sessions: BucketTable, seen: BucketTable, limit: int = 10) -> DataFrame:
    """The columns of :func:`profilum.operators.metrics.web_metrics`, pages by name, out of a row per session and per page."""
    totals = sessions.rows().groupBy("user_id").agg(F.count("session_id").alias("total_sessions"), F.sum("views").alias("total_page_views"), F.max("last_visit").alias("last_visit"))
    named = top_per_group(seen.rows().filter(F.col("page_path").isNotNull()).select("user_id", "page_path"), ["user_id"], [F.col("page_path")], limit)
    return totals.join(named.groupBy("user_id").agg(F.sort_array(F.collect_list("page_path")).alias("visited_pages")), "user_id", "left")
