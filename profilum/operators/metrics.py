"""Per-customer metrics over orders, tickets and web events.

Each aggregate is combined on the map side before its shuffle, so a customer that owns a third of
the rows sends one partial row per input split. Lists with a limit are ranked (the rank limit is
applied before the shuffle) and only the survivors are collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilum.fixed_values import OPEN_STATUSES
from profilum.functions.columns import any_of, col


def _count_ids(column: Column, unique: bool) -> Column:
    return F.count(column) if unique else F.countDistinct(column)


def top_per_group(rows: DataFrame, group: list[str], order: list[Column], limit: int, rank: str = "rank") -> DataFrame:
    """The first ``limit`` rows of each group under a total order, with their rank."""
    window = Window.partitionBy(*group).orderBy(*order)
    return rows.withColumn(rank, F.row_number().over(window)).filter(F.col(rank) <= limit)


def purchase_metrics(orders: DataFrame, key: str = "customer_email", unique_ids: bool = False) -> DataFrame:
    """Order count, value, last order and mean order value per ``key``."""
    total = F.sum("total_amount").cast("double")
    return (
        orders.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            _count_ids(F.col("order_id"), unique_ids).alias("total_orders"),
            total.alias("lifetime_value"),
            F.max("order_date").alias("last_purchase_date"),
            (total / F.nullif(F.count("total_amount"), F.lit(0))).alias("avg_order_value"),
        )
    )


def support_metrics(tickets: DataFrame, key: str = "customer_email", hours: str = "stored", unique_ids: bool = False) -> DataFrame:
    """Ticket counts, mean resolution hours and mean satisfaction per ``key``.

    ``hours='stored'`` averages the stored hours; ``'elapsed'`` measures whole hours from creation
    to resolution of solved tickets.
    """
    if hours == "stored":
        spent = F.col("resolution_time_hours")
    else:
        solved = (F.col("status") == "solved") & F.col("resolved_at").isNotNull()
        spent = F.when(solved, F.timestamp_diff("HOUR", F.col("created_at"), F.col("resolved_at")))
    is_open = F.col("status").isin(OPEN_STATUSES)
    return (
        tickets.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            _count_ids(F.col("ticket_id"), unique_ids).alias("total_tickets"),
            _count_ids(F.when(is_open, F.col("ticket_id")), unique_ids).alias("open_tickets"),
            F.avg(spent).alias("avg_resolution_hours"),
            F.max("created_at").alias("last_ticket_date"),
            F.avg("satisfaction_rating").alias("avg_satisfaction_score"),
        )
    )


def ticket_status_counts(tickets: DataFrame, key: str = "customer_email") -> DataFrame:
    """Tickets, open tickets and solved tickets per ``key`` by conditional counting."""
    return (
        tickets.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(
            F.count("*").alias("total_tickets"),
            F.count_if(F.col("status").isin(OPEN_STATUSES)).alias("open_tickets"),
            F.count_if(F.col("status") == "solved").alias("solved_tickets"),
        )
    )


def resolution_hours(tickets: DataFrame, key: str = "customer_email") -> DataFrame:
    """Mean whole hours from creation to resolution per ``key``; unresolved tickets are ignored."""
    elapsed = F.timestamp_diff("HOUR", F.col("created_at"), F.col("resolved_at"))
    return (
        tickets.filter(F.col(key).isNotNull())
        .groupBy(key)
        .agg(F.avg(elapsed).alias("avg_resolution_hours"), F.count("resolved_at").alias("resolved_tickets"))
    )


def ticket_tag_counts(tickets: DataFrame, separator: str = "|") -> DataFrame:
    """Tickets per tag. Tickets without tags drop out, as an inner unnest does."""
    split = F.split("tags", any_of(separator))
    return (
        tickets.select("ticket_id", F.explode(split).alias("tag"))
        .filter(F.col("tag") != "")
        .groupBy("tag")
        .agg(F.count("*").alias("tickets"))
    )


def common_tags(tickets: DataFrame, key: str = "customer_email", separator: str = "|") -> DataFrame:
    """Distinct tags per ``key`` as one text. Tags are made distinct before they meet in one row."""
    tagged = tickets.filter(F.col(key).isNotNull()).select(key, F.explode(F.split("tags", any_of(separator))).alias("tag"))
    return tagged.filter(F.col("tag") != "").distinct().groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("tag")), ", ").alias("common_ticket_tags"))


def preferred_payment_methods(orders: DataFrame, key: str = "customer_id") -> DataFrame:
    """Distinct payment methods per ``key`` as one text in alphabetical order."""
    pairs = orders.filter(F.col(key).isNotNull() & F.col("payment_method").isNotNull()).select(key, "payment_method").distinct()
    return pairs.groupBy(key).agg(F.array_join(F.sort_array(F.collect_list("payment_method")), ", ").alias("preferred_payment_methods"))


def acquisition_sources(events: DataFrame, key: str = "user_id") -> DataFrame:
    """Distinct traffic sources per ``key`` in alphabetical order."""
    pairs = events.filter(F.col(key).isNotNull() & F.col("traffic_source").isNotNull()).select(key, "traffic_source").distinct()
    return pairs.groupBy(key).agg(F.sort_array(F.collect_list("traffic_source")).alias("acquisition_sources"))


def web_activity(events: DataFrame, key: str = "user_id", unique_ids: bool = False) -> DataFrame:
    """Distinct sessions, events and the last visit per ``key``."""
    known = events.filter(F.col(key).isNotNull())
    if not unique_ids:
        return known.groupBy(key).agg(
            F.countDistinct("session_id").alias("total_sessions"),
            F.countDistinct("event_id").alias("total_page_views"),
            F.max("event_timestamp").alias("last_visit"),
        )
    sessions = known.groupBy(key, "session_id").agg(F.count("event_id").alias("views"), F.max("event_timestamp").alias("last_visit"))
    return sessions.groupBy(key).agg(
        F.count("session_id").alias("total_sessions"),
        F.sum("views").alias("total_page_views"),
        F.max("last_visit").alias("last_visit"),
    )


def visited_pages(events: DataFrame, key: str = "user_id", limit: int = 10, by: str = "name") -> DataFrame:
    """At most ``limit`` distinct pages per ``key``: the first by name, or the latest seen."""
    known = events.filter(F.col(key).isNotNull() & F.col("page_path").isNotNull())
    pages = known.groupBy(key, "page_path").agg(F.max("event_timestamp").alias("seen"))
    order = [F.col("page_path")] if by == "name" else [F.col("seen").desc(), F.col("page_path")]
    ranked = top_per_group(pages, [key], order, limit)
    listed = F.transform(F.sort_array(F.collect_list(F.struct("rank", "page_path"))), lambda row: row["page_path"])
    return ranked.groupBy(key).agg(listed.alias("visited_pages"))


def web_metrics(events: DataFrame, key: str = "user_id", pages: str = "name", unique_ids: bool = False) -> DataFrame:
    """Web activity with the list of visited pages."""
    return web_activity(events, key, unique_ids).join(visited_pages(events, key, by=pages), key, "left")


def orders_left_grouped(customers: DataFrame, orders: DataFrame, unique_ids: bool = False) -> DataFrame:
    """Order metrics for every customer, zeros when there are none.

    Orders are reduced to one row per customer before the join, so the join never fans out.
    """
    metrics = purchase_metrics(orders, "customer_id", unique_ids)
    joined = customers.select("customer_id", "email").join(metrics, "customer_id", "left")
    return joined.select(
        "customer_id",
        "email",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("lifetime_value", F.lit(0.0)).alias("lifetime_value"),
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        "last_purchase_date",
    )


def recent_rows(rows: DataFrame, key: str, moment: str, tie: str, limit: int) -> DataFrame:
    """The newest ``limit`` rows per ``key``."""
    return top_per_group(rows, [key], [F.col(moment).desc(), col(tie)], limit)
