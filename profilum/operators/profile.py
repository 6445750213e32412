"""The one-row-per-customer profile that joins CRM, orders, tickets and web events."""

from __future__ import annotations

from dataclasses import replace

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.functions import policies
from profilum.operators import metrics
from profilum.sources.model import Tables


def days_since(as_of: str, moment: Column | str) -> Column:
    moment = F.col(moment) if isinstance(moment, str) else moment
    return F.datediff(F.lit(as_of).cast("date"), F.to_date(moment))


def restrict(tables: Tables, emails: DataFrame, by_id: bool = False) -> Tables:
    """The tables cut down to customers whose address is listed, ignoring case.

    The facts are cut by semi-joins on the keys of those customers before they are aggregated, since a
    filter on the finished profile is not passed into the left-joined aggregates. Spark sends a short
    list of keys to the scans; a long one meets the facts in a shuffle, where a busy customer is split
    like any skewed join.
    """
    wanted = emails.select(F.lower("email").alias("_wanted")).distinct()
    customers = tables.customers.join(wanted, F.lower("email") == F.col("_wanted"), "left_semi")
    addresses = customers.select(F.col("email").alias("customer_email"))
    ids = customers.select("customer_id")
    return replace(
        tables,
        customers=customers,
        orders=tables.orders.join(ids, "customer_id", "left_semi") if by_id else tables.orders.join(addresses, "customer_email", "left_semi"),
        tickets=tables.tickets.join(addresses, "customer_email", "left_semi"),
        events=tables.events.join(ids.withColumnRenamed("customer_id", "user_id"), "user_id", "left_semi"),
    )


def customer_profile(tables: Tables, as_of: str, policy: str = "simple", only: DataFrame | None = None, measured: tuple[DataFrame, DataFrame, DataFrame] | None = None) -> DataFrame:
    """Profiles under one of the policies of :mod:`profilum.functions.policies`.

    ``simple`` matches orders by address; the other two match them by customer id, measure elapsed
    resolution hours, order pages by recency and add payment methods, tags and traffic sources.
    ``measured`` has the metrics of orders, tickets and events under policy ``simple`` if they are known
    already (:mod:`profilum.operators.kept`); the facts are not read then.
    """
    rich = policy != "simple"
    if measured and rich:
        raise ValueError("kept metrics are those of the policy simple")
    if only is not None:
        tables = restrict(tables, only, rich)
    base = tables.customers.filter(F.col("email").isNotNull())
    unique = tables.unique_ids

    if measured:
        bought, helped, visits = measured
        bought, helped, visits = bought.withColumnRenamed("customer_email", "email"), helped.withColumnRenamed("customer_email", "email"), visits.withColumnRenamed("user_id", "customer_id")
    elif rich:
        bought = metrics.purchase_metrics(tables.orders, "customer_id", unique)
    else:
        bought = metrics.purchase_metrics(tables.orders, "customer_email", unique).withColumnRenamed("customer_email", "email")
    if not measured:
        helped = metrics.support_metrics(tables.tickets, hours="elapsed" if rich else "stored", unique_ids=unique).withColumnRenamed("customer_email", "email")
        visits = metrics.web_metrics(tables.events, pages="recent" if rich else "name", unique_ids=unique).withColumnRenamed("user_id", "customer_id")

    if rich:
        joined = base.join(helped, "email", "left").join(bought, "customer_id", "left").join(visits, "customer_id", "left")
    else:
        joined = base.join(bought, "email", "left").join(helped, "email", "left").join(visits, "customer_id", "left")
    extra: list[Column | str] = []
    if rich:
        tags = metrics.common_tags(tables.tickets).withColumnRenamed("customer_email", "email")
        joined = (
            joined.join(metrics.preferred_payment_methods(tables.orders), "customer_id", "left")
            .join(metrics.acquisition_sources(tables.events).withColumnRenamed("user_id", "customer_id"), "customer_id", "left")
            .join(tags, "email", "left")
        )
        extra = ["preferred_payment_methods", "common_ticket_tags", "acquisition_sources"]

    days = days_since(as_of, "last_purchase_date")
    no_texts = F.array().cast("array<string>")
    return joined.select(
        "customer_id", "email", "first_name", "last_name", "phone",
        F.col("company").alias("account_name"),
        "industry", "customer_since", "acquisition_channel",
        F.coalesce("total_orders", F.lit(0)).alias("total_orders"),
        F.coalesce("lifetime_value", F.lit(0.0)).alias("lifetime_value"),
        "last_purchase_date",
        F.coalesce("avg_order_value", F.lit(0.0)).alias("avg_order_value"),
        no_texts.alias("purchased_product_ids"),
        F.coalesce("total_tickets", F.lit(0)).alias("total_tickets"),
        F.coalesce("open_tickets", F.lit(0)).alias("open_tickets"),
        "avg_resolution_hours", "last_ticket_date", "avg_satisfaction_score",
        F.coalesce("total_sessions", F.lit(0)).alias("total_sessions"),
        F.coalesce("total_page_views", F.lit(0)).alias("total_page_views"),
        "last_visit",
        F.coalesce("visited_pages", no_texts).alias("visited_pages"),
        days.alias("days_since_last_purchase"),
        policies.segment(policy, F.col("lifetime_value"), F.col("total_orders")).alias("customer_segment"),
        policies.churn(policy, days, F.col("open_tickets")).alias("churn_risk"),
        *extra,
    )


def create_views(tables: Tables, as_of: str, policy: str = "simple") -> None:
    """Register the profile and its two summaries as temporary views, replacing older ones."""
    from profilum.operators import rollups

    profile = customer_profile(tables, as_of, policy)
    profile.createOrReplaceTempView("unified_customer_view")
    rollups.churn_risk_summary(profile).createOrReplaceTempView("churn_risk_summary")
    rollups.customer_segments(profile).createOrReplaceTempView("customer_segments")
