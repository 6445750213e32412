"""Summaries over profiles and facts.

Means of money run through decimal sums, so repeated runs agree to the last digit whatever the
partitioning. Where only the name of a figure is given by the dashboards, its definition is stated
in the docstring.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from profilum.functions import scoring
from profilum.functions.columns import mean_exact


def churn_risk_summary(profile: DataFrame) -> DataFrame:
    return profile.groupBy("churn_risk").agg(
        F.count("*").alias("customer_count"),
        mean_exact(F.col("lifetime_value")).alias("avg_ltv"),
        F.avg("days_since_last_purchase").alias("avg_days_inactive"),
    )


def customer_segments(profile: DataFrame) -> DataFrame:
    return profile.groupBy("customer_segment").agg(
        F.count("*").alias("customer_count"),
        mean_exact(F.col("lifetime_value")).alias("avg_ltv"),
        F.avg("total_orders").alias("avg_orders"),
    )


def view_health_check(profile: DataFrame) -> DataFrame:
    return profile.agg(
        F.count("*").alias("customer_count"),
        F.countDistinct("customer_segment").alias("segments"),
        F.countDistinct("churn_risk").alias("risk_levels"),
    )


def dataset_summary(tables: dict[str, DataFrame]) -> DataFrame:
    """Row counts of all tables, revenue, mean order value, open tickets and mean satisfaction,
    one row per figure."""
    parts = [frame.agg(F.count("*").cast("double").alias("value")).withColumn("metric", F.lit(f"rows_{name}")) for name, frame in sorted(tables.items())]
    orders, tickets = tables["orders"], tables["tickets"]
    revenue = F.sum("total_amount").cast("double")
    money = orders.agg(revenue.alias("revenue"), (revenue / F.count("total_amount")).alias("avg_order_value"))
    service = tickets.agg(
        F.count_if(F.col("status") == "open").cast("double").alias("open_tickets"),
        F.avg("satisfaction_rating").alias("avg_satisfaction"),
    )
    parts += [frame.unpivot([], frame.columns, "metric", "value") for frame in (money, service)]
    return reduce(lambda left, right: left.unionByName(right), parts).select("metric", "value")


def kpi_tiles(profile: DataFrame) -> DataFrame:
    """One row of figures. Churn rate is the share of High Risk customers; health is the mean score."""
    risky = F.count_if(F.col("churn_risk") == "High Risk")
    return profile.withColumn("health", scoring.health_mean()).agg(
        F.count("*").alias("total_customers"),
        mean_exact(F.col("lifetime_value")).alias("avg_ltv"),
        (risky / F.nullif(F.count("*"), F.lit(0))).alias("churn_rate"),
        risky.alias("high_risk_customers"),
        mean_exact(F.col("avg_satisfaction_score"), 9).alias("avg_satisfaction"),
        F.avg("health").alias("avg_health_score"),
    )


def _days(start: str, end: str):
    """Array of the dates from ``start`` to ``end``."""
    return F.sequence(F.lit(start).cast("date"), F.lit(end).cast("date"))


def daily_trends(profile: DataFrame, start: str, end: str) -> DataFrame:
    """New customers, churned customers and mean value per day of a date range, zero-filled.

    New: first known on that day. Churned: High Risk customers whose last order was on that day.
    Mean value: mean lifetime value of the customers whose last order was on that day.
    """
    spark = profile.sparkSession
    first, last = F.to_date("customer_since"), F.to_date("last_purchase_date")
    inside = F.col("day").between(F.lit(start).cast("date"), F.lit(end).cast("date"))
    facts = profile.select(
        F.explode(
            F.array(
                F.struct(first.alias("day"), F.lit(1).alias("new"), F.lit(0).alias("churned"), F.lit(None).cast("double").alias("ltv")),
                F.struct(
                    last.alias("day"), F.lit(0).alias("new"),
                    F.when(F.col("churn_risk") == "High Risk", 1).otherwise(0).alias("churned"),
                    F.col("lifetime_value").alias("ltv"),
                ),
            )
        ).alias("fact")
    ).select("fact.*")
    daily = facts.filter(inside).groupBy("day").agg(
        F.sum("new").alias("new_customers"), F.sum("churned").alias("churned_customers"), mean_exact(F.col("ltv")).alias("avg_ltv")
    )
    spine = spark.range(1).select(F.explode(_days(start, end)).alias("day"))
    return spine.join(daily, "day", "left").select(
        "day",
        F.coalesce("new_customers", F.lit(0)).alias("new_customers"),
        F.coalesce("churned_customers", F.lit(0)).alias("churned_customers"),
        "avg_ltv",
    )


def customer_timeline(customers: DataFrame, orders: DataFrame, tickets: DataFrame, end: str, days: int = 30) -> DataFrame:
    """Purchases and tickets of every customer on each of the ``days`` up to ``end``.

    The counts of a customer travel as one small map (at most one entry per day), so the joins move
    one row per customer and the day rows are produced after them.
    """
    last = F.lit(end).cast("date")
    first = F.date_sub(last, days - 1)

    def daily(rows: DataFrame, moment: str, name: str) -> DataFrame:
        counted = rows.select("customer_id", F.to_date(moment).alias("day")).filter(F.col("day").between(first, last)).groupBy("customer_id", "day").agg(F.count("*").alias("n"))
        return counted.groupBy("customer_id").agg(F.map_from_entries(F.collect_list(F.struct("day", "n"))).alias(name))

    joined = (
        customers.select("customer_id")
        .join(daily(orders, "order_date", "bought"), "customer_id", "left")
        .join(daily(tickets, "created_at", "raised"), "customer_id", "left")
    )
    spread = joined.select("customer_id", "bought", "raised", F.explode(F.sequence(first, last)).alias("day"))
    return spread.select(
        "customer_id",
        "day",
        F.coalesce(F.try_element_at("bought", F.col("day")), F.lit(0)).alias("purchases"),
        F.coalesce(F.try_element_at("raised", F.col("day")), F.lit(0)).alias("tickets"),
    )


def embedding_stats(tables: dict[str, DataFrame]) -> DataFrame:
    """Rows with and without a vector per document table, and the share done in percent."""
    parts = [
        frame.agg(F.count("*").alias("total_rows"), F.count("embedding").alias("rows_with_embeddings")).select(
            F.lit(name).alias("table_name"),
            "total_rows",
            "rows_with_embeddings",
            (F.col("total_rows") - F.col("rows_with_embeddings")).alias("rows_without_embeddings"),
            F.round(F.try_divide(F.col("rows_with_embeddings").cast("double"), F.col("total_rows")) * 100, 2).alias("completion_percentage"),
        )
        for name, frame in tables.items()
    ]
    return reduce(lambda left, right: left.unionByName(right), parts)


def embedding_dim_audit(tables: dict[str, DataFrame], expected: int) -> DataFrame:
    """Vectors per table and dimension, with a flag for the expected dimension."""
    parts = [
        frame.filter(F.col("embedding").isNotNull())
        .groupBy(F.size("embedding").alias("dimension"))
        .agg(F.count("*").alias("count"))
        .select(F.lit(name).alias("table_name"), "dimension", "count", (F.col("dimension") == expected).alias("as_expected"))
        for name, frame in tables.items()
    ]
    return reduce(lambda left, right: left.unionByName(right), parts).orderBy("table_name", "dimension")
