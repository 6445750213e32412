"""Lookups, listings, rankings and comparisons over profiles."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from profilum.fixed_values import CHURN_RISK_NAMES, CHURN_RISKS, SEGMENTS
from profilum.functions import scoring
from profilum.functions.columns import display_name, relative_age
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version


def customer_lookup(requests: DataFrame, profile: DataFrame) -> DataFrame:
    """The profile whose address equals each requested one, ignoring case; NULLs when unknown.

    ``requests`` has ``query_id`` and ``email``. When an address occurs twice the smallest customer
    id is taken.
    """
    first = top_per_group(profile.withColumn("email_norm", F.lower("email")), ["email_norm"], [F.col("customer_id")], 1).drop("rank")
    named = first.withColumn("name", display_name()).drop("email")
    wanted = requests.select("query_id", F.col("email").alias("requested_email"), F.lower("email").alias("email_norm"))
    return wanted.join(named, "email_norm", "left").drop("email_norm")


GRAM = 3


def _grams(value: Column, size: Column) -> Column:
    """The distinct substrings of a size; the empty one for size 0, none if the value is shorter."""
    starts = F.sequence(F.lit(1), F.greatest(F.length(value) - size + 1, F.lit(1)))
    found = F.array_distinct(F.transform(starts, lambda start: F.substring(value, start, size)))
    return F.when(size == 0, F.array(F.lit(""))).when(F.length(value) >= size, found).otherwise(F.array().cast("array<string>"))


def similar_customers(requests: DataFrame, profile: DataFrame, limit: int = 5) -> DataFrame:
    """Customers whose address contains the part before ``@``, nearest spelling first.

    ``requests`` has ``query_id`` and ``email``. A part is looked up by the rarest of its substrings of three
    characters (of its own length if it is shorter, the empty one if it is empty), an equi-join with the
    substrings of the addresses; what meets is compared whole. Addresses are cut into substrings of the
    sizes that occur and keep those that some part is looked up by. An address that many requests name is
    looked up once.

    Spark takes the size of a table from its files and that of exploded rows from the rows before, so it would send
    the cut addresses around as if they were few: joins whose other side grows with the profile are told to shuffle.
    """
    # Written once: the parts are counted before they are looked up. A split at the first @ is the whole text when there is none.
    wanted = write_version(requests.select(
        "query_id", F.lower("email").alias("search_email"), F.lower(F.element_at(F.split("email", "@"), 1)).alias("part")
    ).filter(F.col("part").isNotNull()), "wanted")
    asked = wanted.select("search_email", "part").distinct()
    size = F.least(F.length("part"), F.lit(GRAM))
    parts = wanted.select("part", size.alias("size")).distinct()
    of_parts = parts.select("part", F.explode(_grams(F.col("part"), F.col("size"))).alias("gram"))
    sizes = parts.agg(F.collect_set("size")).scalar()
    address = F.lower("email")
    cuts = F.flatten(F.array(*[F.when(F.array_contains(sizes, F.lit(n)), _grams(address, F.lit(n))).otherwise(F.array().cast("array<string>")) for n in range(GRAM + 1)]))
    of_addresses = profile.filter(F.col("email").isNotNull()).select("customer_id", "email", F.explode(cuts).alias("gram"))
    common = of_addresses.join(of_parts.select("gram").distinct(), "gram", "left_semi").groupBy("gram").agg(F.count("*").alias("addresses"))
    rarity = F.struct(F.coalesce("addresses", F.lit(0)), "gram")
    # A row per part.
    rarest = write_version(of_parts.join(common.hint("merge"), "gram", "left").groupBy("part").agg(F.min_by("gram", rarity).alias("gram")), "rarest")
    looked_up = of_addresses.join(rarest.select("gram").distinct(), "gram", "left_semi")
    candidates = asked.join(rarest, "part").join(looked_up.hint("merge"), "gram").filter(address.contains(F.col("part"))).select(
        "search_email", "customer_id", "email", F.levenshtein(address, F.col("search_email")).alias("distance")
    )
    nearest = top_per_group(candidates, ["search_email"], [F.col("distance"), F.col("email")], limit).drop("email")
    # The rest of the profile is only needed for the few that are left.
    described = nearest.join(profile.select("customer_id", "email", "first_name", "last_name", "customer_segment").hint("merge"), "customer_id").select(
        "search_email", "rank", "email", display_name(default=None).alias("name"), F.col("customer_segment").alias("segment"), "distance"
    )
    return wanted.select("query_id", "search_email").join(described, "search_email").drop("search_email")


def lookup_suggestions(requests: DataFrame, profile: DataFrame, limit: int = 3) -> DataFrame:
    """Similar customers for the requested addresses that are unknown."""
    known = profile.select(F.lower("email").alias("email_norm")).distinct().hint("merge")
    missed = requests.withColumn("email_norm", F.lower("email")).join(known, "email_norm", "left_anti").drop("email_norm")
    return similar_customers(missed, profile, limit)


def top_customers(profile: DataFrame, limit: int = 100) -> DataFrame:
    """The customers of highest value."""
    return (
        profile.select(
            "customer_id", "email",
            display_name(default=None).alias("name"),
            F.col("customer_segment").alias("segment"),
            "churn_risk", "lifetime_value",
        )
        .orderBy(F.col("lifetime_value").desc(), "customer_id")
        .limit(limit)
    )


def high_risk_customers(profile: DataFrame) -> DataFrame:
    """Customers at high risk, most valuable first."""
    return (
        profile.filter(F.col("churn_risk") == "High Risk")
        .select("customer_id", display_name().alias("name"), "email", "lifetime_value", "days_since_last_purchase", "open_tickets")
        .orderBy(F.col("lifetime_value").desc(), "customer_id")
    )


def leaderboard(profile: DataFrame, limit: int = 10) -> DataFrame:
    """Ranked customers of highest value with orders and health. The limit comes first, so the
    ranking window sees at most ``limit`` rows."""
    best = profile.orderBy(F.col("lifetime_value").desc(), "customer_id").limit(limit)
    rank = F.row_number().over(Window.orderBy(F.col("lifetime_value").desc(), F.col("customer_id")))
    return best.select(
        rank.alias("rank"), "customer_id", display_name().alias("name"), "email", "lifetime_value", "total_orders",
        scoring.health_mean().alias("health_score"),
    )


def value_percentile(profile: DataFrame, column: str = "lifetime_value", key: str = "customer_id", slices: int | None = None) -> DataFrame:
    """Percentile rank of every row: the share of values not above its own, times one hundred.

    Equal values are counted first. The distinct values are sorted into ranges, by default as many as
    shuffle partitions, and written with their range; each range is summed on its own and shifted by
    the ranges below it, so no task sees all values.
    """
    # Written once: the ranks and the final join both read the values.
    values = write_version(profile.select(key, column), "values")
    counts = values.filter(F.col(column).isNotNull()).groupBy(column).agg(F.count("*").alias("n"))
    ranged = counts.repartitionByRange(slices, column) if slices else counts.repartitionByRange(column)
    placed = write_version(ranged.withColumn("slice", F.spark_partition_id()), "distinct-values")
    # One row per range: the running total over them is small.
    below = placed.groupBy("slice").agg(F.sum("n").alias("size")).select(
        "slice",
        F.coalesce(F.sum("size").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, -1)), F.lit(0)).alias("below"),
        F.sum("size").over(Window.orderBy("slice").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)).alias("total"),
    )
    within = F.sum("n").over(Window.partitionBy("slice").orderBy(column).rowsBetween(Window.unboundedPreceding, Window.currentRow))
    ranks = placed.withColumn("within", within).join(below, "slice").select(
        column, ((F.col("below") + F.col("within")) / F.col("total") * F.lit(100.0)).alias("percentile")
    )
    return values.join(ranks, column, "left").select(key, column, "percentile")


def compare_customers(pairs: DataFrame, profile: DataFrame) -> DataFrame:
    """Both profiles of each pair side by side. ``pairs`` has ``left_id`` and ``right_id``."""
    facts = profile.select(
        "customer_id",
        display_name().alias("name"),
        "customer_segment", "churn_risk", "lifetime_value", "total_orders",
        scoring.health_mean().alias("health"),
        scoring.churn_probability().alias("churn_probability"),
    )

    def side(name: str) -> DataFrame:
        return facts.select(*[F.col(c).alias(f"{name}_{'id' if c == 'customer_id' else c}") for c in facts.columns])

    both = pairs.join(side("left"), "left_id").join(side("right"), "right_id")
    return both.select(
        "left_id", "right_id", "left_name", "right_name",
        (F.col("left_customer_segment") == F.col("right_customer_segment")).alias("same_segment"),
        (F.col("left_churn_risk") == F.col("right_churn_risk")).alias("same_risk"),
        (F.col("left_lifetime_value") - F.col("right_lifetime_value")).alias("value_difference"),
        (F.col("left_total_orders") - F.col("right_total_orders")).alias("order_difference"),
        (F.col("left_health") - F.col("right_health")).alias("health_difference"),
        F.when(F.col("left_lifetime_value") >= F.col("right_lifetime_value"), F.col("left_id")).otherwise(F.col("right_id")).alias("more_valuable_id"),
        F.when(F.col("left_churn_probability") >= F.col("right_churn_probability"), F.col("left_id")).otherwise(F.col("right_id")).alias("higher_churn_id"),
    )


def normalize_segment(value: Column) -> Column:
    """Match by value, then by upper-case name with spaces as underscores; General otherwise."""
    by_value = F.when(value.isin(SEGMENTS), value)
    name = F.replace(F.upper(value), F.lit(" "), F.lit("_"))
    by_name = F.coalesce(*[F.when(name == segment.upper().replace(" ", "_"), segment) for segment in SEGMENTS])
    return F.coalesce(by_value, by_name, F.lit("General"))


def normalize_churn(value: Column) -> Column:
    """Match by value, then by upper-case name; Low Risk otherwise."""
    by_value = F.when(value.isin(CHURN_RISKS), value)
    name = F.replace(F.upper(value), F.lit(" "), F.lit("_"))
    by_name = F.coalesce(*[F.when(name == short, risk) for short, risk in CHURN_RISK_NAMES.items()])
    return F.coalesce(by_value, by_name, F.lit("Low Risk"))


def recency_buckets(profile: DataFrame, now: str) -> DataFrame:
    """Customers by the spelled-out age of their last order."""
    moment = F.col("last_purchase_date").cast("timestamp_ntz")
    label = relative_age(moment, F.lit(now).cast("timestamp_ntz"))
    return profile.groupBy(label.alias("last_purchase")).agg(F.count("*").alias("customers"))
