"""Profiles and scores on hand-written tables."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from profilum import schemas
from profilum.functions import policies, scoring
from profilum.functions.columns import relative_age, safe_divide
from profilum.operators import customers as people
from profilum.operators import metrics, rollups
from profilum.operators.profile import create_views, customer_profile
from profilum.sources.model import Tables

DAY = dt.datetime(2024, 6, 30)


def ago(days):
    return DAY - dt.timedelta(days=days)


@pytest.fixture(scope="module")
def tables(spark):
    def person(key, email):
        return (key, email, "Ann", key, None, None, None, ago(900), "Direct", "Active")

    people_rows = [person("a", "a@x.org"), person("b", "b@x.org"), person("c", "c@x.org"), person("d", "d@x.org"), person("n", None)]
    order_rows = [
        ("o1", "a", "a@x.org", ago(181), "completed", 6000.0, 1, None, "PayPal"),
        ("o2", "a", "a@x.org", ago(300), "cancelled", 4000.5, 1, None, "Credit Card"),
        ("o2", "a", "a@x.org", ago(300), "cancelled", 4000.5, 1, None, "Credit Card"),
        ("o3", "b", "b@x.org", ago(180), "completed", 1000.0, 1, None, "PayPal"),
        ("o4", "c", "c@x.org", ago(90), "completed", 5000.0, 1, None, None),
        ("o5", "n", None, ago(1), "completed", 9.0, 1, None, None),
    ]
    ticket_rows = [
        ("t1", "a", "a@x.org", "s", "d", "open", "low", ago(5), None, None, None, "billing|refund"),
        ("t2", "a", "a@x.org", "s", "d", "solved", "low", ago(9), ago(8), 10, 3, "billing"),
        ("t3", "b", "b@x.org", "s", "d", "pending", "low", ago(9), None, None, None, None),
        ("t4", "x", "x@x.org", "s", "d", "open", "low", ago(9), None, None, None, ""),
    ]
    event_rows = [(f"e{i}", "a", f"s{i % 2}", "page_view", f"/p{i:02d}", ago(20 - i), "mobile", "Direct") for i in range(12)]
    event_rows += [("e0", "a", "s0", "page_view", "/p00", ago(20), "mobile", "Direct"), ("e99", None, "s9", "search", "/home", ago(1), None, None)]
    return Tables(
        customers=spark.createDataFrame(people_rows, schemas.CUSTOMERS),
        orders=spark.createDataFrame(order_rows, schemas.ORDERS),
        tickets=spark.createDataFrame(ticket_rows, schemas.SUPPORT_TICKETS).withColumn("resolved_at", F.col("updated_at")),
        events=spark.createDataFrame(event_rows, schemas.ANALYTICS_EVENTS),
    )


def by_id(frame, key="customer_id"):
    return {row[key]: row for row in frame.collect()}


def test_simple_profile(tables):
    rows = by_id(customer_profile(tables, "2024-06-30"))
    assert set(rows) == {"a", "b", "c", "d"}
    a = rows["a"]
    # A repeated order id counts once but its amount is summed, as COUNT(DISTINCT) next to SUM does.
    assert (a.total_orders, a.lifetime_value, a.days_since_last_purchase) == (2, 14001.0, 181)
    assert (a.total_tickets, a.open_tickets, a.avg_resolution_hours, a.avg_satisfaction_score) == (2, 1, 10.0, 3.0)
    assert (a.total_sessions, a.total_page_views) == (2, 12)
    assert a.visited_pages == [f"/p{i:02d}" for i in range(10)]
    assert (a.customer_segment, a.churn_risk) == ("VIP", "High Risk")
    # Exactly 180 days is not over 180; exactly 1000 is not over 1000.
    assert (rows["b"].customer_segment, rows["b"].churn_risk) == ("Low Value", "Medium Risk")
    # Exactly 90 days is not over 90; exactly 5000 is not over 5000.
    assert (rows["c"].customer_segment, rows["c"].churn_risk) == ("Medium Value", "Low Risk")
    d = rows["d"]
    assert (d.total_orders, d.lifetime_value, d.days_since_last_purchase, d.visited_pages) == (0, 0.0, None, [])
    assert (d.customer_segment, d.churn_risk) == ("Low Value", "Low Risk")


def test_rich_profiles(tables):
    strict, loose = (by_id(customer_profile(tables, "2024-06-30", policy)) for policy in ("rfm_and", "rfm_or"))
    a = strict["a"]
    assert a.visited_pages == [f"/p{i:02d}" for i in range(11, 1, -1)]
    assert a.preferred_payment_methods == "Credit Card, PayPal" and a.common_ticket_tags == "billing, refund"
    assert a.acquisition_sources == ["Direct"] and a.avg_resolution_hours == 24.0
    # Fewer than ten orders are no VIP; one open ticket is not over one.
    assert (a.customer_segment, a.churn_risk) == ("High Value", "Medium Risk")
    assert loose["a"].churn_risk == "High Risk" and loose["b"].churn_risk == "Medium Risk"
    assert strict["b"].customer_segment == "Medium Value" and strict["c"].customer_segment == "High Value"
    assert strict["d"].customer_segment == "General"


def test_restricted_profile_equals_filtered(spark, tables):
    only = spark.createDataFrame([("A@X.org",), ("d@x.org",), ("zz",)], "email string")
    part = customer_profile(tables, "2024-06-30", only=only)
    whole = customer_profile(tables, "2024-06-30").filter(F.col("customer_id").isin("a", "d"))
    assert sorted(map(str, part.collect())) == sorted(map(str, whole.collect()))


def test_unique_ids_shortcut_agrees(tables):
    events = tables.events.dropDuplicates(["event_id"])
    slow, fast = (by_id(metrics.web_activity(events, unique_ids=flag), "user_id") for flag in (False, True))
    assert slow == fast


def test_views_follow_each_other(spark, tables):
    create_views(tables, "2024-06-30")
    assert spark.table("churn_risk_summary").agg(F.sum("customer_count")).first()[0] == 4
    assert spark.table("customer_segments").agg(F.sum("customer_count")).first()[0] == 4


def test_unknown_policy():
    with pytest.raises(ValueError):
        policies.segment("other", F.lit(1), F.lit(1))


SCORED = "days_since_last_purchase int, total_orders bigint, lifetime_value double, avg_satisfaction_score double, open_tickets bigint, churn_risk string, customer_segment string"


@pytest.mark.parametrize(
    "row, mean, overall, deduction, churn",
    [
        # No orders: only the support part counts; missing parts default to fifty in the weighted score.
        ((None, 0, 0.0, None, 0, "Low Risk", "Low Value"), 100, 35, 100, 0.0),
        # Zero satisfaction reads as missing.
        ((29, 10, 10000.0, 0.0, 0, "Low Risk", "VIP"), 100, 92, 100, 0.0),
        ((30, 5, 5000.0, 5.0, 2, "Low Risk", "Medium Value"), 69, 66, 95, 0.15),
        ((90, 1, 150.0, 3.5, 3, "Low Risk", "Low Value"), 32, 29, 85, 0.15),
        ((91, 1, 150.0, 3.4, 4, "Medium Risk", "Low Value"), 31, 29, 50, 0.65),
        ((181, 21, 5000.01, 2.9, 1, "High Risk", "High Value"), 60, 57, 55, 0.7),
        ((180, 1, 100.0, 3.0, 2, "Medium Risk", "Low Value"), 33, 28, 60, 0.5),
    ],
)
def test_scores(spark, row, mean, overall, deduction, churn):
    frame = spark.createDataFrame([row], SCORED)
    found = frame.select(
        scoring.health_mean().alias("mean"), scoring.health_detailed()["overall_score"].alias("overall"),
        scoring.health_deduction().alias("deduction"), F.round(scoring.churn_probability(), 6).alias("churn"),
    ).first()
    assert tuple(found) == (mean, overall, deduction, churn)


def test_factors(spark):
    frame = spark.createDataFrame([(91, 21, 10000.01, 4.5, 3, "High Risk", "VIP"), (None, 20, 10000.0, 0.0, 2, "Low Risk", "General")], SCORED)
    parts = scoring.health_detailed()
    rows = frame.select(parts["risk_factors"].alias("risk"), parts["positive_factors"].alias("good")).collect()
    assert rows[0].risk == ["No purchases in 90+ days", "Multiple open support tickets", "High churn risk identified"]
    assert len(rows[0].good) == 4
    assert rows[1].risk == [] and rows[1].good == []


def test_percentile_against_definition(spark):
    values = [0.0] * 40 + [float(i % 7) for i in range(50)] + [1e9, -3.0]
    frame = spark.createDataFrame([(i, v) for i, v in enumerate(values)] + [(999, None)], "customer_id bigint, lifetime_value double")
    found = by_id(people.value_percentile(frame, slices=5))
    for i, value in enumerate(values):
        assert found[i].percentile == pytest.approx(100 * sum(v <= value for v in values) / len(values))
    assert found[999].percentile is None


def test_similar_by_part(spark):
    profile = spark.createDataFrame(
        [(1, "Sam@x.org", "S", None, "VIP"), (2, "sammy@x.org", None, None, "VIP"), (3, "bob@x.org", "B", "B", "VIP"), (4, "q@sam.org", None, "Q", "VIP")],
        "customer_id bigint, email string, first_name string, last_name string, customer_segment string",
    )
    asked = spark.createDataFrame([("q1", "SAM@x.org"), ("q2", "bo"), ("q3", "nobody@x.org"), ("q4", "@x.org")], "query_id string, email string")
    rows = people.similar_customers(asked, profile, 3).collect()
    found = {}
    for row in sorted(rows, key=lambda row: (row.query_id, row.rank)):
        found.setdefault(row.query_id, []).append((row.email, row.distance))
    assert found["q1"] == [("Sam@x.org", 0), ("sammy@x.org", 2), ("q@sam.org", 4)]
    assert found["q2"] == [("bob@x.org", 7)]
    assert "q3" not in found
    # Nothing before the @ is contained in every address.
    assert len(found["q4"]) == 3


def test_normalised_names(spark):
    rows = [("VIP", "VIP"), ("vip", "VIP"), ("high value", "High Value"), ("LOW_VALUE", "Low Value"), ("High Value", "High Value"), ("gold", "General"), (None, "General")]
    frame = spark.createDataFrame(rows, "raw string, wanted string")
    assert all(row.got == row.wanted for row in frame.select("wanted", people.normalize_segment(F.col("raw")).alias("got")).collect())
    rows = [("High Risk", "High Risk"), ("medium", "Medium Risk"), ("LOW", "Low Risk"), ("high risk", "Low Risk"), (None, "Low Risk")]
    frame = spark.createDataFrame(rows, "raw string, wanted string")
    assert all(row.got == row.wanted for row in frame.select("wanted", people.normalize_churn(F.col("raw")).alias("got")).collect())


def test_ages(spark):
    now = dt.datetime(2024, 6, 30, 12)
    spans = [
        (dt.timedelta(days=800), "2 years ago"), (dt.timedelta(days=366), "1 year ago"), (dt.timedelta(days=365), "12 months ago"), (dt.timedelta(days=31), "1 month ago"),
        (dt.timedelta(days=30), "30 days ago"), (dt.timedelta(days=1), "1 day ago"), (dt.timedelta(seconds=7200), "2 hours ago"), (dt.timedelta(seconds=3600), "60 minutes ago"),
        (dt.timedelta(seconds=61), "1 minute ago"), (dt.timedelta(seconds=60), "Just now"),
    ]
    frame = spark.createDataFrame([(now - span, label) for span, label in spans] + [(None, "Never")], "at timestamp_ntz, wanted string")
    for row in frame.select("wanted", relative_age(F.col("at"), F.lit(now).cast("timestamp_ntz")).alias("got")).collect():
        assert row.got == row.wanted


def test_safe_divide(spark):
    frame = spark.createDataFrame([(1.0, 4.0), (1.0, 0.0), (None, 2.0)], "a double, b double")
    assert [row[0] for row in frame.select(safe_divide("a", "b")).collect()] == [0.25, 0.0, 0.0]


def test_stats_of_an_empty_table(spark):
    empty = spark.createDataFrame([], "embedding array<double>")
    row = rollups.embedding_stats({"none": empty}).first()
    assert (row.total_rows, row.completion_percentage) == (0, None)
