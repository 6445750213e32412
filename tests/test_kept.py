"""Kept metrics against the metrics of all facts at once."""

import datetime

import pytest
from pyspark.sql import functions as F

from profilum.operators import kept, metrics
from profilum.operators.profile import customer_profile
from profilum.session import fresh_path
from profilum.sources import model
from profilum.sources.buckets import BucketTable


def rows(frame):
    return sorted(map(tuple, frame.select(*sorted(frame.columns)).collect()), key=repr)


@pytest.fixture
def orders(spark):
    """A hot customer with a third of the orders, orders without customer, amount or date."""
    day = datetime.date(2001, 1, 1)
    found = [(i, "hot" if i % 3 == 0 else f"c{i % 7}", day + datetime.timedelta(days=i % 50), i % 11) for i in range(300)]
    return spark.createDataFrame([(i, *rest[:2], None) if i % 13 == 0 else (i, *rest) for i, *rest in found] + [(900, None, day, 5), (901, "dateless", None, 5)],
                                 "order_id bigint, customer_email string, order_date date, total_amount int").selectExpr("order_id", "customer_email", "order_date", "cast(total_amount as decimal(10,2)) total_amount")


def test_landings_fold_into_partials(spark, orders):
    table = BucketTable.create(orders.where("order_id < 100"), fresh_path(spark, "facts"), "order_id")
    root = fresh_path(spark, "partials")
    first = kept.refresh(table, root, kept.purchases())
    assert rows(kept.purchase_metrics(first)) == rows(metrics.purchase_metrics(orders.where("order_id < 100")))
    # Two landings with repeated and known rows, a landing without rows, a compaction: one refresh makes up for all.
    table = table.insert_missing(orders.where("order_id < 200").union(orders.where("order_id < 200")))
    table = table.insert_missing(orders.limit(0)).compact().insert_missing(orders)
    last = kept.refresh(table, root, kept.purchases())
    assert rows(kept.purchase_metrics(last)) == rows(metrics.purchase_metrics(orders))
    # Nothing new: nothing is written. The version before is as it was.
    assert kept.refresh(table, root, kept.purchases()).number == last.number == table.number
    assert rows(kept.purchase_metrics(BucketTable(spark, root, kept.KEY, last.schema, 0))) == rows(kept.purchase_metrics(first))


def test_a_landing_touches_its_own_groups(spark, orders):
    table = BucketTable.create(orders, fresh_path(spark, "facts"), "order_id")
    root = fresh_path(spark, "partials")
    kept.refresh(table, root, kept.purchases())
    one = orders.where("order_id = 4").withColumn("order_id", F.lit(5000).cast("bigint"))
    after = kept.refresh(table.insert_missing(one), root, kept.purchases())
    assert [row.customer_email for row in after.added().collect()] == ["c4"]


def test_no_facts(spark, orders):
    table = BucketTable.create(orders.limit(0), fresh_path(spark, "facts"), "order_id")
    root = fresh_path(spark, "partials")
    assert kept.refresh(table, root, kept.purchases()).rows().count() == 0
    assert rows(kept.purchase_metrics(kept.refresh(table.insert_missing(orders), root, kept.purchases()))) == rows(metrics.purchase_metrics(orders))


def test_an_empty_insert_keeps_the_filters(spark):
    known = spark.range(50).select(F.col("id").alias("key"), F.lit("known").alias("value"))
    table = BucketTable.create(known, fresh_path(spark, "facts"), "key").insert_missing(known.limit(0))
    assert {row.value for row in table.insert_missing(known.withColumn("value", F.lit("late"))).rows().collect()} == {"known"}


def test_profile_of_kept_metrics(spark):
    """All three fact tables, through two landings, give the profile of the whole tables."""
    tables = model.tables(spark, "/root/testdata/sf0.001")

    def landed(facts, key):
        return BucketTable.create(facts.filter(F.col(key) % 2 == 0), fresh_path(spark, "facts"), key).insert_missing(facts)

    def measured(table, partials):
        return kept.refresh(table, fresh_path(spark, "partials"), partials)

    events = landed(tables.events, "event_id")
    known = (
        kept.purchase_metrics(measured(landed(tables.orders, "order_id"), kept.purchases())),
        kept.support_metrics(measured(landed(tables.tickets, "ticket_id"), kept.support())),
        kept.web_metrics(measured(events, kept.visits()), measured(events, kept.pages())),
    )
    assert rows(customer_profile(tables, model.AS_OF, measured=known)) == rows(customer_profile(tables, model.AS_OF))
    with pytest.raises(ValueError):
        customer_profile(tables, model.AS_OF, "rfm_or", measured=known)
