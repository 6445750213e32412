"""What the plans must keep at scale: pruned scans, limits before shuffles, joins that fall away."""

import re

import pytest
from pyspark.sql import functions as F

from profilum.operators import metrics, retrieval, rollups, search
from profilum.operators.profile import customer_profile
from profilum.sources import model

FOLDER = "/root/testdata/sf0.001"


def plan(frame):
    return frame._jdf.queryExecution().executedPlan().toString()


def scans(text):
    return [(re.search(r"(\w+)\.parquet", line).group(1), re.search(r"ReadSchema: struct<(.*?)>", line).group(1)) for line in text.splitlines() if "FileScan parquet" in line]


@pytest.fixture(scope="module")
def wide_session(spark):
    # Plans print whole paths and column lists only with a longer limit.
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    yield spark
    spark.conf.unset("spark.sql.maxMetadataStringLength")


def test_summary_reads_only_what_it_needs(wide_session):
    text = plan(rollups.customer_segments(customer_profile(model.tables(wide_session, FOLDER), model.AS_OF)))
    read = dict(scans(text))
    # Tickets, events, nations and regions are not part of the question.
    assert set(read) == {"customer", "orders"}
    assert {part.split(":")[0] for part in read["orders"].split(",")} == {"o_orderkey", "o_custkey", "o_totalprice"}
    assert read["customer"] == "c_custkey:bigint"


def test_limits_come_before_the_shuffle(wide_session):
    text = plan(metrics.recent_rows(model.orders(wide_session, FOLDER), "customer_id", "order_date", "order_id", 3))
    assert text.index("Final") < text.index("Exchange hashpartitioning(customer_id") < text.index("Partial")
    hits = search.top_k(model.user_queries(wide_session, FOLDER), model.tickets_embedded(wide_session, FOLDER), "ticket_id")
    text = plan(hits)
    assert text.index("Exchange hashpartitioning(query_id") < text.index("Partial") < text.index("MapInPandas")


def test_search_moves_no_texts(wide_session):
    hits = search.top_k(model.user_queries(wide_session, FOLDER), model.tickets_embedded(wide_session, FOLDER), "ticket_id")
    assert dict(scans(plan(hits)))["documents"] == "doc_id:bigint"


def test_filters_reach_the_scan(wide_session):
    text = plan(model.user_queries(wide_session, FOLDER, vectors=False))
    assert "PushedFilters: [IsNotNull(role), EqualTo(role,user)]" in text


def test_a_list_of_addresses_has_one_plan(wide_session):
    """Facts are cut by semi-joins before they are combined, and the plan is the same whatever the length of the list."""
    shapes = set()
    for count in (499, 500, 501):
        listed = wide_session.range(count).select(model.email_of(F.col("id")).alias("email"))
        text = plan(customer_profile(model.tables(wide_session, FOLDER), model.AS_OF, only=listed).select("customer_id", "total_sessions"))
        assert "LeftSemi" in text
        shapes.add(tuple(re.findall(r"^[ :+*()\d-]*([A-Z]\w+)", text, re.MULTILINE)))
    assert len(shapes) == 1


def test_timeline_shuffles_customers_not_days(wide_session):
    timeline = rollups.customer_timeline(
        model.customers(wide_session, FOLDER), model.orders(wide_session, FOLDER), model.tickets(wide_session, FOLDER), "2001-07-20"
    )
    text = plan(timeline)
    # The day rows are produced above every exchange.
    assert text.index("Generate explode") < text.index("Exchange")


def test_metrics_are_combined_before_they_move(wide_session):
    text = plan(metrics.purchase_metrics(model.orders(wide_session, FOLDER), unique_ids=True))
    assert text.count("Exchange hashpartitioning") == 1 and "partial_sum" in text
    loose = plan(metrics.purchase_metrics(model.orders(wide_session, FOLDER)))
    assert loose.count("Exchange hashpartitioning") == 2


def test_lines_of_products_without_vectors_do_not_meet_their_orders(spark):
    orders = spark.createDataFrame([(1, 10), (2, 20), (3, 10)], "order_id long, customer_id long")
    lines = spark.createDataFrame([(1, 100), (1, 100), (1, 101), (2, 102), (3, 100), (3, None), (9, 100)], "order_id long, product_id long")
    products = spark.createDataFrame([(100, [1.0, 0.0]), (101, [0.0, 1.0]), (102, None), (103, [1.0, 1.0])], "product_id long, embedding array<float>")
    vectors = retrieval.purchase_vectors(orders, lines, products)
    text = plan(vectors)
    assert text.count("LeftSemi") == 1 and text.index("SortMergeJoin [order_id") < text.index("LeftSemi")
    assert vectors.collect() == [(10, [0.5, 0.5])]
