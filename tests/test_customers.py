"""Similar customers against a comparison of all addresses, with parts of mixed lengths."""

from pyspark.sql import functions as F

from profilum.operators.customers import lookup_suggestions, similar_customers

ADDRESSES = ["anna@example.com", "Hannah.b@example.com", "an@x.org", "bob+an@example.com", "zoe@example.com", "n", "", None, "ananas@example.com", "customer1@example.com"]
ASKED = ["an@nowhere.com", "ann@x", "example.com", "@x", "a", "", None, "hannah.b@example.org", "qqq@x", "com", "nn@"]


def distance(left, right):
    row = list(range(len(right) + 1))
    for i, a in enumerate(left, 1):
        row, before = [i], row
        for j, b in enumerate(right, 1):
            row.append(min(row[-1] + 1, before[j] + 1, before[j - 1] + (a != b)))
    return row[-1]


def test_equals_all_pairs(spark):
    people = [(i, email, "A", "B", "VIP") for i, email in enumerate(ADDRESSES)]
    profile = spark.createDataFrame(people, "customer_id bigint, email string, first_name string, last_name string, customer_segment string")
    requests = spark.createDataFrame([(i, email) for i, email in enumerate(ASKED)], "query_id int, email string")
    found = sorted((row.query_id, row["rank"], row.email, row.distance) for row in similar_customers(requests, profile, 3).collect())
    expected = []
    for query, email in enumerate(ASKED):
        if email is None:
            continue
        part = email.split("@")[0].lower()
        hits = sorted((distance(other.lower(), email.lower()), other) for other in ADDRESSES if other is not None and part in other.lower())
        expected += [(query, rank, other, far) for rank, (far, other) in enumerate(hits[:3], 1)]
    assert found == sorted(expected)


def test_a_part_that_every_address_holds(spark):
    profile = spark.range(3000).select(F.col("id").alias("customer_id"), F.format_string("customer%05d@example.com", "id").alias("email"), F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("VIP").alias("customer_segment"))
    requests = spark.createDataFrame([(1, "customer"), (2, "customer00007@example.org"), (3, "")], "query_id int, email string")
    found = {}
    for row in similar_customers(requests, profile).orderBy("query_id", "rank").collect():
        found.setdefault(row.query_id, []).append(row.email)
    assert found[2] == ["customer00007@example.com"] and len(found[1]) == len(found[3]) == 5
    assert found[1] == [f"customer{i:05d}@example.com" for i in range(5)]


def test_cut_addresses_are_not_sent_around(spark, tmp_path):
    """A table whose file is far smaller than its cut addresses, and requests that repeat: only what requests bring is broadcast."""
    path = f"file://{tmp_path}/people"
    spark.range(20_000).select(F.col("id").alias("customer_id"), F.lit("A").alias("first_name"), F.lit("B").alias("last_name"), F.lit("VIP").alias("customer_segment")).coalesce(1).write.parquet(path)
    profile = spark.read.parquet(path).withColumn("email", F.format_string("customer%09d@example.com", "customer_id"))
    requests = spark.range(2_000).select(F.col("id").alias("query_id"), F.format_string("customer%08d@example.com", F.col("id") % 40).alias("email"))
    for found in (similar_customers(requests, profile, 3), lookup_suggestions(requests, profile, 3)):
        rows = found.collect()
        assert len(rows) == 6_000 and len({(row.query_id % 40, row["rank"], row.email) for row in rows}) == 120
        metrics, waiting = [], [found._jdf.queryExecution().executedPlan()]
        while waiting:
            node = waiting.pop()
            name = node.getClass().getSimpleName()
            if name == "BroadcastExchangeExec":
                metrics.append(node.metrics().apply("numOutputRows").value())
            waiting += [node.executedPlan()] if name == "AdaptiveSparkPlanExec" else [node.plan()] if name.endswith("QueryStageExec") else []
            children = node.children()
            waiting += [children.apply(at) for at in range(children.size())]
        assert max(metrics, default=0) <= 6_000
