"""Loads under rules, clustered tables."""

import pytest
from pyspark.sql import functions as F

from profilum.session import fresh_path
from profilum.sources import checked, store

SCHEMA = "id bigint, amount double, name string"
RULES = {"amount >= 0": "amount >= 0", "named": "name <> ''"}


def rows(frame):
    return sorted((tuple(row) for row in frame.collect()), key=repr)


def test_bad_rows_go_aside_with_all_their_reasons(spark):
    root = fresh_path(spark, "checked")
    source = spark.createDataFrame([(1, 1.0, "a"), (2, -1.0, ""), (3, None, "c"), (None, None, None), (1, 1.0, "a")], SCHEMA)
    load = checked.checked_load(source, root, RULES, bound=0.6)
    assert (load.number, load.rows_checked, load.rows_refused, load.violations) == (1, 5, 3, {"amount >= 0": 3, "named": 2})
    assert rows(load.accepted(spark)) == [(1, 1.0, "a"), (1, 1.0, "a")]
    assert rows(load.refused(spark).select("id", checked.BROKEN)) == [(2, ["amount >= 0", "named"]), (3, ["amount >= 0"]), (None, ["amount >= 0", "named"])]
    assert rows(load.report(spark)) == [("amount >= 0", 5, 3), ("named", 5, 2)]
    assert checked.current(spark, root) == load


def test_a_load_over_the_bound_is_not_committed(spark):
    root = fresh_path(spark, "checked")
    first = checked.checked_load(spark.createDataFrame([(1, 1.0, "a")], SCHEMA), root, RULES)
    with pytest.raises(checked.RulesBroken) as raised:
        checked.checked_load(spark.createDataFrame([(2, -1.0, "b"), (3, 1.0, "c")], SCHEMA), root, RULES, bound=0.4)
    assert checked.current(spark, root) == first
    assert rows(raised.value.load.refused(spark)) == [(2, -1.0, "b", ["amount >= 0"])]
    # The bound itself is allowed.
    assert checked.checked_load(spark.createDataFrame([(2, -1.0, "b"), (3, 1.0, "c")], SCHEMA), root, RULES, bound=0.5).number == 2


def test_empty_sources_no_rules_and_missing_columns(spark):
    root = fresh_path(spark, "checked")
    assert checked.current(spark, root) is None
    load = checked.checked_load(spark.createDataFrame([], SCHEMA), root, RULES)
    assert (load.rows_checked, load.rows_refused, load.accepted(spark).count(), load.refused(spark).count()) == (0, 0, 0, 0)
    assert checked.checked_load(spark.createDataFrame([(1, None, None)], SCHEMA), root, {}).accepted(spark).count() == 1
    with pytest.raises(ValueError, match="embedding"):
        checked.checked_load(spark.createDataFrame([("1", "text")], "ticket_id string, full_text string"), root, {}, kind="tickets_embedded")
    with pytest.raises(ValueError, match=checked.BROKEN):
        checked.checked_load(spark.createDataFrame([(1, "x")], f"id bigint, {checked.BROKEN} string"), root, {})
    assert checked.current(spark, root).number == 2


def test_lines_that_do_not_parse(spark):
    folder = fresh_path(spark, "lines")
    lines = ["id,amount,name", "1,2.5,a", "x,2.5,b", "3,-1,c", "4,oops,"]
    spark.createDataFrame([("\n".join(lines),)], "value string").coalesce(1).write.text(folder)
    load = checked.checked_csv(spark, folder, SCHEMA, fresh_path(spark, "checked"), RULES, bound=1.0)
    assert rows(load.accepted(spark)) == [(1, 2.5, "a", None)]
    refused = {row["_bad_row"] or row["name"]: row[checked.BROKEN] for row in load.refused(spark).collect()}
    assert refused == {"x,2.5,b": ["row parses"], "c": ["amount >= 0"], "4,oops,": ["row parses", "amount >= 0", "named"]}


def test_a_load_reads_its_source_once(spark):
    """The write counts; nothing else runs over the rows."""
    reads = spark.sparkContext.accumulator(0)

    def count(frames):
        for frame in frames:
            reads.add(len(frame))
            yield frame

    source = spark.range(1000).select(F.col("id"), F.col("id").cast("double").alias("amount"), F.lit("n").alias("name")).mapInPandas(count, SCHEMA)
    assert checked.checked_load(source, fresh_path(spark, "checked"), RULES).rows_checked == 1000
    assert reads.value == 1000


def scanned_rows(frame):
    """Rows that the scan hands on, after files and row groups were skipped."""
    frame.collect()
    leaves = frame._jdf.queryExecution().executedPlan().collectLeaves()
    return sum(leaves.apply(place).metrics().apply("numOutputRows").value() for place in range(leaves.size()))


def test_a_clustered_table_is_read_in_part(spark):
    """One address costs a small share of the rows, also where another has a third of them."""
    frame = spark.range(60_000).select(
        F.col("id").alias("ticket_id"),
        F.when(F.col("id") % 3 == 0, "hot@x").otherwise(F.concat(F.lit("c"), F.pmod(F.xxhash64("id"), F.lit(2000)).cast("string"), F.lit("@x"))).alias("customer_email"),
        F.lit("open").alias("status"), F.sha2(F.col("id").cast("string"), 512).alias("full_text"),
        F.expr("timestampadd(DAY, cast(id % 2 as int), timestamp_ntz'2024-01-01 05:00:00')").alias("created_at"),
    )
    path = fresh_path(spark, "clustered")
    spark.conf.set("spark.sql.adaptive.enabled", "false")
    try:
        store.write_clustered(frame, path, "ticket_id", row_group_bytes=200_000)
    finally:
        spark.conf.set("spark.sql.adaptive.enabled", "true")
    stored = spark.read.parquet(path)
    assert stored.count() == 60_000
    for address in ("c77@x", "c1999@x"):
        found = stored.filter(F.col("customer_email") == address)
        assert found.count() == frame.filter(F.col("customer_email") == address).count() > 0
        assert scanned_rows(found) < 0.2 * 60_000
    # Absent, and between others by name: only the Bloom filters know.
    assert scanned_rows(stored.filter(F.col("customer_email") == "c77@y")) < 0.2 * 60_000
    # Rows of one address lie in several files, as one task could not write them at scale.
    hot = stored.filter(F.col("customer_email") == "hot@x")
    assert hot.select(F.input_file_name()).distinct().count() >= 4
