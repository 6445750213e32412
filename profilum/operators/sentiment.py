"""Interaction sentiment: daily means, trend per customer and the context built from them."""

from __future__ import annotations

from collections.abc import Iterator
from itertools import islice

import ahocorasick
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.fixed_values import ANALYST_CLOSING, ANALYST_OPENING, ANALYST_QUERY, INTERACTION_ERROR, SENTIMENT_CLOSING, SENTIMENT_OPENING, SENTIMENT_SUMMARY, SOURCE_MARKS
from profilum.functions.columns import mean_exact, number_text
from profilum.functions.documents import interaction_text
from profilum.operators.metrics import top_per_group
from profilum.sources.store import write_version

# Ids that one automaton holds.
AUTOMATON_IDS = 1 << 17
# Texts that are searched at once, and rows that leave at once.
TEXTS, HITS = 256, 4096
VOLATILE_SPREAD = 0.5
TREND_SLOPE = 0.005


def _since(as_of: str, days: int):
    return F.col("timestamp") >= F.lit(as_of).cast("timestamp_ntz") - F.expr(f"INTERVAL {int(days)} DAYS")


def recent_interactions(interactions: DataFrame, as_of: str, days: int = 30, limit: int = 100) -> DataFrame:
    """The newest interactions of the last days, as one bounded extract."""
    return interactions.filter(_since(as_of, days)).orderBy(F.col("timestamp").desc(), F.col("interaction_id")).limit(limit)


def daily_sentiment(interactions: DataFrame, as_of: str, days: int = 90, newest: int = 30) -> DataFrame:
    """Mean sentiment and interactions per customer and day; the newest days of each customer."""
    daily = (
        interactions.filter(_since(as_of, days))
        .groupBy("customer_id", F.to_date("timestamp").alias("date"))
        .agg(F.round(mean_exact(F.col("sentiment_score")), 3).alias("avg_sentiment"), F.count("*").alias("interactions"))
    )
    return top_per_group(daily, ["customer_id"], [F.col("date").desc()], newest).drop("rank")


def sentiment_trend(daily: DataFrame, as_of: str) -> DataFrame:
    """Latest daily mean and a trend label per customer.

    Volatile when the daily means spread widely, otherwise improving or declining by the slope of
    the means over time, otherwise stable. A customer has at most thirty daily rows here.
    """
    day = -F.datediff(F.lit(as_of).cast("date"), F.col("date"))
    shaped = daily.groupBy("customer_id").agg(
        F.max_by("avg_sentiment", "date").alias("latest_avg_sentiment"),
        F.round(F.regr_slope(F.col("avg_sentiment"), day.cast("double")), 6).alias("slope"),
        F.round(F.stddev_pop("avg_sentiment"), 6).alias("spread"),
        F.count("*").alias("days"),
        F.sum("interactions").alias("interactions"),
    )
    return shaped.withColumn("trend", _trend_label())


def _trend_label() -> Column:
    return (
        F.when(F.col("spread") > VOLATILE_SPREAD, "volatile")
        .when(F.col("slope") > TREND_SLOPE, "improving")
        .when(F.col("slope") < -TREND_SLOPE, "declining")
        .otherwise("stable")
    )


def trend_sums(daily: DataFrame) -> DataFrame:
    """What a trend needs of some days, per customer, in columns that add up: whole numbers and decimals with the
    three digits of a daily mean, so that sums are the same in every order. ``newest`` is a maximum. Days without
    a score count as days but take no part in the line."""
    x = F.datediff(F.col("date"), F.lit("1970-01-01").cast("date")).cast("bigint")
    y = F.col("avg_sentiment").cast("decimal(4,3)")
    scored = y.isNotNull()

    def total(value: Column, kind: str, name: str) -> Column:
        return F.coalesce(F.sum(F.when(scored, value)), F.lit(0)).cast(kind).alias(name)

    return daily.filter(F.col("customer_id").isNotNull()).groupBy("customer_id").agg(
        F.count("*").alias("days"), F.coalesce(F.sum("interactions"), F.lit(0)).cast("bigint").alias("interactions"),
        total(F.lit(1), "bigint", "n"), total(x, "bigint", "sum_x"), total(x * x, "bigint", "sum_xx"),
        total(y, "decimal(24,3)", "sum_y"), total(x * y, "decimal(24,3)", "sum_xy"), total(y * y, "decimal(24,6)", "sum_yy"),
        F.max(F.struct("date", y.alias("mean"))).alias("newest"),
    )


TREND_SUMS = ["days", "interactions", "n", "sum_x", "sum_xx", "sum_y", "sum_xy", "sum_yy"]


def trend_of_sums(sums: DataFrame) -> DataFrame:
    """The columns of :func:`sentiment_trend` out of :func:`trend_sums`, one row per customer."""
    n = F.col("n")
    across = n * F.col("sum_xx") - F.col("sum_x") * F.col("sum_x")
    along = n * F.col("sum_xy") - F.col("sum_x") * F.col("sum_y")
    spread = n * F.col("sum_yy") - F.col("sum_y") * F.col("sum_y")
    shaped = sums.select(
        "customer_id", F.col("newest.mean").cast("double").alias("latest_avg_sentiment"),
        F.round(along.cast("double") / F.nullif(across, F.lit(0)).cast("double"), 6).alias("slope"),
        F.round(F.sqrt(spread.cast("double")) / F.nullif(n, F.lit(0)), 6).alias("spread"),
        "days", "interactions",
    )
    return shaped.withColumn("trend", _trend_label())


def sentiment_prompts(daily: DataFrame) -> DataFrame:
    """Per customer: the question that asks for a summary of its daily rows, newest first.

    A customer has at most thirty daily rows, so they fit one text.
    """
    record = F.concat(
        F.lit('{"date": "'), F.col("date").cast("string"), F.lit('", "avg_sentiment": '), number_text(F.col("avg_sentiment")),
        F.lit(', "interactions": '), F.col("interactions").cast("string"), F.lit("}"),
    )
    newest_first = F.reverse(F.sort_array(F.collect_list(F.struct("date", record.alias("record")))))
    listed = daily.groupBy("customer_id").agg(F.array_join(F.transform(newest_first, lambda row: row["record"]), ", ").alias("records"))
    return listed.select(
        "customer_id",
        F.concat(
            F.lit(SENTIMENT_OPENING), F.col("customer_id").cast("string"), F.lit(":\n\n["), F.col("records"), F.lit("]\n\n"), F.lit(SENTIMENT_CLOSING)
        ).alias("prompt"),
    )


def interaction_documents(interactions: DataFrame) -> DataFrame:
    return interactions.select("interaction_id", "customer_id", "timestamp", interaction_text().alias("content"), "metadata")


def customer_docs(documents: DataFrame, customers: DataFrame) -> DataFrame:
    """Documents of the listed customers, matched by customer id rather than by text."""
    return documents.join(customers.select("customer_id").distinct(), "customer_id", "left_semi")


def containing(batches, ids: list[str]) -> Iterator[pa.RecordBatch]:
    """The rows whose ``content`` holds one of the ids, once per id. A text can hold most ids, so few texts are
    searched at once and their rows leave in bounded batches."""
    automaton = ahocorasick.Automaton()
    for one in ids:
        automaton.add_word(one, one)
    if not len(automaton):
        return
    automaton.make_automaton()
    for whole in batches:
        for first in range(0, whole.num_rows, TEXTS):
            batch = whole.slice(first, TEXTS)
            texts = batch.column("content").to_pylist()
            hits = ((row, one) for row, text in enumerate(texts) if text for one in sorted({one for _, one in automaton.iter(text)}))
            while some := list(islice(hits, HITS)):
                rows = batch.take(pa.array([row for row, _ in some], type=pa.int64()))
                yield pa.RecordBatch.from_arrays([*rows.columns, pa.array([one for _, one in some], type=pa.string())], names=[*rows.schema.names, "wanted_id"])


def docs_containing(documents: DataFrame, customers: DataFrame, key: str = "customer_id") -> DataFrame:
    """Documents whose text contains a listed id anywhere, also inside a longer one: a row per document and id found,
    as ``wanted_id``. Texts pass once per ``AUTOMATON_IDS`` ids, through an automaton of these ids. Null and empty ids are none."""
    ids = customers.select(F.col(key).cast("string").alias("wanted_id")).where("wanted_id <> ''").distinct()
    passes = max(1, -(-ids.count() // AUTOMATON_IDS))
    fields = ", ".join(f"`{field.name}` {field.dataType.simpleString()}" for field in documents.schema)
    ids = write_version(ids.withColumn("_pass", F.pmod(F.xxhash64("wanted_id"), F.lit(passes))), "wanted-ids")
    found = []
    for number in range(passes):
        # About AUTOMATON_IDS ids.
        some = [row.wanted_id for row in ids.where(F.col("_pass") == number).select("wanted_id").collect()]
        sent = documents.sparkSession.sparkContext.broadcast(some)

        def run(batches, sent=sent):
            return containing(batches, sent.value)

        found.append(documents.mapInArrow(run, f"{fields}, wanted_id string"))
    result = found[0]
    for more in found[1:]:
        result = result.unionByName(more)
    return result


def _summary(trend: Column, latest: Column) -> Column:
    parts = [F.col("customer_id").cast("string"), trend, latest]
    return F.concat(*[column for label, part in zip(SENTIMENT_SUMMARY, parts) for column in (F.lit(label), part)])


def _block(number: Column, content: Column) -> Column:
    before, after, end, last = map(F.lit, SOURCE_MARKS)
    return F.concat(before, number, after, content, end, number, last)


def combined_context(interactions: DataFrame, as_of: str, newest: int = 5) -> DataFrame:
    """Per customer: a sentiment document first, then the newest interactions, numbered.

    Interactions are ranked within their customer, so a customer that is quiet among all others
    still gets its own. A customer's sources travel as one array of a handful.
    """
    trends = sentiment_trend(daily_sentiment(interactions, as_of), as_of)
    recent = top_per_group(
        interactions.filter(_since(as_of, 30)), ["customer_id"], [F.col("timestamp").desc(), F.col("interaction_id")], newest
    )
    texts = recent.select(
        "customer_id",
        F.struct(
            (F.col("rank") + 1).alias("source_no"), F.col("interaction_id").cast("string").alias("doc_id"), interaction_text().alias("content")
        ).alias("source"),
    ).groupBy("customer_id").agg(F.collect_list("source").alias("recent"))
    summary = F.struct(
        F.lit(1).alias("source_no"),
        F.lit("SENTIMENT_SUMMARY").alias("doc_id"),
        _summary(F.col("trend"), number_text(F.col("latest_avg_sentiment"))).alias("content"),
    )
    joined = trends.join(texts, "customer_id", "left")
    sources = F.when(F.col("recent").isNull(), F.array(summary)).otherwise(F.concat(F.array(summary), F.col("recent")))
    return joined.select("customer_id", F.explode(sources).alias("source")).select("customer_id", "source.*")


def context_blocks(context: DataFrame) -> DataFrame:
    """One text per customer with its numbered sources in order; a customer has a handful."""
    block = _block(F.col("source_no").cast("string"), F.col("content"))
    listed = F.sort_array(F.collect_list(F.struct(F.col("source_no"), block.alias("block"))))
    return context.groupBy("customer_id").agg(
        F.array_join(F.transform(listed, lambda row: row["block"]), "\n").alias("context_block"), F.count("*").alias("sources")
    )


def analyst_prompts(questions: DataFrame, blocks: DataFrame) -> DataFrame:
    """One prompt per question about a customer, from that customer's context.

    ``questions`` has ``query_id``, ``query_text`` and ``customer_id``. A customer without recent
    interactions gets the bare summary line.
    """
    nothing = _block(F.lit("1"), _summary(F.lit("None"), F.lit("None")))
    joined = questions.join(blocks.select("customer_id", "context_block"), "customer_id", "left")
    return joined.select(
        "query_id",
        "customer_id",
        F.concat(
            F.lit(ANALYST_OPENING), F.coalesce("context_block", nothing), F.lit(ANALYST_QUERY), F.col("query_text"), F.lit(ANALYST_CLOSING)
        ).alias("prompt"),
    )


def interaction_records(answers: DataFrame, trends: DataFrame, context: DataFrame) -> DataFrame:
    """One record per answer about a customer's interactions: answer, cited sources, sentiment and status.

    ``answers`` has ``answer_id``, ``customer_id``, ``query_text`` and ``answer_text``, and may have ``error`` and
    ``response_time_ms``; ``trends`` and ``context`` are what :func:`sentiment_trend` and :func:`combined_context` give.
    A customer without recent interactions has the bare summary as its one source.
    """
    for name, kind in (("error", "string"), ("response_time_ms", "bigint")):
        if name not in answers.columns:
            answers = answers.withColumn(name, F.lit(None).cast(kind))
    offered = answers.join(context.select("customer_id", "source_no", "doc_id", "content"), "customer_id", "left").select(
        "answer_id",
        F.coalesce("source_no", F.lit(1)).alias("source_id"),
        F.coalesce("doc_id", F.lit("SENTIMENT_SUMMARY")).alias("doc_id"),
        F.concat(F.substring(F.coalesce("content", _summary(F.lit("None"), F.lit("None"))), 1, 200), F.lit("...")).alias("content_snippet"),
        F.col("answer_text").contains(F.concat(F.lit("[Source "), F.coalesce("source_no", F.lit(1)).cast("string"), F.lit("]"))).alias("cited"),
        "error",
    )
    source = F.when(F.col("cited") & F.col("error").isNull(), F.struct("source_id", "doc_id", "content_snippet"))
    gathered = offered.groupBy("answer_id").agg(F.sort_array(F.collect_list(source)).alias("citations"), F.count("*").alias("sources_used"))
    report = trends.select("customer_id", F.struct("trend", "latest_avg_sentiment").alias("sentiment_report"))
    failed = F.col("error").isNotNull()
    return answers.join(gathered, "answer_id").join(report, "customer_id", "left").select(
        "answer_id", "customer_id", F.col("query_text").alias("query"),
        F.when(failed, F.concat(F.lit(INTERACTION_ERROR), F.col("error"))).otherwise(F.col("answer_text")).alias("final_answer"),
        "citations", "sentiment_report", F.struct("sources_used", "response_time_ms").alias("metadata"),
        F.when(failed, "error").otherwise("success").alias("status"),
    )
