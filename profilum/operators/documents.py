"""Corpus operators: chunks, cleaning, keywords, token budgets and row checks."""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from profilum.fixed_values import STOP_WORDS, WORD_PUNCTUATION
from profilum.functions import text as texts
from profilum.functions.chunking import chunk_bounds, chunk_sizes
from profilum.functions.membership import key_filter
from profilum.operators.metrics import top_per_group
from profilum.schemas import REQUIRED_COLUMNS
from profilum.sources.store import write_version


# Chunks leave a task in frames of about so many characters.
OUTPUT_CHARACTERS = 4_000_000
TEXTS = 128


def chunk_documents(documents: DataFrame, key: str = "doc_id", text: str = "text", max_tokens: int = 8000, overlap: int = 200) -> DataFrame:
    """Chunks of every whole text with their number and start; one short text is one chunk."""
    size, shared = chunk_sizes(max_tokens, overlap)
    source = documents.select(F.col(key), F.col(text).alias("text")).filter(F.col("text").isNotNull())
    key_type = source.schema[key].dataType.simpleString()

    def cut(batches):
        for batch in batches:
            schema = pa.schema([batch.schema.field(0), ("chunk_no", pa.int32()), ("start", pa.int64()), ("chunk", pa.string())])
            rows, characters = ([], [], [], []), 0
            # A few texts of a batch at once, so that a task holds its texts once and few of them twice.
            for first in range(0, batch.num_rows, TEXTS):
                part = batch.slice(first, TEXTS)
                for doc, whole in zip(part.column(0).to_pylist(), part.column(1).to_pylist()):
                    for number, (start, end) in enumerate(chunk_bounds(whole, size, shared)):
                        for column, value in zip(rows, (doc, number, start, whole[start:end])):
                            column.append(value)
                        characters += end - start
                        if characters >= OUTPUT_CHARACTERS:
                            yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(rows, schema)], schema=schema)
                            rows, characters = ([], [], [], []), 0
            if rows[0]:
                yield pa.RecordBatch.from_arrays([pa.array(column, field.type) for column, field in zip(rows, schema)], schema=schema)

    return source.mapInArrow(cut, f"{key} {key_type}, chunk_no int, start bigint, chunk string")


def sanitize_corpus(documents: DataFrame, text: str = "text") -> DataFrame:
    return documents.withColumn("clean_text", texts.sanitize(F.col(text)))


def document_keywords(documents: DataFrame, key: str = "doc_id", text: str = "text", limit: int = 10) -> DataFrame:
    """The most frequent words of each document; earlier words win ties.

    A key that has one row is counted within that row, and nothing of its text moves. Keys with several rows, found
    by moving the keys alone, are counted per word and row before their words move.
    """
    repeated = write_version(documents.groupBy(key).agg(F.count("*").alias("_rows")).filter("_rows > 1").select(key), "repeated-keys")
    several = repeated.count()
    if not several:
        return _row_keywords(documents, key, text, limit)
    # Keys that the filter only takes for repeated are counted the longer way, with the same result.
    shared = key_filter(repeated, F.col(key), count=several).holds(documents.sparkSession, F.col(key))
    return _row_keywords(documents.filter(~shared), key, text, limit).unionByName(_key_keywords(documents.filter(shared), key, text, limit))


def _is_keyword(word: Column) -> Column:
    return (F.length(word) > 3) & ~word.isin(STOP_WORDS)


def _row_keywords(documents: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """The keywords of each row on its own: its words sorted, equal words are runs."""
    raw = F.split(F.lower(F.col(text)), texts.WHITESPACE)
    named = F.transform(raw, lambda word, place: F.struct(F.btrim(word, F.lit(WORD_PUNCTUATION)).alias("keyword"), place.alias("place")))
    words = documents.select(key, F.sort_array(F.filter(named, lambda word: _is_keyword(word["keyword"]))).alias("_words"))

    def opens(place: Column) -> Column:
        return (place == 0) | (F.get("_words", place)["keyword"] != F.get("_words", place - 1)["keyword"])

    places = F.when(F.size("_words") > 0, F.sequence(F.lit(0), F.size("_words") - 1)).otherwise(F.array().cast("array<int>"))
    runs = words.select(key, "_words", F.filter(places, opens).alias("_starts"))

    def run(start: Column, number: Column) -> Column:
        first, end = F.get("_words", start), F.coalesce(F.get("_starts", number + 1), F.size("_words"))
        return F.struct((start - end).cast("bigint").alias("fewer"), first["place"].alias("place"), first["keyword"].alias("keyword"))

    best = runs.select(key, F.slice(F.sort_array(F.transform("_starts", run)), 1, limit).alias("_best"))
    # Outer, as the rows without keywords are otherwise looked for by counting all of them before.
    ranked = best.select(key, F.posexplode_outer("_best").alias("_place", "_run")).filter(F.col("_run").isNotNull())
    return ranked.select(key, F.col("_run.keyword").alias("keyword"), (-F.col("_run.fewer")).alias("occurrences"), (F.col("_place") + 1).alias("rank"))


def _key_keywords(documents: DataFrame, key: str, text: str, limit: int) -> DataFrame:
    """The keywords of all rows of a key together."""
    words = documents.select(key, F.posexplode(F.split(F.lower(F.col(text)), texts.WHITESPACE)).alias("position", "raw"))
    word = F.btrim(F.col("raw"), F.lit(WORD_PUNCTUATION))
    counted = (
        words.select(key, "position", word.alias("keyword"))
        .filter(_is_keyword(F.col("keyword")))
        .groupBy(key, "keyword")
        .agg(F.count("*").alias("occurrences"), F.min("position").alias("first_position"))
    )
    return top_per_group(counted, [key], [F.col("occurrences").desc(), F.col("first_position")], limit).drop("first_position")


def token_budget(documents: DataFrame, group: str = "source", text: str = "text", max_tokens: int = 512) -> DataFrame:
    """Per source: documents, estimated tokens, documents over the limit and tokens kept under it."""
    tokens = texts.token_estimate(F.col(text))
    kept = F.length(texts.truncate_to_tokens(F.col(text), max_tokens))
    return documents.select(group, tokens.alias("tokens"), F.length(text).alias("chars"), kept.alias("kept")).groupBy(group).agg(
        F.count("*").alias("documents"),
        F.sum("tokens").alias("estimated_tokens"),
        F.count_if(F.col("chars") > 4 * max_tokens).alias("over_budget"),
        F.sum("kept").cast("bigint").alias("kept_chars"),
    )


def email_quality(customers: DataFrame, group: str = "acquisition_channel") -> DataFrame:
    """Valid, invalid and missing addresses per group."""
    email = F.col("email")
    valid = texts.valid_email(email)
    return customers.groupBy(group).agg(
        F.count("*").alias("customers"),
        F.count_if(valid).alias("valid_emails"),
        F.count_if(email.isNotNull() & ~valid).alias("invalid_emails"),
        F.count_if(email.isNull()).alias("missing_emails"),
    )


PROFILE_RULES: dict[str, Column | str] = {
    "lifetime_value >= 0": "lifetime_value >= 0",
    "total_orders >= 0": "total_orders >= 0",
    "avg_order_value >= 0": "avg_order_value >= 0",
    "total_sessions >= 0": "total_sessions >= 0",
    "total_page_views >= 0": "total_page_views >= 0",
    "open_tickets >= 0": "open_tickets >= 0",
    "total_tickets >= 0": "total_tickets >= 0",
    "satisfaction in 0..5": "avg_satisfaction_score is null or avg_satisfaction_score between 0 and 5",
}
HIT_RULES = {"similarity in 0..1": "similarity_score between 0 and 1"}
SCORE_RULES = {
    f"{name} in 0..100": f"{name} between 0 and 100"
    for name in ("overall_score", "recency_score", "frequency_score", "monetary_score", "satisfaction_score", "support_health_score")
}


def constraint_violations(rows: DataFrame, rules: dict[str, str]) -> DataFrame:
    """Rows checked and rows breaking each rule, in one pass; NULL breaks a rule."""
    counts = [F.count_if(~F.coalesce(F.expr(test), F.lit(False))).alias(name) for name, test in rules.items()]
    wide = rows.agg(F.count("*").alias("rows_checked"), *counts)
    return wide.unpivot(["rows_checked"], [F.col(f"`{name}`") for name in rules], "rule", "violations")


def missing_columns(table: DataFrame, kind: str) -> list[str]:
    """Required columns that a table of this kind lacks."""
    return [name for name in REQUIRED_COLUMNS[kind] if name not in table.columns]
