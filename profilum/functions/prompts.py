"""Prompt texts from a question, an optional profile and up to a handful of sources."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilum.fixed_values import (
    BUDGETED_CLOSING,
    BUDGETED_HEADING,
    BUDGETED_INSTRUCTIONS,
    BUDGETED_LABELS,
    PROFILE_HEADING,
    PROFILE_LABELS,
    PROMPT_CLOSING,
    PROMPT_INSTRUCTIONS,
)
from profilum.functions import scoring
from profilum.functions.columns import currency, display_name

MOMENT = "yyyy-MM-dd HH:mm:ss"


def _or(value: Column, missing: str) -> Column:
    return F.coalesce(value.cast("string"), F.lit(missing))


def profile_block() -> Column:
    """Fourteen labelled lines about the customer; NULL when the profile is missing."""
    rated = _or(F.nullif(F.col("avg_satisfaction_score"), F.lit(0.0)), "N/A")
    values = [
        display_name(),
        F.col("email"),
        F.col("customer_id").cast("string"),
        F.col("customer_segment"),
        currency("lifetime_value"),
        F.col("total_orders").cast("string"),
        currency("avg_order_value"),
        _or(F.col("days_since_last_purchase"), "None"),
        F.col("total_tickets").cast("string"),
        F.col("open_tickets").cast("string"),
        F.concat(rated, F.lit("/5.0")),
        F.col("churn_risk"),
        F.concat(scoring.health_deduction().cast("string"), F.lit("/100")),
        _or(F.date_format("customer_since", MOMENT), "None"),
    ]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), value) for label, value in zip(PROFILE_LABELS, values)])
    return F.when(F.col("customer_id").isNotNull(), F.concat(F.lit(PROFILE_HEADING), body, F.lit("\n")))


def numbered(number: Column, body: Column) -> Column:
    return F.concat(F.lit("\n[Source "), number.cast("string"), body)


def source_block() -> Column:
    """Heading, title, date and the first 800 characters of one source."""
    return numbered(F.col("source_no"), source_body())


def source_body() -> Column:
    """A source block without what comes before and with its number."""
    title = F.nullif(F.col("title"), F.lit(""))
    return F.concat_ws(
        "\n",
        F.concat(
            F.lit("] ("),
            F.initcap(F.replace(F.col("source_type"), F.lit("_"), F.lit(" "))),
            F.format_string(", Relevance: %.1f%%)", F.col("similarity_score") * 100),
        ),
        F.concat(F.lit("Title: "), title),
        F.concat(F.lit("Date: "), F.date_format("created_at", MOMENT)),
        F.concat(F.lit("Content: "), F.substring(F.coalesce("content", F.lit("")), 1, 800)),
    )


def prompt(question: Column, profile: Column, sources: Column) -> Column:
    """The whole prompt. ``sources`` is the array of source blocks, NULL when there are none."""
    found = F.when(F.size(sources) > 0, F.concat(F.lit("\nRELEVANT HISTORICAL DATA:\n"), F.array_join(sources, "\n")))
    return F.concat_ws("\n", F.lit(PROMPT_INSTRUCTIONS), profile, found, F.concat(F.lit("\nUSER QUERY: "), question), F.lit(PROMPT_CLOSING))


def budgeted_profile_block() -> Column:
    """Nine labelled lines; zero days or satisfaction read as not available."""
    values = [
        display_name(),
        F.col("email"),
        F.col("customer_segment"),
        currency("lifetime_value"),
        F.col("total_orders").cast("string"),
        _or(F.nullif(F.col("days_since_last_purchase"), F.lit(0)), "N/A"),
        F.col("open_tickets").cast("string"),
        _or(F.nullif(F.col("avg_satisfaction_score"), F.lit(0.0)), "N/A"),
        F.col("churn_risk"),
    ]
    body = F.concat_ws("\n", *[F.concat(F.lit(f"- {label}: "), value) for label, value in zip(BUDGETED_LABELS, values)])
    return F.when(F.col("customer_id").isNotNull(), F.concat(F.lit(BUDGETED_HEADING), body, F.lit("\n")))


def budgeted_source_block() -> Column:
    return F.concat(
        F.lit("\n[Source "), F.col("source_no").cast("string"), F.lit("] ("), F.col("source_type"),
        F.format_string(", relevance: %.2f%%)\n", F.col("similarity_score") * 100),
        F.substring(F.coalesce("content", F.lit("")), 1, 500),
    )


def budgeted_prompt(question: Column, profile: Column, sources: Column, max_tokens: int = 8000) -> Column:
    """The shorter prompt, cut at four characters per token."""
    found = F.when(F.size(sources) > 0, F.concat(F.lit("\nRelevant Historical Data:\n"), F.array_join(sources, "\n")))
    whole = F.concat_ws("\n", F.lit(BUDGETED_INSTRUCTIONS), profile, found, F.concat(F.lit("\nUser Query: "), question), F.lit(BUDGETED_CLOSING))
    return F.substring(whole, 1, 4 * max_tokens)
