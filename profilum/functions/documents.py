"""Texts that documents are embedded and quoted by."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilum.fixed_values import INTERACTION_LABELS, PRODUCT_CATEGORY, PRODUCT_LABELS, TICKET_LABELS
from profilum.functions.columns import number_text


def ticket_text() -> Column:
    """Four labelled lines; a missing part is empty."""
    labelled = zip(TICKET_LABELS, ["subject", "description", "status", "priority"])
    return F.concat_ws("\n", *[F.concat(F.lit(label), F.coalesce(F.col(name), F.lit(""))) for label, name in labelled])


def product_text() -> Column:
    """Four labelled lines. A missing name or price makes the whole text NULL."""
    price = F.col("price").cast("decimal(18,2)").cast("string")
    parts = [F.col("product_name"), F.coalesce(F.col("category"), F.lit(PRODUCT_CATEGORY)), F.coalesce(F.col("description"), F.lit("")), price]
    return F.concat(*[column for label, part in zip(PRODUCT_LABELS, parts) for column in (F.lit(label), part)])


def interaction_text() -> Column:
    """Six labelled lines about one interaction."""
    def shown(column: Column) -> Column:
        return F.coalesce(column.cast("string"), F.lit("None"))

    values = [
        shown(F.col("interaction_id")), shown(F.col("customer_id")), shown(F.col("channel")), shown(number_text(F.col("sentiment_score"))),
        F.date_format("timestamp", "yyyy-MM-dd HH:mm:ss"), shown(F.col("content")),
    ]
    return F.trim(F.concat_ws("\n", *[F.concat(F.lit(label), value) for label, value in zip(INTERACTION_LABELS, values)]))
