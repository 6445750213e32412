"""Column expressions over texts: cleaning, token estimates, intents and citations."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilum.fixed_values import (
    CITATION_PATTERN,
    CUSTOMER_INFO_WORDS,
    EMAIL_PATTERN,
    INTENT_WORDS,
    PRODUCTS_PER_INTENT,
    TICKETS_PER_INTENT,
)

# Every character that counts as white space, not only the ASCII ones.
WHITESPACE = "[\\t-\\r\\x1c-\\x20\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]+"
MAX_CLEAN_CHARS = 100_000


def sanitize(text: Column, max_chars: int = MAX_CLEAN_CHARS) -> Column:
    """Single blanks between words, no NUL characters, an ellipsis past ``max_chars``."""
    joined = F.trim(F.regexp_replace(F.coalesce(text, F.lit("")), WHITESPACE, " "))
    clean = F.regexp_replace(joined, "\\x00", "")
    cut = F.when(F.length(clean) > max_chars, F.concat(F.substring(clean, 1, max_chars), F.lit("..."))).otherwise(clean)
    return F.trim(cut)


def token_estimate(text: Column) -> Column:
    """Four characters count as one token."""
    return F.floor(F.length(text) / 4).cast("bigint")


def truncate_to_tokens(text: Column, max_tokens: int = 8000) -> Column:
    limit = 4 * max_tokens
    return F.when(F.length(text) <= limit, text).otherwise(F.concat(F.substring(text, 1, limit), F.lit("...")))


def valid_email(email: Column) -> Column:
    return F.coalesce(email.rlike(EMAIL_PATTERN), F.lit(False))


def _mentions(text: Column, words: list[str]) -> Column:
    return reduce(lambda left, right: left | right, [text.contains(word) for word in words])


def intent(text: Column, customer_known: Column) -> Column:
    """First intent one of whose words occurs in the question."""
    lowered = F.lower(text)
    (name, words), *rest = INTENT_WORDS
    chosen = F.when(_mentions(lowered, words), name)
    for name, words in rest:
        chosen = chosen.when(_mentions(lowered, words), name)
    return chosen.when(customer_known & _mentions(lowered, CUSTOMER_INFO_WORDS), "customer_info").otherwise("general")


def wanted_hits(intent_name: Column, source: str) -> Column:
    """How many hits an intent takes from ``tickets`` or ``products``."""
    counts = TICKETS_PER_INTENT if source == "tickets" else PRODUCTS_PER_INTENT
    return F.coalesce(*[F.when(intent_name == name, count) for name, count in counts.items()], F.lit(0))


def cited_numbers(text: Column) -> Column:
    """Distinct source numbers a text cites; numbers too long to be one are dropped."""
    digits = F.regexp_extract_all(text, F.lit(CITATION_PATTERN), F.lit(1))
    return F.array_compact(F.array_distinct(F.transform(digits, lambda digit: digit.try_cast("int"))))
