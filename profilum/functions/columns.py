"""Small column expressions shared by the operators."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def any_of(characters: str) -> str:
    """A pattern for any one of the characters, whatever they mean in patterns."""
    return "|".join(f"\\x{{{ord(character):x}}}" for character in characters)


def col(column: Column | str) -> Column:
    return F.col(column) if isinstance(column, str) else column


def display_name(first: Column | str = "first_name", last: Column | str = "last_name", default: str | None = "Unknown") -> Column:
    """Trimmed first and last name; ``default`` when both are empty."""
    joined = F.trim(F.concat(F.coalesce(col(first), F.lit("")), F.lit(" "), F.coalesce(col(last), F.lit(""))))
    return joined if default is None else F.coalesce(F.nullif(joined, F.lit("")), F.lit(default))


def safe_divide(numerator: Column | str, denominator: Column | str, default: float = 0.0) -> Column:
    return F.coalesce(F.try_divide(col(numerator).cast("double"), col(denominator).cast("double")), F.lit(default))


def currency(amount: Column | str) -> Column:
    return F.concat(F.lit("$"), F.format_number(col(amount).cast("double"), 2))


def number_text(number: Column) -> Column:
    """A double as text, with an exponent only below one ten-thousandth."""
    plain = number.cast("string")
    fixed = F.rtrim(number.cast("decimal(38,22)").cast("string"), F.lit("0"))
    short = F.regexp_replace(F.regexp_replace(plain, r"\.0E", "E"), r"E-(\d)$", "E-0$1")
    return F.when((F.abs(number) < 0.001) & (F.abs(number) >= 0.0001), fixed).otherwise(F.lower(short))


def mean_exact(value: Column, digits: int = 6) -> Column:
    """Mean through a decimal sum: the result does not depend on the order rows arrive in."""
    return F.sum(value.cast(f"decimal(38,{digits})")).cast("double") / F.count(value)


def relative_age(moment: Column, now: Column) -> Column:
    """Age of a timestamp as words, in the largest whole unit."""
    elapsed = F.timestamp_diff("SECOND", moment, now)
    days = F.floor(elapsed / 86400)
    seconds = elapsed - days * 86400

    def spell(count: Column, unit: str) -> Column:
        count = count.cast("bigint")
        return F.concat(count.cast("string"), F.lit(f" {unit}"), F.when(count > 1, "s").otherwise(""), F.lit(" ago"))

    return (
        F.when(moment.isNull(), "Never")
        .when(days > 365, spell(F.floor(days / 365), "year"))
        .when(days > 30, spell(F.floor(days / 30), "month"))
        .when(days > 0, spell(days, "day"))
        .when(seconds > 3600, spell(F.floor(seconds / 3600), "hour"))
        .when(seconds > 60, spell(F.floor(seconds / 60), "minute"))
        .otherwise("Just now")
    )
