"""Health and churn scores over the columns of a profile row.

The three health scores differ on purpose and keep separate names: a mean of the parts that
exist, a weighted sum with defaults for missing parts, and deductions from one hundred.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilum.fixed_values import (
    CHURN_DAYS,
    CHURN_SATISFACTION,
    CHURN_TICKETS,
    DAYS_DEDUCTIONS,
    DECLINING_BELOW,
    HEALTH_WEIGHTS,
    IMPROVING_FROM,
    POSITIVE_CUTS,
    POSITIVE_FACTORS,
    RECENCY_MISSING,
    RECENCY_REST,
    RECENCY_SCORES,
    RISK_CUTS,
    RISK_DEDUCTIONS,
    RISK_FACTORS,
    SATISFACTION_MISSING,
    SUPPORT_REST,
    SUPPORT_SCORES,
    TICKET_DEDUCTIONS,
    VALUE_BONUS,
)

_ZERO = 0.0


def _recency(missing: int | None) -> Column:
    days = F.col("days_since_last_purchase")
    score = F.coalesce(*[F.when(days < bound, points) for bound, points in RECENCY_SCORES], F.when(days.isNotNull(), RECENCY_REST))
    return score if missing is None else F.coalesce(score, F.lit(missing))


def _support() -> Column:
    tickets = F.col("open_tickets")
    return F.coalesce(*[F.when(tickets <= bound, points) for bound, points in SUPPORT_SCORES], F.lit(SUPPORT_REST))


def _satisfied() -> Column:
    """Satisfaction, with zero treated like a missing answer."""
    return F.nullif(F.col("avg_satisfaction_score"), F.lit(0.0))


def _whole(score: Column) -> Column:
    """Truncate towards zero."""
    return score.cast("int")


def health_mean() -> Column:
    """Mean of the parts present, truncated. Orders and value count only when positive."""
    orders, value = F.col("total_orders"), F.col("lifetime_value")
    parts = [
        _recency(None).cast("double"),
        F.when(orders > 0, F.least(F.lit(100.0), (orders / F.lit(10.0)) * F.lit(100.0))),
        F.when(value > 0, F.least(F.lit(100.0), value / F.lit(100.0))),
        (_satisfied() / F.lit(5.0)) * F.lit(100.0),
        _support().cast("double"),
    ]
    total = count = None
    for part in parts:
        amount = F.coalesce(part, F.lit(0.0))
        present = F.when(part.isNull(), 0).otherwise(1)
        total = amount if total is None else total + amount
        count = present if count is None else count + present
    return _whole(total / count)


def health_detailed() -> dict[str, Column]:
    """Component scores, the weighted overall score and its factors, by output name."""
    recency = _recency(RECENCY_MISSING)
    frequency = F.least(F.lit(100), _whole((F.col("total_orders") / F.lit(10.0)) * F.lit(100.0)))
    monetary = F.least(F.lit(100), _whole(F.col("lifetime_value") / F.lit(100.0)))
    satisfaction = F.coalesce(_whole((_satisfied() / F.lit(5.0)) * F.lit(100.0)), F.lit(SATISFACTION_MISSING))
    support = _support()
    weights = HEALTH_WEIGHTS
    overall = _whole(
        recency * F.lit(weights["recency"]) + frequency * F.lit(weights["frequency"]) + monetary * F.lit(weights["monetary"])
        + satisfaction * F.lit(weights["satisfaction"]) + support * F.lit(weights["support"])
    )
    rated = _satisfied()
    risks = [
        F.col("days_since_last_purchase") > RISK_CUTS["days"],
        F.col("open_tickets") > RISK_CUTS["tickets"],
        rated < RISK_CUTS["satisfaction"],
        F.col("churn_risk") == "High Risk",
    ]
    positives = [
        F.col("lifetime_value") > POSITIVE_CUTS["value"],
        F.col("total_orders") > POSITIVE_CUTS["orders"],
        rated >= POSITIVE_CUTS["satisfaction"],
        F.col("customer_segment") == "VIP",
    ]

    def named(tests: list[Column], texts: list[str]) -> Column:
        return F.array_compact(F.array(*[F.when(test, text) for test, text in zip(tests, texts)]))

    return {
        "recency_score": recency,
        "frequency_score": frequency,
        "monetary_score": monetary,
        "satisfaction_score": satisfaction,
        "support_health_score": support,
        "overall_score": overall,
        "trend": F.when(overall >= IMPROVING_FROM, "improving").when(overall < DECLINING_BELOW, "declining").otherwise("stable"),
        "risk_factors": named(risks, RISK_FACTORS),
        "positive_factors": named(positives, POSITIVE_FACTORS),
    }


def health_deduction() -> Column:
    """One hundred less deductions for risk, inactivity and open tickets, plus ten for value."""
    risk, days, tickets = F.upper("churn_risk"), F.col("days_since_last_purchase"), F.col("open_tickets")
    score = (
        F.lit(100)
        - F.coalesce(*[F.when(risk.contains(word), points) for word, points in RISK_DEDUCTIONS], F.lit(0))
        - F.coalesce(*[F.when(days > bound, points) for bound, points in DAYS_DEDUCTIONS], F.lit(0))
        - F.coalesce(*[F.when(tickets > bound, points) for bound, points in TICKET_DEDUCTIONS], F.lit(0))
        + F.when(F.col("lifetime_value") > VALUE_BONUS[0], VALUE_BONUS[1]).otherwise(0)
    )
    return F.greatest(F.lit(0), F.least(F.lit(100), score))


def churn_probability() -> Column:
    """Sum of inactivity, ticket and satisfaction factors, at most one."""
    days, tickets, rated = F.col("days_since_last_purchase"), F.col("open_tickets"), _satisfied()
    score = (
        F.coalesce(*[F.when(days > bound, share) for bound, share in CHURN_DAYS], F.lit(_ZERO))
        + F.coalesce(*[F.when(tickets > bound, share) for bound, share in CHURN_TICKETS], F.lit(_ZERO))
        + F.coalesce(*[F.when(rated < bound, share) for bound, share in CHURN_SATISFACTION], F.lit(_ZERO))
    )
    return F.least(F.lit(1.0), score)
