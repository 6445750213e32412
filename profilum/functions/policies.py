"""Value segments and churn risk. Three policies exist side by side and never mix.

``simple``   strict cut-offs on lifetime value; risk needs both inactivity and open tickets.
``rfm_and``  inclusive cut-offs, VIP also needs ten orders; both risk levels need open tickets.
``rfm_or``   segments as in ``rfm_and``; inactivity or open tickets alone raise the risk.
"""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from profilum.fixed_values import HIGH_RISK_DAYS, HIGH_RISK_TICKETS, MEDIUM_RISK_DAYS, SEGMENT_FROM, SEGMENT_OVER, VIP_ORDERS

POLICIES = ("simple", "rfm_and", "rfm_or")


def _known(policy: str) -> None:
    if policy not in POLICIES:
        raise ValueError(f"unknown policy {policy!r}; expected one of {POLICIES}")


def segment(policy: str, value: Column, orders: Column) -> Column:
    """Segment from lifetime value (NULL when the customer never ordered) and order count."""
    _known(policy)
    if policy == "simple":
        return F.coalesce(*[F.when(value > cut, name) for name, cut in SEGMENT_OVER.items()], F.lit("Low Value"))
    value, enough = F.coalesce(value, F.lit(0)), F.coalesce(orders, F.lit(0)) >= VIP_ORDERS
    reached = [F.when((value >= cut) & (enough if name == "VIP" else F.lit(True)), name) for name, cut in SEGMENT_FROM.items()]
    return F.coalesce(*reached, F.lit("General"))


def churn(policy: str, days: Column, open_tickets: Column) -> Column:
    """Risk from days since the last order (NULL: never ordered) and open tickets."""
    _known(policy)
    count = F.coalesce(open_tickets, F.lit(0))
    away, quiet, many = days > HIGH_RISK_DAYS, days > MEDIUM_RISK_DAYS, count > HIGH_RISK_TICKETS[policy]
    if policy == "simple":
        high, medium = away & many, quiet
    elif policy == "rfm_and":
        high, medium = away & many, quiet & (count > 0)
    else:
        high, medium = away | many, quiet | (count > 0)
    return F.when(high, "High Risk").when(medium, "Medium Risk").otherwise("Low Risk")
