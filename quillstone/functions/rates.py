"""Hazards, annuities, bands and present values as Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def competing_monthly(annual_default: Column, annual_prepay: Column) -> tuple[Column, Column]:
    """Monthly probabilities of default and prepayment from annual ones, as hazards that compete."""
    d, p = -F.log1p(-annual_default) / 12, -F.log1p(-annual_prepay) / 12
    total = d + p
    event = -F.expm1(-total)
    zero = F.lit(0.0)
    return F.when(total == 0, zero).otherwise(event * d / total), F.when(total == 0, zero).otherwise(event * p / total)


def annual_from_monthly(monthly_default: Column, monthly_prepay: Column) -> tuple[Column, Column]:
    """The inverse of competing_monthly."""
    event = monthly_default + monthly_prepay
    hazard = -F.log1p(-event)
    share = lambda x: F.when(event == 0, F.lit(0.0)).otherwise(-F.expm1(-12 * hazard * x / event))
    return share(monthly_default), share(monthly_prepay)


def scaled_hazard(probability: Column, multiple: Column) -> Column:
    """Multiplies the hazard behind a probability."""
    return 1 - F.pow(1 - probability, multiple)


def present_value(flow: Column, years: Column, rate: Column) -> Column:
    """A summand: flow / (1 + rate) ** years."""
    return flow / F.pow(1 + rate, years)


def band(value: Column, edges: list[float]) -> Column:
    """Right-closed bands numbered from 0; -1 for a missing value."""
    out = F.lit(len(edges))
    for number in range(len(edges) - 1, -1, -1):
        out = F.when(value <= edges[number], number).otherwise(out)
    return F.when(value.isNull() | F.isnan(value.cast("double")), F.lit(-1)).otherwise(out)


#: Right-closed upper edges of the delinquency buckets; a missing status is bucket 0.
DELINQUENCY_EDGES = (0, 30, 60, 90)


def delinquency_bucket(days: Column) -> Column:
    """0 missing or negative, 1 current, then up to 30, 60, 90 days and more."""
    value = F.coalesce(days.cast("double"), F.lit(-1.0))
    return F.when(value <= -0.5, 0).otherwise(band(value, list(DELINQUENCY_EDGES)) + 1)
