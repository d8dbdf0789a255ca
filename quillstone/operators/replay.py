"""Replay of certificates: bounded, and compared line by line with what was reported."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .waterfall import FINAL_DATES, NOTES, Period, Rejected, State, Terms, distribute

# The aggregates and tiers that a certificate reports.
AGGREGATES = ("servicing_fee", "total_note_interest", "total_note_principal", "residual_distribution", "reserve_deposit", "reserve_end", "reserve_release")
TIERS = ("priority", "secondary", "tertiary", "quaternary", "regular")


def lines(month: dict) -> dict[str, int]:
    """The 37 figures of a month that can be compared with a certificate."""
    out = {
        "servicing_fee": month["servicing_paid"], "total_note_interest": sum(month["interest"].values()), "total_note_principal": sum(month["principal"].values()),
        "residual_distribution": month["residual"], "reserve_deposit": month["reserve_deposit"], "reserve_end": month["reserve_end"], "reserve_release": month["reserve_release"],
    }
    for group in ("interest", "principal", "note_end"):
        out |= {f"{group}.{n}": month[group][n] for n in NOTES}
    return out | {f"{tier}_principal": month["tier_due"][tier] for tier in TIERS} | {"oc_target": month["oc_target"]}


def bounded(pool_begin: int, pool_end: int, collections: int, reserve_begin: int, reserve_interest: int, notes: dict, last: str, today: str, floating_rate: str, terms: Terms = Terms()) -> dict:
    """A fully funded month before any note's final date; anything else is rejected."""
    if not 0 < pool_end <= pool_begin or not sum(notes.values()):
        raise Rejected("the pool must be positive and not grow, and notes outstanding")
    if today >= min(FINAL_DATES.values()) or last < terms.first_distribution:
        raise Rejected("outside the dates of the bounded replay")
    principal = min(pool_begin - pool_end, collections)
    period = Period(today, pool_end, principal, collections - principal, defaults=pool_begin - pool_end - principal, reserve_interest=reserve_interest, floating_rate=floating_rate)
    _, month = distribute(State(pool_begin, notes, reserve_begin, last), period, terms)
    for step in month["ledger"]:
        if step["collection"] < step["due"]:
            raise Rejected(f"collections do not cover {step['step']}")
    if month["sweep"]:
        raise Rejected("a payoff is outside the bounded replay")
    return month


_SCHEMA = "line string, computed_cents long"


def replay(certificates: DataFrame, keys: list[str], terms: Terms = Terms()) -> DataFrame:
    """keys, line, computed_cents: 37 lines for each certificate.

    Certificates have BIGINT maps ``amounts`` and ``note_begin``, and prior_distribution_date, distribution_date,
    floating_note_rate as text. Each is one month by itself, so they are mapped row by row.
    """
    kinds = dict(certificates.dtypes)
    schema = ", ".join(f"`{k}` {kinds[k]}" for k in keys) + ", " + _SCHEMA

    def run(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            rows = []
            for r in frame.to_dict("records"):
                a = {k: int(v) for k, v in dict(r["amounts"]).items()}
                state = State(a["pool_begin"], {n: int(v) for n, v in dict(r["note_begin"]).items()}, a["reserve_begin"], str(r["prior_distribution_date"]))
                period = Period(
                    str(r["distribution_date"]), a["pool_end"], a["principal_collected"], a["interest_collected"], recoveries=a["recoveries"], defaults=a["defaults"], repurchases=a["repurchases"],
                    investment_income=a["investment_income"], reserve_interest=a["reserve_interest"], floating_rate=r["floating_note_rate"], trustee_fee=a["trustee_fee"],
                )
                rows += [(*[r[k] for k in keys], line, cents) for line, cents in lines(distribute(state, period, terms)[1]).items()]
            yield pd.DataFrame(rows, columns=[*keys, "line", "computed_cents"])

    return certificates.mapInPandas(run, schema)


def compare(replayed: DataFrame, reported: DataFrame, keys: list[str]) -> DataFrame:
    """line by line: computed_cents, reported_cents, residual_cents, status. ``reported``: keys, line, reported_cents."""
    from .panel import compare as against

    return against(replayed.join(reported, [*keys, "line"], "left"), "computed_cents", "reported_cents").select(*keys, "line", "computed_cents", "reported_cents", "residual_cents", "status")


def summary(compared: DataFrame) -> DataFrame:
    return compared.agg(F.count("*").alias("comparisons"), F.count_if(F.col("status") == "DIFFERENCE").alias("differences"), F.count_if(F.col("status") == "SKIPPED").alias("skipped"))
