"""Audits across sources: alignment of keys, candidates for a reported figure, movements, profiles and ratios."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_number

KEYS = ["deal_id", "loan_id"]


def require_columns(df: DataFrame, names: list[str]) -> DataFrame:
    """The named columns; names that are not there are an error that lists them all. Only the schema is read."""
    absent = [name for name in names if name not in df.columns]
    if absent:
        raise ValueError(f"required columns are missing: {', '.join(absent)}")
    return df.select(*names)


def misaligned(frames: dict[str, DataFrame], keys: list[str]) -> DataFrame:
    """keys and a count for each frame, of the keys that not every frame holds exactly once; empty if all align.

    The frames' keys are stacked under their names and counted in one aggregate, so no outer joins are chained.
    """
    stacked = None
    for name, frame in frames.items():
        side = frame.select(*keys, F.lit(name).alias("__side"))
        stacked = side if stacked is None else stacked.unionByName(side)
    counts = stacked.groupBy(*keys).agg(*[F.count_if(F.col("__side") == name).alias(name) for name in frames])
    once = F.lit(True)
    for name in frames:
        once = once & (F.col(name) == 1)
    return counts.where(~once)


def default_candidates(panel: DataFrame, reported: DataFrame, other: Column | None = None) -> DataFrame:
    """deal_id, period_end, candidate, observed_cents, reported_cents, residual_cents, status.

    Five readings of the tape that could stand for a certificate's defaults; none is forced to agree. ``panel`` has
    derived events, ``reported`` has deal_id, period_end and reported_cents, ``other`` is the other principal
    adjustment. The panel is aggregated once; candidates are unpivoted within a row.
    """
    loss = F.coalesce(F.col("chargeoff_cents"), F.lit(0))
    first = F.col("first_default_event") == 1
    same = F.col("zero_balance_month") == F.date_format("period_end", "yyyy-MM")
    amounts = {
        "all_chargeoffs": loss,
        "first_default_chargeoffs": F.when(first, loss).otherwise(0),
        "first_default_beginning_principal": F.when(first, F.col("begin_balance_cents")).otherwise(0),
        "chargeoffs_effective_in_period": F.when(same, loss).otherwise(0),
        "chargeoffs_and_other_adjustments": loss + F.coalesce(F.lit(0) if other is None else other, F.lit(0)),
    }
    sums = panel.groupBy("deal_id", "period_end").agg(*[F.sum(c).alias(name) for name, c in amounts.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("candidate"), F.col(name).alias("observed_cents")) for name in amounts])
    f = sums.join(reported, ["deal_id", "period_end"]).select("deal_id", "period_end", "reported_cents", F.explode(rows).alias("c"))
    f = f.select("deal_id", "period_end", "c.candidate", "c.observed_cents", "reported_cents").withColumn("residual_cents", F.col("observed_cents") - F.col("reported_cents"))
    return f.withColumn("status", F.when(F.col("residual_cents") == 0, "NUMERIC_MATCH_ONLY").otherwise("DOES_NOT_RECONCILE"))


def observed_recovery_ratio(panel: DataFrame, fallback: float = 0.3) -> DataFrame:
    """deal_id, default_cents, recovery_cents, recovery_ratio of all observed flows, censored as they are; ``fallback`` where there was no default."""
    sums = panel.groupBy("deal_id").agg(F.coalesce(F.sum("chargeoff_cents"), F.lit(0)).alias("default_cents"), F.coalesce(F.sum("recovery_cents"), F.lit(0)).alias("recovery_cents"))
    return sums.withColumn("recovery_ratio", F.when(F.col("default_cents") != 0, F.col("recovery_cents") / F.col("default_cents")).otherwise(F.lit(fallback)))


def loan_moves(panel: DataFrame) -> DataFrame:
    """deal_id, period_end, move, loans, balance_cents: loans that ENTER a month, ROLL from the month before, or LEAVE after it.

    ROLL and ENTER carry the beginning balance, LEAVE the ending one, by the month in which it was last seen; the deal's last month has no
    LEAVE. One window over the loan replaces the join of each month with the next.
    """
    loan = Window.partitionBy(*KEYS).orderBy("period_end")
    number = month_number(F.col("period_end"))
    last = panel.groupBy("deal_id").agg(F.max("period_end").alias("__last"))
    f = panel.select(*KEYS, "period_end", "begin_balance_cents", "end_balance_cents", number.alias("__m"))
    f = f.withColumns({"__before": F.lag("__m").over(loan), "__after": F.lead("__m").over(loan)}).join(last, "deal_id")
    rolled = F.coalesce(F.col("__before") == F.col("__m") - 1, F.lit(False))
    leaves = ~F.coalesce(F.col("__after") == F.col("__m") + 1, F.lit(False)) & (F.col("period_end") < F.col("__last"))
    moves = F.array(
        F.struct(F.when(rolled, "ROLL").otherwise("ENTER").alias("move"), F.col("begin_balance_cents").alias("cents")),
        F.when(leaves, F.struct(F.lit("LEAVE").alias("move"), F.col("end_balance_cents").alias("cents"))),
    )
    long = f.select("deal_id", "period_end", F.explode(F.array_compact(moves)).alias("x")).select("deal_id", "period_end", "x.*")
    return long.groupBy("deal_id", "period_end", "move").agg(F.count("*").alias("loans"), F.sum("cents").alias("balance_cents"))


def tape_profile(panel: DataFrame, amounts: list[str]) -> DataFrame:
    """deal_id, zero_balance_code (NONE where null), rows, identity_breaks, and of each amount its sum, values present and negatives.

    identity_breaks counts rows whose beginning balance less principal is not the ending balance.
    """
    code = F.coalesce(F.col("zero_balance_code"), F.lit("NONE")).alias("zero_balance_code")
    breaks = F.count_if(F.col("begin_balance_cents") - F.col("principal_paid_cents") != F.col("end_balance_cents"))
    measures = [x for c in amounts for x in (F.sum(c).alias(f"{c}_sum"), F.count(c).alias(f"{c}_present"), F.count_if(F.col(c) < 0).alias(f"{c}_negative"))]
    return panel.groupBy("deal_id", code).agg(F.count("*").alias("rows"), breaks.alias("identity_breaks"), *measures)


def widest(rows: DataFrame, keys: list[str], gap: str, label: str) -> DataFrame:
    """keys, label and gap of the row whose gap is farthest from 0; the smallest label on ties, null gaps last."""
    size = F.coalesce(F.abs(F.col(gap)), F.lit(-1.0))
    best = F.min_by(F.struct(label, gap), F.struct((-size).alias("s"), F.col(label).alias("l")))
    return rows.groupBy(*keys).agg(best.alias("__best")).select(*keys, "__best.*")


def increasing(rows: DataFrame, keys: list[str], order: str, value: str) -> DataFrame:
    """keys and whether ``value`` grows strictly along ``order``; one value alone does."""
    before = F.lag(value).over(Window.partitionBy(*keys).orderBy(order))
    return rows.withColumn("__ok", F.coalesce(F.col(value) > before, before.isNull())).groupBy(*keys).agg(F.min("__ok").alias("increasing"))


def official_rate(average: Column, margin: str = "0.69") -> Column:
    """An official average in percent and a fixed margin, never below 0, exact in decimals."""
    return F.greatest(average.cast("decimal(18,8)") + F.lit(margin).cast("decimal(18,8)"), F.lit(0).cast("decimal(18,8)")).cast("decimal(18,8)")


#: What audit_events counts, at each level.
EVENT_COUNTS = (
    "rows", "balance_identity_failures", "balance_identity_residual_cents", "net_chargeoff_adjustments", "effective_month_chargeoffs", "first_observed_defaults", "first_default_chargeoffs",
    "first_default_begin_balance", "effective_month_missing", "effective_month_earlier", "effective_month_same", "effective_month_later", "boundary_defaults", "positive_end_first_defaults",
    "positive_end_chargedoff_codes", "positive_end_after_default", "returned_to_positive_after_default", "chargeoffs_after_first_default", "reinstated_loans",
)


def audit_events(panel: DataFrame) -> DataFrame:
    """level (all, deal, period), deal_id, period_end, EVENT_COUNTS: how defaults were observed, in one pass for all levels.

    Windows over the loan mark each row, then grouping sets fold the marks, so the panel is neither read nor shuffled once
    for each level. reinstated_loans counts a loan in the first period that it ends with a balance after its
    default, so the levels add up. A deal's boundary is its first period. A missing balance is an error; a panel without other_principal_adjustment_cents has none.
    """
    loan = Window.partitionBy(*KEYS).orderBy("period_end")
    before = loan.rowsBetween(Window.unboundedPreceding, -1)
    amount = lambda c: F.coalesce(F.col(c), F.lit(0)).cast("bigint") if c in panel.columns else F.lit(0).cast("bigint")
    begin, end, paid = (F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing")).cast("bigint")).otherwise(F.col(c)) for c in ("begin_balance_cents", "end_balance_cents", "principal_paid_cents"))
    loss, other, month, effective = amount("chargeoff_cents"), amount("other_principal_adjustment_cents"), F.date_format("period_end", "yyyy-MM"), F.col("zero_balance_month")
    event = F.coalesce(F.col("first_default_event"), F.lit(0)) == 1
    boundary = panel.groupBy("deal_id").agg(F.min("period_end").alias("__boundary"))
    f = panel.join(boundary, "deal_id").select(
        *KEYS, "period_end", "__boundary", begin.alias("begin"), end.alias("end"), paid.alias("paid"), loss.alias("loss"), other.alias("other"), event.alias("event"),
        F.coalesce(F.max(event).over(before), F.lit(False)).alias("seen"), F.lag("end_balance_cents").over(loan).alias("last_end"),
        F.when(effective.isNull(), "missing").when(effective < month, "earlier").when(effective == month, "same").otherwise("later").alias("effective"),
        F.array_contains(F.split(F.coalesce(F.col("zero_balance_code"), F.lit("")), "[|]"), "4").alias("charged_off"),
    )
    again = F.col("seen") & (F.col("end") > 0)
    f = f.withColumn("again", again).withColumn("first_again", F.col("again") & ~F.coalesce(F.max("again").over(before), F.lit(False)))
    residual = F.col("begin") - F.col("end") - F.col("paid") - F.col("loss") - F.col("other")
    of_event = lambda c: F.when(F.col("event"), c).otherwise(0)
    one = lambda condition: condition.cast("bigint")
    marks = dict(zip(EVENT_COUNTS, (
        F.lit(1).cast("bigint"), one(residual != 0), residual, F.col("loss") + F.col("other"), F.when(F.col("effective") == "same", F.col("loss")).otherwise(0), one(F.col("event")), of_event(F.col("loss")),
        of_event(F.col("begin")), *[one(F.col("event") & (F.col("effective") == name)) for name in ("missing", "earlier", "same", "later")], one(F.col("event") & (F.col("period_end") == F.col("__boundary"))),
        one(F.col("event") & (F.col("end") > 0)), one((F.col("end") > 0) & F.col("charged_off")), one(F.col("again")), one(F.col("again") & (F.col("last_end") <= 0)), one(F.col("seen") & (F.col("loss") > 0)), one(F.col("first_again")),
    )))
    marked = f.select("deal_id", "period_end", *[value.alias(name) for name, value in marks.items()])
    sets = [[], [F.col("deal_id")], [F.col("deal_id"), F.col("period_end")]]
    found = marked.groupingSets(sets, "deal_id", "period_end").agg(F.grouping_id().alias("__level"), *[F.sum(name).alias(name) for name in EVENT_COUNTS])
    level = F.when(F.col("__level") == 0, "period").when(F.col("__level") == 1, "deal").otherwise("all")
    return found.select(level.alias("level"), "deal_id", "period_end", *[F.coalesce(name, F.lit(0)).alias(name) for name in EVENT_COUNTS])


def form_counts(filings: DataFrame, by: list[str], first: str, cutoff: str) -> DataFrame:
    """``by``, form, filings: how often each form was filed from a day on and accepted up to another."""
    inside = filings.where((F.col("filing_date") >= F.lit(first).cast("date")) & (F.to_date("acceptance_time") <= F.lit(cutoff).cast("date")))
    return inside.groupBy(*by, "form").agg(F.count("*").alias("filings"))


def byte_totals(archives: DataFrame) -> DataFrame:
    """sources, original_bytes and archived_bytes of checked archives."""
    return archives.agg(F.count("*").alias("sources"), F.sum("original_bytes").alias("original_bytes"), F.sum("archived_bytes").alias("archived_bytes"))
