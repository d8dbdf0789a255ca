"""Point-in-time features: what was disclosed before a period began."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import months_between

#: Features taken from an earlier disclosure, and how many rows back it may lie.
DISCLOSED = ("credit_score", "orig_ltv_pct", "interest_rate_pct", "age_months", "remaining_months", "delinquency_days", "end_balance_cents", "period_end")
ROWS_BACK = 4


def bounded_asof(df: DataFrame, keys: list[str], order: str, columns: list[str], usable: Column, back: int, out: str) -> DataFrame:
    """Adds a struct ``out`` of the nearest of the previous ``back`` rows for which ``usable`` holds, with ``rows_back``.

    ``usable`` reads the earlier row's columns as fields of ``p`` and the current row's directly.
    Rows are counted, not months; a null predicate counts as false. One window, no self-join.
    """
    window = Window.partitionBy(*keys).orderBy(order)
    picked = None
    for k in range(1, back + 1):
        df = df.withColumn("p", F.lag(F.struct(*columns), k).over(window))
        kept = F.when(F.coalesce(usable, F.lit(False)), F.struct(*[F.col(f"p.{c}").alias(c) for c in columns], F.lit(k).alias("rows_back")))
        df = df.withColumn(f"__p{k}", kept)
        picked = F.col(f"__p{k}") if picked is None else F.coalesce(picked, F.col(f"__p{k}"))
    return df.withColumn(out, picked).drop("p", *[f"__p{k}" for k in range(1, back + 1)])


def prior_terminal(df: DataFrame, keys: list[str], order: str, terminal: Column, out: str = "prior_terminal") -> DataFrame:
    """Adds whether an earlier row of the key was terminal; the row itself does not count."""
    before = Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    return df.withColumn(out, F.coalesce(F.sum(terminal.cast("int")).over(before), F.lit(0)) > 0)


def disclosure_features(panel: DataFrame) -> DataFrame:
    """The modeling rows: features of the newest usable disclosure, and the outcome.

    Usable: one of the loan's previous four rows, accepted by the period's start, of an earlier
    period, with a balance. Rows stay if they have one, if no earlier row was terminal, and if
    this row is neither censored nor a repurchase and starts with a balance. outcome: 1 default,
    2 prepayment, 0 neither; both at once is an error. It was public from label_available_at on, which is what training has to wait for.
    """
    keys = ["deal_id", "loan_id"]
    codes = F.split(F.coalesce(F.col("zero_balance_code"), F.lit("")), "[|]")
    censored = F.col("end_balance_cents").isNull() | F.arrays_overlap(codes, F.array(F.lit("2"), F.lit("5"), F.lit("99")))
    flag = lambda c: F.coalesce(F.col(c), F.lit(0)) == 1
    terminal = flag("first_default_event") | flag("prepayment_event") | flag("repurchase_event") | flag("maturity_event") | censored
    f = prior_terminal(panel, keys, "period_end", terminal)
    usable = (F.col("p.acceptance_time") <= F.col("period_start").cast("timestamp")) & (F.col("p.period_end") < F.col("period_start")) & (F.col("p.end_balance_cents") > 0)
    f = bounded_asof(f, keys, "period_end", [*DISCLOSED, "acceptance_time"], usable, ROWS_BACK, "seen")
    f = f.where(F.col("seen").isNotNull() & ~F.col("prior_terminal") & ~censored & (F.col("begin_balance_cents") > 0) & ~flag("repurchase_event"))
    lag = months_between(F.col("period_end"), F.col("seen.period_end"))
    both = flag("first_default_event") & flag("prepayment_event")
    outcome = F.when(both, F.raise_error(F.lit("default and prepayment in one loan-month"))).when(flag("first_default_event"), 1).when(flag("prepayment_event"), 2).otherwise(0)
    return f.select(
        *keys,
        "period_start",
        "period_end",
        "begin_balance_cents",
        F.col("seen.credit_score").alias("credit_score"),
        F.col("seen.orig_ltv_pct").alias("orig_ltv_pct"),
        F.col("seen.interest_rate_pct").alias("interest_rate_pct"),
        (F.col("seen.age_months") + lag).alias("age_months"),
        # greatest() would pass over a null
        F.when(F.col("seen.remaining_months").isNotNull(), F.greatest(F.col("seen.remaining_months") - lag, F.lit(0))).alias("remaining_months"),
        F.col("seen.delinquency_days").alias("delinquency_days"),
        F.log1p(F.col("seen.end_balance_cents") / 100).alias("log_balance"),
        lag.alias("disclosure_lag_months"),
        F.col("seen.acceptance_time").alias("feature_available_at"),
        F.col("acceptance_time").alias("label_available_at"),
        outcome.cast("int").alias("outcome"),
    )


def unavailable(rows: DataFrame) -> DataFrame:
    """Rows whose features were not yet public when their period began; must be none."""
    return rows.where(F.coalesce(F.col("feature_available_at") > F.col("period_start").cast("timestamp"), F.lit(True)))
