"""Loan-month panel: event derivation, first-seen facts, aggregates, comparisons."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def has_code(codes: Column, code: str) -> Column:
    """Whether a pipe-joined code string holds the code; false for null."""
    return F.array_contains(F.split(F.coalesce(codes, F.lit("")), "[|]"), code)


def first_when(df: DataFrame, keys: list[str], time: str, condition: Column, out: str) -> DataFrame:
    """Adds the earliest ``time`` at which the condition held within ``keys``; null if it never did.

    Rows are sorted by ``time``, which the result does not need: windows along it that follow then sort nothing again.
    """
    whole = Window.partitionBy(*keys).orderBy(time).rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return df.withColumn(out, F.min(F.when(condition, F.col(time))).over(whole))


def earliest(df: DataFrame, keys: list[str], order: list[str], columns: list[str]) -> DataFrame:
    """keys and the ``columns`` of each key's first row by ``order``, in one aggregate."""
    return df.groupBy(*keys).agg(F.min_by(F.struct(*columns), F.struct(*order)).alias("__first")).select(*keys, "__first.*")


def returned(df: DataFrame, keys: list[str], order: str, event: Column, amount: Column, out: str) -> DataFrame:
    """Adds whether an amount came back: an earlier row of the key had the event, the row before had no amount above 0, and this one has."""
    along = Window.partitionBy(*keys).orderBy(order)
    marked = df.withColumns({"__event": event, "__amount": amount})
    seen = F.max("__event").over(along.rowsBetween(Window.unboundedPreceding, -1))
    back = seen & (F.lag("__amount").over(along) <= 0) & (F.col("__amount") > 0)
    return marked.withColumn(out, F.coalesce(back, F.lit(False))).drop("__event", "__amount")


def derive_events(panel: DataFrame) -> DataFrame:
    """First default, prepayment, maturity and repurchase flags of each loan-month.

    One window over (deal_id, loan_id) finds the first default (a charge-off or code 4); all flags are
    expressions on it, so the panel is shuffled once.
    """
    month = F.date_format("period_end", "yyyy-MM")
    code = lambda c: has_code(F.col("zero_balance_code"), c)
    loss = F.coalesce(F.col("chargeoff_cents"), F.lit(0))
    seen = first_when(panel, ["deal_id", "loan_id"], "period_end", (loss > 0) | code("4"), "__first_default")
    before = F.coalesce(F.col("__first_default") <= F.col("period_end"), F.lit(False))
    paid_off = code("1") & ~code("3") & (F.col("end_balance_cents") <= 0) & (F.col("begin_balance_cents") > 0) & (loss == 0) & (F.col("zero_balance_month") == month) & ~before
    flag = lambda condition: F.coalesce(condition, F.lit(False)).cast("int")
    prepaid = paid_off & ~code("4") & (F.col("maturity_month") > month)
    return seen.withColumns(
        {
            "first_default_event": flag(F.col("period_end") == F.col("__first_default")),
            "prepayment_event": flag(prepaid),
            "maturity_event": flag(paid_off & (F.col("maturity_month") <= month)),
            "repurchase_event": flag(code("3") & (F.col("zero_balance_month") == month)),
            "prepayment_cents": F.when(flag(prepaid) == 1, F.col("principal_paid_cents")),
        }
    ).drop("__first_default")


def panel_stats(panel: DataFrame) -> DataFrame:
    """Counts and exact-cent sums by deal and period, in one hash aggregate."""
    total = lambda c: F.sum(c).alias(c)
    positive = lambda c: F.sum(F.greatest(F.col(c), F.lit(0))).alias(f"positive_{c}")
    return panel.groupBy("deal_id", "period_end").agg(
        F.count("*").alias("loans"),
        F.count_if(F.col("end_balance_cents") > 0).alias("active_loans"),
        total("begin_balance_cents"),
        total("end_balance_cents"),
        positive("end_balance_cents"),
        total("principal_paid_cents"),
        total("interest_paid_cents"),
        total("chargeoff_cents"),
        total("recovery_cents"),
        total("prepayment_cents"),
        F.sum("first_default_event").alias("first_defaults"),
        F.sum("prepayment_event").alias("prepayments"),
        F.sum("repurchase_event").alias("repurchases"),
        F.sum("maturity_event").alias("maturities"),
    )


def missing_counts(df: DataFrame, columns: list[str]) -> DataFrame:
    """One row: a map from each column to its number of nulls."""
    counts = [x for name in columns for x in (F.lit(name), F.count_if(F.col(name).isNull()))]
    return df.agg(F.create_map(*counts).alias("missing_fields"))


def duplicate_keys(df: DataFrame, keys: list[str]) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def first_rows(df: DataFrame, keys: list[str], order: list[Column]) -> DataFrame:
    """The first row of each key in a stated order."""
    return df.withColumn("__place", F.row_number().over(Window.partitionBy(*keys).orderBy(*order))).where("__place = 1").drop("__place")


def latest(df: DataFrame, keys: list[str], time: str) -> DataFrame:
    """The rows whose time is the largest of their key: an aggregate joined back, which Spark may broadcast."""
    newest = df.groupBy(*keys).agg(F.max(time).alias(time))
    return df.join(newest, [*keys, time], "left_semi")


def compare(df: DataFrame, computed: str, reported: str) -> DataFrame:
    """residual_cents and status of computed against reported; a missing side is SKIPPED."""
    residual = F.col(computed) - F.col(reported)
    status = F.when(residual.isNull(), "SKIPPED").when(residual == 0, "PASS").otherwise("DIFFERENCE")
    return df.withColumns({"residual_cents": residual, "status": status})


def audit_defaults(panel: DataFrame) -> DataFrame:
    """Counters per deal on how first defaults were observed.

    Default rows after which a balance came back, first defaults in the deal's first
    period, and the zero-balance month's place against the period.
    """
    first = panel.groupBy("deal_id").agg(F.min("period_end").alias("__first_period"))
    event = F.col("first_default_event") == 1
    f = returned(panel, ["deal_id", "loan_id"], "period_end", event, F.col("end_balance_cents"), "__back").join(first, "deal_id", "left").withColumn("__month", F.date_format("period_end", "yyyy-MM"))
    month = F.col("zero_balance_month")
    timing = F.when(month.isNull(), "missing").when(month < F.col("__month"), "earlier").when(month == F.col("__month"), "same").otherwise("later")
    return f.groupBy("deal_id").agg(
        F.count_if(event).alias("first_defaults"),
        F.count_if(event & (F.col("period_end") == F.col("__first_period"))).alias("at_boundary"),
        *[F.count_if(event & (timing == name)).alias(f"effective_{name}") for name in ("missing", "earlier", "same", "later")],
        F.count_if("__back").alias("balance_returned"),
    )
