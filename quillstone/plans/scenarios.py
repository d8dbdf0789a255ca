"""Scenarios and forecasts: cohorts, run-off, waterfall and value put together."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.rates import scaled_hazard
from ..operators import panel, runoff, valuation, waterfall

# Scenario, multiples of default and prepayment hazards and recovery, extra lag, multiple of interest; the severities of the reverse stress.
SCENARIOS = (("Central", 1.0, 1.0, 1.0, 0, 1.0), ("Downside", 2.0, 0.75, 0.75, 3, 0.95), ("Severe", 5.0, 0.5, 0.5, 6, 0.85))
SEVERITIES = (1, 2, 3, 5, 7, 10, 15, 20, 30)
DISCOUNT = 0.08


def assumptions(spark: SparkSession, *, annual_default: float, annual_prepay: float, recovery_rate: float, recovery_lag: int, interest_factor: float, previous_distribution: str, scenarios=SCENARIOS) -> DataFrame:
    """A row per scenario; multiples act on hazards, not probabilities."""
    rows = [F.struct(F.lit(n).alias("scenario"), F.lit(float(d)).alias("d"), F.lit(float(p)).alias("p"), F.lit(float(r)).alias("r"), F.lit(int(lag)).alias("lag"), F.lit(float(i)).alias("i")) for n, d, p, r, lag, i in scenarios]
    f = spark.range(1).select(F.explode(F.array(*rows)).alias("s")).select("s.*")
    return f.select(
        "scenario", scaled_hazard(F.lit(annual_default), F.col("d")).alias("annual_default"), scaled_hazard(F.lit(annual_prepay), F.col("p")).alias("annual_prepay"),
        F.least(F.lit(recovery_rate) * F.col("r"), F.lit(1.0)).alias("recovery_rate"), (F.lit(recovery_lag) + F.col("lag")).alias("recovery_lag"),
        F.least(F.lit(interest_factor) * F.col("i"), F.lit(1.0)).alias("interest_factor"), F.lit(previous_distribution).cast("date").alias("previous_distribution"),
    )


def stress_grid(severities=SEVERITIES) -> tuple:
    """A scenario for each severity: defaults so many times, prepayment and recovery divided by it."""
    return tuple((str(s), float(s), 1.0 / s, 1.0 / s, 0, 1.0) for s in severities)


def with_unmapped(flows: DataFrame, unmapped_cents: int) -> DataFrame:
    """A residual of the pool that no loan explains, added as an immediate default of the first month."""
    first = F.col("month") == 1
    add = F.when(first, F.lit(unmapped_cents)).otherwise(0).cast("bigint")
    return flows.withColumns({"pool_begin_cents": F.col("pool_begin_cents") + add, "default_cents": F.col("default_cents") + add, "net_loss_cents": F.col("net_loss_cents") + add})


def run(cohorts: DataFrame, table: DataFrame, opening: waterfall.State, terms: waterfall.Terms = waterfall.Terms(), floating_rate: str = "0.05", rate: float = DISCOUNT) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(pool flows, note flows, note summary) of all scenarios."""
    pool = runoff.project(cohorts, table).withColumn("floating_rate", F.lit(floating_rate))
    notes = waterfall.note_flows(pool, opening, terms)
    return pool, notes, valuation.note_summary(notes, F.lit(opening.last_distribution).cast("date"), rate)


def reverse_stress(cohorts: DataFrame, table: DataFrame, opening: waterfall.State, note: str, terms: waterfall.Terms = waterfall.Terms()) -> DataFrame:
    """First breach and preceding safe point of a note over a grid made by ``stress_grid``."""
    _, notes, _ = run(cohorts, table, opening, terms)
    worst = notes.where(F.col("note") == note).groupBy(F.col("scenario").cast("int").alias("severity")).agg((F.max("loss_cents") + F.max_by("shortfall_cents", "month") + F.max("maturity_shortfall_cents")).alias("loss_cents"))
    return waterfall.first_breach(worst)


def known_fleet(loans: DataFrame, origin: Column) -> DataFrame:
    """Loans as last accepted by an origin, with a balance, and whether they had defaulted before or at that snapshot."""
    known = loans.where((F.col("acceptance_time") <= origin) & (F.col("period_end").cast("timestamp") < origin))
    seen = F.max("first_default_event").over(Window.partitionBy("deal_id", "loan_id").orderBy("period_end").rowsBetween(Window.unboundedPreceding, 0))
    f = panel.latest(known.withColumn("previously_defaulted", seen == 1), ["deal_id"], "period_end")
    return f.where("end_balance_cents > 0")


def interest_factor(fleet: DataFrame, reported_cents: Column) -> Column:
    """min(1, reported interest / (beginning balances * rates / 12)), as an aggregate over the fleet; an unknown rate is the median of the known ones."""
    rate, balance = F.col("interest_rate_pct"), F.greatest(F.col("begin_balance_cents"), F.lit(0))
    unknown = F.coalesce(F.median(rate) * F.sum(F.when(rate.isNull(), balance)), F.lit(0.0))
    return F.least(F.lit(1.0), reported_cents / ((F.coalesce(F.sum(balance * rate), F.lit(0.0)) + unknown) / 100 / 12))
