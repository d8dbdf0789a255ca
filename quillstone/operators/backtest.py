"""Cash forecasts for past periods, each from what was public when its period began, against what the servicer then reported."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..functions.calendar import months_between, payment_date
from ..functions.rates import annual_from_monthly, competing_monthly, scaled_hazard
from . import models, runoff, scoring, valuation

# The forecast quantities, each an amount in cents of a certificate.
QUANTITIES = ("gross_defaults", "principal_collections", "interest_collections", "ending_pool")
#: A target is one deal's period; its origin is the moment at which the period begins.
TARGET = ("deal_id", "target_period")


def _or_fail(value: Column, ok: Column, message: str) -> Column:
    """``value``, or an error that names the target where ``ok`` does not hold."""
    at = F.concat_ws(" ", F.col("deal_id"), F.col("target_period").cast("string"))
    return F.when(F.coalesce(ok, F.lit(False)), value).otherwise(F.raise_error(F.concat(F.lit(f"{message}: "), at)))


def origins(loans: DataFrame, targets: DataFrame) -> DataFrame:
    """TARGET, origin, snapshot_end: the newest period of each deal of which a row was public when the target's period began.

    A period is public from its first accepted row on, so loans fold to a row for each deal and period before they meet the origins;
    the meeting is an equality of deals and two ranges, one on each time. A target without a public period is an error.
    """
    filed = loans.groupBy("deal_id", "period_end").agg(F.min("acceptance_time").alias("public_from"))
    t = targets.select("deal_id", F.col("collection_period_end").alias("target_period"), F.col("collection_period_start").cast("timestamp").alias("origin"))
    known = (F.col("t.deal_id") == F.col("f.deal_id")) & (F.col("public_from") <= F.col("origin")) & (F.col("period_end").cast("timestamp") < F.col("origin"))
    newest = t.alias("t").join(filed.alias("f"), known, "left").groupBy(*[F.col(f"t.{c}") for c in TARGET], "origin").agg(F.max("period_end").alias("snapshot_end"))
    return newest.withColumn("snapshot_end", _or_fail(F.col("snapshot_end"), F.col("snapshot_end").isNotNull(), "no fleet was public at the origin of"))


def origin_certificates(of: DataFrame, certificates: DataFrame) -> DataFrame:
    """``origins`` with source_interest_cents and forecast_distribution_date of the certificate of their snapshot's period.

    It is an error if there is none, if it was not public at the origin, or if the payment date that many months on is not the target's.
    """
    source = certificates.select(F.col("deal_id").alias("__deal"), F.col("collection_period_end").alias("__end"), F.col("acceptance_time").alias("__accepted"), F.col("distribution_date").alias("__paid"), F.col("interest_collections").alias("__interest"))
    own = certificates.select(F.col("deal_id"), F.col("collection_period_end").alias("target_period"), F.col("distribution_date").alias("__own_date"))
    gap = months_between(F.col("origin"), F.col("snapshot_end"))
    f = of.join(source, (F.col("deal_id") == F.col("__deal")) & (F.col("snapshot_end") == F.col("__end")), "left").join(own, list(TARGET)).withColumn("bridge_months", gap)
    found = _or_fail(F.col("__interest"), F.col("__deal").isNotNull(), "no certificate of the origin's period for")
    public = _or_fail(found, F.col("__deal").isNull() | (F.col("__accepted") <= F.col("origin")), "the origin's certificate was not public for")
    date = payment_date(F.col("__paid"), F.col("bridge_months"))
    return f.select(*TARGET, "origin", "snapshot_end", "bridge_months", public.alias("source_interest_cents"), _or_fail(date, date == F.col("__own_date"), "another payment month than the period's for").alias("forecast_distribution_date"))


def snapshots(loans: DataFrame, of: DataFrame) -> DataFrame:
    """The loans' rows of each origin's snapshot as they were public at the origin, and previously_defaulted.

    A loan's rows meet only the origins whose snapshot they are. A default is known from the later of its acceptance and the end of its
    period; a loan's first such moment is compared with the origin, so that no loan's history is expanded over the origins.
    """
    later = F.greatest(F.col("acceptance_time"), F.col("period_end").cast("timestamp") + F.expr("INTERVAL 1 MICROSECOND"))
    defaulted = loans.where("first_default_event = 1").groupBy("deal_id", "loan_id").agg(F.min(later).alias("__known_default"))
    at = of.select(F.col("deal_id").alias("__deal"), F.col("target_period"), "origin", "snapshot_end", "bridge_months", "source_interest_cents")
    same = (F.col("deal_id") == F.col("__deal")) & (F.col("period_end") == F.col("snapshot_end")) & (F.col("acceptance_time") <= F.col("origin"))
    f = loans.join(at, same).drop("__deal").join(defaulted, ["deal_id", "loan_id"], "left")
    return f.withColumn("previously_defaulted", F.coalesce(F.col("__known_default") <= F.col("origin"), F.lit(False))).drop("__known_default")


def interest_factors(snapshot: DataFrame) -> DataFrame:
    """TARGET, interest_collection_factor and uncapped_collection_ratio: reported interest against beginning balances at their rates; an unknown rate is the snapshot's median."""
    rate, balance = F.col("interest_rate_pct"), F.greatest(F.col("begin_balance_cents"), F.lit(0))
    unknown = F.coalesce(F.median(rate) * F.sum(F.when(rate.isNull(), balance)), F.lit(0.0))
    due = (F.coalesce(F.sum(balance * rate), F.lit(0.0)) + unknown) / 100 / 12
    f = snapshot.groupBy(*TARGET).agg((F.max("source_interest_cents") / due).alias("uncapped_collection_ratio"))
    return f.withColumn("interest_collection_factor", F.least(F.lit(1.0), "uncapped_collection_ratio"))


def hazards(fleet: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """TARGET, method, annual_default, annual_prepayment: balance-weighted probabilities of loans not known to have defaulted.

    Every method scores the rows of all targets at once: a function that adds p0, p1, p2. The features are the snapshot's, moved to the first
    month that it does not cover.
    """
    gap = F.col("bridge_months")
    moved = fleet.withColumns({
        "age_months": F.col("age_months") + gap, "disclosure_lag_months": gap, "log_balance": F.log1p(F.col("end_balance_cents") / 100),
        "remaining_months": F.when(F.col("remaining_months").isNotNull(), F.greatest(F.col("remaining_months") - gap, F.lit(0))),
    })
    for name, predict in methods.items():
        moved = predict(moved).drop("p0").withColumnsRenamed({"p1": f"__d_{name}", "p2": f"__p_{name}"})
    weight = F.when(~F.col("previously_defaulted"), F.col("end_balance_cents"))
    f = models.weighted_means(moved, list(TARGET), weight, {c: F.col(c) for name in methods for c in (f"__d_{name}", f"__p_{name}")})
    each = F.array(*[F.struct(F.lit(name).alias("method"), F.col(f"__d_{name}").alias("d"), F.col(f"__p_{name}").alias("p")) for name in methods])
    f = f.select(*TARGET, F.explode(each).alias("m"))
    d, p = F.col("m.d"), F.col("m.p")
    ok = (d >= 0) & (p >= 0) & (d + p < 1)  # null where no loan is left to weigh
    annual_d, annual_p = annual_from_monthly(d, p)
    return f.select(*TARGET, "m.method", _or_fail(annual_d, ok, "no competing probabilities for").alias("annual_default"), annual_p.alias("annual_prepayment"))


def forecasts(loans: DataFrame, certificates: DataFrame, targets: DataFrame, methods: dict[str, Callable[[DataFrame], DataFrame]]) -> DataFrame:
    """TARGET, method, how each forecast was made, and its QUANTITIES: one row for each target and method, all targets in one plan.

    ``loans``: deal_id, loan_id, period_end, acceptance_time, begin_balance_cents, end_balance_cents, interest_rate_pct, remaining_months,
    age_months, first_default_event and what the methods read. ``certificates``: deal_id, collection_period_end, acceptance_time,
    distribution_date, QUANTITIES. ``targets``: the certificates to be forecast, with collection_period_start.

    The snapshot's cohorts run off over the months that were not yet public, the last of which is the target's; a pool that closes before
    has no cash left. Recoveries of defaults before the origin are not part of the quantities, so none are forecast.
    """
    of = origin_certificates(origins(loans, targets), certificates)
    snapshot = snapshots(loans, of)
    fleet = snapshot.where("end_balance_cents > 0")
    given = of.join(hazards(fleet, methods), list(TARGET), "left").join(interest_factors(snapshot), list(TARGET), "left")
    given = given.withColumn("method", _or_fail(F.col("method"), F.col("method").isNotNull(), "no loan had a balance at the origin of"))
    cohorts = runoff.make_cohorts(fleet, keys=TARGET).join(given, list(TARGET)).withColumnRenamed("interest_collection_factor", "interest_factor")
    scaled = scaled_hazard(F.col("annual_default"), F.col("default_hazard_multiplier"))
    default_monthly, prepay_monthly = competing_monthly(scaled, F.col("annual_prepayment"))
    rated = cohorts.withColumns({"default_monthly": default_monthly, "prepay_monthly": prepay_monthly})
    keys = [*TARGET, "method", "bridge_months"]
    last = runoff.cohort_paths(rated, keys, F.col("bridge_months")).where(F.col("month") == F.col("bridge_months"))
    sums = {"gross_defaults": F.col("loss"), "principal_collections": F.col("scheduled") + F.col("prepay"), "interest_collections": F.col("interest"), "ending_pool": F.col("end")}
    pool = last.groupBy(*TARGET, "method").agg(*[F.sum(value).alias(name) for name, value in sums.items()])
    return given.join(pool, [*TARGET, "method"], "left").fillna(0, list(QUANTITIES))


def errors(made: DataFrame, certificates: DataFrame, quantities=QUANTITIES) -> DataFrame:
    """TARGET, method, quantity, forecast_cents, observed_cents, error_cents: every forecast against its period's certificate."""
    pairs = F.array(*[F.struct(F.lit(q).alias("quantity"), F.col(f"f.{q}").alias("forecast_cents"), F.col(f"c.{q}").alias("observed_cents")) for q in quantities])
    same = (F.col("f.deal_id") == F.col("c.deal_id")) & (F.col("f.target_period") == F.col("c.collection_period_end"))
    f = made.alias("f").join(certificates.alias("c"), same).select("f.deal_id", "f.target_period", "f.method", F.explode(pairs).alias("q")).select(*TARGET, "method", "q.*")
    return f.withColumn("error_cents", F.col("forecast_cents") - F.col("observed_cents"))


def scores(of: DataFrame, baseline: str, model: str) -> DataFrame:
    """deal_id, quantity, months, baseline_mae, model_mae, difference, improvement_pct of the rows of ``errors``."""
    months = of.groupBy("deal_id", "quantity").agg(F.countDistinct("target_period").alias("months"))
    return valuation.error_table(of, ["deal_id", "quantity"], "method", "error_cents", baseline, model).join(months, ["deal_id", "quantity"])


def baselines(train: DataFrame) -> dict[str, Callable[[DataFrame], DataFrame]]:
    """Methods by name that score rows from the outcomes of training rows: constant shares, delinquency transitions, cohort cells."""
    overall = scoring.constant_probabilities(train)
    return {
        "constant": lambda rows: rows.join(F.broadcast(overall)),  # one row
        "transition": lambda rows: scoring.transition_predictions(train, rows),
        "cohort": lambda rows: scoring.cohort_predictions(train, rows),
    }
