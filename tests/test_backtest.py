"""Cash forecasts of past periods: nothing that was not public may change them."""

import datetime as dt

import pytest
from pyspark.sql import functions as F

from quillstone.functions.calendar import federal_holidays, payment_date
from quillstone.operators import backtest

LOAN = "deal_id string, loan_id string, period_end date, acceptance_time timestamp, begin_balance_cents long, end_balance_cents long, interest_rate_pct double, remaining_months int, age_months int, delinquency_days int, first_default_event int"
CERTIFICATE = "deal_id string, collection_period_start date, collection_period_end date, acceptance_time timestamp, distribution_date date, gross_defaults long, principal_collections long, interest_collections long, ending_pool long"
DEALS = ("X", "Y")


def day(text):
    return dt.date.fromisoformat(text)


def time(text):
    return dt.datetime.fromisoformat(text)


def loans(**changed):
    """One loan a deal: December is public in January, January only after February began."""
    late = {"end": 99_999_999, "default": 0, "days": 0} | changed
    rows = []
    for deal in DEALS:
        rows.append((deal, "1", day("2025-12-31"), time("2026-01-15 00:00:00"), 13_000_000, 12_000_000, 12.0, 24, 12, 0, 0))
        rows.append((deal, "1", day("2026-01-31"), time("2026-02-15 00:00:00"), 13_000_000, late["end"], 12.0, 24, 13, late["days"], late["default"]))
    return rows


def certificates(accepted="2026-01-15 12:00:00", defaults=10_000, paid="2026-03-16"):
    rows = []
    for deal in DEALS:
        rows.append((deal, day("2025-12-01"), day("2025-12-31"), time(accepted), day("2026-01-15"), 10_000, 500_000, 100_000, 11_000_000))
        rows.append((deal, day("2026-02-01"), day("2026-02-28"), time("2026-03-15 12:00:00"), day(paid), defaults, 500_000, 100_000, 11_000_000))
    return rows


def shares(p1, p2):
    return lambda rows: rows.withColumns({"p0": F.lit(1 - p1 - p2), "p1": F.lit(p1), "p2": F.lit(p2)})


METHODS = {"baseline": shares(0.005, 0.015), "model": shares(0.01, 0.02)}


def made(spark, rows, reported, methods=METHODS):
    reported = spark.createDataFrame(reported, CERTIFICATE)
    targets = reported.where("collection_period_end >= DATE '2026-02-01'")
    return backtest.forecasts(spark.createDataFrame(rows, LOAN), reported, targets, methods), reported


def test_what_was_not_public_changes_no_forecast(spark):
    first, reported = made(spark, loans(), certificates())
    other, other_reported = made(spark, loans(end=1, default=1, days=999), certificates(defaults=99_999_900))
    keys = ("deal_id", "method", "quantity")
    one = {tuple(r[k] for k in keys): r for r in backtest.errors(first, reported).collect()}
    two = {tuple(r[k] for k in keys): r for r in backtest.errors(other, other_reported).collect()}
    assert len(one) == 2 * 2 * 4 and one.keys() == two.keys()
    for key, r in one.items():
        assert r.forecast_cents == two[key].forecast_cents and r.error_cents == r.forecast_cents - r.observed_cents
        assert (r.observed_cents != two[key].observed_cents) == (key[2] == "gross_defaults")
    of = first.select("snapshot_end", "bridge_months", "forecast_distribution_date").distinct().collect()
    assert [tuple(r) for r in of] == [(day("2025-12-31"), 2, day("2026-03-16"))]


def test_forecasts_are_those_of_a_plain_run_off(spark):
    """One cohort of 24 months at 12%, two months on, in Python."""
    import math

    got = {(r.deal_id, r.method): r for r in made(spark, loans(), certificates())[0].collect()}
    factor = min(1.0, 100_000 / (13_000_000 * 12 / 100 / 12))
    for method, (d, p) in {"baseline": (0.005, 0.015), "model": (0.01, 0.02)}.items():
        hazard = -math.log1p(-(d + p))
        md, mp = (-math.expm1(-hazard) * x / (d + p) for x in (d, p))  # the yearly figures and back
        balance, term, rate = 12_000_000, 24, 0.01
        for _ in range(2):
            loss, paid = round(balance * md), round(balance * mp)
            rest = balance - loss - paid
            due = max(0, round(rest * rate / (1 - (1 + rate) ** -term) - rest * rate))
            interest = math.floor((balance - (loss + paid) / 2) * rate * factor + 0.5)
            begin, balance, term = balance, rest - due, term - 1
        r = got["X", method]
        assert (r.gross_defaults, r.principal_collections, r.interest_collections, r.ending_pool) == (loss, paid + due, interest, balance)
        assert begin - r.gross_defaults - r.principal_collections == r.ending_pool
        assert abs(r.interest_collection_factor - factor) < 1e-12


def test_features_are_moved_to_the_forecast_month(spark):
    seen = []

    def watched(rows):
        seen.append(rows.select("age_months", "remaining_months", "disclosure_lag_months", "log_balance"))
        return METHODS["model"](rows)

    made(spark, loans(), certificates(), {"model": watched})
    rows = seen[0].collect()
    assert len(seen) == 1 and [(r.age_months, r.remaining_months, r.disclosure_lag_months) for r in rows] == [(14, 22, 2)] * 2
    assert all(abs(r.log_balance - 11.695255) < 1e-6 for r in rows)


@pytest.mark.parametrize(
    "rows,reported,message",
    [
        (loans(), certificates(accepted="2026-02-15 12:00:00"), "not public"),
        (loans(), certificates(paid="2026-03-17"), "another payment month"),
        (loans(), [r for r in certificates() if r[2] != day("2025-12-31")], "no certificate"),
        ([r for r in loans() if r[2] != day("2025-12-31")], certificates(), "no fleet"),
        ([(*r[:5], 0, *r[6:]) for r in loans()], certificates(), "no loan had a balance"),
        ([(*r[:-1], 1) for r in loans()], certificates(), "no competing probabilities"),
    ],
)
def test_origins_that_cannot_be_forecast_are_errors(spark, rows, reported, message):
    with pytest.raises(Exception, match=message):
        made(spark, rows, reported)[0].collect()


def test_known_defaults_double_the_hazard_and_are_not_weighed(spark):
    """A default counts from the day it is public; a loan that came back runs off at twice the hazard."""
    more = [("X", "2", day("2025-11-30"), time("2025-12-10 00:00:00"), 9_000_000, 0, 12.0, 24, 1, 0, 1), ("X", "2", day("2025-12-31"), time("2026-01-15 00:00:00"), 0, 8_000_000, 12.0, 24, 1, 120, 0)]
    by_days = lambda rows: rows.withColumns({"p0": F.lit(0.9), "p1": F.when(F.col("delinquency_days") > 90, 0.5).otherwise(0.01), "p2": F.lit(0.02)})
    reported = spark.createDataFrame(certificates(), CERTIFICATE)
    of = backtest.origin_certificates(backtest.origins(spark.createDataFrame(loans() + more, LOAN), reported.where("collection_period_end > DATE '2026-01-01'")), reported)
    fleet = {(r.deal_id, r.loan_id): r.previously_defaulted for r in backtest.snapshots(spark.createDataFrame(loans() + more, LOAN), of).collect()}
    assert fleet == {("X", "1"): False, ("X", "2"): True, ("Y", "1"): False}
    got = {r.deal_id: r for r in made(spark, loans() + more, certificates(), {"model": by_days})[0].collect()}
    assert abs(got["X"].annual_default - got["Y"].annual_default) < 1e-12  # the reinstated loan's 0.5 is not weighed
    assert got["X"].gross_defaults > got["Y"].gross_defaults * 20 / 12 * 1.2
    # Public only after the origin: not known.
    late = [(*more[0][:3], time("2026-02-02 00:00:00"), *more[0][4:]), more[1]]
    assert not any(r.previously_defaulted for r in backtest.snapshots(spark.createDataFrame(loans() + late, LOAN), of).collect())


def test_a_pool_that_closes_before_its_target_has_no_cash(spark):
    rows = [(*r[:7], 1, *r[8:]) for r in loans()]
    (r,) = [r for r in made(spark, rows, certificates(), {"model": METHODS["model"]})[0].collect() if r.deal_id == "X"]
    assert (r.gross_defaults, r.principal_collections, r.interest_collections, r.ending_pool) == (0, 0, 0, 0)


def test_scores(spark):
    made_, reported = made(spark, loans(), certificates())
    s = {(r.deal_id, r.quantity): r for r in backtest.scores(backtest.errors(made_, reported), "baseline", "model").collect()}
    e = {(r.deal_id, r.quantity, r.method): abs(r.error_cents) for r in backtest.errors(made_, reported).collect()}
    assert len(s) == 8 and all(r.months == 1 and r.baseline_mae == e[(*k, "baseline")] and r.model_mae == e[(*k, "model")] for k, r in s.items())


def test_the_plan_has_neither_a_loop_nor_a_cross_join(spark):
    plan = made(spark, loans(), certificates())[0]._jdf.queryExecution().executedPlan().toString()
    assert "CartesianProduct" not in plan and "BroadcastNestedLoopJoin" not in plan


def test_payment_dates_agree_with_the_holidays(spark):
    """Every 15th of seventy years, by the rule and by the list of holidays."""
    months = spark.range(70 * 12).select(F.add_months(F.lit("1980-01-01").cast("date"), F.col("id").cast("int")).alias("m"))
    got = {r.m: r.d for r in months.select("m", payment_date(F.col("m"), F.lit(0)).alias("d")).collect()}
    closed = {r.day for r in federal_holidays(spark, 1979, 2051).collect()}
    for month, paid in got.items():
        want = month.replace(day=15)
        while want.weekday() > 4 or want in closed:
            want += dt.timedelta(days=1)
        assert paid == want
