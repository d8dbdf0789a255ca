"""Operators on small hand-made inputs."""

import datetime as dt
import json

import pytest
from pyspark.sql import functions as F

from quillstone.functions import calendar, money, rates
from quillstone.operators import features, models, panel, reconcile, recovery, replay, runoff, scoring, valuation, waterfall
from quillstone.plans import scenarios
from quillstone.sources import documents, tapes


def one(df):
    rows = df.collect()
    assert len(rows) == 1
    return rows[0]


def value(spark, column):
    return one(spark.range(1).select(column.alias("x"))).x


# ---- functions


@pytest.mark.parametrize("text,cents", [("0", 0), ("12", 1200), ("12.3", 1230), ("12.30", 1230), ("00012.30", 1230)])
def test_amounts_that_parse(spark, text, cents):
    assert value(spark, money.parse_cents(F.lit(text))) == cents


@pytest.mark.parametrize("text", ["-0.00", "+1.00", "0.001", "1.", ".50", "1e2", "1,000.00", "$1.00", " 1", "NaN", "", "１", "1\n"])
def test_amounts_that_do_not(spark, text):
    with pytest.raises(Exception):
        value(spark, money.parse_cents(F.lit(text)))


def test_signed_and_wide_amounts(spark):
    assert value(spark, money.parse_cents(F.lit("-3.25"), signed=True)) == -325
    assert int(value(spark, money.parse_cents(F.lit("9" * 31 + ".99"), wide=True))) == int("9" * 33)
    assert value(spark, money.parse_cents(F.lit(None).cast("string"))) is None
    assert value(spark, money.dollars(F.lit(-4105))) == "-41.05"


def test_rounding(spark):
    assert value(spark, money.half_up(F.lit(5), F.lit(10))) == 1 and value(spark, money.half_up(F.lit(4), F.lit(10))) == 0
    # Act/360 interest of a floating note, by exact integers
    assert value(spark, money.half_up(F.lit("16151000000").cast("decimal(38,0)") * F.lit("503270").cast("decimal(38,0)") * F.lit(31).cast("decimal(38,0)"), F.lit("3600000000").cast("decimal(38,0)"))) == 69_993_813


def test_strict_numbers(spark):
    assert value(spark, money.strict_number(F.lit("NONE"))) is None and value(spark, money.strict_integer(F.lit("12"))) == 12
    for bad in ("1.5", "x", "inf"):
        with pytest.raises(Exception):
            value(spark, money.strict_integer(F.lit(bad)))


def test_months_and_payment_dates(spark):
    day = lambda s: F.lit(s).cast("date")
    assert value(spark, calendar.months_between(day("2026-01-01"), day("2025-11-30"))) == 2
    assert value(spark, calendar.add_months_on(day("2025-01-31"), F.lit(1), F.lit(31))) == dt.date(2025, 2, 28)
    rows = spark.createDataFrame([(dt.date(2025, 8, 15), n) for n in (1, 2, 3, 5, 6)], "d date, m int")
    got = {r.m: r.distribution_date.isoformat() for r in calendar.distribution_dates(rows, "d", "m").collect()}
    # The 15th, past week-ends; 2026-02-15 is a Sunday before a holiday.
    assert got == {1: "2025-09-15", 2: "2025-10-15", 3: "2025-11-17", 5: "2026-01-15", 6: "2026-02-17"}


def test_hazards_round_trip(spark):
    d, p = rates.competing_monthly(F.lit(0.03), F.lit(0.12))
    back = one(spark.range(1).select(d.alias("d"), p.alias("p")).select(*rates.annual_from_monthly(F.col("d"), F.col("p"))))
    assert back[0] == pytest.approx(0.03) and back[1] == pytest.approx(0.12)
    assert tuple(one(spark.range(1).select(*rates.competing_monthly(F.lit(0.0), F.lit(0.0))))) == (0.0, 0.0)


def test_bands_are_right_closed(spark):
    rows = spark.createDataFrame([(None,), (620.0,), (620.1,), (780.0,), (780.1,)], "x double")
    assert [r.b for r in rows.select(rates.band(F.col("x"), [620, 660, 720, 780]).alias("b")).collect()] == [-1, 0, 1, 3, 4]
    days = spark.createDataFrame([(None,), (0,), (1,), (30,), (31,), (91,)], "x int")
    assert [r.b for r in days.select(rates.delinquency_bucket(F.col("x")).alias("b")).collect()] == [0, 1, 2, 2, 3, 5]


# ---- panel and features

PANEL = "deal_id string, loan_id string, period_start date, period_end date, acceptance_time timestamp, begin_balance_cents long, end_balance_cents long, principal_paid_cents long, interest_paid_cents long, chargeoff_cents long, recovery_cents long, zero_balance_code string, zero_balance_month string, maturity_month string, credit_score double, orig_ltv_pct double, interest_rate_pct double, age_months int, remaining_months int, delinquency_days int"


def loan_month(loan, month, begin=1000, end=900, score=600.0, accepted=15, **more):
    start = dt.date(2025 + (month - 1) // 12, (month - 1) % 12 + 1, 1)
    nxt = dt.date(2025 + month // 12, month % 12 + 1, 1)
    row = {
        "deal_id": "D", "loan_id": loan, "period_start": start, "period_end": nxt - dt.timedelta(days=1), "acceptance_time": dt.datetime(nxt.year, nxt.month, accepted, 12),
        "begin_balance_cents": begin, "end_balance_cents": end, "principal_paid_cents": begin - end, "interest_paid_cents": 5, "chargeoff_cents": 0, "recovery_cents": 0, "zero_balance_code": None,
        "zero_balance_month": None, "maturity_month": "2027-01", "credit_score": score, "orig_ltv_pct": 80.0, "interest_rate_pct": 6.0, "age_months": month, "remaining_months": 40 - month, "delinquency_days": 0,
    }
    return row | more


def frame(spark, rows):
    names = [c.split()[0] for c in PANEL.split(", ")]
    return spark.createDataFrame([tuple(r[n] for n in names) for r in rows], PANEL)


def test_events_are_derived_once(spark):
    rows = [
        loan_month("a", 1, chargeoff_cents=500), loan_month("a", 2, chargeoff_cents=100, recovery_cents=3000),
        loan_month("b", 2, end=0, zero_balance_code="1", zero_balance_month="2025-02"), loan_month("c", 3, end=0, zero_balance_code="1|3", zero_balance_month="2025-03"),
        loan_month("d", 3, end=0, zero_balance_code="1", zero_balance_month="2025-03", maturity_month="2025-03"), loan_month("a", 3, end=0, zero_balance_code="1", zero_balance_month="2025-03"),
    ]
    f = panel.derive_events(frame(spark, rows))
    got = {(r.loan_id, r.period_end.month): (r.first_default_event, r.prepayment_event, r.maturity_event, r.repurchase_event) for r in f.collect()}
    assert got == {("a", 1): (1, 0, 0, 0), ("a", 2): (0, 0, 0, 0), ("a", 3): (0, 0, 0, 0), ("b", 2): (0, 1, 0, 0), ("c", 3): (0, 0, 0, 1), ("d", 3): (0, 0, 1, 0)}
    stats = panel.panel_stats(f).agg(F.sum("first_defaults"), F.sum("recovery_cents"), F.sum("prepayments"), F.sum("prepayment_cents")).first()
    assert tuple(stats) == (1, 3000, 1, 1000)


def test_features_are_those_disclosed_before(spark):
    base = [loan_month("a", m, score=600.0 + 100 * (m - 1)) for m in (1, 2, 3)]
    f = features.disclosure_features(panel.derive_events(frame(spark, base)))
    r = one(f)
    assert (r.period_end.month, r.credit_score, r.disclosure_lag_months, r.age_months, r.remaining_months, r.outcome) == (3, 600.0, 2, 3, 37, 0)
    assert features.unavailable(f).count() == 0
    # What happens in the month itself moves no feature.
    changed = base[:2] + [loan_month("a", 3, score=1.0, end=0, zero_balance_code="4", chargeoff_cents=900)]
    s = one(features.disclosure_features(panel.derive_events(frame(spark, changed))))
    assert (s.credit_score, s.age_months, s.log_balance) == (r.credit_score, r.age_months, r.log_balance) and s.outcome == 1


def test_terminal_and_censored_rows_leave_the_risk_set(spark):
    rows = [loan_month("a", 1), loan_month("a", 2, zero_balance_code="5"), loan_month("a", 3), loan_month("a", 4)]
    rows += [loan_month("b", 1), loan_month("b", 2), loan_month("b", 3, end=0, zero_balance_code="3", zero_balance_month="2025-03")]
    assert features.disclosure_features(panel.derive_events(frame(spark, rows))).count() == 0


def test_default_audit(spark):
    rows = [loan_month("a", 1, chargeoff_cents=5, end=0, zero_balance_month="2025-01"), loan_month("a", 2, end=50), loan_month("b", 2, chargeoff_cents=5, zero_balance_month="2025-01")]
    r = one(panel.audit_defaults(panel.derive_events(frame(spark, rows))))
    assert (r.first_defaults, r.at_boundary, r.effective_same, r.effective_earlier, r.balance_returned) == (2, 1, 1, 1, 1)


# ---- reconciliation and replay

BALANCED = {
    "pool_begin": 100000, "principal_collected": 12000, "defaults": 2500, "repurchases": 500, "pool_end": 85000, "interest_collected": 1000, "recoveries": 1000, "investment_income": 200,
    "available_collections": 14700, "reserve_draw": 300, "total_distributions": 15000, "servicing_fee": 100, "trustee_fee": 10, "total_note_interest": 890, "total_note_principal": 10000,
    "reserve_deposit": 500, "residual_distribution": 3500, "note_begin": 50000, "note_end": 40000, "reserve_begin": 4700, "reserve_interest": 200, "reserve_release": 100, "reserve_end": 5000, "gross_loss": 2500, "net_loss": 1500,
}


def certificate(spark, amounts):
    texts = {k: f"{v // 100}.{v % 100:02d}" for k, v in amounts.items()}
    df = spark.createDataFrame([("D", texts)], "deal_id string, amounts map<string,string>")
    return df.select("deal_id", reconcile.parse_amounts(F.col("amounts")).alias("amounts"))


def test_identities_pass_and_one_cent_fails(spark):
    checks = {r.check_id: r for r in reconcile.reconcile(certificate(spark, BALANCED), ["deal_id"]).collect()}
    assert {c.status for c in checks.values()} == {"PASS"} and len(checks) == 7
    assert int(checks["pool_rollforward"].computed_cents) == 85000 and int(checks["net_loss"].computed_cents) == 1500
    off = reconcile.reconcile(certificate(spark, BALANCED | {"net_loss": 1501}), ["deal_id"])
    bad = [r for r in off.collect() if r.status != "PASS"]
    assert len(bad) == 1 and int(bad[0].residual_cents) == -1
    assert one(reconcile.summarize(off, ["deal_id"])).status == "FAIL"


def test_missing_operand_is_skipped_and_unknown_is_an_error(spark):
    amounts = dict(BALANCED)
    del amounts["gross_loss"]
    checks = reconcile.reconcile(certificate(spark, amounts), ["deal_id"])
    assert {r.check_id: r.status for r in checks.collect()}["net_loss"] == "SKIPPED"
    assert one(reconcile.summarize(checks, ["deal_id"])).status == "INCOMPLETE"
    with pytest.raises(Exception):
        reconcile.reconcile(certificate(spark, BALANCED | {"other": 1}), ["deal_id"]).collect()


def test_replay_of_a_certificate(spark):
    amounts = dict(BALANCED) | {
        "pool_begin": 122_104_520_524, "pool_end": 117_606_364_734, "principal_collected": 4_392_326_486, "interest_collected": 973_795_169, "recoveries": 28_115_954, "defaults": 105_829_304,
        "repurchases": 0, "investment_income": 17_354_007, "reserve_begin": 352_644_855, "reserve_interest": 1_260_152, "trustee_fee": 0,
    }
    note_begin = {"A1": 9_366_578_350, "A2a": 35_000_000_000, "A2b": 16_151_000_000, "A3": 45_210_000_000, "A4": 8_900_000_000, "B": 2_892_000_000, "C": 2_116_000_000, "D": 1_411_000_000}
    df = spark.createDataFrame([("D", amounts, note_begin, "2025-08-15", "2025-09-15", "0.0503270")], "deal_id string, amounts map<string,bigint>, note_begin map<string,bigint>, prior_distribution_date string, distribution_date string, floating_note_rate string")
    lines = replay.replay(df, ["deal_id"])
    reported = spark.createDataFrame([("D", "oc_target", 1_057_942_174), ("D", "servicing_fee", 101_753_767)], "deal_id string, line string, reported_cents bigint")
    compared = replay.compare(lines, reported, ["deal_id"])
    by_line = {r.line: r for r in compared.collect()}
    assert len(by_line) == 37 and by_line["oc_target"].residual_cents == -7608 and by_line["servicing_fee"].status == "PASS"
    assert tuple(one(replay.summary(compared))) == (37, 1, 35)


# ---- scoring


def test_smoothed_cells_and_unseen_fallback(spark):
    train = spark.createDataFrame([("x", o) for o in (0, 0, 1, 2)], "c string, outcome int")
    test = spark.createDataFrame([("x", 0), ("new", 0)], "c string, outcome int")
    p = scoring.predict_cells(test, scoring.smoothed_cells(train, [F.col("c")], ["cell"], 10.0), scoring.constant_probabilities(train), [F.col("c")], ["cell"])
    got = {r.c: (r.p0, r.p1, r.p2) for r in p.collect()}
    overall = (3 / 7, 2 / 7, 2 / 7)
    assert got["new"] == pytest.approx(overall)
    assert got["x"] == pytest.approx([(n + 10 * q) / 14 for n, q in zip((2, 1, 1), overall)])
    assert scoring.bad_probabilities(p).count() == 0


def test_rank_metrics(spark):
    rows = spark.createDataFrame([(0.1, 0), (0.4, 0), (0.35, 1), (0.8, 1), (0.4, 1)], "p double, y int")
    m = one(scoring.rank_metrics(rows, F.col("y") == 1, F.col("p")))
    assert m.auc == pytest.approx(4.5 / 6)  # ties count a half
    assert m.average_precision == pytest.approx((1 * 1 + 1 * 2 / 3 + 1 * 3 / 4) / 3)
    alone = one(scoring.rank_metrics(rows.where("y = 0"), F.col("y") == 1, F.col("p")))
    assert alone.auc is None and alone.average_precision is None


def test_calibration_bins_are_by_rank(spark):
    rows = spark.createDataFrame([(i / 100, int(i >= 6), i) for i in range(12)], "p double, y int, k int")
    bins = {r.bin: r.n for r in scoring.calibration(rows, F.col("y") == 1, F.col("p"), ["k"]).collect()}
    assert bins == {1: 2, 2: 1, 3: 1, 4: 1, 5: 1, 6: 1, 7: 1, 8: 1, 9: 1, 10: 2}


def test_calibration_ranks_of_many_rows(spark):
    """So many rows that a range exchange samples them: ranks must be those of one order, wherever a plan reads the rows again."""
    n = 300_000
    p = F.pmod(F.xxhash64("id"), F.lit(5000)) / 5000.0
    rows = spark.range(0, n, 1, 8).select("id", p.alias("p"), (F.col("id") % 3 == 0).alias("y"))
    got = {r.bin: (r.n, r.predicted, r.observed) for r in scoring.calibration(rows, F.col("y"), F.col("p"), ["id"]).collect()}
    ranked = sorted((r.p, r.id, r.y) for r in rows.collect())
    bins = {}
    for k, row in enumerate(ranked):
        bins.setdefault(max(1, -(-10 * k // (n - 1))), []).append(row)
    assert got == {b: (len(x), pytest.approx(sum(r[0] for r in x) / len(x)), pytest.approx(sum(r[2] for r in x) / len(x))) for b, x in bins.items()}



def test_bootstrap_holds_the_mean(spark):
    rows = spark.range(2000).select((F.col("id") % 100).alias("k"), (F.col("id") % 5 == 0).cast("double").alias("y"))
    r = one(scoring.cluster_bootstrap(rows, ["k"], {"y": F.col("y")}))
    assert r.lower <= 0.2 <= r.upper and r.upper - r.lower < 0.3


def test_segments(spark):
    names = "deal_id string, loan_id string, begin_balance_cents long, outcome int, credit_score double, age_months int, remaining_months int, disclosure_lag_months int, delinquency_days int, interest_rate_pct double, m_p1 double, m_p2 double"
    test = spark.createDataFrame([("D", "a", 100, 1, 600.0, 5, 30, 2, 0, 7.0, 0.8, 0.1), ("D", "b", 300, 0, None, 5, 30, 2, 0, 7.0, 0.2, 0.1)], names)
    s = {(r.feature, r.band_id): r for r in scoring.segment_stability(test, test, ["m"]).collect()}
    r = s["credit_score", 0]
    assert (r.test_rows, r.beginning_exposure_cents, r.m_gap_1, r.m_brier_1) == (1, 100, pytest.approx(-0.2), pytest.approx(0.04))
    assert s["credit_score", -1].test_loans == 1 and s["age_months", 0].composition_change_percentage_points == 0


def test_recovery_cohort(spark):
    rows = [loan_month("a", m, chargeoff_cents=1000 if m == 1 else 0, recovery_cents=100 if m in (3, 5) else 0) for m in range(1, 15)]
    rows += [loan_month("b", m, chargeoff_cents=1000 if m == 1 else 0) for m in (1, 2, 14)]
    first, flows = recovery.seasoned_defaults(panel.derive_events(frame(spark, rows)), 12)
    assert [r.loan_id for r in first.collect()] == ["a"]
    curve = recovery.recovery_curve(flows, 12)
    assert [r.cumulative_cents for r in curve.orderBy("lag").collect()] == [0, 0, 100, 100] + [200] * 9
    assert one(recovery.median_lag(curve, 12)).median_lag == 2


# ---- run-off, scenarios, value


def test_level_run_off(spark):
    cohorts = spark.createDataFrame([(1200, 12, 0.0, 1.0)], "balance_cents long, remaining_months int, apr double, default_hazard_multiplier double")
    table = scenarios.assumptions(spark, annual_default=0.0, annual_prepay=0.0, recovery_rate=0.5, recovery_lag=2, interest_factor=1.0, previous_distribution="2025-08-15", scenarios=(("s", 1, 1, 1, 0, 1),))
    rows = runoff.project(cohorts, table, horizon=24).orderBy("month").collect()
    assert [r.scheduled_principal_cents for r in rows] == [100] * 12 and rows[-1].pool_end_cents == 0
    with pytest.raises(Exception):
        runoff.project(cohorts, table, horizon=5).collect()


def test_recoveries_come_late(spark):
    cohorts = spark.createDataFrame([(100_000, 1, 0.0, 1.0)], "balance_cents long, remaining_months int, apr double, default_hazard_multiplier double")
    table = scenarios.assumptions(spark, annual_default=0.5, annual_prepay=0.0, recovery_rate=0.5, recovery_lag=2, interest_factor=1.0, previous_distribution="2025-08-15", scenarios=(("s", 1, 1, 1, 0, 1),))
    rows = runoff.project(cohorts, table, horizon=12).orderBy("month").collect()
    assert len(rows) == 3 and rows[2].recovery_cents == (rows[0].default_cents + 1) // 2 and rows[0].recovery_cents == 0


def test_cohorts(spark):
    active = spark.createDataFrame([(100, 10, 6.0, False), (200, None, None, False), (50, 0, 6.04, True), (70, 30, 8.0, False)], "end_balance_cents long, remaining_months int, interest_rate_pct double, previously_defaulted boolean")
    got = sorted(tuple(r) for r in runoff.make_cohorts(active, 420).collect())
    assert got == [(50, 1, 0.06, 2.0), (70, 30, 0.08, 1.0), (100, 10, 0.06, 1.0), (200, 20, 0.06, 1.0)]
    with pytest.raises(Exception):
        runoff.make_cohorts(active, 421).collect()


def test_scenarios_to_value(spark):
    cohorts = spark.createDataFrame([(100_000, 6, 0.06, 1.0)], "balance_cents long, remaining_months int, apr double, default_hazard_multiplier double")
    table = scenarios.assumptions(spark, annual_default=0.1, annual_prepay=0.1, recovery_rate=0.3, recovery_lag=1, interest_factor=1.0, previous_distribution="2025-08-15", scenarios=scenarios.SCENARIOS)
    terms = waterfall.Terms(initial_pool=100_000, reserve_floor=100, oc_rate="0", coupons=dict.fromkeys([n for n in waterfall.NOTES if n != "A2b"], "0.05"))
    opening = waterfall.State(100_000, waterfall.nothing() | {"A1": 80_000, "D": 15_000}, 500, "2025-08-15")
    pool, notes, summary = scenarios.run(cohorts, table, opening, terms)
    assert valuation.roll_checks(notes).where("residual_cents != 0").count() == 0
    s = {(r.scenario, r.note): r for r in summary.collect()}
    assert s["Central", "A1"].wal_years > 0 and s["Central", "A1"].closing_cents == 0 and s["Central", "B"].price_per_100 is None
    assert s["Severe", "D"].pv_cents < s["Central", "D"].pv_cents
    assert waterfall.month_flows(pool.withColumn("floating_rate", F.lit("0.05")), opening, terms).where("size(ledger) = 0").count() == 0
    grid = scenarios.assumptions(spark, annual_default=0.1, annual_prepay=0.1, recovery_rate=0.3, recovery_lag=1, interest_factor=1.0, previous_distribution="2025-08-15", scenarios=scenarios.stress_grid((1, 3, 30)))
    assert one(scenarios.reverse_stress(cohorts, grid, opening, "D", terms)).breaches >= 1


def test_first_breach_looks_at_the_whole_grid(spark):
    grid = spark.createDataFrame([(0, 0), (1, 5), (2, 0)], "severity int, loss_cents int")
    assert tuple(one(waterfall.first_breach(grid))) == (1, 0, 1)
    assert tuple(one(waterfall.first_breach(grid.where("severity > 0")))) == (1, None, 1)


def test_rate_reset_and_errors(spark):
    fixings = spark.createDataFrame([(dt.date(2025, 1, d), float(d)) for d in (2, 5, 9)], "d date, r double")
    periods = spark.createDataFrame([(dt.date(2025, 1, 9),), (dt.date(2025, 1, 10),), (dt.date(2025, 1, 3),)], "s date")
    got = {r.s.day: r.fixing_rate for r in valuation.rate_in_force(periods, fixings, "s", "d", "r").collect()}
    assert got == {9: 2.0, 10: 5.0, 3: None}
    errors = spark.createDataFrame([("q", "baseline", -4), ("q", "baseline", 2), ("q", "model", 1)], "quantity string, method string, error int")
    assert one(valuation.error_table(errors, ["quantity"], "method", "error", "baseline", "model")).improvement_pct == pytest.approx(200 / 3)


def test_model_learns_and_guards(spark):
    rows = spark.range(1200).select(
        *[F.lit(1.0).alias(c) for c in models.FEATURES if c not in ("credit_score", "log_balance")], F.when(F.col("id") % 7 == 0, F.lit(None)).otherwise(F.col("id") % 10).cast("double").alias("credit_score"),
        (F.col("id") % 3).cast("double").alias("log_balance"), F.when(F.col("id") % 10 > 7, 1).when(F.col("id") % 3 == 2, 2).otherwise(0).alias("outcome"), F.lit(dt.date(2025, 1, 31)).alias("period_end"),
    )
    model = models.fit(rows, rows)
    p = model.predict(rows)
    assert scoring.bad_probabilities(p).count() == 0
    assert one(scoring.rank_metrics(p, F.col("outcome") == 1, F.col("p1"))).auc > 0.8
    with pytest.raises(ValueError):
        models.fit(rows.limit(50))


# ---- sources

TAPE = """<assetData xmlns="http://www.sec.gov/edgar/document/absee/autoloan/assetdata">
<assets><assetNumber>L1</assetNumber><reportingPeriodBeginningDate>08-01-2025</reportingPeriodBeginningDate><reportingPeriodEndingDate>08-31-2025</reportingPeriodEndingDate>
<originalLoanAmount>10000.00</originalLoanAmount><reportingPeriodBeginningLoanBalanceAmount>100.00</reportingPeriodBeginningLoanBalanceAmount><reportingPeriodActualEndBalanceAmount>-0.41</reportingPeriodActualEndBalanceAmount>
<actualPrincipalCollectedAmount>-3.25</actualPrincipalCollectedAmount><actualInterestCollectedAmount>0</actualInterestCollectedAmount><vehicleValueAmount>8000</vehicleValueAmount>
<originationDate>01/2025</originationDate><obligorCreditScore>NONE</obligorCreditScore><reportingPeriodInterestRatePercentage>0.0814</reportingPeriodInterestRatePercentage>
<zeroBalanceCode>1</zeroBalanceCode><zeroBalanceCode>4</zeroBalanceCode><repossessedIndicator>true</repossessedIndicator>%s</assets></assetData>"""


def tape(spark, tmp_path, extra=""):
    (tmp_path / "tape.xml").write_text(TAPE % extra)
    raw = tapes.scan(spark, str(tmp_path / "tape.xml"))
    return raw.withColumns({"deal_id": F.lit("D"), "accession": F.lit("x"), "acceptance_time": F.lit("2025-09-15T10:00:00Z"), "report_period": F.lit("2025-08-31")})


def test_tape_is_normalized(spark, tmp_path):
    r = one(tapes.normalize(tape(spark, tmp_path)))
    assert (r.end_balance_cents, r.principal_paid_cents, r.interest_paid_cents, r.recovery_cents, r.credit_score) == (-41, -325, 0, None, None)
    assert (r.zero_balance_code, r.status_code, r.age_months, r.origination_month, r.orig_ltv_pct, r.repossessed, r.modified) == ("1|4", "1|4", 7, "2025-01", 125.0, 1, None)
    assert r.interest_rate_pct == pytest.approx(8.14)
    assert tapes.wrong_roots(spark, str(tmp_path / "tape.xml")).count() == 0
    (tmp_path / "other.xml").write_text("<assetData xmlns='urn:x'><assets/></assetData>")
    assert tapes.wrong_roots(spark, str(tmp_path / "other.xml")).count() == 1


@pytest.mark.parametrize("extra", ["<assetNumber>L2</assetNumber>", "<recoveredAmount>0.001</recoveredAmount>", "<originalLoanTerm>1.5</originalLoanTerm>"])
def test_tape_rejects(spark, tmp_path, extra):
    with pytest.raises(Exception):
        tapes.normalize(tape(spark, tmp_path, extra)).collect()


def test_ingest_is_idempotent(spark, tmp_path):
    sources = spark.createDataFrame([("a", "h1"), ("b", "h2")], "accession string, sha256 string")
    assert [r.accession for r in tapes.new_sources(sources, sources.where("accession = 'a'")).collect()] == ["b"]
    with pytest.raises(Exception):
        tapes.new_sources(sources, spark.createDataFrame([("a", "other")], "accession string, sha256 string")).collect()


def test_certificate_rows(spark):
    cells = [["Pool"], ["1.", "Pool begin", "$", "1,000.00"], ["8.", "Notes"], ["", "a. A1", "$", "5.00", "$", "4.00"], ["a. again", "$", "9.00"], ["45.", "x"], ["a. A1 interest", "$", "—"]]
    html = "<table>" + "".join("<tr>" + "".join(f"<td> {c} </td>" for c in row) + "</tr>" for row in cells) + "</table>"
    rows = documents.html_rows(spark.createDataFrame([(1, html)], "id int, html string"), ["id"], "html")
    assert rows.count() == 7
    got = {r.row_key: r.money_cents for r in documents.numbered_rows(rows, ["id"]).collect()}
    assert got == {"1": [100000], "8": [], "8a": [500, 400], "45": [], "45a": [None]}


def test_certificate_amounts_use_the_total_where_interest_is_missing(spark):
    keys = {k: [100] for k in {*documents.SIMPLE_ROWS.values(), *documents.INTEREST_ROWS, *sum(documents.SUMMED_ROWS.values(), ())}} | {"8i": [900, 100], "45q": [2000], "45b": [None]}
    rows = spark.createDataFrame([(1, k, "", v) for k, v in keys.items()], "id int, row_key string, label string, money_cents array<bigint>")
    r = one(documents.certificate_amounts(rows, ["id"]))
    assert (r.amounts["total_note_interest"], r.amounts["note_end"], r.amounts["trustee_fee"], r.missing_interest) == (1200, 100, 400, ["45b"])
    assert set(r.amounts) == reconcile.known_fields()


def test_text_helpers(spark):
    assert value(spark, documents.plain_text(F.lit("<p>a&amp;b</p>\n<b>c</b>"))) == "a&b c"
    day = documents.document_date(F.lit("https://x/dex991091525.htm"), F.lit("2025-09-14").cast("date"))
    assert value(spark, day) == dt.date(2025, 9, 15)
    hits = documents.keyword_hits(spark.createDataFrame([(1, "xx key yy key")], "id int, t string"), ["id"], "t", "key")
    assert [(r.hit_no, r.before, r.after) for r in hits.orderBy("hit_no").collect()] == [(0, "xx ", " yy "), (1, " yy ", "")]


def test_manifests_first_wins(spark, tmp_path):
    for name, rows in (("m1", [{"url": "u", "deal_id": "D", "report_period": "2025-08-31", "acceptance_time": "1"}]), ("m2", [{"url": "u", "deal_id": "E", "report_period": "2025-08-31", "acceptance_time": "0"}, {"url": "v", "deal_id": "A", "report_period": "2025-08-31", "acceptance_time": "2"}])):
        (tmp_path / f"{name}.json").write_text(json.dumps({"sources": rows}))
    got = documents.manifest_sources(spark, [str(tmp_path / "m1.json"), str(tmp_path / "m2.json")])
    assert [(r.url, r.deal_id) for r in got.collect()] == [("v", "A"), ("u", "D")]


def test_archive_hashes(spark, tmp_path):
    import gzip
    import hashlib

    (tmp_path / "a.gz").write_bytes(gzip.compress(b"abc") + gzip.compress(b"def"))
    r = one(documents.archive_hashes(spark, str(tmp_path / "a.gz")))
    assert (r.original_bytes, r.original_sha256) == (6, hashlib.sha256(b"abcdef").hexdigest())


def test_stream_ingest_adds_once(spark, tmp_path):
    from quillstone.streaming import ingest

    df = spark.createDataFrame([("x", 1), ("x", 2)], "accession string, v int")
    for turn in range(2):  # the same filing arrives twice
        df.write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), df.schema, str(tmp_path / "out"), str(tmp_path / "check")).awaitTermination()
    assert spark.read.parquet(str(tmp_path / "out")).count() == 2


# ---- what the second review found wrong


def test_all_entities_come_back(spark):
    for html, text in (("it&#8217;s caf&eacute; &mdash; ok", "it’s café — ok"), ("<td>a&nbsp;&nbsp;b</td>", "a b"), ("a &amp;lt; b", "a &lt; b"), ("&#x41;<br/>&euro;5", "A €5"), ("plain", "plain")):
        assert value(spark, documents.plain_text(F.lit(html))) == text
    assert value(spark, documents.plain_text(F.lit(None).cast("string"))) is None


def test_keyword_places_are_offsets(spark):
    text = "aa KEY bb keyy cc KEY"
    hits = documents.keyword_hits(spark.createDataFrame([(1, text), (2, None), (3, "none")], "id int, t string"), ["id"], "t", "(?i)key+")
    import re

    assert [(r.start, r.match) for r in hits.orderBy("hit_no").collect()] == [(m.start(), m.group()) for m in re.finditer("(?i)key+", text)]


def test_every_amendment_stays(spark, tmp_path):
    rows = lambda accession, n: spark.createDataFrame([("D", dt.date(2025, 8, 31), accession, f"L{i}") for i in range(n)], "deal_id string, period_end date, accession string, loan_id string")
    for accession, n in (("a1", 2), ("a2", 3), ("a2", 4)):
        tapes.write_panel(rows(accession, n), F.lit(True), str(tmp_path))
    tapes.write_panel(rows("first", 5), F.lit(False), str(tmp_path))
    tapes.write_panel(rows("first", 6), F.lit(False), str(tmp_path))
    stored = spark.read.parquet(str(tmp_path / "loan_amendment"))
    assert {r.accession: r["count"] for r in stored.groupBy("accession").count().collect()} == {"a1": 2, "a2": 4}
    assert spark.read.parquet(str(tmp_path / "loan_month")).count() == 6


def test_files_are_checked_as_they_are_loaded(spark, tmp_path):
    path = tmp_path / "tape.xml"
    path.write_text(TAPE % "")
    assert tapes.load(spark, str(path)).count() == 1
    record = (TAPE % "").partition("\n")[2].removesuffix("</assetData>")
    for text in (TAPE % "<newElement>1</newElement><newElement>2</newElement>", (TAPE % "").replace("</assetData>", record + "</assetData>"), (TAPE % "").replace("autoloan", "other")):
        path.write_text(text)
        spark.catalog.clearCache()
        with pytest.raises(ValueError):
            tapes.load(spark, str(path))


def test_unknown_rates_are_the_median_of_known_ones(spark):
    fleet = spark.createDataFrame([(120_000, 6.0), (120_000, 12.0), (240_000, None), (-5, 99.0)], "begin_balance_cents long, interest_rate_pct double")
    # 600 and 1,200 of the known ones, and 2,400 at their median, 12.
    share = one(fleet.agg(scenarios.interest_factor(fleet, F.lit(2_100)).alias("x"))).x
    assert share == pytest.approx(2_100 / 4_200)
    assert one(fleet.where("interest_rate_pct IS NOT NULL").agg(scenarios.interest_factor(fleet, F.lit(9_999)).alias("x"))).x == 1.0
