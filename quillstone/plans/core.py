"""Registered queries that call the panel's, run-off's, waterfall's and audit's operators themselves, each with its SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.money import dollars, double_cents, half_up, parse_cents
from ..functions.calendar import add_months_on, distribution_dates, is_full_month, months_between
from ..operators import audit, features, models, panel, recovery, runoff, scoring, valuation, waterfall
from ..sources import documents as document_sources
from ..sources import tapes
from . import queries as base
from . import scenarios, validation
from .queries import table

_r = base._r


def _events(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.derive_events(base._panel(spark, sf_dir))


def _fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A dense panel: sixty loans that report in nearly every month."""
    return panel.derive_events(base._panel(spark, sf_dir, F.col("o_custkey") % 60))


_FLEET = base._PANEL.replace("SELECT o_custkey, CAST(date_trunc", "SELECT o_custkey % 60 AS o_custkey, CAST(date_trunc", 1)

# ---- scoring on disclosed features -------------------------------------------

_CUT = "1998-01-01"


def _split(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    rows = features.disclosure_features(_events(spark, sf_dir))
    return rows.where(F.col("period_end") < F.lit(_CUT).cast("date")), rows.where(F.col("period_end") >= F.lit(_CUT).cast("date"))


def _band_sql(name: str, edges) -> str:
    return f"CASE WHEN {name} IS NULL THEN -1 " + " ".join(f"WHEN {name} <= {e} THEN {i}" for i, e in enumerate(edges)) + f" ELSE {len(edges)} END"


_BUCKET = "CASE WHEN coalesce(delinquency_days, -1) <= -0.5 THEN 0 WHEN delinquency_days <= 0 THEN 1 WHEN delinquency_days <= 30 THEN 2 WHEN delinquency_days <= 60 THEN 3 WHEN delinquency_days <= 90 THEN 4 ELSE 5 END"
_CELL = ", ".join(f"{_band_sql(name, scoring.SEGMENT_EDGES[name])}" for name in scoring.COHORT_FEATURES)
_SPLIT = f"""r AS ({base.DISCLOSURE_ROWS}),
  k AS (SELECT *, [{_CELL}] AS cell, [{_BUCKET}] AS bucket FROM r),
  tr AS (SELECT * FROM k WHERE period_end < DATE '{_CUT}'), te AS (SELECT * FROM k WHERE period_end >= DATE '{_CUT}'),
  q AS (SELECT (count(*) FILTER (outcome = 0) + 1) / (count(*) + 3e0) AS q0, (count(*) FILTER (outcome = 1) + 1) / (count(*) + 3e0) AS q1, (count(*) FILTER (outcome = 2) + 1) / (count(*) + 3e0) AS q2 FROM tr)"""


def _predicted_sql(key: str) -> str:
    cells = ", ".join(f"(count(*) FILTER (outcome = {c}) + 100e0 * any_value(q{c})) / (count(*) + 100e0) AS c{c}" for c in range(3))
    return f"""c AS (SELECT {key}, {cells} FROM tr, q GROUP BY 1), p AS (SELECT te.*, coalesce(c0, q0) AS p0, coalesce(c1, q1) AS p1, coalesce(c2, q2) AS p2 FROM te CROSS JOIN q LEFT JOIN c ON c.{key} = te.{key})"""


def _probabilities(rows: DataFrame) -> DataFrame:
    return rows.select("deal_id", "loan_id", "period_end", "outcome", *[_r(f"p{c}").alias(f"p{c}") for c in range(3)])


_P_COLUMNS = "deal_id, loan_id, period_end, outcome, round(p0, 9) AS p0, round(p1, 9) AS p1, round(p2, 9) AS p2"


def cohort_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(scoring.cohort_predictions(*_split(spark, sf_dir)))


COHORT_PREDICTIONS = f"WITH {_SPLIT}, {_predicted_sql('cell')} SELECT {_P_COLUMNS} FROM p"


def transition_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _probabilities(scoring.transition_predictions(*_split(spark, sf_dir)))


TRANSITION_PREDICTIONS = f"WITH {_SPLIT}, {_predicted_sql('bucket')} SELECT {_P_COLUMNS} FROM p"


def _segments(spark: SparkSession, sf_dir: str) -> DataFrame:
    train, test = _split(spark, sf_dir)
    scored = scoring.cohort_predictions(train, test).withColumnsRenamed({"p1": "cohort_p1", "p2": "cohort_p2"})
    return scoring.segment_stability(train, scored, ["cohort"])


def segment_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir)
    return s.select(*[_r(F.col(name)).alias(name) if kind == "double" else F.col(name) for name, kind in s.dtypes])


def _bands_of(side: str) -> str:
    return " UNION ALL ".join(f"SELECT '{name}' AS feature, {_band_sql(name, edges)} AS band_id, * FROM {side}" for name, edges in scoring.SEGMENT_EDGES.items())


def _cause(c: int) -> str:
    y = f"CAST(outcome = {c} AS INT)"
    return f"avg(p{c}) AS cohort_predicted_{c}, avg(p{c}) - avg({y}) AS cohort_gap_{c}, avg((p{c} - {y}) * (p{c} - {y})) AS cohort_brier_{c}"


_SEGMENTS = f"""{_SPLIT}, {_predicted_sql('cell')}, u AS ({_bands_of('p')}), v AS ({_bands_of('tr')}),
  a AS (SELECT feature, band_id, count(*) AS test_rows, count(DISTINCT (deal_id, loan_id)) AS test_loans, CAST(sum(begin_balance_cents) AS BIGINT) AS beginning_exposure_cents,
        count(*) FILTER (outcome = 1) AS events_1, count(*) FILTER (outcome = 2) AS events_2, {_cause(1)}, {_cause(2)} FROM u GROUP BY 1, 2),
  d AS (SELECT feature, band_id, count(*) AS n, avg(CAST(outcome = 1 AS INT)) AS r1, avg(CAST(outcome = 2 AS INT)) AS r2 FROM v GROUP BY 1, 2),
  j AS (SELECT a.*, coalesce(n, 0) AS development_rows, r1 AS development_rate_1, r2 AS development_rate_2, test_rows / CAST(sum(test_rows) OVER (PARTITION BY feature) AS DOUBLE) AS test_share,
        coalesce(n, 0) / CAST(sum(coalesce(n, 0)) OVER (PARTITION BY feature) AS DOUBLE) AS development_share FROM a LEFT JOIN d USING (feature, band_id)),
  g AS (SELECT *, (test_share - development_share) * 100 AS composition_change_percentage_points FROM j)"""
_SEGMENT_DOUBLES = [f"cohort_{m}_{c}" for c in (1, 2) for m in ("predicted", "gap", "brier")] + ["development_rate_1", "development_rate_2", "test_share", "development_share", "composition_change_percentage_points"]
SEGMENT_STABILITY = f"""
WITH {_SEGMENTS}
SELECT feature, CAST(band_id AS INT) AS band_id, test_rows, test_loans, beginning_exposure_cents, events_1, events_2, development_rows, {', '.join(f'round({c}, 9) AS {c}' for c in _SEGMENT_DOUBLES)} FROM g
"""


def widest_gaps(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = _segments(spark, sf_dir).withColumn("cohort_gap_1", _r("cohort_gap_1"))
    return audit.widest(s, ["feature"], "cohort_gap_1", "band_id")


WIDEST_GAPS = f"""
WITH {_SEGMENTS}, w AS (SELECT *, row_number() OVER (PARTITION BY feature ORDER BY abs(round(cohort_gap_1, 9)) DESC, band_id) AS k FROM g)
SELECT feature, CAST(band_id AS INT) AS band_id, round(cohort_gap_1, 9) AS cohort_gap_1 FROM w WHERE k = 1
"""

_WINDOWS = (("1997-06-01", "1997-12-31"), ("1998-06-01", "1998-12-31"), ("1999-06-01", "1999-12-31"), ("2000-06-01", "2000-12-31"))


def expanding_folds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three baselines over four windows, each fitted on what was public before its window."""
    s = validation.score_folds(features.disclosure_features(_events(spark, sf_dir)), _WINDOWS)
    return s.withColumns({c: _r(c) for c in ("observed_rate", "predicted_rate", "brier", "log_loss")})


def _fold_cells(key: str, method: str) -> str:
    cells = ", ".join(f"(count(*) FILTER (outcome = {c}) + 100e0 * any_value(q{c})) / (count(*) + 100e0) AS c{c}" for c in range(3))
    return f"""c_{method} AS (SELECT tr.fold, {key}, {cells} FROM tr JOIN q ON q.fold = tr.fold GROUP BY 1, 2),
  p_{method} AS (SELECT te.fold, '{method}' AS method, outcome, coalesce(c0, q0) AS a0, coalesce(c1, q1) AS a1, coalesce(c2, q2) AS a2 FROM te JOIN q ON q.fold = te.fold LEFT JOIN c_{method} c ON c.fold = te.fold AND c.{key} = te.{key})"""


EXPANDING_FOLDS = f"""
WITH r AS ({base.DISCLOSURE_ROWS}), k AS (SELECT *, [{_CELL}] AS cell, [{_BUCKET}] AS bucket FROM r),
  w(fold, a, b) AS (VALUES {', '.join(f"({i}, DATE '{a}', DATE '{b}')" for i, (a, b) in enumerate(_WINDOWS, 1))}),
  tr AS (SELECT fold, k.* FROM k JOIN w ON period_end < a AND label_available_at < a), te AS (SELECT fold, k.* FROM k JOIN w ON period_end BETWEEN a AND b),
  q AS (SELECT fold, (count(*) FILTER (outcome = 0) + 1) / (count(*) + 3e0) AS q0, (count(*) FILTER (outcome = 1) + 1) / (count(*) + 3e0) AS q1, (count(*) FILTER (outcome = 2) + 1) / (count(*) + 3e0) AS q2 FROM tr GROUP BY 1),
  {_fold_cells('bucket', 'transition')}, {_fold_cells('cell', 'cohort')},
  u AS (SELECT * FROM p_transition UNION ALL SELECT * FROM p_cohort UNION ALL SELECT te.fold, 'constant', outcome, q0, q1, q2 FROM te JOIN q ON q.fold = te.fold),
  n AS (SELECT *, CASE outcome WHEN 0 THEN a0 WHEN 1 THEN a1 ELSE a2 END AS own FROM u),
  l AS (SELECT fold, method, own, 1 AS event, CAST(outcome = 1 AS INT) AS y, a1 AS p FROM n UNION ALL SELECT fold, method, own, 2, CAST(outcome = 2 AS INT), a2 FROM n)
SELECT fold, method, event, count(*) AS rows, CAST(sum(y) AS BIGINT) AS events, round(avg(y), 9) AS observed_rate, round(avg(p), 9) AS predicted_rate, round(avg((p - y) * (p - y)), 9) AS brier, round(avg(-ln(own)), 9) AS log_loss FROM l GROUP BY 1, 2, 3
"""

# ---- seasoned defaults, known fleet, audits ------------------------------------


def seasoned_defaults(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.seasoned_defaults(_fleet(spark, sf_dir), 12)[0]


_SEASONED = f"""{_FLEET}, z AS (SELECT deal_id, max(period_end) AS last_end FROM e GROUP BY 1),
  f AS (SELECT deal_id, loan_id, period_end AS default_period, chargeoff_cents AS default_principal_cents FROM e JOIN z USING (deal_id) WHERE first_default_event = 1 AND chargeoff_cents > 0 AND period_end <= last_end - INTERVAL 12 MONTH),
  l AS (SELECT e.deal_id, e.loan_id, e.recovery_cents, (year(e.period_end) - year(f.default_period)) * 12 + month(e.period_end) - month(f.default_period) AS lag FROM e JOIN f USING (deal_id, loan_id)),
  i AS (SELECT * FROM l WHERE lag BETWEEN 0 AND 12), s AS (SELECT deal_id, loan_id FROM i GROUP BY 1, 2 HAVING count(DISTINCT lag) = 13)"""
SEASONED_DEFAULTS = f"WITH {_SEASONED} SELECT deal_id, loan_id, default_period, default_principal_cents FROM f SEMI JOIN s USING (deal_id, loan_id)"


def seasoned_recoveries(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.recovery_curve(recovery.seasoned_defaults(_fleet(spark, sf_dir), 12)[1], 12)


SEASONED_RECOVERIES = f"""
WITH {_SEASONED}, t AS (SELECT CAST(x AS INT) AS lag, CAST(coalesce(sum(recovery_cents), 0) AS BIGINT) AS recovery_cents FROM range(13) g(x) LEFT JOIN (SELECT * FROM i SEMI JOIN s USING (deal_id, loan_id)) y ON y.lag = x GROUP BY 1)
SELECT lag, recovery_cents, CAST(sum(recovery_cents) OVER (ORDER BY lag) AS BIGINT) AS cumulative_cents FROM t
"""
_ORIGIN = "1999-03-10"


def known_fleet(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = scenarios.known_fleet(_fleet(spark, sf_dir), F.lit(_ORIGIN).cast("timestamp"))
    return f.select("deal_id", "loan_id", "period_end", "end_balance_cents", "previously_defaulted")


_KNOWN = f"""{_FLEET}, n AS (SELECT * FROM e WHERE acceptance_time <= TIMESTAMP '{_ORIGIN}' AND CAST(period_end AS TIMESTAMP) < TIMESTAMP '{_ORIGIN}'),
  o2 AS (SELECT *, max(first_default_event) OVER (PARTITION BY deal_id, loan_id ORDER BY period_end) = 1 AS previously_defaulted, max(period_end) OVER (PARTITION BY deal_id) AS newest FROM n)"""
KNOWN_FLEET = f"WITH {_KNOWN} SELECT deal_id, loan_id, period_end, end_balance_cents, previously_defaulted FROM o2 WHERE period_end = newest AND end_balance_cents > 0"


def interest_share(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Reported interest against the balances' rates by deal; every fifth rate is unknown."""
    f = _events(spark, sf_dir).withColumn("interest_rate_pct", F.when(F.col("age_months") % 5 != 0, F.col("interest_rate_pct")))
    return f.groupBy("deal_id").agg(_r(scenarios.interest_factor(f, F.sum("interest_paid_cents") * F.lit(0.5))).alias("interest_share"))


INTEREST_SHARE = f"""
WITH {base._PANEL}, y AS (SELECT deal_id, begin_balance_cents AS b, interest_paid_cents AS i, CASE WHEN age_months % 5 <> 0 THEN interest_rate_pct END AS rate FROM e), m AS (SELECT deal_id, median(rate) AS md FROM y GROUP BY 1)
SELECT deal_id, round(least(1e0, sum(i) * 0.5e0 / (sum(greatest(b, 0) * coalesce(rate, md)) / 100e0 / 12)), 9) AS interest_share FROM y JOIN m USING (deal_id) GROUP BY 1
"""


def default_candidates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five readings of defaults against a reported figure: the charge-offs of loans that the period also closed."""
    f = _events(spark, sf_dir)
    loss = F.coalesce(F.col("chargeoff_cents"), F.lit(0))
    reported = f.groupBy("deal_id", "period_end").agg(F.sum(F.when(F.col("end_balance_cents") == 0, loss).otherwise(0)).alias("reported_cents"))
    return audit.default_candidates(f, reported, F.col("recovery_cents"))


DEFAULT_CANDIDATES = f"""
WITH {base._PANEL},
s AS (SELECT deal_id, period_end, sum(loss) AS a, coalesce(sum(loss) FILTER (first_default_event = 1), 0) AS b, coalesce(sum(begin_balance_cents) FILTER (first_default_event = 1), 0) AS c2,
        coalesce(sum(loss) FILTER (zero_balance_month = month), 0) AS d2, sum(loss + recovery_cents) AS e2, coalesce(sum(loss) FILTER (end_balance_cents = 0), 0) AS r FROM e GROUP BY 1, 2),
u AS (SELECT deal_id, period_end, r, 'all_chargeoffs' AS candidate, a AS o FROM s UNION ALL SELECT deal_id, period_end, r, 'first_default_chargeoffs', b FROM s UNION ALL SELECT deal_id, period_end, r, 'first_default_beginning_principal', c2 FROM s
  UNION ALL SELECT deal_id, period_end, r, 'chargeoffs_effective_in_period', d2 FROM s UNION ALL SELECT deal_id, period_end, r, 'chargeoffs_and_other_adjustments', e2 FROM s)
SELECT deal_id, period_end, candidate, CAST(o AS BIGINT) AS observed_cents, CAST(r AS BIGINT) AS reported_cents, CAST(o - r AS BIGINT) AS residual_cents, CASE WHEN o = r THEN 'NUMERIC_MATCH_ONLY' ELSE 'DOES_NOT_RECONCILE' END AS status FROM u
"""


def recovery_ratio(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.observed_recovery_ratio(_events(spark, sf_dir)).withColumn("recovery_ratio", _r("recovery_ratio"))


RECOVERY_RATIO = f"""
WITH {base._PANEL}, s AS (SELECT deal_id, coalesce(sum(chargeoff_cents), 0) AS d, coalesce(sum(recovery_cents), 0) AS r FROM e GROUP BY 1)
SELECT deal_id, CAST(d AS BIGINT) AS default_cents, CAST(r AS BIGINT) AS recovery_cents, CASE WHEN d <> 0 THEN round(CAST(r AS DOUBLE) / CAST(d AS DOUBLE), 9) ELSE 0.3e0 END AS recovery_ratio FROM s
"""


def loan_moves(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.loan_moves(base._panel(spark, sf_dir))


LOAN_MOVES = f"""
WITH {base._PANEL}, m AS (SELECT *, year(period_end) * 12 + month(period_end) AS n, max(period_end) OVER (PARTITION BY deal_id) AS last_end FROM p),
u AS (
  SELECT a.deal_id, a.period_end, CASE WHEN b.n IS NULL THEN 'ENTER' ELSE 'ROLL' END AS move, a.begin_balance_cents AS cents FROM m a LEFT JOIN m b ON b.deal_id = a.deal_id AND b.loan_id = a.loan_id AND b.n = a.n - 1
  UNION ALL SELECT a.deal_id, a.period_end, 'LEAVE', a.end_balance_cents FROM m a ANTI JOIN m b ON b.deal_id = a.deal_id AND b.loan_id = a.loan_id AND b.n = a.n + 1 WHERE a.period_end < a.last_end)
SELECT deal_id, period_end, move, count(*) AS loans, CAST(sum(cents) AS BIGINT) AS balance_cents FROM u GROUP BY 1, 2, 3
"""
_PROFILED = ["chargeoff_cents", "recovery_cents", "interest_paid_cents"]


def tape_profile(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.tape_profile(base._panel(spark, sf_dir), _PROFILED)


TAPE_PROFILE = f"""
WITH {base._PANEL}
SELECT deal_id, coalesce(zero_balance_code, 'NONE') AS zero_balance_code, count(*) AS rows, count(*) FILTER (begin_balance_cents - principal_paid_cents <> end_balance_cents) AS identity_breaks,
  {', '.join(f'CAST(sum({c}) AS BIGINT) AS {c}_sum, count({c}) AS {c}_present, count(*) FILTER ({c} < 0) AS {c}_negative' for c in _PROFILED)} FROM p GROUP BY 1, 2
"""


def key_alignment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Order keys that orders, late line items and open orders do not all hold exactly once."""
    o, li = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    frames = {"headers": o.select("o_orderkey"), "first_lines": li.where("l_linenumber = 1").select(F.col("l_orderkey").alias("o_orderkey")), "open": o.where("o_orderstatus = 'O'").select("o_orderkey")}
    return audit.misaligned(frames, ["o_orderkey"])


KEY_ALIGNMENT = """
WITH u AS (SELECT o_orderkey, 1 AS a, 0 AS b, CAST(o_orderstatus = 'O' AS INT) AS c FROM orders UNION ALL SELECT l_orderkey, 0, 1, 0 FROM lineitem WHERE l_linenumber = 1)
SELECT o_orderkey, CAST(sum(a) AS BIGINT) AS headers, CAST(sum(b) AS BIGINT) AS first_lines, CAST(sum(c) AS BIGINT) AS open FROM u GROUP BY 1 HAVING NOT (sum(a) = 1 AND sum(b) = 1 AND sum(c) = 1)
"""


def money_texts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Prices as text, to cents and back; a discount of so many cents by exact half-up division."""
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_extendedprice").cast("decimal(15,2)").cast("string").alias("t"), F.round(F.col("l_discount") * 100, 0).cast("int").alias("d"))
    cents = parse_cents(F.col("t"))
    return li.groupBy("l_orderkey", "l_linenumber", "t").agg(F.count("*").alias("n"), F.max("d").alias("d")).select("l_orderkey", "l_linenumber", "n", cents.alias("cents"), dollars(cents).alias("dollars"), half_up(cents * F.col("d"), F.lit(100)).alias("discount_cents"))


MONEY_TEXTS = """
WITH t AS (SELECT l_orderkey, l_linenumber, CAST(l_extendedprice AS DECIMAL(15,2)) AS t, count(*) AS n, max(CAST(round(l_discount * 100e0) AS INT)) AS d FROM lineitem GROUP BY 1, 2, 3)
SELECT l_orderkey, l_linenumber, n, CAST(t * 100 AS BIGINT) AS cents, CAST(t AS VARCHAR) AS dollars, CAST((2 * CAST(t * 100 AS BIGINT) * d + 100) // 200 AS BIGINT) AS discount_cents FROM t
"""


def payment_dates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The payment date that follows each day of orders by two months."""
    days = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct().withColumn("ahead", F.lit(2))
    return distribution_dates(days, "day", "ahead").select("day", "distribution_date")


PAYMENT_DATES = """
WITH y AS (SELECT x AS y FROM range(1994, 2005) t(x)),
f AS (SELECT make_date(y, m, d) AS day FROM y, (VALUES (1, 1), (7, 4), (11, 11), (12, 25)) v(m, d)),
h AS (SELECT CASE isodow(day) WHEN 6 THEN day - 1 WHEN 7 THEN day + 1 ELSE day END AS day FROM f
  UNION SELECT first + CAST((w - isodow(first) + 7) % 7 + 7 * (k - 1) AS INT) FROM (SELECT make_date(y, m, 1) AS first, w, k FROM y, (VALUES (1, 1, 3), (2, 1, 3), (9, 1, 1), (10, 1, 2), (11, 4, 4)) v(m, w, k))
  UNION SELECT last - CAST(isodow(last) - 1 AS INT) FROM (SELECT make_date(y, 5, 31) AS last FROM y)),
d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), b AS (SELECT day, CAST(date_trunc('month', day) + INTERVAL 2 MONTH AS DATE) + 14 AS target FROM d),
c AS (SELECT CAST(x AS DATE) AS open_day FROM range(DATE '1994-01-01', DATE '2004-12-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN (SELECT day FROM h))
SELECT day, min(open_day) AS distribution_date FROM b JOIN c ON open_day BETWEEN target AND target + 10 GROUP BY 1
"""

# ---- run-off, waterfall, value --------------------------------------------------

_YEARLY = {"annual_default": 0.02, "annual_prepay": 0.15, "recovery_rate": 0.4, "recovery_lag": 4, "interest_factor": 0.97}


def pool_projection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Run-off of the line items' cohorts under the three scenarios, recoveries late."""
    cohorts = base.cohort_buckets(spark, sf_dir)
    given = scenarios.assumptions(spark, **_YEARLY, previous_distribution="2025-05-15")
    return runoff.project(cohorts, given).drop("distribution_date")


_SCENARIOS = ", ".join(f"('{n}', {float(d)}e0, {float(p)}e0, {float(r)}e0, {lag}, {float(i)}e0)" for n, d, p, r, lag, i in scenarios.SCENARIOS)
POOL_PROJECTION = f"""
WITH RECURSIVE co AS ({base.COHORT_BUCKETS}),
a AS (SELECT scenario, 1 - pow(1 - 0.02e0, d) AS ad, 1 - pow(1 - 0.15e0, p) AS ap, least(0.4e0 * r, 1) AS rr, 4 + lag AS rl, least(0.97e0 * i, 1) AS f FROM (VALUES {_SCENARIOS}) v(scenario, d, p, r, lag, i)),
h AS (SELECT *, -ln(1 - (1 - pow(1 - ad, default_hazard_multiplier))) / 12 AS hd, -ln(1 - ap) / 12 AS hp FROM co, a),
g AS (SELECT row_number() OVER (ORDER BY scenario, remaining_months, apr, default_hazard_multiplier) AS id, scenario, balance_cents, remaining_months AS term, apr / 12 AS rate, f, (1 - exp(-(hd + hp))) * hd / (hd + hp) AS md, (1 - exp(-(hd + hp))) * hp / (hd + hp) AS mp FROM h),
w(id, month, b, loss, pre, sched, intr, e) AS (
  SELECT id, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), balance_cents FROM g
  UNION ALL
  SELECT id, month, b, loss, pre, sched, CAST(round((b - (loss + pre) / 2e0) * rate * f) AS BIGINT), perf - sched FROM (
    SELECT *, CASE WHEN left_ <= 1 THEN perf WHEN rate > 0 THEN least(perf, greatest(CAST(round(perf * rate / (1 - pow(1 + rate, -left_)) - perf * rate) AS BIGINT), 0)) ELSE least(perf, CAST(round(perf / CAST(left_ AS DOUBLE)) AS BIGINT)) END AS sched FROM (
      SELECT *, b - loss - pre AS perf FROM (
        SELECT *, least(b - loss, CAST(round(b * mp) AS BIGINT)) AS pre FROM (
          SELECT w.id, w.month + 1 AS month, w.e AS b, least(w.e, CAST(round(w.e * md) AS BIGINT)) AS loss, mp, rate, f, greatest(term - w.month, 1) AS left_ FROM w JOIN g ON g.id = w.id WHERE w.e > 0 AND w.month < 180))))),
t AS (SELECT scenario, month, CAST(sum(b) AS BIGINT) AS b, CAST(sum(w.e) AS BIGINT) AS e, CAST(sum(sched) AS BIGINT) AS s, CAST(sum(pre) AS BIGINT) AS p, CAST(sum(loss) AS BIGINT) AS d, CAST(sum(intr) AS BIGINT) AS i FROM w JOIN g ON g.id = w.id WHERE month > 0 GROUP BY 1, 2),
x AS (SELECT a.scenario, CAST(m AS INT) AS month, coalesce(t.b, 0) AS b, coalesce(t.e, 0) AS e, coalesce(t.s, 0) AS s, coalesce(t.p, 0) AS p, coalesce(t.d, 0) AS d, coalesce(t.i, 0) AS i, coalesce(CAST(round(l.d * a.rr) AS BIGINT), 0) AS r
      FROM a CROSS JOIN range(1, 181) q(m) LEFT JOIN t ON t.scenario = a.scenario AND t.month = m LEFT JOIN t l ON l.scenario = a.scenario AND l.month = m - a.rl),
z AS (SELECT scenario, max(month) AS last_month FROM x WHERE b > 0 OR r > 0 GROUP BY 1)
SELECT scenario, month, b AS pool_begin_cents, e AS pool_end_cents, s AS scheduled_principal_cents, p AS prepayment_cents, d AS default_cents, r AS recovery_cents, i AS interest_cents, s + p + i + r AS available_cash_cents, d - r AS net_loss_cents
FROM x JOIN z USING (scenario) WHERE month <= last_month
"""

_POOL, _MONTHS = 100_000_000_000, 80
_OPEN = {"A3": 80_000_000_000, "B": 6_000_000_000, "C": 6_000_000_000, "D": 7_000_000_000}
_TERMS = waterfall.Terms(initial_pool=_POOL, reserve_floor=250_000_000, final_dates=dict.fromkeys(waterfall.NOTES, "2033-01-15") | {"D": "2031-10-15"})
_STATE = waterfall.State(_POOL, waterfall.nothing() | _OPEN, 250_000_000, "2025-05-15")


def _pool_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five pools of one size that shrink as the orders of a priority did, month by month; the priority's digit is the severity."""
    o = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("scenario"), ((F.year("o_orderdate") - 1995) * 12 + F.month("o_orderdate")).alias("month")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("cents"))
    grid = o.select("scenario").distinct().select("scenario", F.explode(F.sequence(F.lit(1), F.lit(_MONTHS))).alias("month"))
    f = grid.join(o, ["scenario", "month"], "left").fillna(0, ["cents"])
    one = Window.partitionBy("scenario")
    f = f.withColumns({"cum": F.sum("cents").over(one.orderBy("month").rowsBetween(Window.unboundedPreceding, 0)), "total": F.sum("cents").over(one)})
    gone = lambda c: F.expr(f"CAST(CAST({_POOL} AS DECIMAL(12,0)) * CAST({c} AS DECIMAL(20,0)) div CAST(total AS DECIMAL(20,0)) AS BIGINT)")
    f = f.withColumns({"pool_begin_cents": F.lit(_POOL) - gone("(cum - cents)"), "pool_end_cents": F.lit(_POOL) - gone("cum")})
    f = f.withColumn("default_cents", F.expr("(pool_begin_cents - pool_end_cents) * CAST(scenario AS BIGINT) * 4 div 100"))
    f = f.withColumns({"prepayment_cents": F.lit(0).cast("bigint"), "scheduled_principal_cents": F.col("pool_begin_cents") - F.col("pool_end_cents") - F.col("default_cents")})
    return f.withColumns({
        "interest_cents": F.expr("pool_begin_cents * 9 div 1200"), "recovery_cents": F.expr("default_cents * 3 div 10"),
        "distribution_date": F.add_months(F.lit("2025-05-15").cast("date"), F.col("month")), "floating_rate": F.lit("0.05"),
    }).drop("cents", "cum", "total")


def _note_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfall.note_flows(_pool_flows(spark, sf_dir), _STATE, _TERMS).where(F.col("note").isin(*_OPEN))


def note_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    return _note_flows(spark, sf_dir)


# The months of ordinary payments by whole-cent SQL: four notes in turn, their tiers, the reserve. Interest is never short before the last month.
_WATERFALL = f"""mo AS (SELECT substr(o_orderpriority, 1, 1) AS scenario, (year(o_orderdate) - 1995) * 12 + month(o_orderdate) AS month, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS cents FROM orders GROUP BY 1, 2),
gr AS (SELECT s.scenario, CAST(m AS INT) AS month, coalesce(cents, 0) AS cents FROM (SELECT DISTINCT scenario FROM mo) s CROSS JOIN range(1, {_MONTHS} + 1) q(m) LEFT JOIN mo ON mo.scenario = s.scenario AND mo.month = m),
cu AS (SELECT *, CAST(sum(cents) OVER (PARTITION BY scenario ORDER BY month) AS HUGEINT) AS cum, CAST(sum(cents) OVER (PARTITION BY scenario) AS HUGEINT) AS total FROM gr),
pl AS (SELECT scenario, month, CAST({_POOL} - {_POOL} * (cum - cents) // total AS BIGINT) AS pb, CAST({_POOL} - {_POOL} * cum // total AS BIGINT) AS pe FROM cu),
df AS (SELECT *, (pb - pe) * CAST(scenario AS BIGINT) * 4 // 100 AS dflt FROM pl),
fl AS (SELECT scenario, month, pb, pe, pb - pe - dflt + pb * 9 // 1200 + dflt * 3 // 10 AS coll, (2 * pb + 1200) // 2400 AS svc FROM df),
wf(scenario, month, b1, b2, b3, b4, d1, d2, d3, d4, i1, i2, i3, i4, n1, n2, n3, n4, res, coll, paid_svc, draw, deposit, release, residual, sweep) AS (
  SELECT scenario, 0, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT,
         {', '.join(f'{v}::BIGINT' for v in _OPEN.values())}, 250000000::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, 0::BIGINT, false FROM (SELECT DISTINCT scenario FROM fl)
  UNION ALL
  SELECT scenario, month, b1, b2, b3, b4, d1, d2, d3, d4, i1, i2, i3, i4, n1, n2, n3, n4, rs2 - rel, coll, psvc, dr, dep, rel, resid, sweep FROM (
   SELECT *, CASE WHEN n1 + n2 + n3 + n4 = 0 THEN rs2 ELSE greatest(rs2 - flo, 0) END AS rel FROM (
    SELECT *, b1 - q1 AS n1, b2 - q2 AS n2, b3 - q3 AS n3, b4 - (pt - q1 - q2 - q3) AS n4, rs1 - x2 + dleft - greatest(x1 - cleft, 0) AS rs2, greatest(cleft - x1, 0) AS resid FROM (
     SELECT *, least(b1, pt) AS q1, least(b2, greatest(pt - b1, 0)) AS q2, least(b3, greatest(pt - b1 - b2, 0)) AS q3 FROM (
      SELECT *, tp + x1 + x2 AS pt FROM (
       SELECT *, least(reg - x1, greatest(rs1 - flo, 0)) AS x2 FROM (
        SELECT *, least(reg, cleft + dleft) AS x1, opening - dr + dep AS rs1 FROM (
         SELECT *, cl0 - dep AS cleft FROM (
          SELECT *, least(greatest(flo - opening + dr, 0), cl0) AS dep FROM (
           SELECT *, greatest(coll - psvc - used, 0) AS cl0, dr - greatest(used - (coll - psvc), 0) AS dleft, p1 + p2 + p3 + p4 AS tp FROM (
            SELECT *, i1 + p1 + i2 + p2 + i3 + p3 + i4 + p4 AS used FROM (
             SELECT *, least(t4, m - i1 - p1 - i2 - p2 - i3 - p3 - i4) AS p4 FROM (
              SELECT *, least(d4, m - i1 - p1 - i2 - p2 - i3 - p3) AS i4 FROM (
               SELECT *, least(t3, m - i1 - p1 - i2 - p2 - i3) AS p3 FROM (
                SELECT *, least(d3, m - i1 - p1 - i2 - p2) AS i3 FROM (
                 SELECT *, least(t2, m - i1 - p1 - i2) AS p2 FROM (
                  SELECT *, least(d2, m - i1 - p1) AS i2 FROM (
                   SELECT *, least(t1, m - i1) AS p1 FROM (
                    SELECT *, least(d1, m) AS i1 FROM (
                     SELECT *, least(svc, coll) AS psvc, coll - least(svc, coll) + dr AS m, CASE WHEN sweep THEN nt ELSE least(nt, greatest(nt + 750000000 - pe, 0)) END AS reg, CASE WHEN sweep OR pe = 0 THEN 0 ELSE 250000000 END AS flo FROM (
                      SELECT *, ob - t1 - t2 - t3 - t4 AS nt, CASE WHEN sweep OR pe = 0 THEN opening ELSE greatest(least(greatest(svc + dt + t1 + t2 + t3 + t4 - coll, 0), opening) - svc, 0) END AS dr FROM (
                       SELECT *, greatest(ob - pe - t1 - t2 - t3, CASE WHEN month >= 77 THEN b4 ELSE 0 END, 0) AS t4, coll >= svc AND coll + opening >= ob + dt + svc AS sweep FROM (
                        SELECT *, greatest(b1 + b2 + b3 - pe - t1 - t2, 0) AS t3 FROM (
                         SELECT *, greatest(b1 + b2 - pe - t1, 0) AS t2 FROM (
                          SELECT *, greatest(b1 - pe, 0) AS t1, d1 + d2 + d3 + d4 AS dt, b1 + b2 + b3 + b4 AS ob FROM (
                           SELECT fl.scenario, fl.month, fl.pe, fl.coll, fl.svc, wf.res AS opening, wf.n1 AS b1, wf.n2 AS b2, wf.n3 AS b3, wf.n4 AS b4, (wf.n1 * 896 + 120000) // 240000 AS d1, (wf.n2 * 992 + 120000) // 240000 AS d2,
                                  (wf.n3 * 1032 + 120000) // 240000 AS d3, (wf.n4 * 1148 + 120000) // 240000 AS d4 FROM wf JOIN fl ON fl.scenario = wf.scenario AND fl.month = wf.month + 1)))))))))))))))))))))))))),
nf AS (
  SELECT w.scenario, w.month, strftime(DATE '2025-05-15' + to_months(w.month), '%Y-%m-%d') AS distribution_date, v.note, v.b AS begin_cents, v.d AS interest_due_cents, v.i AS interest_cents, v.b - v.n AS principal_cents, v.n AS end_cents,
         v.d - v.i AS shortfall_cents, CASE WHEN v.note = 'D' AND w.month >= 77 THEN v.n ELSE 0 END AS maturity_shortfall_cents, CASE v.note WHEN 'A3' THEN l.n1 WHEN 'B' THEN l.n2 WHEN 'C' THEN l.n3 ELSE l.n4 END AS loss_cents
  FROM wf w JOIN wf l ON l.scenario = w.scenario AND l.month = {_MONTHS}, LATERAL (VALUES ('A3', w.b1, w.d1, w.i1, w.n1), ('B', w.b2, w.d2, w.i2, w.n2), ('C', w.b3, w.d3, w.i3, w.n3), ('D', w.b4, w.d4, w.i4, w.n4)) v(note, b, d, i, n)
  WHERE w.month > 0)"""
NOTE_FLOWS = f"WITH RECURSIVE {_WATERFALL} SELECT * FROM nf"


def month_flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("collections_cents", "servicing_cents", "reserve_draw_cents", "reserve_deposit_cents", "reserve_release_cents", "reserve_end_cents", "residual_cents", "sweep")
    return waterfall.month_flows(_pool_flows(spark, sf_dir), _STATE, _TERMS).select("scenario", "month", *names)


MONTH_FLOWS = f"""
WITH RECURSIVE {_WATERFALL}
SELECT scenario, month, coll AS collections_cents, paid_svc AS servicing_cents, draw AS reserve_draw_cents, deposit AS reserve_deposit_cents, release AS reserve_release_cents, res AS reserve_end_cents, residual AS residual_cents, sweep FROM wf WHERE month > 0
"""


def note_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = valuation.note_summary(_note_flows(spark, sf_dir), F.lit("2025-05-15").cast("date"), 0.08)
    return s.withColumns({"pv_cents": _r("pv_cents", 0)} | {c: _r(c, 6) for c in ("price_per_100", "wal_years", "paid_wal_years", "recovery_share")})


NOTE_SUMMARY = f"""
WITH RECURSIVE {_WATERFALL}, y AS (SELECT *, date_diff('day', DATE '2025-05-15', CAST(distribution_date AS DATE)) / 365.25e0 AS years FROM nf),
s AS (SELECT scenario, note, arg_min(begin_cents, month) AS o, arg_max(end_cents, month) AS c, CAST(sum(interest_cents) AS BIGINT) AS i, CAST(sum(principal_cents) AS BIGINT) AS p, max(loss_cents) AS l, arg_max(shortfall_cents, month) AS sh,
        sum(principal_cents * years) AS wy, sum((interest_cents + principal_cents) / pow(1.08e0, years)) AS pv FROM y GROUP BY 1, 2)
SELECT scenario, note, o AS opening_cents, c AS closing_cents, i AS interest_cents, p AS principal_cents, l AS loss_cents, sh AS shortfall_cents, round(pv, 0) AS pv_cents, round(CASE WHEN o > 0 THEN 100 * pv / o END, 6) AS price_per_100,
       round(CASE WHEN o > 0 AND c = 0 AND l = 0 THEN wy / o END, 6) AS wal_years, round(CASE WHEN p > 0 THEN wy / p END, 6) AS paid_wal_years, round(CASE WHEN o > 0 THEN p / CAST(o AS DOUBLE) END, 6) AS recovery_share FROM s
"""


def reverse_stress(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first severity at which the junior note loses, by the waterfall of each severity's pool."""
    worst = _note_flows(spark, sf_dir).where("note = 'D'").groupBy(F.col("scenario").cast("int").alias("severity")).agg((F.max("loss_cents") + F.max_by("shortfall_cents", "month")).alias("loss_cents"))
    return waterfall.first_breach(worst)


REVERSE_STRESS = f"""
WITH RECURSIVE {_WATERFALL}, g AS (SELECT CAST(scenario AS INT) AS s, max(loss_cents) + arg_max(shortfall_cents, month) > 0 AS breach FROM nf WHERE note = 'D' GROUP BY 1),
o2 AS (SELECT *, lag(s) OVER (ORDER BY s) AS ps, lag(breach) OVER (ORDER BY s) AS pbr FROM g), f AS (SELECT min(s) FILTER (breach) AS first_breach FROM o2)
SELECT any_value(f.first_breach) AS first_breach, max(ps) FILTER (s = f.first_breach AND NOT pbr) AS preceding_safe, count(*) FILTER (breach) AS breaches FROM o2, f
"""

_OTHER_TARGET = 1_500_000_000


def target_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The notes under twice the target of overcollateralisation."""
    t = validation.target_sensitivity(_pool_flows(spark, sf_dir), _STATE, _TERMS, _OTHER_TARGET, 0.08)
    return t.withColumns({c: _r(c, 0) for c in ("base_pv_cents", "other_pv_cents", "pv_cents_change")})


def _sums(flows: str) -> str:
    return f"SELECT scenario, note, CAST(sum(principal_cents) AS BIGINT) AS p, max(loss_cents) AS l, sum((interest_cents + principal_cents) / pow(1.08e0, date_diff('day', DATE '2025-05-15', CAST(distribution_date AS DATE)) / 365.25e0)) AS pv FROM ({flows}) GROUP BY 1, 2"


TARGET_SENSITIVITY = f"""
WITH b AS ({_sums(NOTE_FLOWS)}), o AS ({_sums(NOTE_FLOWS.replace('nt + 750000000', f'nt + {_OTHER_TARGET}'))})
SELECT scenario, note, b.p AS base_principal_cents, b.l AS base_loss_cents, round(b.pv, 0) AS base_pv_cents, o.p AS other_principal_cents, o.l AS other_loss_cents, round(o.pv, 0) AS other_pv_cents,
       o.p - b.p AS principal_cents_change, o.l - b.l AS loss_cents_change, round(o.pv - b.pv, 0) AS pv_cents_change FROM b JOIN o USING (scenario, note)
"""

# ---- sources, dates, checks -------------------------------------------------------


def filing_selection(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Urgent and high orders as filings of fifty deals, of a window, in each deal's first five months with any."""
    o = table(spark, sf_dir, "orders")
    f = o.select(F.concat(F.lit("D"), (F.col("o_custkey") % 50).cast("string")).alias("deal_id"), F.col("o_orderkey").alias("accession"), F.col("o_orderpriority").alias("form"), base._month("o_orderdate").alias("report_period"), F.to_date("o_orderdate").alias("filing_date"))
    return document_sources.select_filings(f, ["1-URGENT", "2-HIGH"], "1996-01-01", "1997-12-31", 5)


FILING_SELECTION = """
WITH f AS (SELECT 'D' || (o_custkey % 50) AS deal_id, o_orderkey AS accession, o_orderpriority AS form, strftime(o_orderdate, '%Y-%m') AS report_period, CAST(o_orderdate AS DATE) AS filing_date FROM orders),
k AS (SELECT *, dense_rank() OVER (PARTITION BY deal_id ORDER BY report_period) AS n FROM f WHERE form IN ('1-URGENT', '2-HIGH') AND filing_date BETWEEN DATE '1996-01-01' AND DATE '1997-12-31')
SELECT deal_id, accession, form, report_period, filing_date FROM k WHERE n <= 5
"""


def unseen_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents that were not ingested; every third was, with the hash it still has."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("string").alias("accession"), F.sha2("text", 256).alias("sha256"), "doc_id")
    return tapes.new_sources(d.drop("doc_id"), d.where("doc_id % 3 = 0").drop("doc_id"))


UNSEEN_SOURCES = "SELECT CAST(doc_id AS VARCHAR) AS accession, sha256(text) AS sha256 FROM documents WHERE doc_id % 3 <> 0"


def columnar_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders stored as parallel arrays of their lines, as rows again."""
    li = table(spark, sf_dir, "lineitem").groupBy("l_orderkey").agg(F.array_sort(F.collect_list(F.struct("l_linenumber", "l_partkey"))).alias("r"))  # an order has a few lines
    arrays = li.select(F.transform("r", lambda x: F.col("l_orderkey")).alias("order_key"), F.col("r.l_linenumber").alias("line"), F.col("r.l_partkey").alias("part"))
    return document_sources.zip_columns(arrays, ["order_key", "line", "part"])


COLUMNAR_ROWS = "SELECT l_orderkey AS order_key, l_linenumber AS line, l_partkey AS part FROM lineitem"


def calendar_months(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    day, start = F.col("day"), F.lit("1995-01-15").cast("date")
    return o.select("day", add_months_on(day, F.lit(3), F.lit(30)).alias("thirtieth"), months_between(day, start).alias("months"), is_full_month(F.trunc("day", "month"), day).alias("full_month"))


CALENDAR_MONTHS = """
WITH d AS (SELECT DISTINCT CAST(o_orderdate AS DATE) AS day FROM orders), f AS (SELECT day, CAST(date_trunc('month', day) + INTERVAL 3 MONTH AS DATE) AS first FROM d)
SELECT day, least(first + 29, last_day(first)) AS thirtieth, CAST((year(day) - 1995) * 12 + month(day) - 1 AS INT) AS months, day = last_day(day) AS full_month FROM f
"""


def fleet_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance-weighted probabilities of the known fleet and their annual equivalents."""
    f = scenarios.known_fleet(_fleet(spark, sf_dir), F.lit("1995-04-20").cast("timestamp")).withColumns({"p1": F.col("age_months") / 4000.0, "p2": F.col("credit_score") / 50000.0})
    w = models.weighted_rates(f)
    return w.select(*[_r(c, 10).alias(c) for c in w.columns])


FLEET_RATES = f"""
WITH {_KNOWN.replace(_ORIGIN, '1995-04-20')}, f AS (SELECT end_balance_cents AS w, age_months / 4000e0 AS p1, credit_score / 50000e0 AS p2 FROM o2 WHERE period_end = newest AND end_balance_cents > 0 AND NOT previously_defaulted),
m AS (SELECT sum(p1 * w) / sum(w) AS d, sum(p2 * w) / sum(w) AS p FROM f)
SELECT round(d, 10) AS monthly_default, round(p, 10) AS monthly_prepay, round(1 - exp(12 * ln(1 - d - p) * d / (d + p)), 10) AS annual_default, round(1 - exp(12 * ln(1 - d - p) * p / (d + p)), 10) AS annual_prepay FROM m
"""


def growing_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Whether the running sums of a priority's months grow strictly, and whether its months do."""
    t = base._monthly_tiers(spark, sf_dir)
    running = t.withColumn("due_cents", F.sum("due_cents").over(Window.partitionBy("tier").orderBy("month")))
    sums = audit.increasing(running, ["tier"], "month", "due_cents").withColumnRenamed("increasing", "sums_grow")
    return sums.join(audit.increasing(t, ["tier"], "month", "due_cents").withColumnRenamed("increasing", "months_grow"), "tier")


GROWING_TIERS = f"""
WITH {base._TIERS}, r AS (SELECT *, due_cents > coalesce(lag(due_cents) OVER w, -1) AS up FROM t WINDOW w AS (PARTITION BY tier ORDER BY month))
SELECT tier, min(due_cents) > 0 OR count(*) = 1 AS sums_grow, bool_and(up) AS months_grow FROM r GROUP BY 1
"""


def note_rolls(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Opening less principal against closing, of each note and month of the waterfall."""
    return valuation.roll_checks(_note_flows(spark, sf_dir)).select("scenario", "month", "note", "expected_closing_cents", "residual_cents")


NOTE_ROLLS = f"WITH RECURSIVE {_WATERFALL} SELECT scenario, month, note, begin_cents - principal_cents AS expected_closing_cents, end_cents - begin_cents + principal_cents AS residual_cents FROM nf"

_NAMES = (
    "cohort_predictions", "transition_predictions", "segment_stability", "widest_gaps", "seasoned_defaults", "seasoned_recoveries", "known_fleet", "interest_share", "default_candidates", "recovery_ratio",
    "loan_moves", "tape_profile", "key_alignment", "money_texts", "payment_dates", "pool_projection", "note_flows", "month_flows", "note_summary", "reverse_stress", "target_sensitivity", "expanding_folds",
    "filing_selection", "unseen_sources", "columnar_rows", "calendar_months", "fleet_rates", "growing_tiers", "note_rolls",
)
QUERIES = {name: globals()[name] for name in _NAMES}
SQL = {name: globals()[name.upper()] for name in _NAMES}
