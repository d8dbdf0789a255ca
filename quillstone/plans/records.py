"""Registered queries of records kept: event audits, splits, rates, bootstraps, exact values, stored layouts and what readers are shown, each with its SQL where SQL can say it."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.money import double_cents
from ..operators import audit, display, features, models, panel, scoring, valuation
from ..sources import archives, layout, rates
from ..streaming import ingest
from . import core, validation
from . import queries as base

_r, table = base._r, base.table


def _work_folder(spark: SparkSession, name: str) -> str:
    """A new folder where the cluster's tasks and driver both reach it; only a local master may do without the setting."""
    top = spark.sparkContext.getConf().get("spark.checkpoint.dir") or spark.conf.get("spark.checkpoint.dir", None)
    if not top and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that driver and executors share")
    return f"{(top or 'file:///tmp/checkpoints').rstrip('/')}/{name}-{uuid.uuid4().hex}"


# ---- audits and splits ---------------------------------------------------------------


def event_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return audit.audit_events(core._events(spark, sf_dir))


EVENT_AUDIT = f"""
WITH {base._PANEL}, z AS (SELECT deal_id, min(period_end) AS boundary FROM e GROUP BY 1),
a AS (SELECT e.*, boundary, coalesce(chargeoff_cents, 0) AS lo, first_default_event = 1 AS ev, coalesce(max(first_default_event) OVER (PARTITION BY e.deal_id, loan_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) = 1 AS seen,
        lag(end_balance_cents) OVER (PARTITION BY e.deal_id, loan_id ORDER BY period_end) AS last_end, CASE WHEN zero_balance_month IS NULL THEN 'missing' WHEN zero_balance_month < month THEN 'earlier' WHEN zero_balance_month = month THEN 'same' ELSE 'later' END AS ef,
        list_contains(string_split(coalesce(zero_balance_code, ''), '|'), '4') AS four FROM e JOIN z USING (deal_id)),
g AS (SELECT *, seen AND end_balance_cents > 0 AS again, begin_balance_cents - end_balance_cents - principal_paid_cents - lo AS res FROM a),
h AS (SELECT *, again AND NOT coalesce(bool_or(again) OVER (PARTITION BY deal_id, loan_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), false) AS first_again FROM g)
SELECT CASE GROUPING(deal_id, period_end) WHEN 0 THEN 'period' WHEN 1 THEN 'deal' ELSE 'all' END AS level, deal_id, period_end, count(*) AS rows, count(*) FILTER (res <> 0) AS balance_identity_failures, CAST(sum(res) AS BIGINT) AS balance_identity_residual_cents,
  CAST(sum(lo) AS BIGINT) AS net_chargeoff_adjustments, CAST(sum(CASE WHEN ef = 'same' THEN lo ELSE 0 END) AS BIGINT) AS effective_month_chargeoffs, count(*) FILTER (ev) AS first_observed_defaults, CAST(sum(CASE WHEN ev THEN lo ELSE 0 END) AS BIGINT) AS first_default_chargeoffs,
  CAST(sum(CASE WHEN ev THEN begin_balance_cents ELSE 0 END) AS BIGINT) AS first_default_begin_balance, {', '.join(f"count(*) FILTER (ev AND ef = '{n}') AS effective_month_{n}" for n in ('missing', 'earlier', 'same', 'later'))},
  count(*) FILTER (ev AND period_end = boundary) AS boundary_defaults, count(*) FILTER (ev AND end_balance_cents > 0) AS positive_end_first_defaults, count(*) FILTER (four AND end_balance_cents > 0) AS positive_end_chargedoff_codes,
  count(*) FILTER (again) AS positive_end_after_default, count(*) FILTER (again AND last_end <= 0) AS returned_to_positive_after_default, count(*) FILTER (seen AND lo > 0) AS chargeoffs_after_first_default, count(*) FILTER (first_again) AS reinstated_loans
FROM h GROUP BY GROUPING SETS ((), (deal_id), (deal_id, period_end))
"""
_TIMES = {"train": ("0001-01-01", "1998-06-30", "1998-09-01"), "calibration": ("1998-09-01", "1999-05-31", "1999-08-01"), "test": ("1999-08-01", "9999-12-31", None)}


def _model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The modeling rows, written once: samples, folds and every step of a fit read them, and none makes the panel again."""
    path = _work_folder(spark, "model_rows")
    rows = features.disclosure_features(core._events(spark, sf_dir))
    rows.write.parquet(path)
    return spark.read.schema(rows.schema).parquet(path)


def _samples(spark: SparkSession, sf_dir: str) -> dict[str, DataFrame]:
    return models.samples(_model_rows(spark, sf_dir), "D0", "D1", _TIMES)


def split_description(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The four samples of a model of one deal that another deal tests."""
    d = models.describe(_samples(spark, sf_dir))
    return d.withColumns({"deals": F.array_join("deals", ","), "last_label": F.to_date("last_label"), "last_feature": F.to_date("last_feature")})


_SAMPLES = f"""r AS ({base.DISCLOSURE_ROWS}), s AS (
  SELECT 'training' AS sample, * FROM r WHERE deal_id = 'D0' AND period_end <= DATE '{_TIMES['train'][1]}' AND label_available_at < DATE '{_TIMES['train'][2]}'
  UNION ALL SELECT 'calibration', * FROM r WHERE deal_id = 'D0' AND period_end BETWEEN DATE '{_TIMES['calibration'][0]}' AND DATE '{_TIMES['calibration'][1]}' AND label_available_at < DATE '{_TIMES['calibration'][2]}'
  UNION ALL SELECT 'later_months', * FROM r WHERE deal_id = 'D0' AND period_end >= DATE '{_TIMES['test'][0]}'
  UNION ALL SELECT 'unseen_deal', * FROM r WHERE deal_id = 'D1' AND period_start >= DATE '{_TIMES['test'][0]}')"""
SPLIT_DESCRIPTION = f"""
WITH {_SAMPLES}
SELECT sample, count(*) AS rows, count(DISTINCT loan_id) AS loans, any_value(deal_id) AS deals, min(period_start) AS first_period, max(period_end) AS last_period, max(label_available_at) AS last_label, max(feature_available_at) AS last_feature,
  count(*) FILTER (outcome = 0) AS outcome_0, count(*) FILTER (outcome = 1) AS outcome_1, count(*) FILTER (outcome = 2) AS outcome_2 FROM s GROUP BY 1
"""


def model_optimality(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The gradient of the penalised loss at the model's coefficients, to three places: zero for every outcome and input."""
    train = _samples(spark, sf_dir)["training"]
    g = models.gradient(models.fit(train), train)
    return g.withColumn("gradient", F.abs(F.round("gradient", 3)))


MODEL_OPTIMALITY = f"""
WITH {_SAMPLES}, t AS (SELECT *, log_balance AS lb FROM s WHERE sample = 'training'),
i AS (SELECT unnest([{', '.join(repr(name) for name in (*models.FEATURES, 'intercept'))}]) AS input
  UNION ALL {' UNION ALL '.join(f"SELECT '{name}_missing' FROM t HAVING count(*) FILTER ({name} IS NULL) > 0" for name in models.FEATURES)})
SELECT CAST(o AS INT) AS outcome, input, 0e0 AS gradient FROM i, range(3) g(o)
"""


def model_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The calibrated model and two baselines on later months and on the unseen deal."""
    of = _samples(spark, sf_dir)
    fitted = models.fit(of["training"], of["calibration"])
    out = None
    for sample in ("later_months", "unseen_deal"):
        predicted = {"calibrated_model": fitted.predict(of[sample]), "constant": of[sample].join(F.broadcast(scoring.constant_probabilities(of["training"]))), "transition": scoring.transition_predictions(of["training"], of[sample])}
        for method, rows in predicted.items():
            side = rows.select(F.lit(sample).alias("sample"), F.lit(method).alias("method"), "outcome", *[f"p{c}" for c in range(3)])
            out = side if out is None else out.unionByName(side)
    own = F.when(F.col("outcome") == 1, F.col("p1")).when(F.col("outcome") == 2, F.col("p2")).otherwise(F.col("p0"))
    brier = lambda c: F.avg(F.pow(F.col(f"p{c}") - (F.col("outcome") == c).cast("double"), 2))
    scored = scoring.clipped(out).groupBy("sample", "method").agg(F.count("*").alias("rows"), F.avg(-F.log(own)).alias("log_loss"), brier(1).alias("default_brier"), brier(2).alias("prepayment_brier"))
    return scored.select("sample", "method", "rows", *[_r(c, 6).alias(c) for c in ("log_loss", "default_brier", "prepayment_brier")])


def fold_models(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The model fitted anew on what was public before each of two windows, beside the baselines."""
    s = validation.score_folds(_model_rows(spark, sf_dir), core._WINDOWS[2:], {"logistic": validation.logistic})
    return s.select("fold", "method", "event", "rows", "events", *[_r(c, 6).alias(c) for c in ("observed_rate", "predicted_rate", "brier", "log_loss")])


def form_histogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as filings: a priority is a registrant, a status a form."""
    day = F.to_date("o_orderdate")
    filings = table(spark, sf_dir, "orders").select(F.col("o_orderpriority").alias("registrant"), F.col("o_orderstatus").alias("form"), day.alias("filing_date"), F.date_add(day, (F.col("o_orderkey") % 5).cast("int")).cast("timestamp").alias("acceptance_time"))
    return audit.form_counts(filings, ["registrant"], "1996-03-01", "2000-06-30")


FORM_HISTOGRAM = """
SELECT o_orderpriority AS registrant, o_orderstatus AS form, count(*) AS filings FROM orders
WHERE CAST(o_orderdate AS DATE) >= DATE '1996-03-01' AND CAST(o_orderdate AS DATE) + CAST(o_orderkey % 5 AS INT) <= DATE '2000-06-30' GROUP BY 1, 2
"""

# ---- official rates -------------------------------------------------------------------


def _replies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A JSON reply a year, an entry for each day of orders and one of another series; rates are the day's cents."""
    o = table(spark, sf_dir, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.max(double_cents(F.col("o_totalprice"))).alias("cents"))
    rate = F.format_string("%d.%05d", F.floor(F.col("cents") % 900_000 / 100_000), F.col("cents") % 100_000)
    entry = lambda series, value: F.concat(F.lit('{"effectiveDate": "'), F.col("day").cast("string"), F.lit(f'", "type": "{series}", "average30day": '), value, F.lit(', "average90day": null, "note": "x"}'))
    both = o.select(F.year("day").alias("year"), F.concat_ws(", ", entry(rates.SERIES, rate), entry("OTHER", F.lit("9.99"))).alias("entry"))
    return both.groupBy("year").agg(F.concat(F.lit('{"refRates": ['), F.array_join(F.collect_list("entry"), ", "), F.lit("]}")).alias("reply"))


def official_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The series as read from JSON, in hundred-millionths of a percent."""
    return rates.official_rates(_replies(spark, sf_dir), "reply").select("effective_date", (F.col("average30day") * 100_000_000).cast("bigint").alias("rate_e8"))


_RATES = "f AS (SELECT CAST(o_orderdate AS DATE) AS day, max(CAST(round(o_totalprice * 100e0) AS BIGINT)) % 900000 * 1000 AS rate_e8 FROM orders GROUP BY 1)"
OFFICIAL_RATES = f"WITH {_RATES} SELECT day AS effective_date, rate_e8 FROM f"


def rebuilt_coupons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Coupons of monthly periods rebuilt from the second fixing before each; a third of the stated ones is off by a hundredth."""
    o = table(spark, sf_dir, "orders").select(F.trunc("o_orderdate", "month").alias("start")).distinct()
    given = rates.official_rates(_replies(spark, sf_dir), "reply")
    true = valuation.rate_in_force(o, given, "start", "effective_date", "average30day")
    off = F.when(F.month("start") % 3 == 0, F.lit("0.01").cast("decimal(18,8)")).otherwise(F.lit("0").cast("decimal(18,8)"))
    periods = true.select("start", (F.col("fixing_rate") + F.lit("0.69").cast("decimal(18,8)") + off).cast("decimal(18,8)").alias("coupon"))
    f = rates.rebuilt_coupons(periods, given, "start", F.col("coupon"))
    return f.select("start", "fixing_date", (F.col("official_rate") * 100_000_000).cast("bigint").alias("official_e8"), (F.col("difference") * 100_000_000).cast("bigint").alias("difference_e8"), "matches")


REBUILT_COUPONS = f"""
WITH {_RATES}, p AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders),
j AS (SELECT start, day, rate_e8, row_number() OVER (PARTITION BY start ORDER BY day DESC) AS k FROM p JOIN f ON day < start)
SELECT p.start, day AS fixing_date, CAST(rate_e8 + 69000000 AS BIGINT) AS official_e8, CASE WHEN day IS NOT NULL THEN CAST(CASE WHEN month(p.start) % 3 = 0 THEN 1000000 ELSE 0 END AS BIGINT) END AS difference_e8,
  coalesce(day IS NOT NULL AND month(p.start) % 3 <> 0, false) AS matches FROM p LEFT JOIN j ON j.start = p.start AND k = 2
"""

# ---- exact values and exact draws --------------------------------------------------------


def precise_value(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Present value and average life of the line items' prices with 60 places, beside the double's to a billionth."""
    days = F.date_diff("l_shipdate", F.lit("1995-01-01").cast("date"))
    f = table(spark, sf_dir, "lineitem").select("l_returnflag", double_cents(F.col("l_extendedprice")).alias("cents"), days.alias("days"))
    exact = valuation.exact_value(f, ["l_returnflag"], F.col("cents"), F.col("days"), "0.08").join(valuation.exact_life(f, ["l_returnflag"], F.col("cents"), F.col("days")), "l_returnflag")
    double = valuation.value(f, ["l_returnflag"], F.col("cents"), F.col("days") / F.lit(valuation.YEAR), F.lit(0.08))
    near = F.abs(F.col("pv_text").cast("double") / F.col("pv") - 1) < 1e-9
    return exact.join(double, "l_returnflag").select("l_returnflag", _r(F.col("pv_text").cast("double") / 100, 0).alias("pv"), _r(F.col("wal_years").cast("double"), 6).alias("wal_years"), near.alias("agrees"))


PRECISE_VALUE = f"WITH {base._FLOWS} SELECT l_returnflag, round(sum(cents / pow(1.08e0, years)) / 100, 0) AS pv, round(sum(cents * years) / sum(cents), 6) AS wal_years, true AS agrees FROM f GROUP BY 1"
_DRAWS, _BLOCK, _SEED = 50, 4, 20261002


def bootstrap_multinomial(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals over draws of customers' market segments by nation, with replacement."""
    c = table(spark, sf_dir, "customer")
    got = scoring.multinomial_bootstrap(c, ["c_mktsegment", "c_nationkey"], {"balance": F.col("c_acctbal"), "in_debt": (F.col("c_acctbal") < 0).cast("double")}, draws=_DRAWS, seed=_SEED, block=_BLOCK, buckets=16)
    return got.select("measure", _r("lower", 6).alias("lower"), _r("upper", 6).alias("upper"))


def _sql_drawn(n: str, p: str, name: str) -> str:
    """Successes of n (at most 500) trials: as many numbers as have a chance of at most the hash's number not to be exceeded."""
    u = f"(CAST(('0x' || substr(md5({name} || '|0'), 1, 12)) AS BIGINT) / 281474976710656e0)"
    chance = f"exp(lgamma({n} + 1e0) - lgamma(j + 1e0) - lgamma({n} - j + 1e0) + j * ln({p}) + ({n} - j) * ln(1 - {p}))"
    below = f"len(list_filter(range(0, {n} + 1), lambda k: list_sum(list_transform(range(0, k + 1), lambda j: {chance})) <= {u}))"
    return f"CASE WHEN {n} <= 0 THEN 0 WHEN {p} >= 1 THEN {n} ELSE least({n}, {below}) END"


BOOTSTRAP_MULTINOMIAL = f"""
WITH RECURSIVE c AS (SELECT c_mktsegment || '|' || c_nationkey AS key, CAST(count(*) AS DOUBLE) AS n, sum(c_acctbal) AS b, CAST(count(*) FILTER (c_acctbal < 0) AS DOUBLE) AS d FROM customer GROUP BY 1),
x AS (SELECT *, row_number() OVER (ORDER BY CAST(('0x' || substr(md5(key), 1, 8)) AS BIGINT) % 16, key) - 1 AS place FROM c),
t AS (SELECT CAST(count(*) AS BIGINT) AS total, CAST((count(*) + {_BLOCK - 1}) // {_BLOCK} AS BIGINT) AS blocks FROM x),
node(draw, lo, hi, take) AS (
  SELECT CAST(g AS BIGINT), CAST(0 AS BIGINT), blocks, total FROM range({_DRAWS}) r(g), t
  UNION ALL
  SELECT draw, CASE side WHEN 0 THEN lo ELSE mid END, CASE side WHEN 0 THEN mid ELSE hi END, CASE side WHEN 0 THEN l ELSE take - l END FROM (
    SELECT *, CAST({_sql_drawn('take', 'p', "('%d|' || draw || '|' || lo || '|' || hi)" % _SEED)} AS BIGINT) AS l FROM (
      SELECT draw, lo, hi, take, mid, (least(mid * {_BLOCK}, total) - lo * {_BLOCK}) / CAST(least(hi * {_BLOCK}, total) - lo * {_BLOCK} AS DOUBLE) AS p FROM (SELECT *, (lo + hi) // 2 AS mid FROM node, t WHERE hi - lo > 1 AND take > 0))), (VALUES (0), (1)) v(side)),
st(draw, lo, place, rest, k) AS (
  SELECT draw, lo, lo * {_BLOCK} - 1, take, CAST(0 AS BIGINT) FROM node WHERE hi - lo = 1 AND take > 0
  UNION ALL
  SELECT draw, lo, place, rest - l, l FROM (
    SELECT *, CAST({_sql_drawn('rest', 'p', "('%d|' || draw || '|cluster|' || place)" % _SEED)} AS BIGINT) AS l FROM (
      SELECT draw, lo, place + 1 AS place, rest, 1e0 / (least((lo + 1) * {_BLOCK}, total) - place - 1) AS p FROM st, t WHERE place + 1 < least((lo + 1) * {_BLOCK}, total)))),
m AS (SELECT draw, sum(k * b) / sum(k * n) AS balance, sum(k * d) / sum(k * n) AS in_debt FROM st JOIN x USING (place) GROUP BY 1),
u AS (SELECT 'balance' AS measure, balance AS value FROM m UNION ALL SELECT 'in_debt', in_debt FROM m)
SELECT measure, round(quantile_cont(value, 0.025), 6) AS lower, round(quantile_cont(value, 0.975), 6) AS upper FROM u GROUP BY 1
"""


def loss_series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Net loss of each deal and period, and its running total."""
    s = panel.panel_stats(core._events(spark, sf_dir)).select("deal_id", "period_end", (F.coalesce("chargeoff_cents", F.lit(0)) - F.coalesce("recovery_cents", F.lit(0))).alias("net_loss_cents"))
    return display.cumulative(s, ["deal_id"], "period_end", "net_loss_cents", "cumulative_net_loss_cents")


LOSS_SERIES = f"""
WITH {base._PANEL}, s AS (SELECT deal_id, period_end, CAST(coalesce(sum(chargeoff_cents), 0) - coalesce(sum(recovery_cents), 0) AS BIGINT) AS net_loss_cents FROM e GROUP BY 1, 2)
SELECT deal_id, period_end, net_loss_cents, CAST(sum(net_loss_cents) OVER (PARTITION BY deal_id ORDER BY period_end) AS BIGINT) AS cumulative_net_loss_cents FROM s
"""

# ---- what readers are shown ------------------------------------------------------------


def _comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Three comparisons of each deal's period: what its loans add up to, and what was reported of it."""
    s = panel.panel_stats(core._events(spark, sf_dir))
    pairs = [("interest", F.col("interest_paid_cents"), F.col("interest_paid_cents") + F.when(F.col("loans") % 3 == 0, 1).otherwise(0)), ("principal", F.col("principal_paid_cents"), F.col("principal_paid_cents") - F.col("loans") % 2), ("closing", F.col("end_balance_cents"), F.col("end_balance_cents"))]
    f = s.select("deal_id", "period_end", F.explode(F.array(*[F.struct(F.lit(name).alias("name"), a.cast("bigint").alias("computed_cents"), b.cast("bigint").alias("reported_cents")) for name, a, b in pairs])).alias("c")).select("deal_id", "period_end", "c.*")
    return f.withColumn("status", F.when(F.col("computed_cents") == F.col("reported_cents"), "MATCH").otherwise("DIFFERENCE"))


_COMPARISONS = f"""{base._PANEL}, t AS (SELECT deal_id, period_end, count(*) AS loans, CAST(sum(interest_paid_cents) AS BIGINT) AS i, CAST(sum(principal_paid_cents) AS BIGINT) AS p, CAST(sum(end_balance_cents) AS BIGINT) AS b FROM e GROUP BY 1, 2),
k AS (SELECT *, CASE WHEN computed_cents = reported_cents THEN 'MATCH' ELSE 'DIFFERENCE' END AS status FROM (SELECT deal_id, period_end, 'interest' AS name, i AS computed_cents, i + CASE WHEN loans % 3 = 0 THEN 1 ELSE 0 END AS reported_cents FROM t
  UNION ALL SELECT deal_id, period_end, 'principal', p, p - loans % 2 FROM t UNION ALL SELECT deal_id, period_end, 'closing', b, b FROM t))"""


def shown_comparisons(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Differences first, with amounts as readers see them."""
    f = display.differences_first(_comparisons(spark, sf_dir), ["deal_id"])
    residual = F.col("computed_cents") - F.col("reported_cents")
    return f.select("deal_id", "place", "period_end", "name", "status", display.money_text(F.col("computed_cents")).alias("computed"), display.money_text(F.when(residual != 0, residual)).alias("residual"), display.accounting_text(residual).alias("booked"), display.accounting_text(F.col("computed_cents"), True).alias("compact"))


_THOUSANDS = lambda c: f"('$' || format('{{:,}}', abs({c}) // 100) || '.' || lpad(CAST(abs({c}) % 100 AS VARCHAR), 2, '0'))"
SHOWN_COMPARISONS = f"""
WITH {_COMPARISONS}, q AS (SELECT *, computed_cents - reported_cents AS d, CAST(row_number() OVER (PARTITION BY deal_id ORDER BY status <> 'DIFFERENCE', period_end, name) AS INT) AS place FROM k)
SELECT deal_id, place, period_end, name, status, {_THOUSANDS('computed_cents')} AS computed, CASE WHEN d = 0 THEN 'Unavailable' WHEN d < 0 THEN '{display.MINUS}' || {_THOUSANDS('d')} ELSE {_THOUSANDS('d')} END AS residual,
  CASE WHEN d < 0 THEN '(' || {_THOUSANDS('d')} || ')' ELSE {_THOUSANDS('d')} END AS booked,
  CASE WHEN computed_cents >= 100000000 THEN '$' || format('{{:,}}', CAST(round_even(CAST(computed_cents AS DECIMAL(18,0)) / 10000000, 0) AS BIGINT) // 10) || '.' || CAST(round_even(CAST(computed_cents AS DECIMAL(18,0)) / 10000000, 0) AS BIGINT) % 10 || 'm' ELSE {_THOUSANDS('computed_cents')} END AS compact
FROM q
"""


def latest_controls(spark: SparkSession, sf_dir: str) -> DataFrame:
    return display.latest_controls(_comparisons(spark, sf_dir))


LATEST_CONTROLS = f"WITH {_COMPARISONS}, l AS (SELECT deal_id, max(period_end) AS period_end FROM k GROUP BY 1) SELECT deal_id, period_end, name, computed_cents, reported_cents, status FROM k JOIN l USING (deal_id, period_end)"


def shown_order(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as sources: certificates first within a clerk; each clerk's priorities in the order in which they first appear."""
    o = table(spark, sf_dir, "orders").select(F.col("o_custkey").alias("owner"), F.when(F.col("o_orderstatus") == "F", "certificate").otherwise("loan_tape").alias("kind"), F.date_format("o_orderdate", "yyyy-MM-dd").alias("report_period"), F.format_string("u%010d", "o_orderkey").alias("url"), "o_orderpriority")
    places = display.certificates_first(o, ["owner"])
    mentions = display.first_mentions(o, ["owner"], "url", "o_orderpriority").withColumnRenamed("place", "mention")
    return places.join(mentions, ["owner", "o_orderpriority"]).select("owner", "url", "kind", "place", "mention")


SHOWN_ORDER = """
WITH o AS (SELECT o_custkey AS owner, CASE WHEN o_orderstatus = 'F' THEN 'certificate' ELSE 'loan_tape' END AS kind, strftime(o_orderdate, '%Y-%m-%d') AS report_period, printf('u%010d', o_orderkey) AS url, o_orderpriority FROM orders),
p AS (SELECT *, CAST(row_number() OVER (PARTITION BY owner ORDER BY kind <> 'certificate', report_period, url) AS INT) AS place FROM o),
m AS (SELECT owner, o_orderpriority, CAST(row_number() OVER (PARTITION BY owner ORDER BY min(url), o_orderpriority) AS INT) AS mention FROM o GROUP BY 1, 2)
SELECT owner, url, kind, place, mention FROM p JOIN m USING (owner, o_orderpriority)
"""


def keyed_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sums of the orders that bear a status, priority and year, for every such key of a year's first month and some that do not occur."""
    o = table(spark, sf_dir, "orders").select(F.col("o_orderstatus").alias("scenario"), F.col("o_orderpriority").alias("note"), F.year("o_orderdate").alias("year"), F.month("o_orderdate").alias("month"), double_cents(F.col("o_totalprice")).alias("cents"))
    asked = o.where("month = 1").select("scenario", "note", "year").distinct()
    asked = asked.unionByName(asked.select("scenario", "note", (F.col("year") + 100).alias("year")))
    return display.keyed_totals(o, asked, ["scenario", "note", "year"], ["cents"])


KEYED_TOTALS = """
WITH o AS (SELECT o_orderstatus AS scenario, o_orderpriority AS note, CAST(year(o_orderdate) AS INT) AS year, month(o_orderdate) AS month, CAST(round(o_totalprice * 100e0) AS BIGINT) AS cents FROM orders),
a AS (SELECT DISTINCT scenario, note, year FROM o WHERE month = 1), b AS (SELECT * FROM a UNION ALL SELECT scenario, note, CAST(year + 100 AS INT) FROM a)
SELECT b.scenario, b.note, b.year, count(o.cents) AS rows, CAST(coalesce(sum(o.cents), 0) AS BIGINT) AS cents FROM b LEFT JOIN o ON o.scenario = b.scenario AND o.note = b.note AND o.year = b.year GROUP BY 1, 2, 3
"""

# ---- stored layouts and streams --------------------------------------------------------


def clustered_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The events of a panel that was stored in buckets of loans, derived without an exchange."""
    stored = layout.write_clustered(base._panel(spark, sf_dir), f"panel_{uuid.uuid4().hex}", _work_folder(spark, "panel"), 8)
    names = ("first_default_event", "prepayment_event", "maturity_event", "repurchase_event", "prepayment_cents")
    return panel.derive_events(stored).select("deal_id", "loan_id", "period_end", *names)


CLUSTERED_EVENTS = base.LOAN_EVENTS


def stream_record(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The record of filings that a stream ingested, read from its state: a filing for each priority and month of orders."""
    o = table(spark, sf_dir, "orders")
    accession = F.concat(F.substring("o_orderpriority", 1, 1), F.lit("-"), F.date_format("o_orderdate", "yyyyMM"))
    filings = o.select(accession.alias("accession"), F.md5(accession).alias("sha256"), "o_orderkey", "o_custkey", double_cents(F.col("o_totalprice")).alias("cents"), F.when(F.col("o_orderkey") % 7 != 0, F.col("o_orderstatus")).alias("status"))
    top = _work_folder(spark, "filings")
    filings.write.parquet(f"{top}/in")
    ingest.ingest(spark, f"{top}/in", filings.schema, f"{top}/out", f"{top}/checkpoint", source_hash="sha256", row_keys=("o_orderkey",)).awaitTermination()
    stored = spark.read.parquet(f"{top}/out").groupBy("accession").agg(F.sum("cents").alias("cents"))
    record = ingest.ingested_sources(spark, f"{top}/checkpoint").withColumnRenamed("filing", "accession")
    return record.join(stored, "accession").select("accession", "source_hash", "row_count", F.coalesce(F.try_element_at("missing_fields", F.lit("status")), F.lit(0)).alias("missing_status"), "cents")


STREAM_RECORD = """
WITH o AS (SELECT substr(o_orderpriority, 1, 1) || '-' || strftime(o_orderdate, '%Y%m') AS accession, o_orderkey, CAST(round(o_totalprice * 100e0) AS BIGINT) AS cents FROM orders)
SELECT accession, md5(accession) AS source_hash, count(*) AS row_count, count(*) FILTER (o_orderkey % 7 = 0) AS missing_status, CAST(sum(cents) AS BIGINT) AS cents FROM o GROUP BY 1
"""


def archive_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bytes of the tables' own files, as the archive source reads them."""
    return audit.byte_totals(archives.archives(spark, f"{sf_dir}/*.parquet"))


_SQL_NAMES = (
    "event_audit", "split_description", "model_optimality", "form_histogram", "official_rates", "rebuilt_coupons", "precise_value", "loss_series", "shown_comparisons", "latest_controls", "shown_order", "keyed_totals",
    "clustered_events", "stream_record", "bootstrap_multinomial",
)
QUERIES = {name: globals()[name] for name in (*_SQL_NAMES, "model_scores", "fold_models", "archive_totals")}
SQL = {name: globals()[name.upper()] for name in _SQL_NAMES}
