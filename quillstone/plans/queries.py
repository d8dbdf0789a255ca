"""Registered queries: the engine's operators on the driver's tables, each with its SQL where SQL can say it.

Customers, users and documents stand for loans; orders, line items and events for monthly facts.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.calendar import month_number
from ..functions.money import double_cents
from ..functions.rates import band, competing_monthly
from ..operators import features, models, panel, reconcile, recovery, runoff, scoring, valuation, waterfall
from ..sources import certificates as certificate_sources
from ..sources import documents as document_sources


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def _day(column: str):
    return F.to_date(column)


def _month(column: str):
    return F.date_format(column, "yyyy-MM")


# ---- panel -----------------------------------------------------------------


#: Orders that a task takes to make its loans' months of.
_TASK_ORDERS = 200_000


def _by_customer(orders: DataFrame) -> DataFrame:
    """The orders that the panel reads, a customer's in one task, in so many tasks that none has more than its share of rows.

    This is the panel's one exchange: months and the windows over a loan need no other. The number is given, since Spark would
    merge parts by their bytes as compressed, and a loan-month, whose columns all follow from a few, is many times as wide in memory as on disk.
    """
    parts = max(orders.sparkSession.sparkContext.defaultParallelism, -(-orders.count() // _TASK_ORDERS))
    return orders.select("o_custkey", "o_orderkey", "o_orderdate", "o_totalprice").repartition(parts, "o_custkey")


def _panel(spark: SparkSession, sf_dir: str, loan=None) -> DataFrame:
    """Orders as a loan-month panel: a customer is a loan, a month of orders a period; codes and dates follow from the order keys.

    ``loan`` gives a few loans instead, of many customers each, whose orders are summed before they are exchanged.
    """
    orders = table(spark, sf_dir, "orders")
    orders = _by_customer(orders) if loan is None else orders
    o = orders.groupBy((F.col("o_custkey") if loan is None else loan).alias("o_custkey"), F.trunc("o_orderdate", "month").alias("period_start")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("cents"), F.sum("o_orderkey").alias("s"))
    every = lambda n: F.col("s") % n == 0
    part = lambda n: F.floor(F.col("cents") / n).cast("bigint")
    closed = every(7)
    month = F.date_format("period_start", "yyyy-MM")
    end = F.when(closed, 0).otherwise(F.col("cents") - part(10)).cast("bigint")
    return o.select(
        F.concat(F.lit("D"), (F.col("o_custkey") % 3).cast("string")).alias("deal_id"), F.col("o_custkey").alias("loan_id"), "period_start", F.last_day("period_start").alias("period_end"),
        F.col("cents").alias("begin_balance_cents"), end.alias("end_balance_cents"), (F.col("cents") - end).alias("principal_paid_cents"), part(200).alias("interest_paid_cents"),
        F.when(every(11), part(50)).alias("chargeoff_cents"), F.when(every(13), part(80)).otherwise(0).cast("bigint").alias("recovery_cents"),
        F.when(closed, F.when(every(4), "1").when(F.col("s") % 4 == 1, "1|4").when(F.col("s") % 4 == 2, "3").otherwise("1")).alias("zero_balance_code"),
        F.when(closed, F.when(every(5), "1990-01").otherwise(month)).alias("zero_balance_month"), F.when(every(3), "1990-01").otherwise("2005-01").alias("maturity_month"),
        F.date_add(F.last_day("period_start"), (F.col("s") % 50).cast("int")).cast("timestamp").alias("acceptance_time"),
        (F.col("s") % 300 + 500).cast("double").alias("credit_score"), (F.col("s") % 80).cast("double").alias("orig_ltv_pct"), (F.col("s") % 9).cast("double").alias("interest_rate_pct"),
        (F.col("s") % 40).cast("int").alias("age_months"), F.when(~every(6), (F.col("s") % 30).cast("int")).alias("remaining_months"), (F.col("s") % 4 * 30).cast("int").alias("delinquency_days"),
    )


_PANEL = """o AS (
  SELECT o_custkey, CAST(date_trunc('month', o_orderdate) AS DATE) AS period_start, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS cents, CAST(sum(o_orderkey) AS BIGINT) AS s FROM orders GROUP BY 1, 2),
p AS (
  SELECT 'D' || (o_custkey % 3) AS deal_id, o_custkey AS loan_id, period_start, last_day(period_start) AS period_end, strftime(period_start, '%Y-%m') AS month,
         cents AS begin_balance_cents, CASE WHEN s % 7 = 0 THEN 0 ELSE cents - cents // 10 END AS end_balance_cents, cents - CASE WHEN s % 7 = 0 THEN 0 ELSE cents - cents // 10 END AS principal_paid_cents,
         cents // 200 AS interest_paid_cents, CASE WHEN s % 11 = 0 THEN cents // 50 END AS chargeoff_cents, CASE WHEN s % 13 = 0 THEN cents // 80 ELSE 0 END AS recovery_cents,
         CASE WHEN s % 7 = 0 THEN CASE s % 4 WHEN 1 THEN '1|4' WHEN 2 THEN '3' ELSE '1' END END AS zero_balance_code,
         CASE WHEN s % 7 = 0 THEN CASE WHEN s % 5 = 0 THEN '1990-01' ELSE strftime(period_start, '%Y-%m') END END AS zero_balance_month, CASE WHEN s % 3 = 0 THEN '1990-01' ELSE '2005-01' END AS maturity_month,
         CAST(last_day(period_start) + CAST(s % 50 AS INT) AS TIMESTAMP) AS acceptance_time, s % 300 + 500e0 AS credit_score, CAST(s % 80 AS DOUBLE) AS orig_ltv_pct, CAST(s % 9 AS DOUBLE) AS interest_rate_pct,
         CAST(s % 40 AS INT) AS age_months, CASE WHEN s % 6 <> 0 THEN CAST(s % 30 AS INT) END AS remaining_months, CAST(s % 4 * 30 AS INT) AS delinquency_days
  FROM o),
d AS (SELECT *, coalesce(chargeoff_cents, 0) AS loss, coalesce(zero_balance_code, '') AS code, min(period_end) FILTER (coalesce(chargeoff_cents, 0) > 0 OR list_contains(string_split(coalesce(zero_balance_code, ''), '|'), '4')) OVER (PARTITION BY deal_id, loan_id) AS fd FROM p),
c AS (SELECT *, list_contains(string_split(code, '|'), '1') AND NOT list_contains(string_split(code, '|'), '3') AND end_balance_cents <= 0 AND begin_balance_cents > 0 AND loss = 0 AND coalesce(zero_balance_month = month, false) AND NOT coalesce(fd <= period_end, false) AS paid_off FROM d),
e AS (SELECT *, CAST(coalesce(period_end = fd, false) AS INT) AS first_default_event, CAST(paid_off AND NOT list_contains(string_split(code, '|'), '4') AND maturity_month > month AS INT) AS prepayment_event,
        CAST(paid_off AND maturity_month <= month AS INT) AS maturity_event, CAST(list_contains(string_split(code, '|'), '3') AND coalesce(zero_balance_month = month, false) AS INT) AS repurchase_event FROM c)"""


def loan_events(spark: SparkSession, sf_dir: str) -> DataFrame:
    names = ("first_default_event", "prepayment_event", "maturity_event", "repurchase_event", "prepayment_cents")
    return panel.derive_events(_panel(spark, sf_dir)).select("deal_id", "loan_id", "period_end", *names)


LOAN_EVENTS = f"""
WITH {_PANEL}
SELECT deal_id, loan_id, period_end, first_default_event, prepayment_event, maturity_event, repurchase_event, CASE WHEN prepayment_event = 1 THEN principal_paid_cents END AS prepayment_cents FROM e
"""


def panel_stats(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.panel_stats(panel.derive_events(_panel(spark, sf_dir)))


PANEL_STATS = f"""
WITH {_PANEL}
SELECT deal_id, period_end, count(*) AS loans, count(*) FILTER (end_balance_cents > 0) AS active_loans, CAST(sum(begin_balance_cents) AS BIGINT) AS begin_balance_cents,
       CAST(sum(end_balance_cents) AS BIGINT) AS end_balance_cents, CAST(sum(greatest(end_balance_cents, 0)) AS BIGINT) AS positive_end_balance_cents, CAST(sum(principal_paid_cents) AS BIGINT) AS principal_paid_cents,
       CAST(sum(interest_paid_cents) AS BIGINT) AS interest_paid_cents, CAST(sum(chargeoff_cents) AS BIGINT) AS chargeoff_cents, CAST(sum(recovery_cents) AS BIGINT) AS recovery_cents,
       CAST(sum(CASE WHEN prepayment_event = 1 THEN principal_paid_cents END) AS BIGINT) AS prepayment_cents, CAST(sum(first_default_event) AS BIGINT) AS first_defaults,
       CAST(sum(prepayment_event) AS BIGINT) AS prepayments, CAST(sum(repurchase_event) AS BIGINT) AS repurchases, CAST(sum(maturity_event) AS BIGINT) AS maturities
FROM e GROUP BY 1, 2
"""


def default_audit(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.audit_defaults(panel.derive_events(_panel(spark, sf_dir)))


DEFAULT_AUDIT = f"""
WITH {_PANEL},
a AS (SELECT *, coalesce(max(first_default_event) OVER (PARTITION BY deal_id, loan_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen,
        lag(end_balance_cents) OVER (PARTITION BY deal_id, loan_id ORDER BY period_end) AS last_end, min(period_end) OVER (PARTITION BY deal_id) AS first_period FROM e)
SELECT deal_id, count(*) FILTER (first_default_event = 1) AS first_defaults, count(*) FILTER (first_default_event = 1 AND period_end = first_period) AS at_boundary,
       count(*) FILTER (first_default_event = 1 AND zero_balance_month IS NULL) AS effective_missing, count(*) FILTER (first_default_event = 1 AND zero_balance_month < month) AS effective_earlier,
       count(*) FILTER (first_default_event = 1 AND zero_balance_month = month) AS effective_same, count(*) FILTER (first_default_event = 1 AND zero_balance_month > month) AS effective_later,
       count(*) FILTER (seen = 1 AND last_end <= 0 AND end_balance_cents > 0) AS balance_returned
FROM a GROUP BY 1
"""


def disclosure_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.disclosure_features(panel.derive_events(_panel(spark, sf_dir)))
    return f.withColumns({"log_balance": F.round("log_balance", 9), "feature_available_at": F.to_date("feature_available_at"), "label_available_at": F.to_date("label_available_at")})


DISCLOSURE_ROWS = f"""
WITH {_PANEL},
n AS (SELECT *, row_number() OVER w AS k, first_default_event = 1 OR prepayment_event = 1 OR repurchase_event = 1 OR maturity_event = 1 AS terminal FROM e WINDOW w AS (PARTITION BY deal_id, loan_id ORDER BY period_end)),
t AS (SELECT *, coalesce(sum(CAST(terminal AS INT)) OVER (PARTITION BY deal_id, loan_id ORDER BY period_end ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS ended FROM n),
j AS (
  SELECT c.deal_id, c.loan_id, c.period_start, c.period_end, c.begin_balance_cents, c.first_default_event AS fde, c.prepayment_event AS pe, c.acceptance_time AS labelled_at, q.credit_score, q.orig_ltv_pct, q.interest_rate_pct,
         q.age_months, q.remaining_months, q.delinquency_days, q.end_balance_cents AS balance, q.acceptance_time AS seen_at,
         CAST((year(c.period_end) - year(q.period_end)) * 12 + month(c.period_end) - month(q.period_end) AS INT) AS lag, row_number() OVER (PARTITION BY c.deal_id, c.loan_id, c.period_end ORDER BY q.k DESC) AS place
  FROM t c JOIN t q ON q.deal_id = c.deal_id AND q.loan_id = c.loan_id AND q.k BETWEEN c.k - 4 AND c.k - 1
  WHERE q.acceptance_time <= CAST(c.period_start AS TIMESTAMP) AND q.period_end < c.period_start AND q.end_balance_cents > 0 AND c.ended = 0 AND c.begin_balance_cents > 0 AND c.repurchase_event = 0)
SELECT deal_id, loan_id, period_start, period_end, begin_balance_cents, credit_score, orig_ltv_pct, interest_rate_pct, CAST(age_months + lag AS INT) AS age_months,
       CASE WHEN remaining_months IS NOT NULL THEN CAST(greatest(remaining_months - lag, 0) AS INT) END AS remaining_months, delinquency_days, round(ln(1 + balance / 100e0), 9) AS log_balance,
       lag AS disclosure_lag_months, CAST(seen_at AS DATE) AS feature_available_at, CAST(labelled_at AS DATE) AS label_available_at, CAST(CASE WHEN fde = 1 THEN 1 WHEN pe = 1 THEN 2 ELSE 0 END AS INT) AS outcome
FROM j WHERE place = 1
"""


def first_event(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    return panel.earliest(e, ["user_id"], ["ts", "event_id"], ["ts", "event_id"]).withColumnRenamed("ts", "first_ts")


FIRST_EVENT = """
SELECT user_id, min(ts) AS first_ts, min(event_id) FILTER (ts = f) AS event_id
FROM (SELECT *, min(ts) OVER (PARTITION BY user_id) AS f FROM events WHERE event_type = 'error') GROUP BY user_id
"""


def event_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = panel.first_when(table(spark, sf_dir, "events"), ["user_id"], "ts", F.col("event_type") == "error", "first_error")
    before = F.coalesce(F.col("ts") < F.col("first_error"), F.lit(True))
    flag = lambda c: c.cast("int")
    return e.select("event_id", flag(F.coalesce(F.col("ts") == F.col("first_error"), F.lit(False))).alias("is_first_error"), flag((F.col("event_type") == "purchase") & before).alias("early_purchase"), flag((F.col("event_type") == "signup") & ~before).alias("late_signup"))


EVENT_FLAGS = """
SELECT event_id, CAST(coalesce(ts = f, false) AS INT) AS is_first_error,
       CAST(event_type = 'purchase' AND coalesce(ts < f, true) AS INT) AS early_purchase,
       CAST(event_type = 'signup' AND NOT coalesce(ts < f, true) AS INT) AS late_signup
FROM (SELECT *, min(ts) FILTER (event_type = 'error') OVER (PARTITION BY user_id) AS f FROM events)
"""


def _user_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").select("user_id", "event_type", _day("ts").alias("day"), double_cents(F.col("value")).alias("cents"))
    return e.groupBy("user_id", "day").agg(F.count("*").alias("n"), F.sum("cents").alias("cents"), F.count_if(F.col("event_type") == "error").alias("errors"), F.count_if(F.col("event_type") == "purchase").alias("purchases"))


_USER_DAYS = """days AS (
  SELECT user_id, CAST(ts AS DATE) AS day, count(*) AS n, CAST(sum(CAST(round(value * 100e0) AS BIGINT)) AS BIGINT) AS cents,
         count(*) FILTER (event_type = 'error') AS errors, count(*) FILTER (event_type = 'purchase') AS purchases
  FROM events GROUP BY 1, 2)"""


def lag_feature_asof(spark: SparkSession, sf_dir: str) -> DataFrame:
    usable = (F.date_add("p.day", 2) <= F.col("day")) & (F.col("p.cents") > 10_000)
    f = features.bounded_asof(_user_days(spark, sf_dir), ["user_id"], "day", ["day", "cents", "n"], usable, 4, "seen")
    return f.where("seen IS NOT NULL").select("user_id", "day", "cents", F.col("seen.day").alias("seen_day"), F.col("seen.cents").alias("seen_cents"), F.col("seen.rows_back").alias("rows_back"))


LAG_FEATURE_ASOF = f"""
WITH {_USER_DAYS}, numbered AS (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY day) AS k FROM days),
pairs AS (
  SELECT c.user_id, c.day, c.cents, p.day AS seen_day, p.cents AS seen_cents, CAST(c.k - p.k AS INT) AS rows_back,
         row_number() OVER (PARTITION BY c.user_id, c.day ORDER BY p.k DESC) AS place
  FROM numbered c JOIN numbered p ON p.user_id = c.user_id AND p.k BETWEEN c.k - 4 AND c.k - 1
  WHERE p.day + 2 <= c.day AND p.cents > 10000)
SELECT user_id, day, cents, seen_day, seen_cents, rows_back FROM pairs WHERE place = 1
"""


def prior_terminal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = features.prior_terminal(_user_days(spark, sf_dir), ["user_id"], "day", F.col("errors") >= 2)
    return f.where(~F.col("prior_terminal")).select("user_id", "day", "n", "errors", "cents")


PRIOR_TERMINAL = f"""
WITH {_USER_DAYS}, f AS (
  SELECT *, coalesce(sum(CAST(errors >= 2 AS INT)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM days)
SELECT user_id, day, n, errors, cents FROM f WHERE seen = 0
"""


def risk_set_outcomes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Outcome 1 on a day of errors, else 2 on a day of purchases, else 0, for days up to a user's first terminal one."""
    f = features.prior_terminal(_user_days(spark, sf_dir), ["user_id"], "day", F.col("errors") >= 3)
    outcome = F.when(F.col("errors") >= 3, 1).when(F.col("purchases") >= 2, 2).otherwise(0)
    return f.where(~F.col("prior_terminal")).groupBy(outcome.alias("outcome")).agg(F.count("*").alias("n"), F.countDistinct("user_id").alias("users"), F.min("day").alias("first_day"), F.max("day").alias("last_day"))


RISK_SET_OUTCOMES = f"""
WITH {_USER_DAYS}, f AS (
  SELECT *, coalesce(sum(CAST(errors >= 3 AS INT)) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS seen FROM days)
SELECT CAST(CASE WHEN errors >= 3 THEN 1 WHEN purchases >= 2 THEN 2 ELSE 0 END AS INT) AS outcome, count(*) AS n, count(DISTINCT user_id) AS users, min(day) AS first_day, max(day) AS last_day
FROM f WHERE seen = 0 GROUP BY 1
"""


def balance_returned(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Days on which a user's purchases come back after a day without any that followed errors."""
    f = panel.returned(_user_days(spark, sf_dir), ["user_id"], "day", F.col("errors") > 0, F.col("purchases"), "back")
    return f.groupBy("user_id").agg(F.count_if("back").alias("returned"), F.min("day").alias("first_day"), F.count("*").alias("days"))


BALANCE_RETURNED = f"""
WITH {_USER_DAYS}, f AS (
  SELECT *, max(errors) OVER (PARTITION BY user_id ORDER BY day ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS seen, lag(purchases) OVER (PARTITION BY user_id ORDER BY day) AS last FROM days)
SELECT user_id, count(*) FILTER (seen > 0 AND last = 0 AND purchases > 0) AS returned, min(day) AS first_day, count(*) AS days FROM f GROUP BY user_id
"""


def missing_fields(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Nulls by column after an outer join of customers to their orders."""
    c = table(spark, sf_dir, "customer").select("c_custkey")
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'").groupBy(F.col("o_custkey").alias("c_custkey")).agg(F.max("o_orderdate").alias("last_urgent"), F.count("*").alias("n_urgent"))
    m = panel.missing_counts(c.join(o, "c_custkey", "left"), ["c_custkey", "last_urgent", "n_urgent"])
    return m.select(F.explode("missing_fields").alias("field", "n_missing"))


MISSING_FIELDS = """
WITH j AS (SELECT c.c_custkey, o.last_urgent, o.n_urgent FROM customer c LEFT JOIN (
  SELECT o_custkey, max(o_orderdate) AS last_urgent, count(*) AS n_urgent FROM orders WHERE o_orderpriority = '1-URGENT' GROUP BY 1) o ON o.o_custkey = c.c_custkey)
SELECT 'c_custkey' AS field, count(*) FILTER (c_custkey IS NULL) AS n_missing FROM j
UNION ALL SELECT 'last_urgent', count(*) FILTER (last_urgent IS NULL) FROM j
UNION ALL SELECT 'n_urgent', count(*) FILTER (n_urgent IS NULL) FROM j
"""


def latest_snapshot(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", "o_orderdate", double_cents(F.col("o_totalprice")).alias("cents"))
    return panel.latest(o, ["o_custkey"], "o_orderdate")


LATEST_SNAPSHOT = """
SELECT o_custkey, o_orderkey, o_orderdate, CAST(round(o_totalprice * 100e0) AS BIGINT) AS cents
FROM (SELECT *, max(o_orderdate) OVER (PARTITION BY o_custkey) AS m FROM orders) WHERE o_orderdate = m
"""


def first_accepted(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").withColumn("month", _month("o_orderdate"))
    return panel.first_rows(o, ["o_custkey", "month"], [F.col("o_orderdate"), F.col("o_orderkey")]).select("o_custkey", "month", "o_orderkey", "o_orderdate", "o_orderstatus")


FIRST_ACCEPTED = """
SELECT o_custkey, month, o_orderkey, o_orderdate, o_orderstatus FROM (
  SELECT *, strftime(o_orderdate, '%Y-%m') AS month, row_number() OVER (PARTITION BY o_custkey, strftime(o_orderdate, '%Y-%m') ORDER BY o_orderdate, o_orderkey) AS k FROM orders) WHERE k = 1
"""


def duplicate_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    return panel.duplicate_keys(table(spark, sf_dir, "lineitem"), ["l_orderkey", "l_linenumber"])


DUPLICATE_KEYS = "SELECT l_orderkey, l_linenumber, count(*) AS n FROM lineitem GROUP BY 1, 2 HAVING count(*) > 1"


# ---- reconciliation --------------------------------------------------------


def _order_cents(spark: SparkSession, sf_dir: str) -> DataFrame:
    net = double_cents(F.col("l_extendedprice") * (1 - F.col("l_discount")))
    li = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(
        F.sum(double_cents(F.col("l_extendedprice"))).alias("gross"), F.sum(net).alias("net"), F.sum(double_cents(F.col("l_extendedprice")) - net).alias("discount"), F.count("*").alias("n_lines"), F.sum(F.when(F.col("l_returnflag") == "R", net)).alias("returned")
    )
    return li


_ORDER_CENTS = """li AS (
  SELECT l_orderkey AS o_orderkey, CAST(sum(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS BIGINT) AS gross,
         CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100e0) AS BIGINT)) AS BIGINT) AS net,
         CAST(sum(CAST(round(l_extendedprice * 100e0) AS BIGINT) - CAST(round(l_extendedprice * (1 - l_discount) * 100e0) AS BIGINT)) AS BIGINT) AS discount,
         count(*) AS n_lines, CAST(sum(CAST(round(l_extendedprice * (1 - l_discount) * 100e0) AS BIGINT)) FILTER (l_returnflag = 'R') AS BIGINT) AS returned
  FROM lineitem GROUP BY 1)"""


def tape_vs_certificate(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", double_cents(F.col("o_totalprice")).alias("reported_cents"))
    joined = o.join(_order_cents(spark, sf_dir), "o_orderkey", "left")
    f = panel.compare(joined, "gross", "reported_cents")
    return f.select("o_orderkey", F.col("gross").alias("computed_cents"), "reported_cents", "residual_cents", "status")


TAPE_VS_CERTIFICATE = f"""
WITH {_ORDER_CENTS}
SELECT o.o_orderkey, gross AS computed_cents, CAST(round(o_totalprice * 100e0) AS BIGINT) AS reported_cents, gross - CAST(round(o_totalprice * 100e0) AS BIGINT) AS residual_cents,
       CASE WHEN gross IS NULL THEN 'SKIPPED' WHEN gross = CAST(round(o_totalprice * 100e0) AS BIGINT) THEN 'PASS' ELSE 'DIFFERENCE' END AS status
FROM orders o LEFT JOIN li ON li.o_orderkey = o.o_orderkey
"""

_ORDER_RULES = (("net_of_discount", "+gross -discount", "net"), ("kept", "+net -returned", "gross"), ("header", "+gross", "total"))


def identity_checks(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_orderkey", double_cents(F.col("o_totalprice")).alias("total")).join(_order_cents(spark, sf_dir), "o_orderkey")
    names = ("gross", "discount", "net", "returned", "total")
    pairs = [F.struct(F.lit(n).alias("k"), F.col(n).cast("decimal(38,0)").alias("v")) for n in names]
    # An amount that is not there is no entry, as in a certificate.
    amounts = F.map_from_entries(F.filter(F.array(*pairs), lambda x: x["v"].isNotNull()))
    checks = reconcile.reconcile(o.select("o_orderkey", amounts.alias("amounts")), ["o_orderkey"], rules=_ORDER_RULES)
    return checks.select("o_orderkey", "check_id", *[F.col(c).cast("bigint").alias(c) for c in ("computed_cents", "reported_cents", "residual_cents")], "status")


IDENTITY_CHECKS = f"""
WITH {_ORDER_CENTS}, o AS (SELECT o.o_orderkey, CAST(round(o_totalprice * 100e0) AS BIGINT) AS total, gross, net, discount, returned FROM orders o JOIN li ON li.o_orderkey = o.o_orderkey),
c AS (SELECT o_orderkey, 'net_of_discount' AS check_id, gross - discount AS computed_cents, net AS reported_cents FROM o
  UNION ALL SELECT o_orderkey, 'kept', net - returned, gross FROM o UNION ALL SELECT o_orderkey, 'header', gross, total FROM o)
SELECT o_orderkey, check_id, computed_cents, reported_cents, computed_cents - reported_cents AS residual_cents,
       CASE WHEN computed_cents IS NULL OR reported_cents IS NULL THEN 'SKIPPED' WHEN computed_cents = reported_cents THEN 'PASS' ELSE 'FAIL' END AS status FROM c
"""


def check_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.summarize(identity_checks(spark, sf_dir), ["o_orderkey"])


CHECK_SUMMARY = f"""
SELECT o_orderkey, count(*) FILTER (status = 'PASS') AS passed, count(*) FILTER (status = 'FAIL') AS failed, count(*) FILTER (status = 'SKIPPED') AS skipped,
       CASE WHEN count(*) FILTER (status = 'FAIL') > 0 THEN 'FAIL' WHEN count(*) FILTER (status = 'SKIPPED') > 0 THEN 'INCOMPLETE' ELSE 'PASS' END AS status
FROM ({IDENTITY_CHECKS}) GROUP BY o_orderkey
"""


def gate_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return reconcile.gate_counts(identity_checks(spark, sf_dir))


GATE_COUNTS = f"""
SELECT check_id, count(*) FILTER (status = 'PASS') AS "PASS", count(*) FILTER (status = 'FAIL') AS "FAIL", count(*) FILTER (status = 'SKIPPED') AS "SKIPPED" FROM ({IDENTITY_CHECKS}) GROUP BY 1
"""


def pool_continuity(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    m = o.groupBy("c_mktsegment", _month("o_orderdate").alias("month")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("flow"))
    running = Window.partitionBy("c_mktsegment").orderBy("month")
    m = m.withColumn("pool_end", F.sum("flow").over(running.rowsBetween(Window.unboundedPreceding, 0))).withColumn("pool_begin", F.col("pool_end") - F.col("flow"))
    return valuation.continuity(m, ["c_mktsegment"], "month", "pool_begin", "pool_end").select("c_mktsegment", "month", "pool_begin", "prior_end", "residual")


POOL_CONTINUITY = """
WITH m AS (SELECT c_mktsegment, strftime(o_orderdate, '%Y-%m') AS month, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS flow FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
r AS (SELECT *, CAST(sum(flow) OVER (PARTITION BY c_mktsegment ORDER BY month ROWS UNBOUNDED PRECEDING) AS BIGINT) AS pool_end FROM m),
l AS (SELECT c_mktsegment, month, pool_end - flow AS pool_begin, lag(pool_end) OVER (PARTITION BY c_mktsegment ORDER BY month) AS prior_end FROM r)
SELECT c_mktsegment, month, pool_begin, prior_end, pool_begin - prior_end AS residual FROM l WHERE prior_end IS NOT NULL
"""


# ---- recoveries and cash ---------------------------------------------------

_HORIZON = 10


def recovery_curve(spark: SparkSession, sf_dir: str) -> DataFrame:
    e = table(spark, sf_dir, "events").withColumn("day", _day("ts"))
    first = e.where("event_type = 'error'").groupBy("user_id").agg(F.min("day").alias("first_day"))
    # A user has one first day; every day's purchases come in with zero where there were none.
    flows = e.join(first, "user_id").withColumn("lag", F.date_diff("day", "first_day")).groupBy("user_id", "lag").agg(F.sum(F.when(F.col("event_type") == "purchase", double_cents(F.col("value"))).otherwise(0)).alias("recovery_cents"))
    return recovery.recovery_curve(recovery.complete_cohort(flows, ["user_id"], _HORIZON), _HORIZON)


RECOVERY_CURVE = f"""
WITH first AS (SELECT user_id, min(CAST(ts AS DATE)) AS d FROM events WHERE event_type = 'error' GROUP BY 1),
flows AS (SELECT e.user_id, CAST(CAST(ts AS DATE) - d AS INT) AS lag, CAST(sum(CASE WHEN event_type = 'purchase' THEN CAST(round(value * 100e0) AS BIGINT) ELSE 0 END) AS BIGINT) AS cents FROM events e JOIN first USING (user_id) GROUP BY 1, 2),
inside AS (SELECT * FROM flows WHERE lag BETWEEN 0 AND {_HORIZON}),
complete AS (SELECT user_id FROM inside GROUP BY 1 HAVING count(DISTINCT lag) = {_HORIZON} + 1),
s AS (SELECT CAST(l AS INT) AS lag, CAST(coalesce(sum(cents), 0) AS BIGINT) AS recovery_cents FROM range({_HORIZON} + 1) t(l) LEFT JOIN (SELECT * FROM inside JOIN complete USING (user_id)) i ON i.lag = t.l GROUP BY 1)
SELECT lag, recovery_cents, CAST(sum(recovery_cents) OVER (ORDER BY lag) AS BIGINT) AS cumulative_cents FROM s
"""


def recovery_median_lag(spark: SparkSession, sf_dir: str) -> DataFrame:
    return recovery.median_lag(recovery_curve(spark, sf_dir), _HORIZON)


RECOVERY_MEDIAN_LAG = f"""
WITH c AS ({RECOVERY_CURVE}), t AS (SELECT max(cumulative_cents) AS total FROM c)
SELECT CAST(CASE WHEN max(total) > 0 THEN min(lag) FILTER (cumulative_cents * 2 >= total) ELSE {_HORIZON} END AS INT) AS median_lag FROM c, t
"""


def _monthly_tiers(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "orders").groupBy(_month("o_orderdate").alias("month"), F.col("o_orderpriority").alias("tier")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("due_cents"))


_TIERS = "t AS (SELECT strftime(o_orderdate, '%Y-%m') AS month, o_orderpriority AS tier, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS due_cents FROM orders GROUP BY 1, 2)"


def priority_waterfall(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfall.sequential_payment(_monthly_tiers(spark, sf_dir), ["month"], "tier", "due_cents", F.lit(2_000_000_000).cast("bigint"))


PRIORITY_WATERFALL = f"""
WITH {_TIERS}, p AS (SELECT *, least(due_cents, greatest(2000000000 - coalesce(CAST(sum(due_cents) OVER (PARTITION BY month ORDER BY tier ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS BIGINT), 0), 0)) AS paid FROM t)
SELECT month, tier, due_cents, paid, due_cents - paid AS unpaid FROM p
"""


def pro_rata_alloc(spark: SparkSession, sf_dir: str) -> DataFrame:
    return waterfall.proportional_payment(_monthly_tiers(spark, sf_dir), ["month"], "tier", "due_cents", F.lit(1_234_567_891).cast("bigint")).select("month", "tier", "due_cents", "paid")


PRO_RATA_ALLOC = f"""
WITH {_TIERS}, g AS (SELECT *, CAST(sum(due_cents) OVER (PARTITION BY month) AS HUGEINT) AS total FROM t),
b AS (SELECT *, least(CAST(1234567891 AS HUGEINT), total) AS cash, least(CAST(1234567891 AS HUGEINT), total) * due_cents // total AS base, least(CAST(1234567891 AS HUGEINT), total) * due_cents % total AS rest FROM g),
r AS (SELECT *, cash - sum(base) OVER (PARTITION BY month) AS spare, row_number() OVER (PARTITION BY month ORDER BY rest DESC, tier) AS k FROM b)
SELECT month, tier, due_cents, CAST(base + CAST(k <= spare AS INT) AS BIGINT) AS paid FROM r
"""


def recovery_queue(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = table(spark, sf_dir, "lineitem").groupBy(_month("l_shipdate").alias("month")).agg(F.sum(F.when(F.col("l_returnflag") == "R", double_cents(F.col("l_extendedprice"))).otherwise(0)).alias("default_cents"))
    m = m.withColumn("number", month_number(F.to_date("month", "yyyy-MM")))
    late = runoff.late_recoveries(m, [], "number", F.lit(0.3), F.lit(6))
    return m.join(late, "number", "left").fillna(0, ["recovery_cents"]).drop("number")


RECOVERY_QUEUE = """
WITH m AS (SELECT strftime(l_shipdate, '%Y-%m') AS month, CAST(sum(CASE WHEN l_returnflag = 'R' THEN CAST(round(l_extendedprice * 100e0) AS BIGINT) ELSE 0 END) AS BIGINT) AS default_cents FROM lineitem GROUP BY 1)
SELECT month, default_cents, coalesce(CAST((lag(default_cents, 6) OVER (ORDER BY month) * 3 + 5) // 10 AS BIGINT), 0) AS recovery_cents FROM m
"""


def rate_reset(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(_day("o_orderdate").alias("day"), double_cents(F.col("o_totalprice")).alias("cents"))
    fixings = o.groupBy("day").agg(F.max("cents").alias("rate"))
    periods = o.select(F.trunc("day", "month").alias("start")).distinct()
    return valuation.rate_in_force(periods, fixings, "start", "day", "rate")


RATE_RESET = """
WITH f AS (SELECT CAST(o_orderdate AS DATE) AS day, max(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS rate FROM orders GROUP BY 1),
p AS (SELECT DISTINCT CAST(date_trunc('month', o_orderdate) AS DATE) AS start FROM orders),
j AS (SELECT start, day, rate, row_number() OVER (PARTITION BY start ORDER BY day DESC) AS k FROM p JOIN f ON day < start)
SELECT p.start, j.day AS fixing_date, j.rate AS fixing_rate FROM p LEFT JOIN j ON j.start = p.start AND k = 2
"""


def accrual_start(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select("o_custkey", "o_orderkey", _day("o_orderdate").alias("day"))
    return valuation.accrual_periods(o, ["o_custkey"], "day", ["o_orderkey"], F.lit("1995-01-01").cast("date"))


ACCRUAL_START = """
SELECT o_custkey, o_orderkey, CAST(o_orderdate AS DATE) AS day, coalesce(lag(CAST(o_orderdate AS DATE)) OVER w, DATE '1995-01-01') AS accrual_start,
       CAST(CAST(o_orderdate AS DATE) - coalesce(lag(CAST(o_orderdate AS DATE)) OVER w, DATE '1995-01-01') AS BIGINT) AS days
FROM orders WINDOW w AS (PARTITION BY o_custkey ORDER BY CAST(o_orderdate AS DATE), o_orderkey)
"""


# ---- scoring ---------------------------------------------------------------


def _scored(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Labelled documents with an outcome of three classes and deterministic probabilities by length."""
    d = table(spark, sf_dir, "documents").select("doc_id", "lang", "source", "n_chars").join(table(spark, sf_dir, "labels"), "doc_id")
    outcome = F.when(F.col("toxic") == 1, 1).when(F.col("quality") == 0, 2).otherwise(0)
    p1 = F.round(F.lit(1.0) / (F.lit(2.0) + F.col("n_chars") / F.lit(1000.0)), 6)
    p2 = F.round(F.lit(100.0) / (F.lit(400.0) + F.col("n_chars")), 6)
    return d.select("doc_id", "lang", "source", "n_chars", outcome.alias("outcome"), p1.alias("p1"), p2.alias("p2")).withColumn("p0", 1 - F.col("p1") - F.col("p2"))


_SCORED = """s AS (
  SELECT d.doc_id, lang, source, n_chars, CASE WHEN toxic = 1 THEN 1 WHEN quality = 0 THEN 2 ELSE 0 END AS outcome,
         round(1e0 / (2e0 + n_chars / 1000e0), 6) AS p1, round(100e0 / (400e0 + n_chars), 6) AS p2
  FROM documents d JOIN labels l ON l.doc_id = d.doc_id)"""


def _r(c, digits: int = 9):
    return F.round(c, digits)


def constant_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scoring.constant_probabilities(_scored(spark, sf_dir))
    return p.select(*[_r(F.col(f"p{c}")).alias(f"p{c}") for c in range(3)])


CONSTANT_PROBS = f"""
WITH {_SCORED} SELECT round((count(*) FILTER (outcome = 0) + 1) / (count(*) + 3e0), 9) AS p0, round((count(*) FILTER (outcome = 1) + 1) / (count(*) + 3e0), 9) AS p1, round((count(*) FILTER (outcome = 2) + 1) / (count(*) + 3e0), 9) AS p2 FROM s
"""
_BANDS = [200, 1000, 5000]
_BAND_SQL = "CASE WHEN n_chars IS NULL THEN -1 WHEN n_chars <= 200 THEN 0 WHEN n_chars <= 1000 THEN 1 WHEN n_chars <= 5000 THEN 2 ELSE 3 END"


def transition_probs(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scoring.smoothed_cells(_scored(spark, sf_dir), [band(F.col("n_chars"), _BANDS)], ["band"], 100.0)
    return p.select("band", *[_r(F.col(f"p{c}")).alias(f"p{c}") for c in range(3)])


def _cells_sql(keys: str) -> str:
    share = lambda c: f"(SELECT (count(*) FILTER (outcome = {c}) + 1) / (count(*) + 3e0) FROM s)"
    cells = ", ".join(f"round((count(*) FILTER (outcome = {c}) + 100e0 * {share(c)}) / (count(*) + 100e0), 9) AS p{c}" for c in range(3))
    return f"WITH {_SCORED} SELECT {keys}, {cells} FROM s GROUP BY ALL"


TRANSITION_PROBS = _cells_sql(f"CAST({_BAND_SQL} AS INT) AS band")


def smoothed_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    p = scoring.smoothed_cells(_scored(spark, sf_dir), [band(F.col("n_chars"), _BANDS), F.col("lang")], ["band", "lang"], 100.0)
    return p.select("band", "lang", *[_r(F.col(f"p{c}")).alias(f"p{c}") for c in range(3)])


SMOOTHED_CELLS = _cells_sql(f"CAST({_BAND_SQL} AS INT) AS band, lang")


def cell_predictions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Cells learnt on three sources in four, predicted for the others, unseen cells with the overall shares."""
    s = _scored(spark, sf_dir).drop("p0", "p1", "p2")
    train, test = s.where(F.col("source") > "src12"), s.where(F.col("source") <= "src12")
    cells, names = [band(F.col("n_chars"), _BANDS), F.col("lang")], ["band", "language"]
    p = scoring.predict_cells(test, scoring.smoothed_cells(train, cells, names, 10.0), scoring.constant_probabilities(train), cells, names)
    return p.select("doc_id", *[_r(F.col(f"p{c}")).alias(f"p{c}") for c in range(3)])


CELL_PREDICTIONS = f"""
WITH {_SCORED}, tr AS (SELECT *, {_BAND_SQL} AS band FROM s WHERE source > 'src12'), te AS (SELECT *, {_BAND_SQL} AS band FROM s WHERE source <= 'src12'),
q AS (SELECT (count(*) FILTER (outcome = 0) + 1) / (count(*) + 3e0) AS q0, (count(*) FILTER (outcome = 1) + 1) / (count(*) + 3e0) AS q1, (count(*) FILTER (outcome = 2) + 1) / (count(*) + 3e0) AS q2 FROM tr),
c AS (SELECT band, lang, (count(*) FILTER (outcome = 0) + 10e0 * any_value(q0)) / (count(*) + 10e0) AS c0, (count(*) FILTER (outcome = 1) + 10e0 * any_value(q1)) / (count(*) + 10e0) AS c1, (count(*) FILTER (outcome = 2) + 10e0 * any_value(q2)) / (count(*) + 10e0) AS c2 FROM tr, q GROUP BY 1, 2)
SELECT doc_id, round(coalesce(c0, q0), 9) AS p0, round(coalesce(c1, q1), 9) AS p1, round(coalesce(c2, q2), 9) AS p2 FROM te CROSS JOIN q LEFT JOIN c ON c.band = te.band AND c.lang = te.lang
"""


def brier_logloss(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = scoring.clipped(_scored(spark, sf_dir))
    losses = scoring.log_loss(s)
    rates = scoring.event_rates(s, F.col("outcome") == 1, F.col("p1"))
    return losses.join(rates).select("n", _r("log_loss").alias("log_loss"), "observed_events", _r("observed_rate").alias("observed_rate"), _r("predicted_rate").alias("predicted_rate"), _r("brier").alias("brier"))


BRIER_LOGLOSS = f"""
WITH {_SCORED}, c AS (SELECT outcome, greatest(least(1 - p1 - p2, 1 - 1e-9), 1e-9) AS a0, greatest(least(p1, 1 - 1e-9), 1e-9) AS a1, greatest(least(p2, 1 - 1e-9), 1e-9) AS a2 FROM s),
p AS (SELECT outcome, a0 / (a0 + a1 + a2) AS b0, a1 / (a0 + a1 + a2) AS b1, a2 / (a0 + a1 + a2) AS b2 FROM c)
SELECT count(*) AS n, round(avg(-ln(CASE outcome WHEN 0 THEN b0 WHEN 1 THEN b1 ELSE b2 END)), 9) AS log_loss, count(*) FILTER (outcome = 1) AS observed_events,
       round(avg(CAST(outcome = 1 AS INT)), 9) AS observed_rate, round(avg(b1), 9) AS predicted_rate, round(avg((b1 - CAST(outcome = 1 AS INT)) * (b1 - CAST(outcome = 1 AS INT))), 9) AS brier FROM p
"""


def auc_avg_rank(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.rank_metrics(_scored(spark, sf_dir), F.col("outcome") == 1, F.col("p1"))
    return m.select("n", "pos", _r("auc").alias("auc"))


AUC_AVG_RANK = f"""
WITH {_SCORED}, r AS (SELECT CAST(outcome = 1 AS INT) AS y, rank() OVER (ORDER BY p1) + (count(*) OVER (PARTITION BY p1) - 1) / 2e0 AS k FROM s)
SELECT count(*) AS n, CAST(sum(y) AS BIGINT) AS pos, round((sum(k) FILTER (y = 1) - sum(y) * (sum(y) + 1) / 2e0) / (CAST(sum(y) AS DOUBLE) * (count(*) - sum(y))), 9) AS auc FROM r
"""


def average_precision(spark: SparkSession, sf_dir: str) -> DataFrame:
    m = scoring.rank_metrics(_scored(spark, sf_dir), F.col("outcome") == 2, F.col("p2"))
    return m.select(_r("average_precision").alias("average_precision"))


AVERAGE_PRECISION = f"""
WITH {_SCORED}, g AS (SELECT p2, count(*) AS n, count(*) FILTER (outcome = 2) AS pos FROM s GROUP BY 1),
c AS (SELECT pos, sum(n) OVER (ORDER BY p2 DESC) AS seen, sum(pos) OVER (ORDER BY p2 DESC) AS found FROM g)
SELECT round(sum(pos * (found / CAST(seen AS DOUBLE))) / sum(pos), 9) AS average_precision FROM c
"""


def calib_deciles(spark: SparkSession, sf_dir: str) -> DataFrame:
    c = scoring.calibration(_scored(spark, sf_dir), F.col("outcome") == 1, F.col("p1"), ["doc_id"])
    return c.select("bin", "n", _r("predicted").alias("predicted"), _r("observed").alias("observed"))


CALIB_DECILES = f"""
WITH {_SCORED}, r AS (SELECT *, row_number() OVER (ORDER BY p1, doc_id) AS k, count(*) OVER () AS t FROM s)
SELECT CAST(greatest(ceil(least(10, t) * (k - 1) / CAST(t - 1 AS DOUBLE)), 1) AS INT) AS bin, count(*) AS n, round(avg(p1), 9) AS predicted, round(avg(CAST(outcome = 1 AS INT)), 9) AS observed FROM r GROUP BY 1
"""


def monthly_exposure(spark: SparkSession, sf_dir: str) -> DataFrame:
    o = table(spark, sf_dir, "orders").select(F.col("o_orderdate").alias("period_end"), double_cents(F.col("o_totalprice")).alias("begin_balance_cents"), "o_orderstatus", F.when(F.col("o_orderpriority") < "3", 0.625).otherwise(0.25).alias("p"))
    return scoring.monthly_exposure(o, F.col("o_orderstatus") == "F", F.col("p"))


MONTHLY_EXPOSURE = """
WITH o AS (SELECT strftime(o_orderdate, '%Y-%m') AS period, CAST(round(o_totalprice * 100e0) AS BIGINT) AS b, o_orderstatus, CASE WHEN o_orderpriority < '3' THEN 0.625e0 ELSE 0.25e0 END AS p FROM orders)
SELECT period, CAST(round_even(sum(p * b), 0) AS BIGINT) AS predicted_balance_cents, CAST(sum(CASE WHEN o_orderstatus = 'F' THEN b ELSE 0 END) AS BIGINT) AS observed_event_balance_cents, CAST(sum(b) AS BIGINT) AS eligible_balance_cents FROM o GROUP BY 1
"""


def bootstrap(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Intervals of the event rate and the Brier score over 200 draws of whole sources."""
    s = _scored(spark, sf_dir)
    y = (F.col("outcome") == 1).cast("double")
    return scoring.cluster_bootstrap(s, ["source"], {"rate": y, "brier": (F.col("p1") - y) * (F.col("p1") - y)})


def mae_forecast(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Last month's and last year's value as forecasts of a segment's monthly sum."""
    o = table(spark, sf_dir, "orders").join(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment"), "o_custkey")
    m = o.groupBy("c_mktsegment", month_number(F.col("o_orderdate")).alias("m")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("cents"))
    w = Window.partitionBy("c_mktsegment").orderBy("m")
    errors = m.withColumns({"baseline": F.lag("cents", 12).over(w) - F.col("cents"), "model": F.lag("cents", 1).over(w) - F.col("cents")}).where("baseline IS NOT NULL")
    long = errors.select("c_mktsegment", F.expr("stack(2, 'baseline', baseline, 'model', model) AS (method, error)"))
    t = valuation.error_table(long, ["c_mktsegment"], "method", "error", "baseline", "model")
    return t.select("c_mktsegment", *[_r(F.col(c), 3).alias(c) for c in ("baseline_mae", "model_mae", "difference", "improvement_pct")])


MAE_FORECAST = """
WITH m AS (SELECT c_mktsegment, year(o_orderdate) * 12 + month(o_orderdate) AS m, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS cents FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1, 2),
e AS (SELECT c_mktsegment, lag(cents, 12) OVER w - cents AS b, lag(cents, 1) OVER w - cents AS p FROM m WINDOW w AS (PARTITION BY c_mktsegment ORDER BY m)),
a AS (SELECT c_mktsegment, avg(abs(CAST(b AS DOUBLE))) AS bm, avg(abs(CAST(p AS DOUBLE))) AS pm FROM e WHERE b IS NOT NULL GROUP BY 1)
SELECT c_mktsegment, round(bm, 3) AS baseline_mae, round(pm, 3) AS model_mae, round(pm - bm, 3) AS difference, round(CASE WHEN bm <> 0 THEN (bm - pm) / bm * 100 END, 3) AS improvement_pct FROM a
"""


# ---- projection and value --------------------------------------------------


def cohort_buckets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Line items as loans: a part's size is the term, the discount the rate, returned items were in default before; some terms and rates are missing."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    known = F.col("l_linenumber") != 3
    active = li.select(double_cents(F.col("l_extendedprice")).alias("end_balance_cents"), F.when(known, F.col("p_size") - 5).alias("remaining_months"), F.when(known, F.rint(F.col("l_discount") * 100).cast("double")).alias("interest_rate_pct"), (F.col("l_returnflag") == "R").alias("previously_defaulted"))
    return runoff.make_cohorts(active).withColumn("apr", F.round("apr", 9))


COHORT_BUCKETS = """
WITH a AS (
  SELECT CAST(round(l_extendedprice * 100e0) AS BIGINT) AS cents, CASE WHEN l_linenumber <> 3 THEN p_size - 5 END AS term, CASE WHEN l_linenumber <> 3 THEN round(l_discount * 100e0) END AS rate, l_returnflag = 'R' AS again
  FROM lineitem JOIN part ON p_partkey = l_partkey),
m AS (SELECT CAST(round_even(median(term) FILTER (term > 0), 0) AS INT) AS mt, median(rate) AS mr FROM a)
SELECT CAST(sum(cents) AS BIGINT) AS balance_cents, CAST(greatest(coalesce(term, mt), 1) AS INT) AS remaining_months, round(round_even(coalesce(rate, mr) * 10, 0) / 10 / 100, 9) AS apr, CASE WHEN again THEN 2e0 ELSE 1e0 END AS default_hazard_multiplier
FROM a, m GROUP BY 2, 3, 4
"""


def weighted_terms(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Balance-weighted and median rates by brand."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_brand", "p_size"), "l_partkey")
    w = double_cents(F.col("l_extendedprice")).cast("double")
    means = models.weighted_means(li, ["p_brand"], w, {"rate": F.col("l_discount"), "term": F.col("p_size").cast("double")})
    return means.join(li.groupBy("p_brand").agg(_r(F.median("l_tax"), 6).alias("median_tax")), "p_brand").withColumns({"rate": _r("rate", 8), "term": _r("term", 6)})


WEIGHTED_TERMS = """
SELECT p_brand, round(sum(round(l_extendedprice * 100e0) * l_discount) / sum(round(l_extendedprice * 100e0)), 8) AS rate,
       round(sum(round(l_extendedprice * 100e0) * p_size) / sum(round(l_extendedprice * 100e0)), 6) AS term, round(median(l_tax), 6) AS median_tax
FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1
"""
_MONTHS = 60


def runoff_fold(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sixty months of run-off of the cohorts by part size: per month, losses of 4 and prepayments of 13 per mille, level principal at 6 %."""
    li = table(spark, sf_dir, "lineitem").join(table(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), "p_size"), "l_partkey")
    cohorts = li.groupBy(F.greatest("p_size", F.lit(1)).alias("remaining_months")).agg(F.sum(double_cents(F.col("l_extendedprice"))).alias("balance_cents"))
    rates = {"apr": 0.06, "default_monthly": 0.004, "prepay_monthly": 0.013, "interest_factor": 0.97}
    paths = runoff.cohort_paths(cohorts.withColumns({name: F.lit(value) for name, value in rates.items()}), [], _MONTHS)
    return paths.groupBy("month").agg(*[F.sum(c).alias(f"{c}_cents") for c in ("loss", "prepay", "scheduled", "interest", "end")])


RUNOFF_FOLD = f"""
WITH RECURSIVE c AS (SELECT greatest(p_size, 1) AS term, CAST(sum(CAST(round(l_extendedprice * 100e0) AS BIGINT)) AS BIGINT) AS balance FROM lineitem JOIN part ON p_partkey = l_partkey GROUP BY 1),
r(term, month, loss, prepay, scheduled, interest, e) AS (
  SELECT term, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), balance FROM c
  UNION ALL
  SELECT term, month, l, p, s, CAST(round((b - (l + p) / 2e0) * rate * 0.97e0) AS BIGINT), rest - s FROM (
    SELECT *, CASE WHEN left_ <= 1 THEN rest ELSE least(rest, greatest(CAST(round(rest * rate / (1 - pow(1 + rate, -left_)) - rest * rate) AS BIGINT), 0)) END AS s FROM (
      SELECT *, b - l - p AS rest FROM (
        SELECT term, month + 1 AS month, e AS b, least(e, CAST(round(e * 0.004e0) AS BIGINT)) AS l, least(e - least(e, CAST(round(e * 0.004e0) AS BIGINT)), CAST(round(e * 0.013e0) AS BIGINT)) AS p, greatest(term - month, 1) AS left_, 0.06e0 / 12 AS rate
        FROM r WHERE month < {_MONTHS} AND e > 0))))
SELECT CAST(month AS INT) AS month, CAST(sum(loss) AS BIGINT) AS loss_cents, CAST(sum(prepay) AS BIGINT) AS prepay_cents, CAST(sum(scheduled) AS BIGINT) AS scheduled_cents, CAST(sum(interest) AS BIGINT) AS interest_cents, CAST(sum(e) AS BIGINT) AS end_cents FROM r WHERE month > 0 GROUP BY 1
"""


def competing_rates(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Monthly competing probabilities from a nation's shares of low and high balances."""
    c = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.count_if(F.col("c_acctbal") < 0) / (F.count("*") + 1)).alias("d"), (F.count_if(F.col("c_acctbal") > 7000) / (F.count("*") + 1)).alias("p"))
    d, p = competing_monthly(F.col("d"), F.col("p"))
    return c.select("c_nationkey", _r(d).alias("monthly_default"), _r(p).alias("monthly_prepay"))


COMPETING_RATES = """
WITH c AS (SELECT c_nationkey, count(*) FILTER (c_acctbal < 0) / (count(*) + 1e0) AS d, count(*) FILTER (c_acctbal > 7000) / (count(*) + 1e0) AS p FROM customer GROUP BY 1),
h AS (SELECT c_nationkey, -ln(1 - d) / 12 AS d, -ln(1 - p) / 12 AS p FROM c)
SELECT c_nationkey, round(CASE WHEN d + p = 0 THEN 0e0 ELSE (1 - exp(-(d + p))) * d / (d + p) END, 9) AS monthly_default, round(CASE WHEN d + p = 0 THEN 0e0 ELSE (1 - exp(-(d + p))) * p / (d + p) END, 9) AS monthly_prepay FROM h
"""


def _flows(spark: SparkSession, sf_dir: str) -> DataFrame:
    years = F.date_diff("l_shipdate", F.lit("1995-01-01").cast("date")) / F.lit(365.25)
    return table(spark, sf_dir, "lineitem").select("l_returnflag", double_cents(F.col("l_extendedprice")).cast("double").alias("cents"), years.alias("years"))


_FLOWS = "f AS (SELECT l_returnflag, round(l_extendedprice * 100e0) AS cents, date_diff('day', DATE '1995-01-01', CAST(l_shipdate AS DATE)) / 365.25e0 AS years FROM lineitem)"


def pv_wal(spark: SparkSession, sf_dir: str) -> DataFrame:
    f, keys = _flows(spark, sf_dir), ["l_returnflag"]
    both = valuation.value(f, keys, F.col("cents"), F.col("years"), F.lit(0.08)).join(valuation.average_life(f, keys, F.col("cents"), F.col("years")), keys)
    return both.withColumns({"pv": _r(F.col("pv") / 100, 0), "wal_years": _r("wal_years", 6)})


PV_WAL = f"WITH {_FLOWS} SELECT l_returnflag, round(sum(cents / pow(1.08e0, years)) / 100, 0) AS pv, round(sum(cents * years) / sum(cents), 6) AS wal_years FROM f GROUP BY 1"


def yield_sensitivity(spark: SparkSession, sf_dir: str) -> DataFrame:
    v = valuation.yield_sensitivity(_flows(spark, sf_dir), ["l_returnflag"], F.col("cents"), F.col("years"), 0.08, 0.01)
    return v.select("l_returnflag", "case", F.round("yield", 4).alias("yield"), _r(F.col("pv") / 100, 0).alias("pv"))


YIELD_SENSITIVITY = f"""
WITH {_FLOWS} SELECT l_returnflag, c AS "case", round(y, 4) AS yield, round(sum(cents / pow(1 + y, years)) / 100, 0) AS pv FROM f, (VALUES ('down', 0.07e0), ('base', 0.08e0), ('up', 0.09e0)) v(c, y) GROUP BY 1, 2, 3
"""


def enhancement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What stands below each order priority in a year, against the year's total."""
    o = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("y"), F.col("o_orderpriority").alias("rank")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("balance"))
    pool = F.sum("balance").over(Window.partitionBy("y"))
    f = valuation.enhancement(o.withColumn("pool", pool), ["y"], "rank", "balance", F.col("pool"), F.lit(0))
    return f.select("y", "rank", "balance", _r("enhancement_pct", 6).alias("enhancement_pct"))


ENHANCEMENT = """
WITH o AS (SELECT CAST(year(o_orderdate) AS INT) AS y, o_orderpriority AS rank, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS balance FROM orders GROUP BY 1, 2)
SELECT y, rank, balance, round((sum(balance) OVER (PARTITION BY y) - sum(balance) OVER (PARTITION BY y ORDER BY rank)) / CAST(sum(balance) OVER (PARTITION BY y) AS DOUBLE) * 100, 6) AS enhancement_pct FROM o
"""


def source_changes(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Customers with urgent orders in one year and not in the next, and the other way."""
    o = table(spark, sf_dir, "orders").where("o_orderpriority = '1-URGENT'")
    year = lambda y: o.where(F.year("o_orderdate") == y).select("o_custkey").distinct()
    return document_sources.set_changes(year(1996), year(1997), "o_custkey")


SOURCE_CHANGES = """
WITH a AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1996), b AS (SELECT DISTINCT o_custkey FROM orders WHERE o_orderpriority = '1-URGENT' AND year(o_orderdate) = 1997)
SELECT o_custkey, 'NEW' AS change FROM b WHERE o_custkey NOT IN (SELECT o_custkey FROM a) UNION ALL SELECT o_custkey, 'MISSING' FROM a WHERE o_custkey NOT IN (SELECT o_custkey FROM b)
"""


# ---- documents -------------------------------------------------------------


def doc_sha256(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "documents").select("doc_id", F.sha2("text", 256).alias("sha256"), F.octet_length("text").cast("bigint").alias("n_bytes"))


DOC_SHA256 = "SELECT doc_id, sha256(text) AS sha256, CAST(strlen(text) AS BIGINT) AS n_bytes FROM documents"


def keyword_screen(spark: SparkSession, sf_dir: str) -> DataFrame:
    d = table(spark, sf_dir, "documents")
    n = lambda p: F.regexp_count("text", F.lit(p)).cast("bigint")
    return d.select("doc_id", n(r"Licen[sc]ed under").alias("n_licence"), n(r"password=").alias("n_password"), n(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+").alias("n_dotted"))


KEYWORD_SCREEN = r"""
SELECT doc_id, CAST(len(regexp_extract_all(text, 'Licen[sc]ed under')) AS BIGINT) AS n_licence, CAST(len(regexp_extract_all(text, 'password=')) AS BIGINT) AS n_password,
       CAST(len(regexp_extract_all(text, '[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+')) AS BIGINT) AS n_dotted FROM documents
"""


def keyword_context(spark: SparkSession, sf_dir: str) -> DataFrame:
    return document_sources.keyword_hits(table(spark, sf_dir, "documents"), ["doc_id"], "text", r"Licen[sc]ed under").select("doc_id", F.col("hit_no").cast("bigint").alias("hit_no"), F.col("start").cast("bigint").alias("start"), "match", "before", "after")


KEYWORD_CONTEXT = """
WITH d AS (SELECT doc_id, regexp_split_to_array(text, 'Licen[sc]ed under') AS gaps, regexp_extract_all(text, 'Licen[sc]ed under') AS hits FROM documents)
SELECT doc_id, CAST(i - 1 AS BIGINT) AS hit_no,
       CAST(length(array_to_string(gaps[1:i], '')) + length(array_to_string(hits[1:i - 1], '')) AS BIGINT) AS start,
       hits[i] AS match, right(gaps[i], 40) AS before, left(gaps[i + 1], 40) AS after FROM (SELECT *, unnest(range(1, len(hits) + 1)) AS i FROM d)
"""


def html_cells(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The cells of the pages' menus, which are lists, laid out as tables."""
    html = F.col("html")
    for tag, cell in (("<ul>", "<table>"), ("</ul>", "</table>"), ("<li>", "<tr><td>"), ("</li>", "</td></tr>")):
        html = F.replace(html, F.lit(tag), F.lit(cell))
    rows = certificate_sources.html_rows(table(spark, sf_dir, "pages").select("page_id", html.alias("html")), "html")
    return rows.select("page_id", "row_no", F.array_join("cells", "|").alias("cells"))


HTML_CELLS = """
WITH p AS (SELECT page_id, regexp_extract_all(html, '<li>(.*?)</li>', 1) AS items FROM pages), r AS (SELECT page_id, items, unnest(range(1, len(items) + 1)) AS i FROM p)
SELECT page_id, CAST(i - 1 AS INT) AS row_no, trim(regexp_replace(regexp_replace(items[i], '<[^>]*>', '', 'g'), '\\s+', ' ', 'g')) AS cells FROM r
"""


def html_text(spark: SparkSession, sf_dir: str) -> DataFrame:
    return table(spark, sf_dir, "pages").select("page_id", document_sources.plain_text(F.col("html")).alias("text"))


# The entities that occur in the pages; &amp; comes last, as nothing is unescaped twice.
HTML_TEXT = r"""
WITH b AS (SELECT page_id, regexp_replace(html, '(?s)<[^>]*>', ' ', 'g') AS t FROM pages),
e AS (SELECT page_id, regexp_replace(replace(replace(replace(t, '&quot;', '"'), '&middot;', chr(183)), '&copy;', chr(169)), '&amp;?', '&', 'g') AS t FROM b)
SELECT page_id, trim(regexp_replace(t, '[\s\x{0b}\x{a0}]+', ' ', 'g'), ' ') AS text FROM e
"""


def stream_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    from ..streaming.ingest import event_counts

    c = event_counts(table(spark, sf_dir, "events"))
    return c.select(F.to_date("window.start").alias("day"), "event_type", "n", "cents")


STREAM_COUNTS = "SELECT CAST(ts AS DATE) AS day, event_type, count(*) AS n, CAST(sum(CAST(round(value * 100e0) AS BIGINT)) AS BIGINT) AS cents FROM events GROUP BY 1, 2"

_SQL_NAMES = (
    "loan_events", "panel_stats", "default_audit", "disclosure_rows", "first_event", "event_flags", "lag_feature_asof", "prior_terminal", "risk_set_outcomes", "balance_returned", "missing_fields", "latest_snapshot",
    "first_accepted", "duplicate_keys", "tape_vs_certificate", "identity_checks", "check_summary", "gate_counts", "pool_continuity", "recovery_curve", "recovery_median_lag",
    "priority_waterfall", "pro_rata_alloc", "recovery_queue", "rate_reset", "accrual_start", "constant_probs", "transition_probs", "smoothed_cells", "cell_predictions",
    "brier_logloss", "auc_avg_rank", "average_precision", "calib_deciles", "monthly_exposure", "mae_forecast", "cohort_buckets", "weighted_terms",
    "runoff_fold", "competing_rates", "pv_wal", "yield_sensitivity", "enhancement", "source_changes", "doc_sha256", "keyword_screen", "keyword_context", "stream_counts", "html_cells", "html_text",
)
QUERIES = {name: globals()[name] for name in (*_SQL_NAMES, "bootstrap")}
SQL = {name: globals()[name.upper()] for name in _SQL_NAMES}
