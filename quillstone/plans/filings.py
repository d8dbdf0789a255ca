"""Registered queries over filings: forecasts from what was public, with their SQL."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions.calendar import payment_date
from ..functions.money import double_cents
from ..operators import backtest
from ..operators.waterfall import NOTES
from ..sources import certificates as certificate_sources
from ..sources import documents
from . import core
from . import queries as base

_r = base._r
table = base.table

# ---- cash forecasts --------------------------------------------------------------

_TARGETS = ("1998-02-01", "1999-08-31")


def _filed(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The panel as filings: all loans of a deal's period are accepted at once, ten to sixty-one days after its end."""
    late = 10 + 17 * ((F.year("period_end") * 12 + F.month("period_end")) % 4)
    return core._events(spark, sf_dir).withColumn("acceptance_time", F.date_add("period_end", late).cast("timestamp"))


def _certificates(loans: DataFrame) -> DataFrame:
    """What the servicer of each deal reports for a period, on its last day."""
    total = lambda c: F.coalesce(F.sum(c), F.lit(0)).cast("bigint")
    f = loans.groupBy("deal_id", F.col("period_start").alias("collection_period_start"), F.col("period_end").alias("collection_period_end")).agg(
        total("chargeoff_cents").alias("gross_defaults"), total("principal_paid_cents").alias("principal_collections"), total("interest_paid_cents").alias("interest_collections"), total("end_balance_cents").alias("ending_pool"))
    return f.withColumns({"acceptance_time": F.col("collection_period_end").cast("timestamp"), "distribution_date": payment_date(F.col("collection_period_end"), F.lit(1))})


def _backtest(spark: SparkSession, sf_dir: str) -> tuple[DataFrame, DataFrame]:
    """(forecasts, certificates) of the periods in _TARGETS by three methods that learnt from earlier outcomes."""
    loans = _filed(spark, sf_dir)
    certificates = _certificates(loans)
    targets = certificates.where(F.col("collection_period_end").between(*_TARGETS))
    train, _ = core._split(spark, sf_dir)
    return backtest.forecasts(loans, certificates, targets, backtest.baselines(train)), certificates


def cash_origins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Which period each forecast starts from, and the payment date that follows."""
    loans = _filed(spark, sf_dir)
    certificates = _certificates(loans)
    return backtest.origin_certificates(backtest.origins(loans, certificates.where(F.col("collection_period_end").between(*_TARGETS))), certificates)


def cash_forecasts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every target, method and quantity: forecast, observed and error in cents."""
    return backtest.errors(*_backtest(spark, sf_dir))


def cash_assumptions(spark: SparkSession, sf_dir: str) -> DataFrame:
    made, _ = _backtest(spark, sf_dir)
    return made.select("deal_id", "target_period", "method", "bridge_months", *[_r(c).alias(c) for c in ("annual_default", "annual_prepayment", "uncapped_collection_ratio", "interest_collection_factor")])


def cash_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    s = backtest.scores(backtest.errors(*_backtest(spark, sf_dir)), "constant", "cohort")
    return s.select("deal_id", "quantity", "months", *[_r(c, 4).alias(c) for c in ("baseline_mae", "model_mae", "difference", "improvement_pct")])


_SUMS = ("coalesce(sum(chargeoff_cents), 0)", "coalesce(sum(principal_paid_cents), 0)", "coalesce(sum(interest_paid_cents), 0)", "coalesce(sum(end_balance_cents), 0)")
_ORIGINS = f"""{base._PANEL},
fl AS (SELECT * REPLACE (CAST(period_end + CAST(10 + 17 * ((year(period_end) * 12 + month(period_end)) % 4) AS INT) AS TIMESTAMP) AS acceptance_time) FROM e),
ce AS (SELECT deal_id, period_start, period_end, {', '.join(f'CAST({s} AS BIGINT) AS {q}' for s, q in zip(_SUMS, backtest.QUANTITIES))} FROM fl GROUP BY 1, 2, 3),
tg AS (SELECT *, CAST(period_start AS TIMESTAMP) AS origin FROM ce WHERE period_end BETWEEN DATE '{_TARGETS[0]}' AND DATE '{_TARGETS[1]}'),
og AS (SELECT tg.deal_id, tg.period_end AS target_period, origin, max(fl.period_end) AS snapshot_end FROM tg JOIN fl ON fl.deal_id = tg.deal_id AND acceptance_time <= origin AND CAST(fl.period_end AS TIMESTAMP) < origin GROUP BY 1, 2, 3),
oc AS (SELECT og.*, CAST((year(origin) - year(snapshot_end)) * 12 + month(origin) - month(snapshot_end) AS INT) AS bridge_months, ce.interest_collections AS source_interest_cents FROM og JOIN ce ON ce.deal_id = og.deal_id AND ce.period_end = snapshot_end)"""
_DATES = core.PAYMENT_DATES.strip().removeprefix("WITH ").split("d AS (SELECT DISTINCT")[0]
CASH_ORIGINS = f"""
WITH {_ORIGINS}, {_DATES} op AS (SELECT CAST(x AS DATE) AS open_day FROM range(DATE '1997-01-01', DATE '2000-12-31', INTERVAL 1 DAY) t(x) WHERE isodow(x) < 6 AND CAST(x AS DATE) NOT IN (SELECT day FROM h)),
ba AS (SELECT *, CAST(date_trunc('month', target_period) + INTERVAL 1 MONTH AS DATE) + 14 AS base FROM oc)
SELECT deal_id, target_period, origin, snapshot_end, bridge_months, source_interest_cents, min(open_day) AS forecast_distribution_date FROM ba JOIN op ON open_day BETWEEN base AND base + 10 GROUP BY ALL
"""
_BACKTEST = f"""{_ORIGINS}, {core._SPLIT},
ct AS (SELECT bucket, {', '.join(f'(count(*) FILTER (outcome = {c}) + 100e0 * any_value(q{c})) / (count(*) + 100e0) AS t{c}' for c in (1, 2))} FROM tr, q GROUP BY 1),
cc AS (SELECT cell, {', '.join(f'(count(*) FILTER (outcome = {c}) + 100e0 * any_value(q{c})) / (count(*) + 100e0) AS c{c}' for c in (1, 2))} FROM tr, q GROUP BY 1),
sn AS (SELECT oc.target_period, oc.origin, oc.bridge_months, oc.source_interest_cents, fl.* FROM oc JOIN fl ON fl.deal_id = oc.deal_id AND fl.period_end = snapshot_end AND acceptance_time <= origin),
pd AS (SELECT deal_id, loan_id, period_end AS d_end, acceptance_time AS d_at FROM fl WHERE first_default_event = 1),
s AS (SELECT sn.*, EXISTS (SELECT 1 FROM pd WHERE pd.deal_id = sn.deal_id AND pd.loan_id = sn.loan_id AND d_at <= origin AND CAST(d_end AS TIMESTAMP) < origin) AS again FROM sn),
md AS (SELECT deal_id, target_period, median(interest_rate_pct) AS mr FROM s GROUP BY 1, 2),
fa AS (SELECT deal_id, target_period, any_value(source_interest_cents) / (sum(greatest(begin_balance_cents, 0) * coalesce(interest_rate_pct, mr)) / 100e0 / 12) AS ratio FROM s JOIN md USING (deal_id, target_period) GROUP BY 1, 2),
ac AS (SELECT * FROM s WHERE end_balance_cents > 0),
mv AS (SELECT *, [{core._BUCKET}] AS bucket, [{core._CELL}] AS cell FROM (
  SELECT * REPLACE (CAST(age_months + bridge_months AS INT) AS age_months, CASE WHEN remaining_months IS NOT NULL THEN CAST(greatest(remaining_months - bridge_months, 0) AS INT) END AS remaining_months), bridge_months AS disclosure_lag_months FROM ac)),
sc AS (SELECT deal_id, target_period, 'constant' AS method, end_balance_cents AS w, q1 AS p1, q2 AS p2, again FROM mv, q
  UNION ALL SELECT deal_id, target_period, 'transition', end_balance_cents, coalesce(t1, q1), coalesce(t2, q2), again FROM mv CROSS JOIN q LEFT JOIN ct USING (bucket)
  UNION ALL SELECT deal_id, target_period, 'cohort', end_balance_cents, coalesce(c1, q1), coalesce(c2, q2), again FROM mv CROSS JOIN q LEFT JOIN cc USING (cell)),
rt AS (SELECT deal_id, target_period, method, sum(p1 * w) / sum(w) AS d, sum(p2 * w) / sum(w) AS p FROM sc WHERE NOT again GROUP BY 1, 2, 3),
an AS (SELECT *, 1 - exp(-12 * -ln(1 - (d + p)) * d / (d + p)) AS ad, 1 - exp(-12 * -ln(1 - (d + p)) * p / (d + p)) AS ap FROM rt),
gv AS (SELECT an.*, bridge_months, ratio, least(1e0, ratio) AS factor FROM an JOIN oc USING (deal_id, target_period) JOIN fa USING (deal_id, target_period))"""
CASH_ASSUMPTIONS = f"""
WITH {_BACKTEST}
SELECT deal_id, target_period, method, bridge_months, round(ad, 9) AS annual_default, round(ap, 9) AS annual_prepayment, round(ratio, 9) AS uncapped_collection_ratio, round(factor, 9) AS interest_collection_factor FROM gv
"""
_RUNOFF = f"""RECURSIVE {_BACKTEST},
mc AS (SELECT deal_id, target_period, CAST(round_even(median(remaining_months) FILTER (remaining_months > 0), 0) AS INT) AS mt, median(interest_rate_pct) AS ma FROM ac GROUP BY 1, 2),
co AS (SELECT deal_id, target_period, CAST(greatest(coalesce(remaining_months, mt), 1) AS INT) AS term, round_even(coalesce(interest_rate_pct, ma) * 10, 0) / 10 / 100 AS apr, again, CAST(sum(end_balance_cents) AS BIGINT) AS balance FROM ac JOIN mc USING (deal_id, target_period) GROUP BY ALL),
hz AS (SELECT co.*, method, bridge_months, factor, -ln(1 - (1 - pow(1 - ad, CASE WHEN again THEN 2e0 ELSE 1e0 END))) / 12 AS hd, -ln(1 - ap) / 12 AS hp FROM co JOIN gv USING (deal_id, target_period)),
g AS (SELECT row_number() OVER (ORDER BY deal_id, target_period, method, term, apr, again) AS id, *, apr / 12 AS rate, (1 - exp(-(hd + hp))) * hd / (hd + hp) AS md, (1 - exp(-(hd + hp))) * hp / (hd + hp) AS mp FROM hz),
w(id, month, b, loss, pre, sched, intr, e) AS (
  SELECT id, 0, CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), CAST(0 AS BIGINT), balance FROM g
  UNION ALL
  SELECT id, month, b, loss, pre, sched, CAST(round((b - (loss + pre) / 2e0) * rate * factor) AS BIGINT), perf - sched FROM (
    SELECT *, CASE WHEN left_ <= 1 THEN perf WHEN rate > 0 THEN least(perf, greatest(CAST(round(perf * rate / (1 - pow(1 + rate, -left_)) - perf * rate) AS BIGINT), 0)) ELSE least(perf, CAST(round(perf / CAST(left_ AS DOUBLE)) AS BIGINT)) END AS sched FROM (
      SELECT *, b - loss - pre AS perf FROM (
        SELECT *, least(b - loss, CAST(round(b * mp) AS BIGINT)) AS pre FROM (
          SELECT w.id, w.month + 1 AS month, w.e AS b, least(w.e, CAST(round(w.e * md) AS BIGINT)) AS loss, mp, rate, factor, greatest(term - w.month, 1) AS left_ FROM w JOIN g ON g.id = w.id WHERE w.e > 0 AND w.month < bridge_months))))),
fc AS (SELECT deal_id, target_period, method, CAST(sum(loss) AS BIGINT) AS gross_defaults, CAST(sum(sched + pre) AS BIGINT) AS principal_collections, CAST(sum(intr) AS BIGINT) AS interest_collections, CAST(sum(w.e) AS BIGINT) AS ending_pool
  FROM w JOIN g ON g.id = w.id WHERE month = bridge_months GROUP BY 1, 2, 3),
er AS ({' UNION ALL '.join(f"SELECT gv.deal_id, gv.target_period, gv.method, '{q}' AS quantity, coalesce(fc.{q}, 0) AS forecast_cents, ce.{q} AS observed_cents, coalesce(fc.{q}, 0) - ce.{q} AS error_cents FROM gv JOIN ce ON ce.deal_id = gv.deal_id AND ce.period_end = gv.target_period LEFT JOIN fc ON fc.deal_id = gv.deal_id AND fc.target_period = gv.target_period AND fc.method = gv.method" for q in backtest.QUANTITIES)})"""
CASH_FORECASTS = f"WITH {_RUNOFF} SELECT * FROM er"
CASH_SCORES = f"""
WITH {_RUNOFF}, ma AS (SELECT deal_id, quantity, count(DISTINCT target_period) AS months, avg(abs(error_cents)) FILTER (method = 'constant') AS b, avg(abs(error_cents)) FILTER (method = 'cohort') AS m FROM er GROUP BY 1, 2)
SELECT deal_id, quantity, months, round(b, 4) AS baseline_mae, round(m, 4) AS model_mae, round(m - b, 4) AS difference, CASE WHEN b <> 0 THEN round((b - m) / b * 100, 4) END AS improvement_pct FROM ma
"""

# ---- certificates ------------------------------------------------------------------

#: Rows of the made certificates: the section's number, then its lines, each with how many amounts it has.
_SECTIONS = {
    "1": "", "2": "", "3": "", "4": "", "5": "", "6": "", "8": "abcdefghi", "10": "", "15": "", "16": "", "17": "abc", "18": "ab", "20": "", "21": "", "23": "", "24": "", "26": "abc", "27": "", "28": "abcde",
    "30": "", "32": "", "34": "", "36": "", "39": "", "41": "ab", "44": "def", "45": "abcdefghijklmnopq", "50": "", "51": "", "55": "ab", "56": "", "57": "", "76": "", "77": "", "78": "",
}
_LINES = [section + line for section, lines in _SECTIONS.items() for line in (lines or ("",))]
_UNPRICED = ("6", "15", "16")  # rows whose cells hold no dollars
_PLACE = {key: at for at, key in enumerate(_LINES)}


def _issues(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A certificate for each priority and month of orders; n, the month's cents, is what its amounts follow from."""
    o = table(spark, sf_dir, "orders").groupBy(F.substring("o_orderpriority", 1, 1).alias("deal_id"), F.last_day("o_orderdate").alias("period")).agg(F.sum(double_cents(F.col("o_totalprice"))).alias("n"))
    paid = F.date_add("period", 15)
    name = F.when(F.col("n") % 5 == 0, F.lit("https://host/notice.htm")).otherwise(F.concat(F.lit("https://host/d/dex991"), F.date_format(paid, "MMddyy"), F.lit(".htm")))
    return o.select("deal_id", F.concat("deal_id", F.lit("-"), F.date_format("period", "yyyyMM")).alias("accession"), F.date_format("period", "yyyy-MM-dd").alias("report_period"), name.alias("url"), "period", paid.alias("paid"), "n")


def _made_pages(spark: SparkSession, sf_dir: str) -> DataFrame:
    """deal_id, accession, report_period, url, html: certificates as HTML, as servicers lay them out.

    The rows are a list of (key, heading, kind) that a transform fills in: one amount, two (half of the second ones negative), an
    amount that some issues do not report, or what stands in its place.
    """
    issues = _issues(spark, sf_dir)
    rows = []
    for section, lines in _SECTIONS.items():
        rows.append((section, f"<td>{section}.</td><td>Row &amp; section {section}</td>", {"6": "count", "15": "rate", "16": "rate"}.get(section, "none" if lines else "one")))
        rows += [(section + line, f"<td></td><td>{line}. of {section}</td>", "two" if section == "8" else "interest" if section + line in documents.INTEREST_ROWS else "one") for line in lines]
    listed = F.array(*[F.struct(F.lit(_PLACE.get(key, 0)).cast("bigint").alias("place"), F.lit(heading).alias("heading"), F.lit(kind).alias("kind")) for key, heading, kind in rows])
    n = F.col("n")

    def money(value: Column) -> Column:
        """$ in a cell of its own, thousands apart."""
        text = F.format_number(F.abs(value).cast("decimal(20,0)") / F.lit(100).cast("decimal(3,0)"), 2)
        return F.concat(F.lit("<td align=right><font size=2>$</font></td><td>&nbsp;</td><td>\n <b>"), F.when(value < 0, F.concat(F.lit("-"), text)).otherwise(text), F.lit("</b> </td>"))

    def row(x: Column) -> Column:
        place, kind = x["place"], x["kind"]
        amount = (n * (place + 3) + place) % 900_000_000
        cells = (
            F.when(kind == "none", F.lit(""))
            .when(kind == "count", F.concat(F.lit("<td>Loans</td><td>"), F.format_number(n % 70_000, 0), F.lit("</td><td></td>")))
            .when(kind == "rate", F.concat(F.lit("<td>30-day average</td><td>"), F.format_number((n % 900).cast("decimal(10,0)") / F.lit(100).cast("decimal(3,0)"), 2), F.lit("</td><td>%</td>")))
            .when((kind == "interest") & (n % (3 + place % 5) == 0), F.lit("<td>$</td><td>&mdash;</td>"))
            .when(kind == "two", F.concat(money(amount), money(F.when(n % 2 == 0, -amount).otherwise(amount))))
            .otherwise(money(amount))
        )
        return F.concat(F.lit("<tr>"), x["heading"], cells, F.lit("</tr>\n"))

    month = lambda day, shape: F.date_format(day, shape)
    covered = F.when(n % 7 == 0, F.date_sub("period", 40)).otherwise(F.trunc("period", "month"))
    head = [
        F.lit("<html><body><p>Servicer&rsquo;s Certificate</p><table>\n<tr><td>Collection Period</td><td></td><td>"), month(covered, "MM/dd/yy"), F.lit("-"), month("period", "MM/dd/yy"),
        F.lit("</td></tr><tr><td>Determination  Date</td><td>"), month(F.date_sub("paid", 3), "MM/dd/yyyy"), F.lit("</td></tr><tr><td>Distribution Date</td><td>"), month(F.when(n % 11 == 0, F.date_add("paid", 1)).otherwise(F.col("paid")), "MM/dd/yyyy"), F.lit("</td></tr>"),
    ]
    html = F.concat(*head, F.array_join(F.transform(listed, row), ""), F.lit("</table></body></html>"))
    return issues.select("deal_id", "accession", "report_period", "url", html.alias("html"))


def certificate_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The numbered rows of the certificates, read from their HTML: amounts as a list of cents."""
    rows = certificate_sources.html_rows(_made_pages(spark, sf_dir).select("accession", "html"), "html")
    n = documents.numbered_rows(rows, ["accession"])
    return n.select("accession", "row_key", F.array_join(F.transform("money_cents", lambda c: F.coalesce(c.cast("string"), F.lit("-"))), ",").alias("cents"))


def certificate_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Everything that a certificate states, a row for each fact, read from its HTML."""
    c = certificate_sources.certificates(_made_pages(spark, sf_dir))
    of_map = lambda name: F.transform(F.map_entries(name), lambda e: F.struct(F.concat(F.lit(f"{name}."), e["key"]).alias("fact"), e["value"].cast("string").alias("value")))
    one = lambda name, value: F.array(F.struct(F.lit(name).alias("fact"), value.cast("string").alias("value")))
    maps = [of_map(name) for name in ("amounts", "note_begin", "note_end", "interest", "principal", "expected", "additional_cash")]
    singles = [one(name, F.col(name)) for name in ("collection_period_start", "collection_period_end", "distribution_date", "reported_distribution_date", "outstanding_loan_count")]
    rest = [one("floating_note_rate", F.round(F.col("floating_note_rate") * 10_000, 0).cast("bigint")), one("missing_interest", F.array_join("missing_interest", ",")), one("exceptions", F.size("exceptions"))]
    return c.select("deal_id", "accession", F.explode(F.flatten(F.array(*maps, *singles, *rest))).alias("f")).select("deal_id", "accession", "f.*")


def _sql_amount(key: str, second: bool = False) -> str:
    value = f"((n * {_PLACE[key] + 3} + {_PLACE[key]}) % 900000000)"
    return f"(CASE WHEN n % 2 = 0 THEN -{value} ELSE {value} END)" if second else value


def _sql_missing(key: str) -> str:
    return f"n % {3 + _PLACE[key] % 5} = 0" if key in documents.INTEREST_ROWS else "false"


_ISSUES = """i AS (SELECT substr(o_orderpriority, 1, 1) AS deal_id, last_day(o_orderdate) AS period, CAST(sum(CAST(round(o_totalprice * 100e0) AS BIGINT)) AS BIGINT) AS n FROM orders GROUP BY 1, 2),
c AS (SELECT deal_id, deal_id || '-' || strftime(period, '%Y%m') AS accession, period, period + 15 AS paid, n FROM i)"""


def _sql_row(key: str) -> str:
    if key in _SECTIONS and _SECTIONS[key] or key in _UNPRICED:
        return f"SELECT accession, '{key}' AS row_key, '' AS cents FROM c"
    cents = f"CAST({_sql_amount(key)} AS VARCHAR)" + (f" || ',' || CAST({_sql_amount(key, True)} AS VARCHAR)" if key.startswith("8") else "")
    return f"SELECT accession, '{key}' AS row_key, CASE WHEN {_sql_missing(key)} THEN '-' ELSE {cents} END AS cents FROM c"


CERTIFICATE_ROWS = f"WITH {_ISSUES} " + " UNION ALL ".join(map(_sql_row, [*_LINES, *(section for section, lines in _SECTIONS.items() if lines)]))


def _sql_facts() -> dict[str, str]:
    """Each fact as an expression over a made certificate; null where it is absent."""
    facts = {f"amounts.{name}": _sql_amount(key) for name, key in documents.SIMPLE_ROWS.items()}
    total = lambda keys: "(" + " + ".join(map(_sql_amount, keys)) + ")"
    facts |= {f"amounts.{name}": total(keys) for name, keys in documents.SUMMED_ROWS.items()}
    missing = " OR ".join(map(_sql_missing, documents.INTEREST_ROWS))
    facts["amounts.total_note_interest"] = f"CASE WHEN {missing} THEN {_sql_amount(documents.TOTAL_ROW)} - {total(certificate_sources.PRINCIPAL_ROWS)} ELSE {total(documents.INTEREST_ROWS)} END"
    facts["amounts.note_end"] = _sql_amount("8i", True)
    for note, row, interest, principal in zip(NOTES, certificate_sources.BALANCE_ROWS, documents.INTEREST_ROWS, certificate_sources.PRINCIPAL_ROWS):
        facts |= {f"note_begin.{note}": _sql_amount(row), f"note_end.{note}": _sql_amount(row, True), f"principal.{note}": _sql_amount(principal)}
        facts[f"interest.{note}"] = f"CASE WHEN NOT ({_sql_missing(interest)}) THEN {_sql_amount(interest)} END"
    facts |= {f"expected.{name}": _sql_amount(key) for name, key in certificate_sources.EXPECTED_ROWS.items()}
    facts |= {f"additional_cash.{name}": _sql_amount(key) for name, key in certificate_sources.CASH_ROWS.items()}
    stated = "(CASE WHEN n % 11 = 0 THEN paid + 1 ELSE paid END)"
    facts |= {
        "collection_period_start": "CAST(date_trunc('month', period) AS DATE)", "collection_period_end": "period", "reported_distribution_date": stated, "distribution_date": f"CASE WHEN n % 5 = 0 THEN {stated} ELSE paid END",
        "outstanding_loan_count": "n % 70000", "floating_note_rate": "n % 900", "exceptions": "CAST(n % 11 = 0 AND n % 5 <> 0 AS INT) + CAST(n % 7 = 0 AS INT)",
        "missing_interest": "concat_ws(',', " + ", ".join(f"CASE WHEN {_sql_missing(key)} THEN '{note}' END" for note, key in zip(NOTES, documents.INTEREST_ROWS)) + ")",
    }
    return facts


CERTIFICATE_FACTS = f"WITH {_ISSUES}, f AS (" + " UNION ALL ".join(f"SELECT deal_id, accession, '{fact}' AS fact, CAST({value} AS VARCHAR) AS value FROM c" for fact, value in _sql_facts().items()) + ") SELECT * FROM f WHERE value IS NOT NULL"

_SQL_NAMES = ("cash_origins", "cash_forecasts", "cash_assumptions", "cash_scores", "certificate_rows", "certificate_facts")
QUERIES = {name: globals()[name] for name in _SQL_NAMES}
SQL = {name: globals()[name.upper()] for name in _SQL_NAMES}
