"""Filings and records: queries against their SQL, and their operators on small frames."""

from __future__ import annotations

import datetime as dt
import glob
import gzip
import hashlib
import os
import random
import re
from decimal import Decimal, localcontext

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.operators import audit, display, features, models, scoring, valuation
from quillstone.plans import filings, records
from quillstone.sources import archives, certificates, documents, layout, rates, tapes
from quillstone.streaming import ingest

SF = "/root/testdata/sf0.001"


@pytest.mark.parametrize("name", [*filings.SQL, *records.SQL])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    sf = "/root/testdata/sf0.01" if name.startswith(("model", "cash")) else SF  # models and origins need rows
    for path in glob.glob(f"{sf}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = (filings.QUERIES | records.QUERIES)[name](spark, sf)
    names = sorted(got.columns)
    found = con.execute((filings.SQL | records.SQL)[name])
    assert sorted(d[0] for d in found.description) == names
    places = [[d[0] for d in found.description].index(n) for n in names]
    want = [tuple(row[i] for i in places) for row in found.fetchall()]
    rows = sorted(map(str, map(tuple, got.select(*names).collect())))
    assert rows and rows == sorted(map(str, want))


# ---- certificates


def test_html_rows_keep_the_page_and_skip_what_has_no_table(spark):
    pages = spark.createDataFrame([(1, "<table><tr><td> a\n b</td><th>c</th></tr><tr><td></td></table>"), (2, "<p>x</p>"), (3, None), (4, "<tr><td>&amp;<td>1")], "id int, html string")
    got = sorted((r.id, r.row_no, r.cells) for r in certificates.html_rows(pages, "html").collect())
    assert got == [(1, 0, ["a b", "c"]), (1, 1, [""]), (4, 0, ["&", "1"])]


def made_certificate(**changed):
    """HTML of a certificate whose row k holds k's place in dollars; ``changed`` replaces rows by key or cuts them (None)."""
    out = ["<table><tr><td>Collection Period</td><td>08/01/25-08/31/25</td></tr><tr><td>Distribution Date</td><td></td><td>09/15/2025</td></tr>"]
    for section, lines in filings._SECTIONS.items():
        cells = {"6": "<td>1,234</td>", "16": "<td>4.35</td><td>%</td>"}.get(section, "" if lines else f"<td>$</td><td>{filings._PLACE[section]}.00</td>")
        out.append(changed.get("r" + section, f"<tr><td>{section}.</td><td>label</td>{cells}</tr>"))
        for line in lines:
            key = section + line
            second = "<td>$</td><td>7.25</td>" if section == "8" else ""
            out.append(changed.get("r" + key, f"<tr><td></td><td>{line}. x</td><td>$</td><td>{filings._PLACE[key]}.00</td>{second}</tr>"))
    return "".join(row for row in out if row) + "</table>"


def parsed(spark, html, url="https://x/dex991091625.htm", period="2025-08-31"):
    pages = spark.createDataFrame([("D", "a", period, url, html, "kept")], "deal_id string, accession string, report_period string, url string, html string, note string")
    return certificates.certificates(pages).collect()[0]


def test_certificate_states_everything(spark):
    r = parsed(spark, made_certificate())
    at = lambda key: 100 * filings._PLACE[key]
    assert r.note == "kept" and r.outstanding_loan_count == 1234 and r.floating_note_rate == Decimal("0.0435")
    assert (r.collection_period_start, r.collection_period_end, r.distribution_date, r.reported_distribution_date) == (dt.date(2025, 8, 1), dt.date(2025, 8, 31), dt.date(2025, 9, 16), dt.date(2025, 9, 15))
    assert r.note_begin["A2b"] == at("8c") and r.note_end["D"] == 725 and r.interest["B"] == at("45f") and r.principal["A1"] == at("45i")
    assert r.expected["priority_principal"] == at("30") and r.additional_cash["advances"] == at("21") and r.amounts["reserve_release"] == at("55a") + at("55b") + at("56")
    assert r.header["Collection Period"] == "08/01/25-08/31/25" and r.missing_interest == [] and len(r.exceptions) == 1 and "exhibit on 2025-09-16" in r.exceptions[0]


def test_certificate_exceptions_and_absent_interest(spark):
    r = parsed(spark, made_certificate(r45b="<tr><td></td><td>b. x</td><td>$</td><td>&#xFFFD;</td></tr>"), url="https://x/other.htm", period="2025-09-30")
    assert r.missing_interest == ["A2a"] and "A2a" not in r.interest and r.distribution_date == r.reported_distribution_date
    assert r.amounts["total_note_interest"] == 100 * (filings._PLACE["45q"] - sum(filings._PLACE["45" + c] for c in "ijklmnop"))
    assert len(r.exceptions) == 1 and "filing ends 2025-09-30" in r.exceptions[0]


@pytest.mark.parametrize("changed,message", [({"r30": ""}, "row 30"), ({"r6": ""}, "no count of loans"), ({"r45i": "<tr><td></td><td>i. x</td><td>$</td><td>-</td></tr>"}, "row 45i"), ({"r1": "<tr><td>1.</td><td>$</td></tr>"}, "no amount")])
def test_certificates_that_lack_something_are_refused(spark, changed, message):
    with pytest.raises(Exception, match=message):
        parsed(spark, made_certificate(**changed))


def test_a_retired_floating_note_has_no_rate(spark):
    assert parsed(spark, made_certificate(r16="<tr><td>16.</td><td>none</td></tr>")).floating_note_rate is None


# ---- rates


def test_rates_in_force_by_plain_search(spark):
    rng = random.Random(4)
    first = dt.date(2020, 1, 1)
    fixings = [(first + dt.timedelta(days=rng.randint(0, 900)), float(n)) for n in range(400)]
    periods = [(first + dt.timedelta(days=rng.randint(-30, 960)), n) for n in range(500)] + [(None, -1)] + [(first + dt.timedelta(days=450), 1000 + n) for n in range(200)]
    f, p = spark.createDataFrame(fixings, "d date, r double"), spark.createDataFrame(periods, "s date, n int")
    for back, parts in ((1, 4), (2, 32), (3, 1), (7, 100)):
        got = {r.n: (r.fixing_date, r.fixing_rate) for r in valuation.rate_in_force(p, f, "s", "d", "r", back, parts).collect()}
        for start, n in periods:
            earlier = sorted(x for x in fixings if start and x[0] < start)
            assert got[n] == (earlier[-back] if len(earlier) >= back else (None, None))
    assert [tuple(r)[2:] for r in valuation.rate_in_force(p.limit(3), f.limit(0), "s", "d", "r").collect()] == [(None, None)] * 3


def test_rates_in_force_go_through_no_single_task(spark):
    f, p = spark.range(1000).select(F.timestamp_seconds("id").alias("d"), F.col("id").alias("r")), spark.range(1000).select(F.timestamp_seconds("id").alias("s"))
    assert "SinglePartition" not in valuation.rate_in_force(p, f, "s", "d", "r")._jdf.queryExecution().executedPlan().toString()


def test_official_rates_are_exact_and_the_last_counts(spark):
    reply = '{"refRates": [{"effectiveDate": "2025-01-02", "type": "SOFRAI", "average30day": 4.33115}, {"effectiveDate": "2025-01-02", "type": "SOFRAI", "average30day": 0.1}, {"effectiveDate": "2025-01-03", "type": "SOFR", "average30day": 9}]}'
    got = rates.official_rates(spark.createDataFrame([(reply,)], "t string"), "t").collect()
    assert [tuple(r) for r in got] == [(dt.date(2025, 1, 2), Decimal("0.10000000"))]
    for bad in ("{", '{"refRates": [{"effectiveDate": "2025-01-02", "type": "SOFRAI"}]}', '{"refRates": [{"type": "SOFRAI", "average30day": 1}]}'):
        with pytest.raises(Exception):
            rates.official_rates(spark.createDataFrame([(bad,)], "t string"), "t").collect()


def test_coupons_are_rebuilt(spark):
    given = spark.createDataFrame([(dt.date(2025, 1, 2), Decimal("4.30")), (dt.date(2025, 1, 3), Decimal("-2.00")), (dt.date(2025, 1, 6), Decimal("5.00"))], "effective_date date, average30day decimal(18,8)")
    periods = spark.createDataFrame([(dt.date(2025, 1, 6), Decimal("4.99")), (dt.date(2025, 1, 7), Decimal("0.00")), (dt.date(2025, 1, 3), Decimal("1"))], "start date, coupon decimal(18,8)")
    got = {r.start.day: (r.fixing_date, r.official_rate, r.matches) for r in rates.rebuilt_coupons(periods, given, "start", F.col("coupon")).collect()}
    assert got == {6: (dt.date(2025, 1, 2), Decimal("4.99"), True), 7: (dt.date(2025, 1, 3), Decimal(0), True), 3: (None, None, False)}


# ---- archives and tapes


def test_archives_are_hashed_in_pieces(spark, tmp_path, monkeypatch):
    plain = os.urandom(3_000_000)
    (tmp_path / "a.gz").write_bytes(gzip.compress(plain[:2_000_000]) + gzip.compress(plain[2_000_000:]))
    (tmp_path / "b.bin").write_bytes(plain)
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"\0" * 50_000_000))  # a thousandth of it archived
    (tmp_path / "empty").write_bytes(b"")
    (tmp_path / "_hidden").write_bytes(b"x")
    got = {os.path.basename(r.file): r for r in archives.archives(spark, str(tmp_path)).collect()}
    sha = lambda content: hashlib.sha256(content).hexdigest()
    assert sorted(got) == ["a.gz", "b.bin", "c.gz", "empty"]
    for name, content in (("a.gz", plain), ("b.bin", plain), ("c.gz", b"\0" * 50_000_000), ("empty", b"")):
        raw = (tmp_path / name).read_bytes()
        assert tuple(got[name])[1:] == (len(raw), sha(raw), len(content), sha(content))
    totals = audit.byte_totals(archives.archives(spark, str(tmp_path / "*.gz"))).collect()[0]
    assert (totals.sources, totals.original_bytes) == (2, 53_000_000)


def test_pieces_stay_small(tmp_path):
    (tmp_path / "c.gz").write_bytes(gzip.compress(b"\0" * 30_000_000))
    sizes = [len(piece) for piece in archives.plain_pieces(archives.raw_pieces(f"file://{tmp_path}/c.gz"))]
    assert sum(sizes) == 30_000_000 and max(sizes) <= archives.PIECE


def test_archives_that_are_cut_off_or_absent_fail(spark, tmp_path):
    (tmp_path / "a.gz").write_bytes(gzip.compress(os.urandom(100_000))[:-50])
    for path in ("a.gz", "none.gz"):
        with pytest.raises(Exception):
            archives.archives(spark, str(tmp_path / path)).collect()


NS = tapes.NAMESPACE
RECORD = "<assets><assetNumber>{}</assetNumber><reportingPeriodEndingDate>08-31-2025</reportingPeriodEndingDate>{}</assets>"


def tape(*records_, ns=NS, root="assetData"):
    return f'<?xml version="1.0"?>\n<{root} xmlns="{ns}">\n' + "\n".join(records_) + f"\n</{root}>"


def test_tapes_are_read_and_checked_in_one_scan(spark, tmp_path):
    (tmp_path / "a.xml.gz").write_bytes(gzip.compress(tape(*[RECORD.format(n, "<zeroBalanceCode>1</zeroBalanceCode><zeroBalanceCode>4</zeroBalanceCode><newField>x</newField>") for n in range(5000)]).encode()))
    (tmp_path / "b.xml").write_text(tape(RECORD.format(1, "<obligorCreditScore/>")))
    df = tapes.read(spark, str(tmp_path))
    assert df.count() == 5001
    rows = {(os.path.basename(r["__file"]), r.assetNumber): r for r in df.where("assetNumber IN ('1', '4999')").collect()}
    assert rows["a.xml.gz", "4999"].zeroBalanceCode == ["1", "4"] and rows["b.xml", "1"].zeroBalanceCode is None and rows["b.xml", "1"].obligorCreditScore is None
    assert df._jdf.queryExecution().executedPlan().toString().count("Scan") == 1


@pytest.mark.parametrize(
    "text,message",
    [
        (tape(RECORD.format(1, ""), ns="urn:other"), "unexpected root"), (tape(RECORD.format(1, ""), root="other"), "unexpected root"), (tape(RECORD.format(1, ""), RECORD.format(1, "")), "duplicate"),
        (tape(RECORD.format("", "")), "duplicate or missing"), (tape(RECORD.format(1, "<unheardOf>1</unheardOf><unheardOf>1</unheardOf>")), "repeated element unheardOf"),
        (tape(RECORD.format(1, "<x xmlns='urn:y'>1</x>")), "unexpected namespace"), (tape(RECORD.format(1, "").replace("<assets>", "<assets xmlns='urn:y'>")), "unexpected namespace"), (tape(RECORD.format(1, ""))[:-9], "no element found|unclosed"), ("", "no element found|no XML"),
    ],
)
def test_tapes_that_are_wrong_fail_as_they_are_read(spark, tmp_path, text, message):
    (tmp_path / "a.xml").write_text(text)
    with pytest.raises(Exception, match=message):
        tapes.read(spark, str(tmp_path / "a.xml")).collect()
    with pytest.raises(ValueError, match=message):
        tapes.load(spark, str(tmp_path / "a.xml"))


def test_a_read_tape_is_normalized_like_a_scanned_one(spark, tmp_path):
    from .test_engine import TAPE

    (tmp_path / "a.xml").write_text(TAPE % "")
    named = lambda df: df.withColumns({"deal_id": F.lit("D"), "accession": F.lit("x"), "acceptance_time": F.lit("2025-09-15T10:00:00Z"), "report_period": F.lit("2025-08-31")})
    one, two = (tapes.normalize(named(how(spark, str(tmp_path / "a.xml")))).collect() for how in (tapes.read, tapes.scan))
    assert one == two and len(one) == 1


# ---- keyword places


def test_keyword_places_with_many_hits(spark):
    text = "".join(f"é{'x' * (n % 7)}key{n}" for n in range(3000))
    hits = documents.keyword_hits(spark.createDataFrame([(1, text), (1, text), (2, "")], "id int, t string"), ["id"], "t", "key[0-9]+", 5)
    want = [(n, m.start(), m.group(), text[max(0, (text[: m.start()].rfind("y") + 1)) : m.start()][-5:]) for n, m in enumerate(re.finditer("key[0-9]+", text))]
    got = sorted((r.hit_no, r.start, r.match) for r in hits.collect())
    assert got == sorted([w[:3] for w in want] * 2)


# ---- streams


FILING = "accession string, sha256 string, loan_id string, cents long, due date, at timestamp, rate double"


def rows_of(accession, sha, numbers, cents=lambda n: 9_007_199_254_740_993 + n):
    return [(accession, sha, f"L{n}", cents(n), dt.date(2025, 8, 31) if n % 2 else None, dt.datetime(2025, 9, 1, 1, 2, 3, 456789), 0.1 * n) for n in numbers]


@pytest.fixture
def stream(spark, tmp_path):
    schema = spark.createDataFrame([], FILING).schema

    def arrive(*rows):
        spark.createDataFrame(list(rows), FILING).coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
        ingest.ingest(spark, str(tmp_path / "in"), schema, str(tmp_path / "out"), str(tmp_path / "checkpoint"), source_hash="sha256", row_keys=("loan_id",)).awaitTermination()

    arrive.stored = lambda: spark.read.parquet(str(tmp_path / "out"))
    arrive.record = lambda: sorted(tuple(r)[:3] for r in ingest.ingested_sources(spark, str(tmp_path / "checkpoint")).collect())
    arrive.missing = lambda: {r.filing: r.missing_fields for r in ingest.ingested_sources(spark, str(tmp_path / "checkpoint")).collect()}
    return arrive


def test_a_filing_may_come_in_parts_and_twice(spark, stream):
    """Each batch starts the stream anew from its checkpoint."""
    stream(*rows_of("a", "h1", range(3)), *rows_of("b", "h2", range(2)))
    assert stream.record() == [("a", "h1", 3), ("b", "h2", 2)]
    stream(*rows_of("a", "h1", range(2, 5)))  # the rest of the filing, and one row again
    stream(*rows_of("a", "h1", range(5)), *rows_of("c", "h3", [7]))  # all of it again
    assert stream.record() == [("a", "h1", 5), ("b", "h2", 2), ("c", "h3", 1)]
    assert stream.missing() == {"a": {"due": 3}, "b": {"due": 1}, "c": {}}
    got = sorted((tuple(r) for r in stream.stored().where("accession = 'a'").collect()), key=str)
    assert got == sorted(rows_of("a", "h1", range(5)), key=str)  # every digit, date and microsecond


@pytest.mark.parametrize("again,message", [(rows_of("a", "other", [9]), "source changed: a"), (rows_of("a", "h1", [1], lambda n: 1), "row changed: a L1")])
def test_a_changed_filing_is_refused_and_leaves_no_trace(spark, stream, again, message):
    stream(*rows_of("a", "h1", range(3)))
    with pytest.raises(Exception, match=message):
        stream(*again, *rows_of("z", "h9", [1]))
    assert stream.record() == [("a", "h1", 3)] and stream.stored().count() == 3


# ---- layout


def test_a_clustered_panel_needs_no_exchange(spark, tmp_path):
    rows = spark.range(20_000).select(F.concat(F.lit("D"), (F.col("id") % 2).cast("string")).alias("deal_id"), (F.col("id") % 997).cast("string").alias("loan_id"), F.date_add(F.lit("2025-01-01").cast("date"), (F.col("id") / 997).cast("int")).alias("period_end"), F.lit(1).alias("x"))
    table = layout.write_clustered(rows, "clustered_panel", f"file://{tmp_path}/panel", 8)
    from pyspark.sql import Window

    windowed = table.withColumn("n", F.row_number().over(Window.partitionBy("deal_id", "loan_id").orderBy("period_end")))
    plan = windowed._jdf.queryExecution().executedPlan().toString()
    assert "Exchange" not in plan and windowed.count() == 20_000
    assert "Exchange" not in table.groupBy("deal_id", "loan_id").agg(F.sum("x"))._jdf.queryExecution().executedPlan().toString()
    one = layout.loan_history(spark, "clustered_panel", "D0", "500")
    assert "EqualTo(loan_id,500)" in one._jdf.queryExecution().executedPlan().toString()
    (own,) = {r.f for r in one.select(F.input_file_name().alias("f")).distinct().collect()}
    import pyarrow.parquet as pq

    files = glob.glob(f"{tmp_path}/panel/*.parquet")
    assert len(files) == 8
    for file in files:
        loans = pq.read_table(file, columns=["deal_id", "loan_id"]).to_pylist()
        assert [(r["deal_id"], r["loan_id"]) for r in loans] == sorted((r["deal_id"], r["loan_id"]) for r in loans)
        if os.path.basename(file) != os.path.basename(own):
            os.remove(file)  # a look-up opens its own bucket alone
    assert one.count() == rows.where("deal_id = 'D0' AND loan_id = '500'").count() > 0


# ---- models, splits, draws, values


def test_samples_wait_for_their_labels(spark):
    day = dt.date.fromisoformat
    rows = spark.createDataFrame(
        [("A", "1", day("2025-06-01"), day("2025-06-30"), dt.datetime(2025, 8, 31), 0), ("A", "2", day("2025-06-01"), day("2025-06-30"), dt.datetime(2025, 9, 1), 1), ("A", "1", day("2025-10-01"), day("2025-10-31"), dt.datetime(2025, 11, 15), 2),
         ("A", "1", day("2026-02-01"), day("2026-02-28"), dt.datetime(2026, 3, 15), 0), ("B", "9", day("2026-02-01"), day("2026-02-28"), dt.datetime(2026, 3, 15), 1), ("B", "9", day("2025-06-01"), day("2025-06-30"), dt.datetime(2025, 7, 15), 1)],
        "deal_id string, loan_id string, period_start date, period_end date, label_available_at timestamp, outcome int").withColumn("feature_available_at", F.lit("2025-01-01").cast("timestamp"))
    of = models.samples(rows, "A", "B")
    assert {name: [tuple(r) for r in s.select("deal_id", "loan_id", "outcome").collect()] for name, s in of.items()} == {"training": [("A", "1", 0)], "calibration": [("A", "1", 2)], "later_months": [("A", "1", 0)], "unseen_deal": [("B", "9", 1)]}
    assert models.development_rows(rows, "A").count() == 1
    d = {r["sample"]: r for r in models.describe(of).collect()}
    assert d["unseen_deal"].deals == ["B"] and (d["training"].rows, d["training"].loans, d["training"].outcome_0) == (1, 1, 1)


def test_disclosed_rows_say_when_their_outcome_was_public(spark):
    from quillstone.plans import core

    rows = features.disclosure_features(core._events(spark, SF))
    assert rows.where("label_available_at < period_end OR feature_available_at > label_available_at").count() == 0


def test_a_fit_is_where_its_gradient_vanishes(spark):
    rows = spark.range(900).select(
        *[(F.col("id") % (n + 3)).cast("double").alias(c) for n, c in enumerate(models.FEATURES) if c != "credit_score"], F.when(F.col("id") % 11 > 2, (F.col("id") % 10).cast("double")).alias("credit_score"),
        F.when(F.col("id") % 9 == 0, 1).when(F.col("id") % 4 == 0, 2).otherwise(0).alias("outcome"), F.lit(dt.date(2025, 1, 31)).alias("period_end"))
    fitted = models.fit(rows)
    g = models.gradient(fitted, rows).collect()
    assert len(g) == 3 * (len(models.FEATURES) + 2) and max(abs(r.gradient) for r in g) < 1e-5
    other = models.gradient(fitted, rows.where("id % 9 != 0").withColumn("outcome", F.lit(0))).collect()
    assert max(abs(r.gradient) for r in other) > 0.01


def plain_counts(total, draws, seed, block):
    """The draws of multinomial_bootstrap in Python: {draw: counts of clusters}."""
    import math

    def hashed(name):
        return int(hashlib.md5(f"{name}|0".encode()).hexdigest()[:12], 16) / 2**48

    def successes(n, p, name):
        if n <= 0 or p <= 0:
            return 0
        if p >= 1:
            return n
        out = 0
        for part in range(-(-n // scoring.TRIALS)):
            m = min(n - part * scoring.TRIALS, scoring.TRIALS)
            u = int(hashlib.md5(f"{name}|{part}".encode()).hexdigest()[:12], 16) / 2**48
            term = total_ = (1 - p) ** m
            k = 0
            while total_ <= u and k < m:
                k += 1
                term = term * (m - k + 1) / k * (p / (1 - p))
                total_ += term
            out += k
        return out

    size = lambda low, high: min(high * block, total) - low * block
    out = {}
    for draw in range(draws):
        counts = [0] * total
        todo = [(0, math.ceil(total / block), total)]
        while todo:
            lo, hi, take = todo.pop()
            if not take:
                continue
            if hi - lo > 1:
                mid = (lo + hi) // 2
                left = successes(take, size(lo, mid) / size(lo, hi), f"{seed}|{draw}|{lo}|{hi}")
                todo += [(lo, mid, left), (mid, hi, take - left)]
                continue
            rest, left = take, size(lo, hi)
            for at in range(lo * block, min(hi * block, total)):
                counts[at] = successes(rest, 1 / left, f"{seed}|{draw}|cluster|{at}")
                rest, left = rest - counts[at], left - 1
        out[draw] = counts
    return out


@pytest.mark.parametrize("total,block", [(1, 4), (37, 4), (1300, 256)])
def test_draws_add_up_and_are_those_of_a_plain_version(spark, total, block):
    import numpy as np

    counts = plain_counts(total, 20, 7, block)
    assert all(sum(c) == total for c in counts.values())
    rows = spark.range(total * 2).select((F.col("id") % total).alias("k"), (F.col("id") % 13).cast("double").alias("y"))
    keys = sorted(range(total), key=lambda k: (int(hashlib.md5(str(k).encode()).hexdigest()[:8], 16) % 1024, str(k)))
    sums = {k: sum(float(i % 13) for i in (k, k + total)) for k in range(total)}
    means = [sum(c[at] * sums[k] for at, k in enumerate(keys)) / (2 * total) for c in counts.values()]
    (got,) = scoring.multinomial_bootstrap(rows, ["k"], {"y": F.col("y")}, draws=20, seed=7, block=block).collect()
    assert got.lower == pytest.approx(float(np.quantile(means, 0.025)), abs=1e-9) and got.upper == pytest.approx(float(np.quantile(means, 0.975)), abs=1e-9)


def test_draws_vary_as_those_with_replacement(spark):
    """Counts of a cluster over the draws: mean 1, variance 1 - 1 / n."""
    counts = [c for draw in plain_counts(200, 150, 3, 16).values() for c in draw]
    mean = sum(counts) / len(counts)
    assert mean == 1 and abs(sum((c - 1) ** 2 for c in counts) / len(counts) - (1 - 1 / 200)) < 0.05


def test_no_rows_draw_nothing(spark):
    assert scoring.multinomial_bootstrap(spark.range(0), ["id"], {"y": F.col("id")}).count() == 0


def test_exact_values_are_decimals_whatever_the_order(spark):
    rng = random.Random(8)
    flows = [(k, rng.randint(-(10**11), 10**13), rng.randint(0, 9000)) for k in "ab" for _ in range(300)] + [("c", None, 5), ("c", 5, None), ("d", 7, 0), ("d", -7, 0)]
    df = spark.createDataFrame(flows, "k string, cents long, days int")
    one, two = ({r.k: r.pv_text for r in valuation.exact_value(x, ["k"], F.col("cents"), F.col("days"), "0.08").collect()} for x in (df, df.repartition(7, F.rand(3))))
    assert one == two and Decimal(one["c"]) == 0 and Decimal(one["d"]) == 0
    with localcontext() as context:
        context.prec = 60
        for k in "ab":
            want = sum(Decimal(c) / Decimal("1.08") ** (Decimal(d) / Decimal("365.25")) for key, c, d in flows if key == k)
            assert abs(Decimal(one[k]) - want) < Decimal(10) ** -38 and one[k][:40] == f"{want:.60f}"[:40]
    double = {r.k: r.pv for r in valuation.value(df, ["k"], F.col("cents"), F.col("days") / F.lit(365.25), F.lit(0.08)).collect()}
    assert all(abs(double[k] / float(one[k]) - 1) < 1e-9 for k in "ab")


def test_exact_life(spark):
    df = spark.createDataFrame([("a", 100, 365), ("a", 300, 731), ("b", 0, 9)], "k string, cents long, days int")
    got = {r.k: r.wal_years for r in valuation.exact_life(df, ["k"], F.col("cents"), F.col("days")).collect()}
    assert got["b"] is None and abs(got["a"] - Decimal(100 * 365 + 300 * 731) / 400 / Decimal("365.25")) < Decimal("1e-12")


# ---- audits and display


def test_event_audit_in_one_pass(spark):
    day = dt.date.fromisoformat
    rows = [
        ("D", "1", day("2025-01-31"), 100, 0, 0, 100, "4", "2024-12", 1), ("D", "1", day("2025-02-28"), 0, 50, 0, None, None, None, 0), ("D", "1", day("2025-03-31"), 50, 40, 10, 5, None, None, 0),
        ("D", "2", day("2025-02-28"), 100, 90, 10, None, None, None, 0), ("E", "1", day("2025-02-28"), 10, 5, 5, 1, "1|4", "2025-02", 1),
    ]
    df = spark.createDataFrame(rows, "deal_id string, loan_id string, period_end date, begin_balance_cents long, end_balance_cents long, principal_paid_cents long, chargeoff_cents long, zero_balance_code string, zero_balance_month string, first_default_event int")
    found = audit.audit_events(df)
    got = {(r.level, r.deal_id, str(r.period_end)): r for r in found.collect()}
    top = got["all", None, "None"]
    assert (top.rows, top.first_observed_defaults, top.boundary_defaults, top.effective_month_earlier, top.effective_month_same, top.positive_end_first_defaults, top.positive_end_after_default) == (5, 2, 2, 1, 1, 1, 2)
    assert (top.returned_to_positive_after_default, top.chargeoffs_after_first_default, top.reinstated_loans, top.balance_identity_failures, top.balance_identity_residual_cents) == (1, 1, 1, 3, -50 - 5 - 1)
    assert got["deal", "D", "None"].rows == 4 and got["period", "D", "2025-02-28"].rows == 2 and len(got) == 1 + 2 + 4
    assert found._jdf.queryExecution().optimizedPlan().toString().count("Expand") == 1
    with pytest.raises(Exception, match="end_balance_cents is missing"):
        audit.audit_events(df.withColumn("end_balance_cents", F.lit(None).cast("long"))).collect()


def test_money_as_readers_see_it(spark):
    cents = [0, 5, -5, 123456789, -9_007_199_254_740_993, 100_000_000, -150_000_000, None]
    df = spark.createDataFrame([(c,) for c in cents], "c long").select("c", display.money_text(F.col("c")).alias("m"), display.accounting_text(F.col("c")).alias("a"), display.accounting_text(F.col("c"), True).alias("s"))
    got = {r.c: (r.m, r.a, r.s) for r in df.collect()}
    assert got[123456789] == ("$1,234,567.89", "$1,234,567.89", "$1.2m") and got[-5] == ("−$0.05", "($0.05)", "($0.05)") and got[None] == ("Unavailable", "$0.00", "$0.00")
    assert got[-9_007_199_254_740_993][0] == "−$90,071,992,547,409.93" and got[-150_000_000][2] == "($1.5m)" and got[0][0] == "$0.00"


def test_places_and_mentions(spark):
    c = spark.createDataFrame([("D", "MATCH", "2025-01", "a"), ("D", "DIFFERENCE", "2025-02", "b"), ("D", "DIFFERENCE", "2025-01", "z"), ("D", "DIFFERENCE", "2025-01", "c")], "deal_id string, status string, period_end string, name string")
    assert [r.name for r in display.differences_first(c, ["deal_id"]).orderBy("place").collect()] == ["c", "z", "b", "a"]
    m = spark.createDataFrame([(1, 3, "x"), (1, 1, "y"), (1, 2, "x"), (1, 4, "y")], "k int, o int, t string")
    assert [(r.t, r.place) for r in display.first_mentions(m, ["k"], "o", "t").orderBy("place").collect()] == [("y", 1), ("x", 2)]
