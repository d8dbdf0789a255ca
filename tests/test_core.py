"""Audits, packs and folds on small frames, and core queries against their SQL."""

from __future__ import annotations

import datetime as dt
import glob
import json
import os

import duckdb
import pytest
from pyspark.sql import functions as F

from quillstone.functions.calendar import distribution_dates
from quillstone.operators import audit
from quillstone.plans import core
from quillstone.sources import packs

SF = "/root/testdata/sf0.001"
DEC, JAN, FEB = dt.date(2024, 12, 31), dt.date(2025, 1, 31), dt.date(2025, 2, 28)


@pytest.mark.parametrize("name", ["known_fleet", "seasoned_recoveries", "default_candidates", "loan_moves", "payment_dates", "note_summary", "target_sensitivity", "pool_projection", "expanding_folds"])
def test_query_against_its_sql(spark, name):
    con = duckdb.connect()
    for path in glob.glob(f"{SF}/*.parquet"):
        con.execute(f"CREATE VIEW {os.path.basename(path).removesuffix('.parquet')} AS SELECT * FROM '{path}'")
    got = core.QUERIES[name](spark, SF)
    names = sorted(got.columns)
    found = con.execute(core.SQL[name])
    places = [[d[0] for d in found.description].index(n) for n in names]
    want = [tuple(row[i] for i in places) for row in found.fetchall()]
    assert sorted(map(str, map(tuple, got.select(*names).collect()))) == sorted(map(str, want))


def test_moves_see_gaps(spark):
    rows = [("D", "a", DEC, 10, 9), ("D", "a", JAN, 9, 8), ("D", "a", FEB, 8, 7), ("D", "b", DEC, 5, 4), ("D", "b", FEB, 4, 3)]
    got = {(r.period_end, r.move): (r.loans, r.balance_cents) for r in audit.loan_moves(spark.createDataFrame(rows, "deal_id string, loan_id string, period_end date, begin_balance_cents long, end_balance_cents long")).collect()}
    assert got == {(DEC, "ENTER"): (2, 15), (DEC, "LEAVE"): (1, 4), (JAN, "ROLL"): (1, 9), (FEB, "ROLL"): (1, 8), (FEB, "ENTER"): (1, 4)}


def test_alignment_and_columns(spark):
    a, b = spark.createDataFrame([(1,), (2,)], "k int"), spark.createDataFrame([(1,), (1,)], "k int")
    got = sorted((r.k, r.a, r.b) for r in audit.misaligned({"a": a, "b": b}, ["k"]).collect())
    assert got == [(1, 1, 2), (2, 1, 0)] and audit.misaligned({"a": a, "b": a}, ["k"]).count() == 0
    assert audit.require_columns(a, ["k"]).columns == ["k"]
    with pytest.raises(ValueError, match="x, y"):
        audit.require_columns(a, ["k", "x", "y"])


def test_widest_increasing_and_rate(spark):
    f = spark.createDataFrame([("f", 1, -0.5), ("f", 0, 0.5), ("f", 2, None), ("g", 3, None)], "k string, b int, gap double")
    assert {r.k: r.b for r in audit.widest(f, ["k"], "gap", "b").collect()} == {"f": 0, "g": 3}
    g = spark.createDataFrame([("x", 1, 1.0), ("x", 2, 2.0), ("y", 1, 2.0), ("y", 2, 2.0)], "k string, o int, v double")
    assert {r.k: r.increasing for r in audit.increasing(g, ["k"], "o", "v").collect()} == {"x": True, "y": False}
    r = spark.range(1).select(audit.official_rate(F.lit("4.33115")).cast("string").alias("up"), audit.official_rate(F.lit("-2")).cast("string").alias("floor")).first()
    assert (r.up, r.floor) == ("5.02115000", "0.00000000")


def test_ratio_falls_back(spark):
    f = spark.createDataFrame([("D", 100, 25), ("D", None, None), ("E", None, 5)], "deal_id string, chargeoff_cents long, recovery_cents long")
    assert {r.deal_id: r.recovery_ratio for r in audit.observed_recovery_ratio(f).collect()} == {"D": 0.25, "E": 0.3}


def test_payment_dates_bear_any_column(spark):
    f = spark.createDataFrame([(dt.date(2025, 1, 31), 1)], "day date, months int")
    assert distribution_dates(f, "day", "months").first().distribution_date == dt.date(2025, 2, 18)  # a Saturday, then a holiday


def test_packs(spark, tmp_path):
    results, record = tmp_path / "r.json", tmp_path / "s.json"
    with packs.recorded_run(results, record, {"panel": "x"}) as pack:
        assert json.loads(record.read_text())["status"] == packs.BUILDING
        pack["rows"] = packs.rows_of(spark.range(3).toDF("n"), ["n"])
    assert packs.read_pack(results)["rows"] == [{"n": 0}, {"n": 1}, {"n": 2}]
    assert json.loads(record.read_text())["results_sha256"] == packs.identity({"r": results})["r"]
    with pytest.raises(ValueError):
        with packs.recorded_run(results, record, {}) as pack:
            pack["bad"] = float("nan")
    with pytest.raises(ValueError, match="FAILED"):
        packs.read_pack(results)
    with pytest.raises(ValueError):
        packs.rows_of(spark.range(3).toDF("n"), ["n"], most=2)
    packs.write_csv(tmp_path / "t.csv", [{"a": 1, "b": "x,y"}], ["a", "b"])
    assert (tmp_path / "t.csv").read_text() == 'a,b\n1,"x,y"\n'
    assert [packs.gate(*x)["status"] for x in ((0, 2), (1, 2), (0, 0))] == ["PASS", "FAIL", "INCOMPLETE"]


def test_panel_is_dealt_by_rows(spark, monkeypatch):
    """A task's share of the panel is bounded by rows, exchanged and sorted once: Spark would merge such small parts by their bytes."""
    from quillstone.operators import features
    from quillstone.plans import queries

    monkeypatch.setattr(queries, "_TASK_ORDERS", 100, raising=False)
    rows = features.disclosure_features(core._events(spark, SF))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange ") == 1 and plan.count("Sort [") == 1
    shares = rows.groupBy(F.spark_partition_id()).count().collect()
    orders = spark.read.parquet(f"{SF}/orders.parquet").count()
    assert orders // 100 // 2 < len(shares) <= -(-orders // 100)


def test_models_read_the_panel_once(spark, monkeypatch):
    """Samples, folds and fits read the modeling rows as written, whatever number of passes they take."""
    from quillstone.plans import records

    made, held = [], core._events
    monkeypatch.setattr(core, "_events", lambda *of: made.append(of) or held(*of))
    for rows in (*records._samples(spark, SF).values(),):
        plan = rows._jdf.queryExecution().executedPlan().toString()
        assert "Window" not in plan and "Exchange" not in plan
    assert len(made) == 1
