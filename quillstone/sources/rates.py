"""Official reference rates: JSON as the publisher serves it, with exact decimals, and coupons rebuilt from it."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..operators.audit import official_rate
from ..operators.valuation import rate_in_force

# The series' type, and the fields of a rate. Numbers are decimals, so that none passes through a double.
SERIES = "SOFRAI"
SCHEMA = "refRates array<struct<effectiveDate:string,type:string,average30day:decimal(18,8),average90day:decimal(18,8),average180day:decimal(18,8),index:decimal(24,10)>>"


def official_rates(replies: DataFrame, column: str, series: str = SERIES) -> DataFrame:
    """effective_date, average30day: one row a date of the publisher's JSON replies; of entries of one date the last counts.

    A reply that is not such JSON is an error, and so is an entry without a date or rate.
    """
    number = F.row_number().over(Window.partitionBy("effective_date").orderBy(F.desc("reply"), F.desc("at")))
    parsed = F.from_json(F.col(column), SCHEMA, {"mode": "FAILFAST"})
    entries = replies.select(F.col(column).alias("__text"), F.xxhash64(F.col(column)).alias("reply"), F.posexplode(parsed["refRates"]).alias("at", "r")).where(F.col("r.type") == series)
    day, rate = F.to_date("r.effectiveDate", "yyyy-MM-dd"), F.col("r.average30day")
    whole = F.when(day.isNull() | rate.isNull(), F.raise_error(F.lit("a rate without its date or value"))).otherwise(day)
    dated = entries.select("reply", "at", whole.alias("effective_date"), rate.alias("average30day"))
    return dated.withColumn("__n", number).where("__n = 1").select("effective_date", "average30day")


def rebuilt_coupons(periods: DataFrame, rates: DataFrame, start: str, coupon: Column, margin: str = "0.69") -> DataFrame:
    """``periods`` with fixing_date, official_rate (the second fixing before the start, and a margin, never below 0), difference and matches.

    ``coupon`` is the stated one, in percent. Without such a fixing all four are null but matches, which is false.
    """
    f = rate_in_force(periods, rates, start, "effective_date", "average30day")
    f = f.withColumn("official_rate", official_rate(F.col("fixing_rate"), margin)).drop("fixing_rate")
    f = f.withColumn("official_rate", F.when(F.col("fixing_date").isNotNull(), F.col("official_rate")))
    difference = (coupon.cast("decimal(18,8)") - F.col("official_rate")).cast("decimal(18,8)")
    return f.withColumn("difference", difference).withColumn("matches", F.coalesce(F.col("difference") == 0, F.lit(False)))
