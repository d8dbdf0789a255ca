"""What a reader is shown: amounts as text, orders of rows, running totals and selections."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MINUS = "\u2212"  # the sign, not the hyphen
UNKNOWN = "Unavailable"


def _thousands(cents: Column) -> Column:
    """Whole cents as dollars with commas, without a sign; exact beyond what a double holds."""
    return F.concat(F.lit("$"), F.format_number(F.abs(cents).cast("decimal(30,0)") / F.lit(100).cast("decimal(3,0)"), 2))


def money_text(cents: Column) -> Column:
    """$1,234.50, with a minus sign before it if negative; Unavailable for null."""
    return F.when(cents.isNull(), F.lit(UNKNOWN)).when(cents < 0, F.concat(F.lit(MINUS), _thousands(cents))).otherwise(_thousands(cents))


def accounting_text(cents: Column, compact: bool = False) -> Column:
    """$1,234.50, in parentheses if negative; ``compact`` writes a million and more as $1.2m. Null counts as 0."""
    amount = F.coalesce(cents, F.lit(0))
    text = _thousands(amount)
    if compact:
        millions = F.abs(amount).cast("decimal(30,0)") / F.lit(100_000_000).cast("decimal(9,0)")
        text = F.when(F.abs(amount) >= 100_000_000, F.concat(F.lit("$"), F.format_number(millions, 1), F.lit("m"))).otherwise(text)
    return F.when(amount < 0, F.concat(F.lit("("), text, F.lit(")"))).otherwise(text)


def differences_first(comparisons: DataFrame, keys: list[str]) -> DataFrame:
    """``comparisons`` with place, from 1 within ``keys``: rows whose status is DIFFERENCE, then by period and name."""
    order = Window.partitionBy(*keys).orderBy(F.col("status") != "DIFFERENCE", "period_end", "name")
    return comparisons.withColumn("place", F.row_number().over(order))


def certificates_first(sources: DataFrame, keys: list[str]) -> DataFrame:
    """``sources`` with place, from 1 within ``keys``: certificates before tapes, each by period and url."""
    order = Window.partitionBy(*keys).orderBy(F.col("kind") != "certificate", "report_period", "url")
    return sources.withColumn("place", F.row_number().over(order))


def first_mentions(rows: DataFrame, keys: list[str], order: str, text: str) -> DataFrame:
    """keys, ``text`` and place: each distinct text once, in the order in which it is first found."""
    firsts = rows.groupBy(*keys, text).agg(F.min(order).alias("__first"))
    return firsts.withColumn("place", F.row_number().over(Window.partitionBy(*keys).orderBy("__first", text))).drop("__first")


def cumulative(rows: DataFrame, keys: list[str], order: str, value: str, out: str) -> DataFrame:
    """``rows`` with ``out``, the running sum of ``value`` along ``order`` within ``keys``."""
    return rows.withColumn(out, F.sum(value).over(Window.partitionBy(*keys).orderBy(order).rowsBetween(Window.unboundedPreceding, 0)))


def latest_controls(comparisons: DataFrame) -> DataFrame:
    """The comparisons of each deal's newest period."""
    newest = F.max("period_end").over(Window.partitionBy("deal_id"))
    return comparisons.withColumn("__newest", newest).where(F.col("period_end") == F.col("__newest")).drop("__newest")


def keyed_totals(flows: DataFrame, selections: DataFrame, keys: list[str], amounts: list[str]) -> DataFrame:
    """``selections`` (any number of rows of ``keys``) with the count and the sums of the flows that bear those keys; 0 where none do."""
    sums = flows.groupBy(*keys).agg(F.count("*").alias("rows"), *[F.sum(c).alias(c) for c in amounts])
    return selections.join(sums, keys, "left").fillna(0, ["rows", *amounts])
