"""Months, full-month periods and payment dates."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F


def month_number(day: Column) -> Column:
    return F.year(day) * 12 + F.month(day)


def months_between(later: Column, earlier: Column) -> Column:
    """Whole calendar months, whatever the days."""
    return month_number(later) - month_number(earlier)


def parse_xml_date(text: Column) -> Column:
    """MM-dd-yyyy."""
    return F.to_date(text, "MM-dd-yyyy")


def parse_month(text: Column) -> Column:
    """MM/yyyy, as the first of the month."""
    return F.to_date(text, "MM/yyyy")


def is_full_month(start: Column, end: Column) -> Column:
    return (F.dayofmonth(start) == 1) & (F.last_day(start) == end)


def add_months_on(day: Column, months: Column, target_day: Column) -> Column:
    """The target day so many months on, or the month's last day if that is earlier."""
    first = F.add_months(F.trunc(day, "month"), months)
    return F.least(F.date_add(first, target_day - 1), F.last_day(first))


def federal_holidays(spark: SparkSession, first_year: int, last_year: int) -> DataFrame:
    """(day, name): United States federal holidays as observed; Saturdays move to Friday, Sundays to Monday.

    Fixed dates and nth weekdays by rule, one row each, for the years named.
    """
    fixed = [(1, 1, "New Year"), (7, 4, "Independence Day"), (11, 11, "Veterans Day"), (12, 25, "Christmas"), (6, 19, "Juneteenth")]
    # (month, weekday with Monday 1, which, name); -1 is the month's last.
    floating = [(1, 2, 3, "Martin Luther King Jr. Day"), (2, 2, 3, "Presidents Day"), (5, 2, -1, "Memorial Day"), (9, 2, 1, "Labor Day"), (10, 2, 2, "Columbus Day"), (11, 5, 4, "Thanksgiving")]
    years = spark.range(first_year, last_year + 1).select(F.col("id").cast("int").alias("y"))
    struct = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(d).alias("d"), F.lit(n).alias("name")) for m, d, n in fixed])
    days = years.select("y", F.explode(struct).alias("h")).where("h.name != 'Juneteenth' OR y >= 2021").select(F.make_date("y", "h.m", "h.d").alias("day"), "h.name")
    week = F.dayofweek("day")  # Sunday 1
    days = days.select(F.when(week == 7, F.date_sub("day", 1)).when(week == 1, F.date_add("day", 1)).otherwise(F.col("day")).alias("day"), "name")
    # dayofweek numbers: Monday 2, Thursday 5
    struct = F.array(*[F.struct(F.lit(m).alias("m"), F.lit(w).alias("w"), F.lit(k).alias("k"), F.lit(n).alias("name")) for m, w, k, n in floating])
    moved = years.select("y", F.explode(struct).alias("h")).select(F.make_date("y", "h.m", F.lit(1)).alias("first"), "h.*")
    at = F.date_add("first", (F.col("w") - F.dayofweek("first") + 7) % 7)
    last = F.date_sub(F.last_day("first"), (F.dayofweek(F.last_day("first")) - F.col("w") + 7) % 7)
    return days.unionByName(moved.select(F.when(F.col("k") == -1, last).otherwise(F.date_add(at, (F.col("k") - 1) * 7)).alias("day"), "name"))


def _is_closed(day: Column) -> Column:
    """A weekend, or a federal holiday by the rules of ``federal_holidays``."""
    week, month, of_month = F.dayofweek(day), F.month(day), F.dayofmonth(day)  # Sunday 1
    falls = lambda m, d: (month == m) & (of_month == d)
    closed = week.isin(1, 7)
    for m, d in ((1, 1), (7, 4), (11, 11), (12, 25), (6, 19)):
        before, after = F.date_sub(day, 1), F.date_add(day, 1)
        on = lambda other: (F.month(other) == m) & (F.dayofmonth(other) == d)  # noqa: B023, E731
        observed = falls(m, d) | ((week == 2) & on(before)) | ((week == 6) & on(after))
        closed = closed | (observed & (F.year(day) >= 2021) if (m, d) == (6, 19) else observed)
    for m, w, k in ((1, 2, 3), (2, 2, 3), (9, 2, 1), (10, 2, 2), (11, 5, 4)):
        closed = closed | ((month == m) & (week == w) & (F.ceil(of_month / 7) == k))
    return closed | ((month == 5) & (week == 2) & (of_month > 24))


def payment_date(previous: Column, months: Column) -> Column:
    """The 15th so many months on, moved past weekends and federal holidays; a column, so nothing is joined or collected."""
    base = add_months_on(previous.cast("date"), months, F.lit(15))
    days = F.transform(F.sequence(F.lit(0), F.lit(7)), lambda n: F.date_add(base, n))
    return F.get(F.filter(days, lambda day: ~_is_closed(day)), F.lit(0))


def distribution_dates(dates: DataFrame, column: str, months: str, out: str = "distribution_date") -> DataFrame:
    """``dates`` with ``out``, the payment date so many months after ``column``."""
    return dates.withColumn(out, payment_date(F.col(column), F.col(months)))
