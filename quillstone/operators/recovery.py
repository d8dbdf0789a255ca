"""Recovery cohorts of seasoned defaults."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def complete_cohort(flows: DataFrame, entity: list[str], horizon: int) -> DataFrame:
    """The rows of entities that were observed at every lag from 0 to the horizon."""
    inside = flows.where(F.col("lag").between(0, horizon))
    complete = inside.groupBy(*entity).agg(F.countDistinct("lag").alias("seen")).where(F.col("seen") == horizon + 1)
    return inside.join(complete, entity, "left_semi")


def recovery_curve(flows: DataFrame, horizon: int) -> DataFrame:
    """lag, recovery_cents, cumulative_cents for lags 0 to the horizon, zeros filled in."""
    spark = flows.sparkSession
    lags = spark.range(horizon + 1).select(F.col("id").cast("int").alias("lag"))
    sums = flows.groupBy("lag").agg(F.sum("recovery_cents").alias("recovery_cents"))
    filled = lags.join(sums, "lag", "left").fillna(0, ["recovery_cents"])  # horizon + 1 rows
    return filled.withColumn("cumulative_cents", F.sum("recovery_cents").over(Window.orderBy("lag").rowsBetween(Window.unboundedPreceding, 0)))


def median_lag(curve: DataFrame, horizon: int) -> DataFrame:
    """The first lag by which half of all recoveries had come; the horizon if there were none."""
    total = F.max("cumulative_cents").over(Window.partitionBy())
    reached = curve.select("lag", "cumulative_cents", total.alias("total")).agg(F.max("total").alias("total"), F.min(F.when(F.col("cumulative_cents") * 2 >= F.col("total"), F.col("lag"))).alias("lag"))
    return reached.select(F.when(F.col("total") > 0, F.col("lag")).otherwise(F.lit(horizon)).alias("median_lag"))


def seasoned_defaults(panel: DataFrame, horizon: int = 12) -> tuple[DataFrame, DataFrame]:
    """(defaults, flows): first defaults with a charge-off at least ``horizon`` months before the deal's last period,
    and their recoveries by months since; only loans seen in every month stay."""
    last = panel.groupBy("deal_id").agg(F.add_months(F.max("period_end"), -horizon).alias("cutoff"))
    keys = ["deal_id", "loan_id"]
    first = panel.where((F.col("first_default_event") == 1) & (F.col("chargeoff_cents") > 0)).select(*keys, F.col("period_end").alias("default_period"), F.col("chargeoff_cents").alias("default_principal_cents"))
    first = first.join(F.broadcast(last), "deal_id").where("default_period <= cutoff").drop("cutoff")  # a row per deal
    months = (F.year("period_end") - F.year("default_period")) * 12 + F.month("period_end") - F.month("default_period")
    flows = panel.select(*keys, "period_end", "recovery_cents").join(first, keys).withColumn("lag", months)
    complete = complete_cohort(flows, keys, horizon)
    return first.join(complete.select(*keys).distinct(), keys, "left_semi"), complete
