"""Cohorts of loans and their run-off, month by month."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.calendar import distribution_dates
from ..functions.rates import competing_monthly, scaled_hazard

LONGEST_TERM = 120
HORIZON = 180


def make_cohorts(active: DataFrame, pool_cents: int | None = None, keys: tuple[str, ...] = ()) -> DataFrame:
    """``keys``, balance_cents, remaining_months, apr, default_hazard_multiplier by term, rate and reinstatement; each key is a pool of its own.

    ``active``: end_balance_cents, remaining_months, interest_rate_pct, previously_defaulted. A missing term
    is the rounded median of known positive terms, a matured one 1; a missing rate is the median; rates
    round to a tenth of a point, halves to even. Terms above LONGEST_TERM, a sum other than
    ``pool_cents``, or no known term or rate at all are errors.
    """
    known = F.when(F.col("remaining_months") > 0, F.col("remaining_months"))
    medians = active.groupBy(*keys).agg(F.rint(F.percentile(known, 0.5)).cast("int").alias("__term"), F.percentile("interest_rate_pct", 0.5).alias("__apr"), F.max("remaining_months").alias("__longest"), F.sum("end_balance_cents").alias("__pool"))
    f = active.join(medians, list(keys)) if keys else active.join(F.broadcast(medians))  # one row
    wrong = F.col("__term").isNull() | F.col("__apr").isNull() | (F.col("__longest") > LONGEST_TERM)
    if pool_cents is not None:
        wrong = wrong | (F.col("__pool") != pool_cents)
    term = F.when(wrong, F.raise_error(F.lit("cohorts need known terms of at most 120 months, known rates and the stated pool"))).otherwise(F.greatest(F.rint(F.coalesce(F.col("remaining_months"), F.col("__term"))).cast("int"), F.lit(1)))
    apr = F.rint(F.coalesce(F.col("interest_rate_pct"), F.col("__apr")) * 10) / 10
    again = F.coalesce(F.col("previously_defaulted").cast("boolean"), F.lit(False))
    grouped = f.groupBy(*keys, term.alias("remaining_months"), apr.alias("apr_pct"), again.alias("reinstated")).agg(F.sum("end_balance_cents").alias("balance_cents"))
    return grouped.select(*keys, "balance_cents", "remaining_months", (F.col("apr_pct") / 100).alias("apr"), F.when(F.col("reinstated"), 2.0).otherwise(1.0).alias("default_hazard_multiplier"))


def _cents(amount: Column) -> Column:
    return F.round(amount, 0).cast("bigint")


def _let(value: Column, body: Callable[[Column], Column]) -> Column:
    """``body`` of a value that is worked out once: a name would copy its expression to each place of use."""
    return F.get(F.transform(F.array(value), body), 0)


def cohort_paths(cohorts: DataFrame, keys: list[str], horizon: int | Column = HORIZON) -> DataFrame:
    """One row per cohort and month: keys, month, begin, loss, prepay, scheduled, interest, end (cents). ``horizon`` may differ by row.

    Each cohort is folded over the months within its own row, by a higher-order function: cohorts
    need no exchange. Columns used: balance_cents, remaining_months, apr, default_monthly, prepay_monthly,
    interest_factor.
    """
    step_type = "array<struct<month:int,begin:bigint,loss:bigint,prepay:bigint,scheduled:bigint,interest:bigint,end:bigint>>"

    def month(path: Column, number: Column) -> Column:
        rate = F.col("apr") / 12
        term = F.greatest(F.col("remaining_months") - number + 1, F.lit(1))

        def of_balance(begin: Column) -> Column:
            return _let(F.least(begin, _cents(begin * F.col("default_monthly"))), lambda loss: of_loss(begin, loss))

        def of_loss(begin: Column, loss: Column) -> Column:
            return _let(F.least(begin - loss, _cents(begin * F.col("prepay_monthly"))), lambda prepay: of_prepay(begin, loss, prepay))

        def of_prepay(begin: Column, loss: Column, prepay: Column) -> Column:
            return _let(begin - loss - prepay, lambda performing: _let(level(performing), lambda scheduled: row(begin, loss, prepay, performing, scheduled)))

        def level(performing: Column) -> Column:
            annuity = performing * rate / (1 - F.pow(1 + rate, -term))
            due = F.least(performing, F.greatest(_cents(annuity - performing * rate), F.lit(0).cast("bigint")))
            return F.when(term <= 1, performing).when(rate > 0, due).otherwise(F.least(performing, _cents(performing / term)))

        def row(begin: Column, loss: Column, prepay: Column, performing: Column, scheduled: Column) -> Column:
            interest = _cents((begin - (loss + prepay) / 2) * rate * F.col("interest_factor"))
            return F.struct(number.alias("month"), begin.alias("begin"), loss.alias("loss"), prepay.alias("prepay"), scheduled.alias("scheduled"), interest.alias("interest"), (performing - scheduled).alias("end"))

        opening = F.when(F.size(path) == 0, F.col("balance_cents")).otherwise(F.get(path, F.size(path) - 1)["end"])
        return _let(opening, lambda begin: F.when((begin == 0) & (F.size(path) > 0), path).otherwise(F.array_append(path, of_balance(begin))))

    months = F.sequence(F.lit(1), horizon if isinstance(horizon, Column) else F.lit(horizon))
    path = F.aggregate(months, F.array().cast(step_type), month)
    return cohorts.select(*keys, F.explode(path).alias("m")).select(*keys, "m.*")


def late_recoveries(flows: DataFrame, keys: list[str], month: str, share: Column, lag: Column, out: str = "recovery_cents") -> DataFrame:
    """keys, ``month`` and ``out``: a share of a month's default_cents, rounded once, that comes in ``lag`` months later.

    lag() takes a constant and counts rows; lags may differ by row here, and months without defaults need not be there.
    """
    return flows.select(*keys, (F.col(month) + lag).alias(month), _cents(F.col("default_cents") * share).alias(out))


def project(cohorts: DataFrame, assumptions: DataFrame, *, horizon: int = HORIZON, require_closed: bool = True) -> DataFrame:
    """Pool cash flows of each scenario: one row per (scenario, month), with payment dates.

    ``assumptions``, a row per scenario, is broadcast: scenario, annual_default, annual_prepay,
    recovery_rate, recovery_lag, interest_factor, previous_distribution. Recoveries are a share of the pool's defaults
    ``recovery_lag`` months before, rounded once per month. Rows end with the last flow. Where
    ``require_closed`` and the pool or its recoveries outlast the horizon, it is an error.
    """
    keys = ["scenario"]
    scaled = scaled_hazard(F.col("annual_default"), F.col("default_hazard_multiplier"))
    default_monthly, prepay_monthly = competing_monthly(scaled, F.col("annual_prepay"))
    f = cohorts.join(F.broadcast(assumptions.select("scenario", "annual_default", "annual_prepay", "interest_factor")))
    f = f.withColumns({"default_monthly": default_monthly, "prepay_monthly": prepay_monthly})
    total = lambda c, out: F.sum(c).alias(out)
    pool = cohort_paths(f, keys, horizon).groupBy("scenario", "month").agg(
        total("begin", "pool_begin_cents"), total("end", "pool_end_cents"), total("scheduled", "scheduled_principal_cents"), total("prepay", "prepayment_cents"), total("loss", "default_cents"), total("interest", "interest_cents")
    )
    grid = assumptions.select("scenario", "recovery_rate", "recovery_lag", "previous_distribution", F.explode(F.sequence(F.lit(1), F.lit(horizon))).alias("month"))
    grid = distribution_dates(grid, "previous_distribution", "month")
    f = grid.join(pool, ["scenario", "month"], "left").fillna(0)
    late = late_recoveries(f, ["scenario"], "month", F.col("recovery_rate"), F.col("recovery_lag"))  # at most horizon rows each
    f = f.join(late.where(F.col("month") <= horizon), ["scenario", "month"], "left").fillna(0, ["recovery_cents"])
    after = Window.partitionBy("scenario").orderBy(F.col("month").desc()).rowsBetween(Window.unboundedPreceding, 0)
    all_months = Window.partitionBy("scenario")
    alive = (F.col("pool_begin_cents") > 0) | (F.col("recovery_cents") > 0)
    pending = F.sum(F.when(F.col("month") + F.col("recovery_lag") > horizon, F.round(F.col("default_cents") * F.col("recovery_rate"), 0)).otherwise(0)).over(all_months)
    left = F.max(F.when(F.col("month") == horizon, F.col("pool_end_cents"))).over(all_months)
    f = f.withColumns({"__open": (left > 0) | (pending > 0), "__alive": F.max(alive.cast("int")).over(after)}).where("__alive = 1")
    if require_closed:
        f = f.withColumn("month", F.when(F.col("__open"), F.raise_error(F.lit("the horizon does not exhaust the pool and its recoveries"))).otherwise(F.col("month")))
    cash = F.col("scheduled_principal_cents") + F.col("prepayment_cents") + F.col("interest_cents") + F.col("recovery_cents")
    return f.select(
        "scenario", "month", "distribution_date", "pool_begin_cents", "pool_end_cents", "scheduled_principal_cents", "prepayment_cents", "default_cents", "recovery_cents", "interest_cents",
        cash.alias("available_cash_cents"), (F.col("default_cents") - F.col("recovery_cents")).alias("net_loss_cents"),
    )
