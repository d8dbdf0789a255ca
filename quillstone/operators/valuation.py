"""Present values, average lives, enhancement and yield sensitivity of note flows."""

from __future__ import annotations

from collections.abc import Callable
from decimal import ROUND_HALF_EVEN, Decimal, localcontext

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import present_value

YEAR = 365.25


def years_from(origin: Column, day: Column) -> Column:
    return F.date_diff(day, origin) / F.lit(YEAR)


def value(flows: DataFrame, keys: list[str], flow: Column, years: Column, rate: Column) -> DataFrame:
    """keys, pv: discounted sums in the flow's unit."""
    return flows.groupBy(*keys).agg(F.sum(present_value(flow, years, rate)).alias("pv"))


def average_life(flows: DataFrame, keys: list[str], principal: Column, years: Column) -> DataFrame:
    """keys, wal_years: years weighted by principal; null where there is none."""
    paid = F.sum(principal)
    return flows.groupBy(*keys).agg(F.when(paid != 0, F.sum(principal * years) / paid).alias("wal_years"))


def note_summary(flows: DataFrame, origin: Column, rate: float) -> DataFrame:
    """A row per (scenario, note) of waterfall.note_flows.

    opening and closing balance, interest, principal, loss, present value, price per 100 of opening balance, wal (only
    if fully repaid), paid_wal and recovery_share. Nothing is divided by an opening balance of zero.
    """
    f = flows.withColumns({"__years": years_from(origin, F.to_date("distribution_date")), "__cash": F.col("interest_cents") + F.col("principal_cents")})
    first, last = F.min_by("begin_cents", "month"), F.max_by("end_cents", "month")
    weighted = F.sum(F.col("principal_cents") * F.col("__years"))
    s = f.groupBy("scenario", "note").agg(
        first.alias("opening_cents"), last.alias("closing_cents"), F.sum("interest_cents").alias("interest_cents"), F.sum("principal_cents").alias("principal_cents"),
        F.max("loss_cents").alias("loss_cents"), F.max_by("shortfall_cents", "month").alias("shortfall_cents"), weighted.alias("__weighted"),
        F.sum(present_value(F.col("__cash"), F.col("__years"), F.lit(rate))).alias("pv_cents"),
    )
    repaid = (F.col("opening_cents") > 0) & (F.col("closing_cents") == 0) & (F.col("loss_cents") == 0)
    return s.select(
        "scenario", "note", "opening_cents", "closing_cents", "interest_cents", "principal_cents", "loss_cents", "shortfall_cents", "pv_cents",
        F.when(F.col("opening_cents") > 0, 100 * F.col("pv_cents") / F.col("opening_cents")).alias("price_per_100"),
        F.when(repaid, F.col("__weighted") / F.col("opening_cents")).alias("wal_years"),
        F.when(F.col("principal_cents") > 0, F.col("__weighted") / F.col("principal_cents")).alias("paid_wal_years"),
        F.when(F.col("opening_cents") > 0, F.col("principal_cents") / F.col("opening_cents")).alias("recovery_share"),
    )


def yield_sensitivity(flows: DataFrame, keys: list[str], flow: Column, years: Column, base: float, shift: float) -> DataFrame:
    """keys, case, yield, pv at the base yield and at a shift up and down, floored at 0. Flows are exploded by the three yields, which are literals."""
    cases = F.array(*[F.struct(F.lit(name).alias("case"), F.lit(y).alias("yield")) for name, y in (("down", max(0.0, base - shift)), ("base", base), ("up", base + shift))])
    f = flows.withColumns({"__flow": flow, "__years": years}).select(*keys, "__flow", "__years", F.explode(cases).alias("y")).select("*", "y.*")
    return f.groupBy(*keys, "case", "yield").agg(F.sum(present_value(F.col("__flow"), F.col("__years"), F.col("yield"))).alias("pv"))


def enhancement(balances: DataFrame, keys: list[str], rank: str, balance: str, pool: Column, reserve: Column) -> DataFrame:
    """enhancement_pct: what stands below each rank, with the reserve, against the pool. Equal ranks share theirs."""
    total = Window.partitionBy(*keys)
    senior = total.orderBy(rank).rangeBetween(Window.unboundedPreceding, 0)
    through = F.sum(balance).over(senior)
    return balances.withColumn("enhancement_pct", F.when(pool > 0, (pool - through + reserve) / pool * 100))


def roll_checks(flows: DataFrame) -> DataFrame:
    """expected_closing and its residual for each note and month; the residual must be 0."""
    expected = F.col("begin_cents") - F.col("principal_cents")
    return flows.withColumns({"expected_closing_cents": expected, "residual_cents": F.col("end_cents") - expected})


def continuity(df: DataFrame, keys: list[str], order: str, begin: str, end: str) -> DataFrame:
    """residual of each period's beginning against the end of the period before; first periods are left out."""
    before = F.lag(end).over(Window.partitionBy(*keys).orderBy(order))
    return df.withColumn("prior_end", before).where(F.col("prior_end").isNotNull()).withColumn("residual", F.col(begin) - F.col("prior_end"))


def error_table(errors: DataFrame, keys: list[str], method: str, error: str, baseline: str, model: str) -> DataFrame:
    """Mean absolute errors side by side, their difference and the improvement in percent (null where the baseline's is 0)."""
    f = errors.groupBy(*keys).pivot(method, [baseline, model]).agg(F.avg(F.abs(F.col(error).cast("double"))))
    b, m = F.col(baseline), F.col(model)
    return f.select(*keys, b.alias("baseline_mae"), m.alias("model_mae"), (m - b).alias("difference"), F.when(b != 0, (b - m) / b * 100).alias("improvement_pct"))


def _parts_of_time(times: DataFrame, name: str, parts: int) -> Callable[[str], Column]:
    """A function of a column's name: the number of the part of time that its moment lies in, by up to ``parts`` - 1 quantiles of ``times``; equal moments share a part."""
    moment = lambda c: F.unix_micros(F.col(c).cast("timestamp")).cast("double")
    wanted = [n / parts for n in range(1, parts)] or [0.5]
    found = times.agg(F.percentile_approx(moment(name), wanted, 100 * parts).alias("cuts")).first().cuts if parts > 1 else None
    cuts = F.array(*[F.lit(cut) for cut in sorted(set(found or ()))]).cast("array<double>")
    return lambda c: F.size(F.filter(cuts, lambda cut: cut <= moment(c)))


def rate_in_force(periods: DataFrame, fixings: DataFrame, start: str, fixed: str, rate: str, back: int = 2, parts: int = 32) -> DataFrame:
    """``periods`` with fixing_date and fixing_rate: the ``back``-th latest fixing strictly before each period's start; of fixings of one time the greater rate is the later.

    A prefix scan over time: quantiles of the fixings cut time into ``parts``, each a window of its own; the last ``back`` fixings
    of each part are carried to the parts behind it, a handful of rows a part, and complete what a part's first rows lack. Distinct
    starts alone take part, so a start that many periods share is looked up once. Without such a fixing, or a start, both are null.
    """
    part = _parts_of_time(fixings, fixed, parts)
    known = fixings.select(F.col(fixed).alias("__t"), F.col(rate).alias("__rate")).where("__t IS NOT NULL").withColumn("__part", part("__t"))
    of_part = Window.partitionBy("__part")
    latest = known.withColumn("__n", F.row_number().over(of_part.orderBy(F.desc("__t"), F.desc("__rate")))).where(F.col("__n") <= back)
    # Each part's last fixings go to all parts behind it; of what arrives the latest stay.
    sent = latest.select("__t", "__rate", F.explode(F.sequence(F.col("__part") + 1, F.greatest(F.lit(parts), F.col("__part") + 1))).alias("__part"))
    kept = sent.withColumn("__n", F.row_number().over(of_part.orderBy(F.desc("__t"), F.desc("__rate")))).where(F.col("__n") <= back)
    carried = kept.groupBy("__part").agg(F.map_from_entries(F.collect_list(F.struct("__n", F.struct("__t", "__rate").alias("f")))).alias("__carried"))

    earlier = known.withColumn("__own", F.lag(F.struct("__t", "__rate"), back - 1).over(of_part.orderBy("__t", "__rate")))
    fixing = earlier.select("__part", "__t", F.lit(1).alias("__kind"), "__rate", "__own")
    asked = periods.select(F.col(start).alias("__t")).where("__t IS NOT NULL").distinct().withColumn("__part", part("__t"))
    line = fixing.unionByName(asked.withColumn("__kind", F.lit(0)), allowMissingColumns=True)
    # At equal times starts come first: a fixing of the day itself is not strictly before it.
    before = of_part.orderBy("__t", "__kind", "__rate").rowsBetween(Window.unboundedPreceding, 0)
    seen = line.select("__part", "__t", "__kind", F.sum("__kind").over(before).alias("__seen"), F.last(F.when(F.col("__kind") == 1, F.struct("__own")), ignorenulls=True).over(before)["__own"].alias("__own")).where("__kind = 0")
    found = F.when(F.col("__seen") >= back, F.col("__own")).otherwise(F.try_element_at("__carried", (back - F.col("__seen")).cast("int")))
    answers = seen.join(carried, "__part", "left").select(F.col("__t").alias("__start"), found.alias("__found"))
    joined = periods.join(answers, F.col(start) == F.col("__start"), "left")
    return joined.select(*[F.col(f"`{name}`") for name in periods.columns], F.col("__found.__t").alias("fixing_date"), F.col("__found.__rate").alias("fixing_rate"))


#: Places after the point that exact values keep, and the digits of a limb.
PLACES, LIMB = 60, 18


def _discounted_limbs(rate: str):
    """Limbs of flow / (1 + rate) ** (days / 365.25) in units of 10 ** -PLACES, from the lowest up; all bear the sign of the flow."""

    def run(flows: pa.Array, days: pa.Array) -> pa.Array:
        factors: dict[int, Decimal] = {}
        out = []
        with localcontext() as context:
            context.prec = PLACES + 60
            base = 1 + Decimal(rate)
            for flow, day in zip(flows.to_pylist(), days.to_pylist()):
                if flow is None or day is None:
                    out.append(None)
                    continue
                if day not in factors:
                    factors[day] = base ** (-Decimal(day) / Decimal("365.25"))
                units = int((abs(flow) * factors[day]).scaleb(PLACES).to_integral_value(ROUND_HALF_EVEN))
                limbs = []
                while units or not limbs:
                    units, limb = divmod(units, 10**LIMB)
                    limbs.append(Decimal(-limb if flow < 0 else limb))
                out.append(limbs)
        return pa.array(out, pa.list_(pa.decimal128(38, 0)))

    run.__annotations__ = {"flows": pa.Array, "days": pa.Array, "return": pa.Array}
    return F.arrow_udf(run, "array<decimal(38,0)>")


def _joined_limbs(sums: pa.Array) -> pa.Array:
    """Sums of limbs as one number with PLACES digits after the point."""
    out = []
    for limbs in sums.to_pylist():
        units = sum(int(limb) * 10 ** (LIMB * at) for at, limb in enumerate(limbs or []) if limb is not None)
        whole, rest = divmod(abs(units), 10**PLACES)
        out.append(f"{'-' if units < 0 else ''}{whole}.{rest:0{PLACES}d}")
    return pa.array(out, pa.string())


def exact_value(flows: DataFrame, keys: list[str], cents: Column, days: Column, rate: str, limbs: int = 8) -> DataFrame:
    """keys, pv_text: present values in cents with 60 places, the same in whatever order and parts the flows are added.

    Flows of a day add up as whole cents first; each day's sum is discounted once with decimals of 120 digits and cut into limbs of
    18 digits; limbs add up as decimals, and each key's are joined in the end. ``days`` counts from the origin, ``rate`` is a decimal as text. Null flows and days
    count for nothing. Values from 10 ** (18 * ``limbs`` - 60) cents on are an error.
    """
    daily = flows.select(*keys, cents.cast("decimal(38,0)").alias("__cents"), days.cast("int").alias("__days")).groupBy(*keys, "__days").agg(F.sum("__cents").alias("__cents"))
    cut = daily.select(*keys, _discounted_limbs(rate)(F.col("__cents"), F.col("__days")).alias("__limbs"))
    too_many = F.max(F.size("__limbs")) > limbs
    sums = cut.groupBy(*keys).agg(F.array(*[F.sum(F.get("__limbs", F.lit(at))) for at in range(limbs)]).alias("__sums"), too_many.alias("__over"))
    joined = F.arrow_udf(_joined_limbs, "string")(F.col("__sums"))
    return sums.select(*keys, F.when(F.col("__over"), F.raise_error(F.lit("a value has more digits than its limbs"))).otherwise(joined).alias("pv_text"))


def exact_life(flows: DataFrame, keys: list[str], principal: Column, days: Column) -> DataFrame:
    """keys, wal_years: days weighted by principal, in whole numbers until the last division; null without principal."""
    f = flows.groupBy(*keys).agg(F.sum((principal.cast("decimal(38,0)") * days.cast("decimal(9,0)")).cast("decimal(38,0)")).alias("__weighted"), F.sum(principal.cast("decimal(38,0)")).alias("__paid"))
    years = F.col("__weighted").cast("decimal(38,0)") * F.lit(100).cast("decimal(3,0)") / F.col("__paid").cast("decimal(38,0)")
    return f.select(*keys, F.when(F.col("__paid") != 0, (years.cast("decimal(38,18)") / F.lit(36525).cast("decimal(5,0)")).cast("decimal(38,18)")).alias("wal_years"))


def accrual_periods(payments: DataFrame, keys: list[str], day: str, order: list[str], first: Column) -> DataFrame:
    """``payments`` with accrual_start, the day of the payment before (``first`` for a key's first), and days, since then."""
    before = Window.partitionBy(*keys).orderBy(day, *order)
    f = payments.withColumn("accrual_start", F.coalesce(F.lag(day).over(before), first))
    return f.withColumn("days", F.date_diff(day, "accrual_start").cast("bigint"))
