"""Validation of methods: baselines and the model over expanding folds, and the effect of another target on the notes."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import replace

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions.rates import delinquency_bucket
from ..operators import models, scoring, valuation, waterfall

#: Pseudo-rows that draw a cell to the overall shares, as in scoring's baselines.
WEIGHT = 100.0


def logistic(train: DataFrame, test: DataFrame) -> DataFrame:
    """The model fitted anew on a fold's training rows, uncalibrated."""
    return models.fit(train).predict(test)


def _baselines(rows: DataFrame, folds) -> DataFrame:
    """fold, method, outcome, p0, p1, p2 of the constant, transition and cohort baselines over all folds at once.

    A row is read once for the folds that it trains and once for the fold that it tests. Training folds into counts by
    fold and cell, which the bands bound; all baselines are sums of these, and small enough to broadcast.
    """
    keyed = rows.select("outcome", "period_end", "label_available_at", delinquency_bucket(F.col("delinquency_days")).alias("transition"), F.concat_ws("|", *[c.cast("string") for c in scoring.cohort_cells()]).alias("cohort"))
    day = lambda text: F.lit(text).cast("date")
    trains = [F.when((F.col("period_end") < day(a)) & (F.col("label_available_at") < day(a).cast("timestamp")), n) for n, (a, _) in enumerate(folds, 1)]
    tests = [F.when(F.col("period_end").between(day(a), day(b)), n) for n, (a, b) in enumerate(folds, 1)]
    within = lambda numbers: keyed.select("outcome", "transition", "cohort", F.explode(F.array_compact(F.array(*numbers))).alias("fold"))
    counts = within(trains).groupBy("fold", "transition", "cohort").agg(*[F.count_if(F.col("outcome") == c).alias(f"n{c}") for c in scoring.CLASSES])

    def sums(keys: list[str]) -> DataFrame:
        f = counts.groupBy(*keys).agg(*[F.sum(f"n{c}").alias(f"n{c}") for c in scoring.CLASSES])
        return f.withColumn("n", sum((F.col(f"n{c}") for c in scoring.CLASSES), F.lit(0)))

    overall = sums(["fold"]).select("fold", *[((F.col(f"n{c}") + 1) / (F.col("n") + len(scoring.CLASSES))).alias(f"constant{c}") for c in scoring.CLASSES])
    f = within(tests).join(F.broadcast(overall), "fold")
    for name in ("transition", "cohort"):
        cells = sums(["fold", name]).join(F.broadcast(overall), "fold")
        smooth = [((F.col(f"n{c}") + WEIGHT * F.col(f"constant{c}")) / (F.col("n") + WEIGHT)).alias(f"__{name}{c}") for c in scoring.CLASSES]
        f = f.join(F.broadcast(cells.select("fold", name, *smooth)), ["fold", name], "left")
        f = f.withColumns({f"{name}{c}": F.coalesce(f"__{name}{c}", f"constant{c}") for c in scoring.CLASSES})
    methods = [F.struct(F.lit(m).alias("method"), *[F.col(f"{m}{c}").alias(f"p{c}") for c in scoring.CLASSES]) for m in ("constant", "transition", "cohort")]
    return f.select("fold", "outcome", F.explode(F.array(*methods)).alias("m")).select("fold", "m.method", "outcome", *[f"m.p{c}" for c in scoring.CLASSES])


def score_folds(rows: DataFrame, folds=models.FOLDS, methods: dict[str, Callable] | None = None) -> DataFrame:
    """fold, method, event (1 default, 2 prepayment), rows, events, observed_rate, predicted_rate, brier, log_loss.

    Three baselines over all folds, and ``methods`` by name, such as ``logistic``: functions of (train, test) that are fitted
    for each fold. Folds are a handful of windows; all are scored in one aggregate.
    """
    every = _baselines(rows, folds)
    for number, (train, test) in enumerate(models.expanding_folds(rows, folds) if methods else (), 1):
        for name, method in methods.items():
            every = every.unionByName(method(train, test).select(F.lit(number).alias("fold"), F.lit(name).alias("method"), "outcome", "p0", "p1", "p2"))
    every = scoring.clipped(every)
    own = F.when(F.col("outcome") == 1, F.col("p1")).when(F.col("outcome") == 2, F.col("p2")).otherwise(F.col("p0"))
    causes = F.array(*[F.struct(F.lit(c).alias("event"), (F.col("outcome") == c).cast("double").alias("y"), F.col(f"p{c}").alias("p")) for c in (1, 2)])
    long = every.select("fold", "method", (-F.log(own)).alias("loss"), F.explode(causes).alias("e")).select("fold", "method", "loss", "e.*")
    y, p = F.col("y"), F.col("p")
    return long.groupBy("fold", "method", "event").agg(
        F.count("*").alias("rows"), F.sum(y.cast("long")).alias("events"), F.avg(y).alias("observed_rate"), F.avg(p).alias("predicted_rate"), F.avg((p - y) * (p - y)).alias("brier"), F.avg("loss").alias("log_loss")
    )


def target_sensitivity(flows: DataFrame, opening: waterfall.State, terms: waterfall.Terms, other_target: int, rate: float) -> DataFrame:
    """scenario, note, and principal, loss and present value under the terms' target of overcollateralisation, another target, and their changes.

    ``flows`` is the input of waterfall.note_flows. Both runs must hold the same (scenario, note) pairs.
    """
    from ..operators.audit import misaligned

    origin = F.lit(opening.last_distribution).cast("date")
    names = ("principal_cents", "loss_cents", "pv_cents")
    sides = {}
    for side, of in (("base", terms), ("other", replace(terms, oc_target=other_target))):
        summary = valuation.note_summary(waterfall.note_flows(flows, opening, of), origin, rate)
        sides[side] = summary.where("opening_cents > 0").select("scenario", "note", *[F.col(c).alias(f"{side}_{c}") for c in names])
    apart = misaligned(sides, ["scenario", "note"]).agg(F.count("*").alias("__apart"))
    f = sides["base"].join(sides["other"], ["scenario", "note"]).join(F.broadcast(apart))  # one row
    note = F.when(F.col("__apart") > 0, F.raise_error(F.lit("the two runs hold different notes"))).otherwise(F.col("note"))
    changes = [(F.col(f"other_{c}") - F.col(f"base_{c}")).alias(f"{c}_change") for c in names]
    return f.select("scenario", note.alias("note"), *[f"{side}_{c}" for side in sides for c in names], *changes)
