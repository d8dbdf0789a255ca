"""Baselines, event metrics, segments and the loan-cluster bootstrap."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.rates import band, delinquency_bucket
from .runoff import _let

CLASSES = (0, 1, 2)
CLIP = 1e-9
# Right-closed upper edges of the reporting segments, and the features of a cohort cell.
SEGMENT_EDGES = {
    "credit_score": [620, 660, 720, 780],
    "age_months": [12, 24, 36],
    "remaining_months": [12, 36, 60],
    "disclosure_lag_months": [1, 2, 3],
    "delinquency_days": [0, 30, 60, 90],
    "interest_rate_pct": [6, 9, 12, 15],
}
COHORT_FEATURES = ("credit_score", "age_months", "remaining_months", "disclosure_lag_months")


def _counts(outcome: Column) -> list[Column]:
    return [F.count_if(outcome == c).alias(f"n{c}") for c in CLASSES]


def constant_probabilities(train: DataFrame, outcome: str = "outcome") -> DataFrame:
    """One row p0, p1, p2: class shares with one added to each count."""
    counts = train.agg(*_counts(F.col(outcome)))
    total = F.col("n0") + F.col("n1") + F.col("n2") + len(CLASSES)
    return counts.select(*[((F.col(f"n{c}") + 1) / total).alias(f"p{c}") for c in CLASSES])


def smoothed_cells(train: DataFrame, cells: list[Column], names: list[str], weight: float, outcome: str = "outcome") -> DataFrame:
    """p0, p1, p2 of each cell of the training rows, drawn to the overall shares by ``weight`` pseudo-rows.

    The overall shares are one row; it is joined to the cells, whose number the bands bound.
    """
    overall = constant_probabilities(train, outcome).select(*[F.col(f"p{c}").alias(f"q{c}") for c in CLASSES])
    counts = train.groupBy(*[cell.alias(name) for cell, name in zip(cells, names)]).agg(*_counts(F.col(outcome)))
    total = F.col("n0") + F.col("n1") + F.col("n2") + F.lit(float(weight))
    joined = counts.join(F.broadcast(overall))
    return joined.select(*names, *[((F.col(f"n{c}") + F.lit(float(weight)) * F.col(f"q{c}")) / total).alias(f"p{c}") for c in CLASSES])


def predict_cells(rows: DataFrame, table: DataFrame, overall: DataFrame, cells: list[Column], names: list[str]) -> DataFrame:
    """rows with p0, p1, p2 of their cell, or the overall shares where the cell was not seen. Cells and shares are few, by their bands."""
    keyed = rows.withColumns({f"__{name}": cell for cell, name in zip(cells, names)})
    renamed = table.select(*[F.col(name).alias(f"__{name}") for name in names], *[F.col(f"p{c}").alias(f"__p{c}") for c in CLASSES])
    base = overall.select(*[F.col(f"p{c}").alias(f"__q{c}") for c in CLASSES])
    out = keyed.join(F.broadcast(renamed), [f"__{name}" for name in names], "left").join(F.broadcast(base))
    out = out.withColumns({f"p{c}": F.coalesce(f"__p{c}", f"__q{c}") for c in CLASSES})
    return out.select(*[F.col(f"`{c}`") for c in rows.columns], *[f"p{c}" for c in CLASSES])


def transition_table(train: DataFrame) -> DataFrame:
    return smoothed_cells(train, [delinquency_bucket(F.col("delinquency_days"))], ["bucket"], 100.0)


def transition_predictions(train: DataFrame, test: DataFrame) -> DataFrame:
    return predict_cells(test, transition_table(train), constant_probabilities(train), [delinquency_bucket(F.col("delinquency_days"))], ["bucket"])


def cohort_cells() -> list[Column]:
    return [band(F.col(name), SEGMENT_EDGES[name]) for name in COHORT_FEATURES]


def cohort_predictions(train: DataFrame, test: DataFrame, weight: float = 100.0) -> DataFrame:
    names = [f"{name}_band" for name in COHORT_FEATURES]
    return predict_cells(test, smoothed_cells(train, cohort_cells(), names, weight), constant_probabilities(train), cohort_cells(), names)


def bad_probabilities(rows: DataFrame) -> DataFrame:
    """Rows whose p0, p1, p2 are not finite, outside 0 to 1, or do not add up to 1 within 1e-10."""
    p = [F.col(f"p{c}") for c in CLASSES]
    ok = F.lit(True)
    for x in p:
        ok = ok & x.isNotNull() & ~F.isnan(x) & x.between(0.0, 1.0)
    return rows.where(~F.coalesce(ok & (F.abs(p[0] + p[1] + p[2] - 1) <= 1e-10), F.lit(False)))


def clipped(rows: DataFrame) -> DataFrame:
    """Probabilities held CLIP away from 0 and 1, then made to add up to 1 again."""
    low = [F.least(F.greatest(F.col(f"p{c}"), F.lit(CLIP)), F.lit(1 - CLIP)) for c in CLASSES]
    return rows.withColumns({f"p{c}": x / (low[0] + low[1] + low[2]) for c, x in zip(CLASSES, low)})


def log_loss(rows: DataFrame) -> DataFrame:
    true = F.when(F.col("outcome") == 0, F.col("p0")).when(F.col("outcome") == 1, F.col("p1")).otherwise(F.col("p2"))
    return rows.agg(F.count("*").alias("n"), F.avg(-F.log(true)).alias("log_loss"))


def event_rates(rows: DataFrame, hit: Column, p: Column) -> DataFrame:
    """observed_events, observed_rate, predicted_rate and brier of a binary event."""
    y = hit.cast("double")
    return rows.agg(F.sum(hit.cast("long")).alias("observed_events"), F.avg(y).alias("observed_rate"), F.avg(p).alias("predicted_rate"), F.avg((p - y) * (p - y)).alias("brier"))


def score_steps(rows: DataFrame, hit: Column, p: Column) -> DataFrame:
    """(score, n, pos) of each distinct score: all that the rank metrics need, after a partial aggregate."""
    return rows.select(p.alias("score"), hit.cast("long").alias("hit")).groupBy("score").agg(F.count("*").alias("n"), F.sum("hit").alias("pos"))


#: Parts by value, a power of two, and the rows of which every few bound one.
RANGES, CUT_ROWS = 256, 4096


def _in_ranges(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with __part, the number of their range by ``keys``: rows of a higher number have higher keys.

    Cuts are the keys that a hash of them picks first, in order. The number thus follows from the values alone, and a plan that
    reads the rows twice numbers both alike; a range exchange draws a sample of its own, and is coalesced, each time that it runs.
    """
    key = F.struct(*keys)
    picked = rows.select(key.alias("k")).orderBy(F.xxhash64("k"), "k").limit(CUT_ROWS).agg(F.sort_array(F.collect_list("k")).alias("all"))
    cuts = picked.select(F.array_compact(F.transform(F.sequence(F.lit(1), F.lit(RANGES - 1)), lambda i: F.get("all", F.floor(i * F.size("all") / RANGES).cast("int")))).alias("__cuts"))  # one row
    steps = F.array(*[F.lit(RANGES >> n) for n in range(1, RANGES.bit_length())])
    below = F.aggregate(steps, F.lit(0), lambda low, step: F.when(F.get("__cuts", low + step - 1) <= key, low + step).otherwise(low))
    return rows.join(F.broadcast(cuts)).withColumn("__part", below).drop("__cuts")


def rank_metrics(rows: DataFrame, hit: Column, p: Column) -> DataFrame:
    """One row: auc (average ranks on ties; null if one class) and average_precision (null without positives).

    Distinct scores are dealt to ranges; each is counted from the sizes of those
    before it, so no task sorts all scores.
    """
    steps = _in_ranges(score_steps(rows, hit, p), ["score"])
    lower = Window.partitionBy("__part").orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    inside = steps.select("__part", "n", "pos", *[F.coalesce(F.sum(c).over(lower), F.lit(0)).alias(f"__{c}") for c in ("n", "pos")])
    sizes = inside.groupBy("__part").agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"))
    before, every = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    offsets = sizes.select("__part", *[x for c in ("n", "pos") for x in (F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"__{c}_before"), F.sum(c).over(every).alias(f"__{c}_all"))])
    f = inside.join(F.broadcast(offsets), "__part")  # one row per range
    below, found = F.col("__n") + F.col("__n_before"), F.col("__pos_all") - F.col("__pos") - F.col("__pos_before")
    ranks = F.sum(F.col("pos") * (below + (F.col("n") + 1) / F.lit(2.0)))
    f = f.agg(F.sum("n").alias("n"), F.sum("pos").alias("pos"), ranks.alias("ranks"), F.sum(F.col("pos") * found / (F.col("__n_all") - below)).alias("gain"))
    neg = F.col("n") - F.col("pos")
    auc = F.when((F.col("pos") > 0) & (neg > 0), (F.col("ranks") - F.col("pos") * (F.col("pos") + 1) / F.lit(2.0)) / (F.col("pos").cast("double") * neg))
    return f.select("n", "pos", auc.alias("auc"), F.when(F.col("pos") > 0, F.col("gain") / F.col("pos")).alias("average_precision"))


def calibration(rows: DataFrame, hit: Column, p: Column, tie_keys: list[str], bins: int = 10) -> DataFrame:
    """bin, n, predicted, observed by rank of the prediction, ties broken by ``tie_keys``.

    Rows are dealt to ranges: each is numbered from the sizes of those
    before it, so no task sorts all rows.
    """
    keys = ["__p", *tie_keys]
    f = rows.select(p.alias("__p"), hit.cast("double").alias("__y"), *tie_keys)
    f = _in_ranges(f, keys)
    inside = f.withColumn("__rank", F.row_number().over(Window.partitionBy("__part").orderBy(*keys)))
    sizes = inside.groupBy("__part").agg(F.count("*").alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    offsets = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__before"), F.sum("__n").over(Window.partitionBy()).alias("__total"))
    ranked = inside.join(F.broadcast(offsets), "__part")  # one row per range
    most = F.least(F.lit(bins), F.col("__total"))
    rank = F.col("__rank") + F.col("__before")
    number = F.when(F.col("__total") == 1, F.lit(1)).otherwise(F.greatest(F.ceil(most * (rank - 1) / (F.col("__total") - 1)), F.lit(1)))
    return ranked.groupBy(number.cast("int").alias("bin")).agg(F.count("*").alias("n"), F.avg("__p").alias("predicted"), F.avg("__y").alias("observed"))


def monthly_exposure(rows: DataFrame, hit: Column, p: Column) -> DataFrame:
    """period, predicted, observed and eligible balance in cents; the prediction rounds halves to even."""
    balance = F.col("begin_balance_cents")
    return rows.groupBy(F.date_format("period_end", "yyyy-MM").alias("period")).agg(
        F.rint(F.sum(p * balance)).cast("long").alias("predicted_balance_cents"), F.sum(F.when(hit, balance).otherwise(0)).alias("observed_event_balance_cents"), F.sum(balance).alias("eligible_balance_cents")
    )


def segment_stability(train: DataFrame, test: DataFrame, methods: list[str]) -> DataFrame:
    """Composition and calibration by feature, band and event.

    Features are unpivoted, so one aggregate of each side covers all segments. ``test`` has
    columns <method>_p1 and <method>_p2 of raw probabilities.
    """
    bands = F.array(*[F.struct(F.lit(name).alias("feature"), band(F.col(name), edges).alias("band_id")) for name, edges in SEGMENT_EDGES.items()])
    measures = [c for m in methods for c in (f"{m}_p1", f"{m}_p2")]
    long = test.select("deal_id", "loan_id", "begin_balance_cents", "outcome", *measures, F.explode(bands).alias("s")).select("*", "s.*")
    aggregates = []
    for m in methods:
        for cause in (1, 2):
            y, p = (F.col("outcome") == cause).cast("double"), F.col(f"{m}_p{cause}")
            aggregates += [F.avg(p).alias(f"{m}_predicted_{cause}"), (F.avg(p) - F.avg(y)).alias(f"{m}_gap_{cause}"), F.avg((p - y) * (p - y)).alias(f"{m}_brier_{cause}")]
    tested = long.groupBy("feature", "band_id").agg(
        F.count("*").alias("test_rows"),
        F.countDistinct("deal_id", "loan_id").alias("test_loans"),
        F.sum("begin_balance_cents").alias("beginning_exposure_cents"),
        *[F.count_if(F.col("outcome") == c).alias(f"events_{c}") for c in (1, 2)],
        *aggregates,
    )
    trained = train.select("outcome", F.explode(bands).alias("s")).groupBy("s.feature", "s.band_id").agg(F.count("*").alias("development_rows"), *[F.avg((F.col("outcome") == c).cast("double")).alias(f"development_rate_{c}") for c in (1, 2)])
    joined = tested.join(trained, ["feature", "band_id"], "left").fillna(0, ["development_rows"])
    per_feature = Window.partitionBy("feature")
    all_trained = F.sum("development_rows").over(per_feature)
    share = {"test_share": F.col("test_rows") / F.sum("test_rows").over(per_feature), "development_share": F.col("development_rows") / all_trained}
    out = joined.withColumns(share)
    return out.withColumn("composition_change_percentage_points", (F.col("test_share") - F.col("development_share")) * 100)


def cluster_bootstrap(rows: DataFrame, clusters: list[str], measures: dict[str, Column], draws: int = 200, seed: int = 20261002) -> DataFrame:
    """measure, lower, upper: 95 % intervals of means over rows, drawing whole clusters.

    Rows fold into a sum per cluster first. Draws are Poisson: each cluster counts k times, k by a hash of
    cluster and draw, so every draw is an aggregate and no task holds all clusters. The
    hash takes the place of one generator, whose draws would depend on row order.
    """
    sums = rows.groupBy(*clusters).agg(F.count("*").cast("double").alias("__n"), *[F.sum(c).alias(name) for name, c in measures.items()])
    u = (F.pmod(F.xxhash64(*clusters, F.col("draw"), F.lit(seed)), F.lit(1 << 52)) + F.lit(0.5)) / F.lit(float(1 << 52))
    k, cumulative, weight = F.lit(0), 0.0, float(np.exp(-1.0))
    for count in range(12):
        cumulative += weight
        k = k + (u > cumulative).cast("int")
        weight /= count + 1
    drawn = sums.select("*", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).withColumn("__k", k)
    means = drawn.groupBy("draw").agg(*[(F.sum(F.col("__k") * F.col(name)) / F.sum(F.col("__k") * F.col("__n"))).alias(name) for name in measures])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("value")) for name in measures])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.percentile("value", 0.025).alias("lower"), F.percentile("value", 0.975).alias("upper"))


def _hash_number(text: Column, digits: int) -> Column:
    return F.conv(F.substring(F.md5(text), 1, digits), 16, 10).cast("bigint")


#: Trials that are drawn by one sum of terms: the first of them, 0.5 ** TRIALS at the least, must not vanish in a double.
TRIALS = 500


def _successes(n: Column, p: Column, name: Column) -> Column:
    """Successes of ``n`` trials of chance ``p``, drawn by inversion from a hash of ``name``; many trials are drawn in parts that add up."""

    def drawn(part: Column) -> Column:
        u = _hash_number(F.concat_ws("|", name, part.cast("string")), 12).cast("double") / F.lit(float(1 << 48))
        return _let(F.least(n - part * TRIALS, F.lit(TRIALS)).cast("bigint"), lambda m: _let(u, lambda at: inverse(m, at)))

    def inverse(m: Column, u: Column) -> Column:
        """The first k whose chance not to be exceeded is above u."""
        none = F.pow(1 - p, m)
        start = F.struct(F.lit(0).cast("bigint").alias("k"), none.alias("term"), none.alias("sum"))

        def step(state: Column, k: Column) -> Column:
            term = state["term"] * (m - k + 1) / k * (p / (1 - p))
            more = F.struct(k.cast("bigint").alias("k"), term.alias("term"), (state["sum"] + term).alias("sum"))
            return F.when(state["sum"] <= u, more).otherwise(state)

        return F.aggregate(F.sequence(F.lit(1), F.greatest(m, F.lit(1))), start, step, lambda state: F.least(state["k"], m))

    parts = F.sequence(F.lit(0), F.greatest(F.ceil(n / TRIALS) - 1, F.lit(0)).cast("int"))
    some = F.aggregate(F.transform(parts, drawn), F.lit(0).cast("bigint"), lambda total, k: total + k)
    return F.when((n <= 0) | (p <= 0), F.lit(0).cast("bigint")).when(p >= 1, n.cast("bigint")).otherwise(some)


def multinomial_bootstrap(rows: DataFrame, clusters: list[str], measures: dict[str, Column], draws: int = 200, seed: int = 20261002, block: int = 256, buckets: int = 1024) -> DataFrame:
    """measure, lower, upper: 95 % intervals of means over rows; each draw takes as many clusters as there are, with replacement.

    Clusters are numbered by buckets of a hash, whose sizes (``buckets`` numbers) come to the driver. A draw of n clusters splits in two
    at the middle of the numbers: how many fall to the left is binomial, drawn from a hash of seed, draw and place. Splitting goes on down to
    blocks of ``block`` clusters, which meet their sums by one join; within a block the clusters take their shares one by one, each
    binomial in what is left. So counts are those of a draw with replacement, add up to n, do not depend on the order of
    rows, and no task holds all clusters, nor is a cluster a row of each draw.
    """
    names = list(measures)
    sums = rows.groupBy(*clusters).agg(F.count("*").cast("double").alias("__n"), *[F.sum(c).cast("double").alias(f"__{name}") for name, c in measures.items()])
    key = F.concat_ws("|", *[F.coalesce(F.col(c).cast("string"), F.lit("")) for c in clusters])
    sums = sums.withColumn("__key", key).withColumn("__bucket", _hash_number(F.col("__key"), 8) % buckets)
    sizes = {r["__bucket"]: r["count"] for r in sums.groupBy("__bucket").count().collect()}
    total, offsets = 0, []
    for bucket in sorted(sizes):
        offsets += [F.lit(bucket), F.lit(total)]
        total += sizes[bucket]
    if not total:
        return rows.sparkSession.createDataFrame([], "measure string, lower double, upper double")
    within = F.row_number().over(Window.partitionBy("__bucket").orderBy("__key")) - 1
    numbered = sums.withColumn("__at", (F.element_at(F.create_map(*offsets), F.col("__bucket")) + within).cast("bigint"))
    fields = ["__n", *[f"__{name}" for name in names]]
    blocks = numbered.groupBy(F.floor(F.col("__at") / block).cast("bigint").alias("__lo")).agg(F.sort_array(F.collect_list(F.struct("__at", *fields))).alias("__held"))

    count = -(-total // block)
    nodes = rows.sparkSession.range(draws).select(F.col("id").alias("draw"), F.lit(0).cast("bigint").alias("__lo"), F.lit(count).cast("bigint").alias("__hi"), F.lit(total).cast("bigint").alias("__take"))
    size = lambda low, high: F.least(high * block, F.lit(total)) - low * block
    while count > 1:
        lo, hi = F.col("__lo"), F.col("__hi")
        middle = F.floor((lo + hi) / 2).cast("bigint")
        name = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), lo.cast("string"), hi.cast("string"))
        split = nodes.withColumn("__left", F.when(hi - lo > 1, _successes(F.col("__take"), size(lo, middle) / size(lo, hi), name)).otherwise(F.col("__take")))
        halves = F.array(F.struct(lo.alias("lo"), F.when(hi - lo > 1, middle).otherwise(hi).alias("hi"), F.col("__left").alias("take")), F.struct(middle.alias("lo"), hi.alias("hi"), (F.col("__take") - F.col("__left")).alias("take")))
        nodes = split.select("draw", F.explode(halves).alias("h")).where("h.take > 0").select("draw", F.col("h.lo").alias("__lo"), F.col("h.hi").alias("__hi"), F.col("h.take").alias("__take"))
        count = -(-count // 2)

    start = F.struct(F.col("__take").alias("rest"), F.size("__held").alias("left"), *[F.lit(0.0).alias(c) for c in fields])

    def share(state: Column, cluster: Column) -> Column:
        name = F.concat_ws("|", F.lit(str(seed)), F.col("draw").cast("string"), F.lit("cluster"), cluster["__at"].cast("string"))
        taken = _successes(state["rest"], 1 / state["left"], name)
        return _let(taken, lambda k: F.struct((state["rest"] - k).alias("rest"), (state["left"] - 1).alias("left"), *[(state[c] + k * cluster[c]).alias(c) for c in fields]))

    drawn = nodes.join(blocks, "__lo").select("draw", F.aggregate("__held", start, share).alias("s"))
    means = drawn.groupBy("draw").agg(*[(F.sum(f"s.__{name}") / F.sum("s.__n")).alias(name) for name in names])
    long = means.select(F.explode(F.array(*[F.struct(F.lit(name).alias("measure"), F.col(name).alias("value")) for name in names])).alias("x")).select("x.*")
    return long.groupBy("measure").agg(F.percentile("value", 0.025).alias("lower"), F.percentile("value", 0.975).alias("upper"))
