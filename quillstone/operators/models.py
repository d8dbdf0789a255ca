"""Competing-event models: multinomial logistic regression with calibration, on pyspark.ml."""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.ml.classification import LogisticRegression, LogisticRegressionModel
from pyspark.ml.functions import array_to_vector, vector_to_array
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# The model's features, its splits by period end and acceptance, and its guards.
FEATURES = ("credit_score", "orig_ltv_pct", "interest_rate_pct", "age_months", "remaining_months", "delinquency_days", "log_balance", "disclosure_lag_months")
SPLITS = {
    "train": ("0001-01-01", "2025-06-30", "2025-09-01"),
    "calibration": ("2025-09-01", "2025-11-30", "2026-02-01"),
    "test": ("2026-02-01", "9999-12-31", None),
}
LEAST_PERIODS, LEAST_ROWS = 9, 100
FOLDS = (("2024-09-01", "2024-11-30"), ("2025-01-01", "2025-03-31"), ("2025-04-01", "2025-06-30"), ("2025-09-01", "2025-11-30"))


def split(rows: DataFrame, name: str, splits: dict | None = None) -> DataFrame:
    """Rows by period end, and by when their outcomes were public."""
    first, last, known = (splits or SPLITS)[name]
    inside = rows.where(F.col("period_end").between(F.lit(first).cast("date"), F.lit(last).cast("date")))
    return inside.where(F.col("label_available_at") < F.lit(known).cast("timestamp")) if known else inside


def samples(rows: DataFrame, training_deal: str, target_deal: str, splits: dict | None = None) -> dict[str, DataFrame]:
    """training, calibration and later_months of one deal, and unseen_deal: another deal's rows of periods that begin in the test's time.

    Nothing of the target deal is fitted, and nothing that was filed only after the next sample began.
    """
    of = splits or SPLITS
    own = rows.where(F.col("deal_id") == training_deal)
    unseen = rows.where((F.col("deal_id") == target_deal) & (F.col("period_start") >= F.lit(of["test"][0]).cast("date")))
    return {"training": split(own, "train", of), "calibration": split(own, "calibration", of), "later_months": split(own, "test", of), "unseen_deal": unseen}


def describe(of: dict[str, DataFrame]) -> DataFrame:
    """sample, rows, loans, deals, first_period, last_period, last_label, last_feature, outcome_0 to outcome_2 of each sample."""
    stacked = None
    for name, rows in of.items():
        side = rows.select(F.lit(name).alias("sample"), "deal_id", "loan_id", "period_start", "period_end", "label_available_at", "feature_available_at", "outcome")
        stacked = side if stacked is None else stacked.unionByName(side)
    # Loans fold first: what is distinct is then a count of rows.
    loans = stacked.groupBy("sample", "deal_id", "loan_id").agg(
        F.count("*").alias("n"), F.min("period_start").alias("first"), F.max("period_end").alias("last"), F.max("label_available_at").alias("label"), F.max("feature_available_at").alias("feature"),
        *[F.count_if(F.col("outcome") == c).alias(f"c{c}") for c in range(3)])
    return loans.groupBy("sample").agg(
        F.sum("n").alias("rows"), F.count("*").alias("loans"), F.sort_array(F.collect_set("deal_id")).alias("deals"), F.min("first").alias("first_period"), F.max("last").alias("last_period"),
        F.max("label").alias("last_label"), F.max("feature").alias("last_feature"), *[F.sum(f"c{c}").alias(f"outcome_{c}") for c in range(3)])


def development_rows(rows: DataFrame, training_deal: str, splits: dict | None = None) -> DataFrame:
    """The rows that baselines may be fitted on: the training sample's."""
    return split(rows.where(F.col("deal_id") == training_deal), "train", splits)


def expanding_folds(rows: DataFrame, folds=FOLDS):
    """(train, test) for each window: training rows end, and their outcomes were public, before the window begins."""
    for start, end in folds:
        begin = F.lit(start).cast("date")
        train = rows.where((F.col("period_end") < begin) & (F.col("label_available_at") < begin.cast("timestamp")))
        yield train, rows.where(F.col("period_end").between(begin, F.lit(end).cast("date")))


@dataclass(frozen=True)
class Preparation:
    """Medians, indicators, means and population deviations of the training rows."""

    medians: dict
    missing: tuple
    means: tuple
    scales: tuple

    def inputs(self) -> list[Column]:
        filled = [F.coalesce(F.col(c).cast("double"), F.lit(self.medians[c])) for c in FEATURES]
        flags = [F.col(c).isNull().cast("double") for c in self.missing]
        return [(x - mean) / scale for x, mean, scale in zip([*filled, *flags], self.means, self.scales)]

    def apply(self, rows: DataFrame, out: str = "features") -> DataFrame:
        return rows.withColumn(out, array_to_vector(F.array(*self.inputs())))


def prepare(train: DataFrame) -> Preparation:
    """Exact medians; an indicator for each feature that misses values in training; population deviations, 0 taken as 1. A feature without any value counts as 0."""
    row = train.agg(*[F.percentile(F.col(c).cast("double"), 0.5).alias(c) for c in FEATURES], *[F.count_if(F.col(c).isNull()).alias(f"{c}__n") for c in FEATURES]).first()
    medians = {c: row[c] if row[c] is not None else 0.0 for c in FEATURES}
    missing = tuple(c for c in FEATURES if row[f"{c}__n"])
    columns = [F.coalesce(F.col(c).cast("double"), F.lit(medians[c])) for c in FEATURES] + [F.col(c).isNull().cast("double") for c in missing]
    moments = train.agg(*[F.avg(x).alias(f"m{i}") for i, x in enumerate(columns)], *[F.stddev_pop(x).alias(f"s{i}") for i, x in enumerate(columns)]).first()
    n = len(columns)
    return Preparation(medians, missing, tuple(moments[f"m{i}"] for i in range(n)), tuple(moments[f"s{i}"] or 1.0 for i in range(n)))


def _multinomial(rows: DataFrame, n: int, features: str, iterations: int) -> LogisticRegressionModel:
    # The mean loss is minimised here: a penalty of half the squared weights on the summed loss is 1 / n.
    lr = LogisticRegression(featuresCol=features, labelCol="outcome", family="multinomial", regParam=1.0 / n, elasticNetParam=0.0, standardization=False, maxIter=iterations, tol=1e-9, probabilityCol="__p", rawPredictionCol="__raw", predictionCol="__y")
    return lr.fit(rows.withColumn("outcome", F.col("outcome").cast("double")))


@dataclass(frozen=True)
class CompetingRisk:
    preparation: Preparation
    model: LogisticRegressionModel
    calibrator: LogisticRegressionModel | None = None

    def _raw(self, rows: DataFrame) -> DataFrame:
        scored = self.model.transform(self.preparation.apply(rows, "__x")).drop("__x", "__raw", "__y")
        return scored.withColumn("__a", vector_to_array("__p")).drop("__p")

    def predict(self, rows: DataFrame) -> DataFrame:
        """rows with p0, p1, p2."""
        f = self._raw(rows)
        if self.calibrator is not None:
            f = self.calibrator.transform(_log_features(f)).drop("__x", "__raw", "__y", "__a").withColumn("__a", vector_to_array("__p")).drop("__p")
        return f.withColumns({f"p{c}": F.col("__a")[c] for c in range(3)}).drop("__a")


def _log_features(f: DataFrame) -> DataFrame:
    logs = [F.log(F.least(F.greatest(F.col("__a")[c], F.lit(1e-9)), F.lit(1.0))) for c in range(3)]
    return f.withColumn("__x", array_to_vector(F.array(*logs)))


def gradient(fitted: CompetingRisk, rows: DataFrame) -> DataFrame:
    """outcome, input, gradient of the penalised mean loss at a fit's coefficients, over the rows that it was fitted on: zero at the optimum.

    Inputs are the features, an indicator (named _missing) for each that misses values, and the intercept, which bears no penalty.
    """
    names = [*FEATURES, *[f"{c}_missing" for c in fitted.preparation.missing], "intercept"]
    f = fitted._raw(rows)
    x = [*fitted.preparation.inputs(), F.lit(1.0)]
    each = [F.avg((F.col("__a")[c] - (F.col("outcome") == c).cast("double")) * value).alias(f"g{c}_{i}") for c in range(3) for i, value in enumerate(x)]
    means = f.agg(F.count("*").alias("n"), *each)
    weights, _ = fitted.model.coefficientMatrix.toArray(), fitted.model.interceptVector  # three classes by a dozen inputs
    terms = [
        F.struct(F.lit(c).alias("outcome"), F.lit(name).alias("input"), (F.col(f"g{c}_{i}") + (F.lit(float(weights[c][i])) / F.col("n") if i < len(names) - 1 else F.lit(0.0))).alias("gradient"))
        for c in range(3) for i, name in enumerate(names)
    ]
    return means.select(F.explode(F.array(*terms)).alias("t")).select("t.*")


def _guard(rows: DataFrame, name: str, periods: int = 0) -> int:
    row = rows.agg(F.count("*").alias("n"), F.countDistinct("outcome").alias("classes"), F.countDistinct("period_end").alias("periods")).first()
    if row.n < LEAST_ROWS or row.classes < 3 or row.periods < periods:
        raise ValueError(f"{name}: {row.n} rows, {row.classes} outcomes, {row.periods} periods are too few")
    return row.n


def fit(train: DataFrame, calibration: DataFrame | None = None) -> CompetingRisk:
    """Impute, standardise, fit; then a second regression on the log probabilities of the calibration rows."""
    n = _guard(train, "training")
    preparation = prepare(train)
    model = CompetingRisk(preparation, _multinomial(preparation.apply(train, "__x"), n, "__x", 350))
    if calibration is None:
        return model
    m = _guard(calibration, "calibration")
    return CompetingRisk(preparation, model.model, _multinomial(_log_features(model._raw(calibration)), m, "__x", 300))


def weighted_means(rows: DataFrame, keys: list[str], weight: Column, values: dict[str, Column]) -> DataFrame:
    """keys and the mean of each value by ``weight``; rows without a weight or value count for nothing, and no weight gives null."""
    mean = lambda value: F.sum(value * weight) / F.sum(F.when(value.isNotNull(), weight))
    return rows.groupBy(*keys).agg(*[mean(value).alias(name) for name, value in values.items()])


def weighted_rates(predicted: DataFrame, balance: str = "end_balance_cents") -> DataFrame:
    """One row: balance-weighted default and prepayment probabilities of loans that never defaulted, and their annual equivalents."""
    from ..functions.rates import annual_from_monthly

    w = F.when(~F.col("previously_defaulted"), F.col(balance))
    rates = weighted_means(predicted, [], w, {"monthly_default": F.col("p1"), "monthly_prepay": F.col("p2")})
    d, p = annual_from_monthly(F.col("monthly_default"), F.col("monthly_prepay"))
    return rates.select("*", d.alias("annual_default"), p.alias("annual_prepay"))
