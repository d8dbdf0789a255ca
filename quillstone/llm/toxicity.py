"""Toxicity: a linear classifier on character n-grams scaled by naive Bayes log-count ratios."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import materialize, table


@dataclass(frozen=True)
class Settings:
    """per_class bounds the labelled documents that are fitted on, for each label.

    orders: lengths of the n-grams in characters (code points); bits: size of the hashed feature
    space; alpha: smoothing of the counts; l2, steps: of the regression; min_docs:
    training documents that a feature must occur in; keep: features that stay,
    by the likelihood ratio of their counts in the two classes.
    """

    per_class: int = 3000
    orders: tuple[int, ...] = (4, 6, 8)
    bits: int = 19
    alpha: float = 1.0
    l2: float = 1e-3
    steps: int = 200
    min_docs: int = 4
    keep: int = 1000


def ngrams(text: str | None, settings: Settings) -> Iterator[np.ndarray]:
    """Hashed n-grams of each order of the lower-cased text between two spaces, repeats included."""
    raw = np.frombuffer(f" {' '.join((text or '').lower().split())} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32).astype(np.uint64)
    key = raw
    for order in range(1, max(settings.orders) + 1):
        if order > 1:
            key = key[:-1] * np.uint64(0x9E3779B97F4A7C15) + raw[order - 1 :]
        if not len(key):
            return
        if order in settings.orders:
            mixed = key ^ key >> np.uint64(29)
            mixed *= np.uint64(0xBF58476D1CE4E5B9)
            yield (mixed >> np.uint64(64 - settings.bits)).view(np.int64)


def features(text: str | None, settings: Settings) -> np.ndarray:
    """Sorted distinct hashed n-grams of all orders."""
    seen = np.zeros(1 << settings.bits, dtype=bool)
    for found in ngrams(text, settings):
        seen[found] = True
    return np.flatnonzero(seen).astype(np.int32)


@dataclass(frozen=True)
class Model:
    """score = sigmoid(bias + sum of the weights of the kept n-grams that occur); ``place`` numbers the kept ones, others are -1."""

    place: np.ndarray
    weights: np.ndarray
    bias: float

    def score(self, text: str | None, settings: Settings) -> float:
        seen = np.zeros(len(self.weights) + 1, dtype=bool)
        for found in ngrams(text, settings):
            seen[self.place[found]] = True  # the last stands for all that are not kept
        z = self.bias + float(self.weights[seen[:-1]].sum(dtype=np.float64))
        return float(1 / (1 + np.exp(-min(30.0, max(-30.0, z)))))


def likelihood_ratio(pos: np.ndarray, neg: np.ndarray, n_pos: int, n_neg: int) -> np.ndarray:
    """G statistic of the 2 x 2 table of each feature's documents by class."""
    def part(seen: np.ndarray, expected: np.ndarray) -> np.ndarray:
        return np.where(seen > 0, seen * np.log(np.maximum(seen, 1e-12) / expected), 0.0)

    share = (pos + neg) / (n_pos + n_neg)
    share = np.clip(share, 1e-12, 1 - 1e-12)
    return 2 * (part(pos, share * n_pos) + part(neg, share * n_neg) + part(n_pos - pos, (1 - share) * n_pos) + part(n_neg - neg, (1 - share) * n_neg))


def constant(n_pos: int, n: int, settings: Settings) -> Model:
    """Without one of the classes, the score is the smoothed share of label 1 for every text."""
    share = (n_pos + 0.5) / (n + 1)
    return Model(np.full(1 << settings.bits, -1, dtype=np.int32), np.zeros(0), float(np.log(share / (1 - share))))


def choose(df_pos: np.ndarray, df_neg: np.ndarray, n_pos: int, n_neg: int, settings: Settings) -> np.ndarray:
    """Place of each feature among those that stay, -1 for others, from the documents of each class that hold it."""
    used = np.flatnonzero(df_pos + df_neg >= min(settings.min_docs, max(1, (n_pos + n_neg) // 2)))
    evidence = likelihood_ratio(df_pos[used], df_neg[used], n_pos, n_neg)
    used = np.sort(used[np.lexsort((used, -evidence))[: settings.keep]])
    place = np.full(1 << settings.bits, -1, dtype=np.int32)
    place[used] = np.arange(len(used), dtype=np.int32)
    return place


def kept(text: str | None, place: np.ndarray, settings: Settings) -> np.ndarray:
    found = place[features(text, settings)]
    return found[found >= 0]


def regress(rows: list[np.ndarray], labels: np.ndarray, place: np.ndarray, settings: Settings) -> Model:
    """r = log of the smoothed odds of a feature in the two classes; the regression sees each feature times its r. Both classes weigh alike."""
    y = labels.astype(np.float64)
    n_pos, n_neg, n_used = int(y.sum()), int(len(y) - y.sum()), int(place.max()) + 1
    flat = np.concatenate([np.zeros(0, dtype=np.int64), *rows]).astype(np.int64)
    row_of = np.repeat(np.arange(len(y)), [len(row) for row in rows])
    in_pos = np.bincount(flat, weights=y[row_of], minlength=n_used)
    in_neg = np.bincount(flat, minlength=n_used) - in_pos
    scale = np.log((in_pos + settings.alpha) / (n_pos + 2 * settings.alpha)) - np.log((in_neg + settings.alpha) / (n_neg + 2 * settings.alpha))

    weight = np.where(y == 1, 0.5 / n_pos, 0.5 / n_neg)
    theta, bias = np.zeros(n_used), 0.0
    # Adam on the full batch: a few dozen passes over some million non-zeros.
    m, v, rate = np.zeros(n_used + 1), np.zeros(n_used + 1), 0.02
    for step in range(1, settings.steps + 1):
        w = theta * scale
        z = bias + np.bincount(row_of, weights=w[flat], minlength=len(y))
        error = weight * (1 / (1 + np.exp(-np.clip(z, -30, 30))) - y)
        grad = np.append(np.bincount(flat, weights=error[row_of], minlength=n_used) * scale + settings.l2 * theta, error.sum())
        m = 0.9 * m + 0.1 * grad
        v = 0.999 * v + 0.001 * grad**2
        move = rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.999**step)) + 1e-8)
        theta -= move[:-1]
        bias -= float(move[-1])
    return Model(place, theta * scale, bias)


def fit(texts: list[str | None], labels: list[int], settings: Settings = Settings()) -> Model:
    """Fit on texts at hand: what ``fit_table`` does with a table."""
    y = np.array(labels, dtype=np.int64)
    n_pos, n_neg = int(y.sum()), int(len(y) - y.sum())
    if not n_pos or not n_neg:
        return constant(n_pos, len(y), settings)
    df = np.zeros((2, 1 << settings.bits))
    for text, label in zip(texts, labels):
        df[label, features(text, settings)] += 1
    place = choose(df[1], df[0], n_pos, n_neg, settings)
    return regress([kept(text, place, settings) for text in texts], y, place, settings)


def fit_table(train: DataFrame, settings: Settings = Settings()) -> Model:
    """Fit on a bounded table of doc_id, toxic, text. Texts are cut on the executors, twice, so that only n-grams that stay are held for all of them.

    To the driver come 2**bits pairs of counts at most, then at most ``keep`` numbers a training document.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        df = np.zeros((2, 1 << settings.bits), dtype=np.int64)
        for batch in batches:
            for label, text in zip(batch.column(0).to_pylist(), batch.column(1)):
                df[label, features(text.as_py(), settings)] += 1
        seen = np.flatnonzero(df.any(axis=0))
        yield pa.RecordBatch.from_arrays([pa.array(seen), pa.array(df[1, seen]), pa.array(df[0, seen])], names=["feature", "pos", "neg"])

    sizes = {row.toxic: row["count"] for row in train.groupBy("toxic").count().collect()}
    n_pos, n_neg = sizes.get(1, 0), sizes.get(0, 0)
    if not n_pos or not n_neg:
        return constant(n_pos, n_pos + n_neg, settings)
    counts = train.select("toxic", "text").mapInArrow(count, "feature long, pos long, neg long").groupBy("feature").agg(F.sum("pos").alias("pos"), F.sum("neg").alias("neg")).toArrow()
    df = np.zeros((2, 1 << settings.bits))
    for label, name in enumerate(("neg", "pos")):
        df[label, counts["feature"].to_numpy()] = counts[name].to_numpy()
    place = choose(df[1], df[0], n_pos, n_neg, settings)
    shared = train.sparkSession.sparkContext.broadcast(place)

    def cut(texts: pa.Array) -> pa.Array:
        return pa.array([kept(text.as_py(), shared.value, settings) for text in texts], pa.list_(pa.int32()))

    cut.__annotations__ = {"texts": pa.Array, "return": pa.Array}
    rows = train.select("doc_id", "toxic", F.arrow_udf(cut, "array<int>")("text").alias("kept")).orderBy("doc_id").toArrow()
    return regress([np.array(row, dtype=np.int64) for row in rows["kept"].to_pylist()], rows["toxic"].to_numpy(), place, settings)


def fold(column="doc_id"):
    """crc32 of the id as text, modulo 3; 1 marks rows that are held out."""
    return F.crc32(F.coalesce(F.col(column).cast("string"), F.lit("")).cast("binary")) % 3


def training_table(docs: DataFrame, labels: DataFrame, settings: Settings) -> DataFrame:
    """doc_id, toxic, text of at most ``per_class`` documents of each label from the folds that are not held out, first by a hash of the id."""
    known = labels.where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & (fold() != 1)).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    known = known.select(F.col("doc_id").cast("long").alias("doc_id"), "toxic")
    chosen = None
    for label in (0, 1):
        part = known.where(F.col("toxic") == label).orderBy(F.xxhash64("doc_id"), "doc_id").limit(settings.per_class)
        chosen = part if chosen is None else chosen.unionByName(part)
    wanted = F.broadcast(materialize(chosen, "chosen"))  # the bound is 2 * per_class
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).join(wanted, "doc_id")
    return materialize(rows.groupBy("doc_id", "toxic").agg(F.min("text").alias("text")), "training")


def score(docs: DataFrame, labels: DataFrame, settings: Settings = Settings(), threshold: float = 0.7) -> DataFrame:
    """doc_id, held_out, score, predicted for every document.

    Fits on a bounded sample of labelled rows (Settings.per_class), then scores
    whole texts, however long, in one pass without shuffle; the broadcast model has 2**bits
    places and ``keep`` weights. Null text scores like an empty one; null and repeated doc_ids get
    a row each. Without labels every score is 0.5. Labels that are null or not 0
    or 1 are left out; of labels that disagree for an id, the larger counts, and of texts that share a
    labelled id the first in order. An empty table gives no rows. Only the text is an input of a score; other columns are not read.
    """
    model = fit_table(training_table(docs, labels, settings), settings)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batch: pa.Array) -> pa.Array:
        local = shared.value
        return pa.array([local.score(text.as_py(), settings) for text in batch], pa.float64())

    run.__annotations__ = {"batch": pa.Array, "return": pa.Array}
    value = F.arrow_udf(run, "double").asNondeterministic()(F.col("text").cast("string"))
    scored = docs.select("doc_id", (fold() == 1).alias("held_out"), value.alias("score"))
    return scored.withColumn("predicted", (F.col("score") >= threshold).cast("int"))


def op7_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    return score(table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels"))
