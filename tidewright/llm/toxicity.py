"""Toxicity: a linear classifier on character n-grams that are scaled by naive Bayes log-count ratios.

A text's features are its distinct runs of 3 to 6 characters (lower case, words apart by one space), hashed. On the labelled texts
the share of each feature among toxic texts over its share among clean ones gives a log ratio; the features that tell the most are
kept, each with its ratio as its value, and a logistic regression (Spark ML, distributed) is fitted on them. A score is the
regression's probability: ratio times coefficient, added up over the text's features.

Labelled rows are a sample of bounded size: up to ``MOST_EACH`` texts of either label, drawn by a hash of their id; where rows are
left out, those of the label that stay weigh more, so the prior remains that of all. Scoring reads every whole text.

Defined cases: null and empty texts have no features and score the intercept; a null label isn't learnt from; an id labelled more
than once is toxic if one label says so; rows that repeat an id count as often as they come; labels without a document do no
harm; with labels of one kind only, all scores are that label's smoothed share; with none, 0; an empty table gives no rows.
Only the text is seen by a score. Other columns aren't read.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import partial

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import CountVectorizerModel, ElementwiseProduct
from pyspark.ml.linalg import Vectors
from pyspark.sql import Column, DataFrame

from tidewright.llm.common import map_arrow, materialize

#: Lengths of the runs, and how many buckets they are hashed to.
ORDERS, BUCKETS = (3, 4, 5, 6), 1 << 18
#: Labelled texts of either label that are learnt from, at most (about: the draw is by hash).
MOST_EACH = 100_000
#: Features that are kept, the texts that each must be in, and the smoothing of their counts.
FEATURES, LEAST_TEXTS, SMOOTH = 1 << 13, 3, 1.0
#: Penalty and steps of the regression; the score from which a text counts as toxic.
PENALTY, STEPS, CUT = 1e-3, 60, 0.3
#: Characters of a text that are hashed at a time.
BLOCK = 1 << 20

_BETWEEN = re.compile(r"[\W_]+")


def runs(text: str | None) -> np.ndarray:
    """Buckets of all runs of characters of a whole text, repeats included."""
    plain = _BETWEEN.sub(" ", (text or "").lower()).strip()
    if not plain:
        return np.zeros(0, dtype=np.uint32)
    data = np.frombuffer(f" {plain} ".encode("utf-32-le", "surrogatepass"), dtype=np.uint32)
    found = []
    for at in range(0, len(data), BLOCK):
        part = data[at : at + BLOCK + max(ORDERS) - 1]
        code = np.zeros(len(part), dtype=np.uint32)
        for n in range(1, max(ORDERS) + 1):
            m = min(BLOCK, len(part) - n + 1)
            if m <= 0:
                break
            code = (code[:m] ^ part[n - 1 : n - 1 + m]) * np.uint32(0x01000193)
            if n in ORDERS:
                found.append((code ^ np.uint32(n)) * np.uint32(0x9E3779B1) >> np.uint32(32 - BUCKETS.bit_length() + 1))
    return np.concatenate(found) if found else np.zeros(0, dtype=np.uint32)


class Distinct:
    """Distinct buckets of one text after another, by marks in one array."""

    def __init__(self) -> None:
        self.seen = np.zeros(BUCKETS, dtype=bool)

    def of(self, found: np.ndarray) -> np.ndarray:
        if len(found) < 1 << 11:
            return np.unique(found)
        self.seen[found] = True
        out = np.flatnonzero(self.seen)
        self.seen[out] = False
        return out


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """For each feature of the task: in how many toxic and in how many clean texts it is."""
    distinct, total = Distinct(), np.zeros((2, BUCKETS), dtype=np.int64)
    for batch in batches:
        for text, toxic in zip(batch.column("text"), batch.column("toxic").to_pylist(), strict=True):
            total[toxic, distinct.of(runs(text.as_py()))] += 1
    used = np.flatnonzero(total.any(axis=0))
    for at in range(0, len(used), 1 << 14):
        part = used[at : at + (1 << 14)]
        yield pa.record_batch([pa.array(part.astype(np.int32)), pa.array(total[1, part]), pa.array(total[0, part])], names=["feature", "toxic", "clean"])


def log_ratios(counts: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """The features that tell the most, and their log-count ratios; ``FEATURES`` rows are collected at most (the feature of the model)."""
    counts = counts.groupBy("feature").agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    p, q = F.col("toxic") + SMOOTH, F.col("clean") + SMOOTH
    sums = counts.agg(F.sum(p).alias("all_p"), F.sum(q).alias("all_q"))
    ratio = F.log((p / F.col("all_p")) / (q / F.col("all_q")))
    # How many standard deviations the ratio lies from zero tells frequent features from chance.
    told = counts.where(F.col("toxic") + F.col("clean") >= LEAST_TEXTS).crossJoin(F.broadcast(sums)).select("feature", ratio.alias("r"), (F.abs(ratio) / F.sqrt(1 / p + 1 / q)).alias("z"))
    best = told.orderBy(F.col("z").desc(), "feature").limit(FEATURES).collect()
    best.sort(key=lambda r: r["feature"])
    return np.array([r["feature"] for r in best], dtype=np.int64), np.array([r["r"] for r in best])


def _pick(batches: Iterator[pa.RecordBatch], keep: np.ndarray) -> Iterator[pa.RecordBatch]:
    number = np.full(BUCKETS, -1, dtype=np.int32)
    number[keep] = np.arange(len(keep))
    for batch in batches:
        lists = [np.unique(n[n >= 0]) for n in (number[runs(t.as_py())] for t in batch.column("text"))]
        ends = np.cumsum([0, *map(len, lists)]).astype(np.int32)
        flat = np.concatenate(lists).astype(np.int32) if lists else np.zeros(0, np.int32)
        yield pa.record_batch([batch.column("toxic"), pa.ListArray.from_arrays(pa.array(ends), pa.array(flat))], names=["toxic", "features"])


class Model:
    """The weight of each bucket (ratio times coefficient) and the intercept."""

    def __init__(self, features: np.ndarray, weight: np.ndarray, intercept: float) -> None:
        self.features, self.weight, self.intercept = features, weight, intercept

    def table(self) -> np.ndarray:
        out = np.zeros(BUCKETS)
        out[self.features] = self.weight
        return out


def labelled(docs: DataFrame, labels: DataFrame, key: str, text: str, label: str, most: int = MOST_EACH) -> tuple[DataFrame, dict[int, float]]:
    """``text, toxic`` of the sample, and by label how many rows one row of it stands for.

    The labels' table is narrow; what is drawn from it is bounded by ``most`` ids of either label, so it is broadcast to the texts.
    """
    named = labels.where(F.col(label).isNotNull() & F.col(key).isNotNull()).groupBy(F.col(key).alias("__id")).agg(F.max(F.when(F.col(label) > 0, 1).otherwise(0)).alias("toxic"))
    many = {r["toxic"]: r["n"] for r in named.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    share = {c: min(1.0, most / n) for c, n in many.items()}
    draw = F.pmod(F.xxhash64("__id"), F.lit(1 << 30)) / float(1 << 30)
    drawn = named.where(draw < F.when(F.col("toxic") == 1, share.get(1, 1.0)).otherwise(share.get(0, 1.0)))
    joined = docs.select(F.col(key).alias("id"), F.col(text).alias("text")).join(F.broadcast(drawn), F.col("id") == F.col("__id"))
    return joined.select("text", "toxic"), {c: 1 / s for c, s in share.items()}


def train(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", most: int = MOST_EACH) -> Model | float:
    """The model; or one score for all texts where the labels are all of one kind or missing."""
    rows, stands_for = labelled(docs, labels, key, text, label, most)
    counted = materialize(map_arrow(rows, _count, "feature int, toxic bigint, clean bigint"), "toxicity-counts")
    features, ratio = log_ratios(counted)
    picked = materialize(map_arrow(rows, partial(_pick, keep=features), "toxic int, features array<int>"), "toxicity-rows")
    size = {r["toxic"]: r["n"] * stands_for[r["toxic"]] for r in picked.groupBy("toxic").agg(F.count("*").alias("n")).collect()}
    if not size or len(size) == 1 or not len(features):
        return (size.get(1, 0) + 1) / (sum(size.values()) + 2) if size else 0.0
    names = [str(k) for k in range(len(features))]
    vectors = CountVectorizerModel.from_vocabulary(names, inputCol="names", outputCol="present", binary=True)
    scaled = ElementwiseProduct(scalingVec=Vectors.dense(ratio), inputCol="present", outputCol="scaled")
    weight = F.when(F.col("toxic") == 1, stands_for.get(1, 1.0)).otherwise(stands_for.get(0, 1.0))
    known = picked.select(F.col("toxic").cast("double").alias("label"), F.col("features").cast("array<string>").alias("names"), weight.alias("weight"))
    known = scaled.transform(vectors.transform(known)).select("label", "weight", "scaled")
    fitted = LogisticRegression(featuresCol="scaled", weightCol="weight", regParam=PENALTY, maxIter=STEPS, standardization=False).fit(known)
    return Model(features, fitted.coefficients.toArray() * ratio, float(fitted.intercept))


def _score(batches: Iterator[pa.RecordBatch], model) -> Iterator[pa.RecordBatch]:
    m: Model = model.value
    table = m.table()
    used = table != 0
    for batch in batches:
        out = []
        for text in batch.column("text"):
            found = runs(text.as_py())
            out.append(m.intercept + table[np.unique(found[used[found]])].sum())
        yield pa.record_batch([batch.column("id"), pa.array(1 / (1 + np.exp(-np.clip(out, -500, 500))))], names=["id", "score"])


def score(docs: DataFrame, model: Model | float, key: str = "doc_id", text: str = "text") -> DataFrame:
    """``key, score`` of every whole text; no shuffle. The model has a fixed size, so it is broadcast."""
    chosen = docs.select(F.col(key).alias("id"), F.col(text).alias("text"))
    if not isinstance(model, Model):
        return chosen.select(F.col("id").alias(key), F.lit(float(model)).alias("score"))
    sent = docs.sparkSession.sparkContext.broadcast(model)
    return map_arrow(chosen, partial(_score, model=sent), f"id {dict(chosen.dtypes)['id']}, score double").withColumnRenamed("id", key)


def held_out(key: Column) -> Column:
    """The quarter of the rows that is kept from training: CRC-32 of the id as text, modulo 4, is 2."""
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 4 == 2, F.lit(False))


def score_held_out(docs: DataFrame, labels: DataFrame, key: str = "doc_id", text: str = "text", label: str = "toxic", cut: float = CUT) -> DataFrame:
    """Learns from the labels of rows that aren't held out and scores all: ``key, held_out, score, predicted``."""
    model = train(docs, labels.where(~held_out(F.col(key))), key, text, label)
    got = score(docs, model, key, text)
    return got.select(key, held_out(F.col(key)).alias("held_out"), "score", F.when(F.col("score") >= cut, 1).otherwise(0).alias("predicted"))
