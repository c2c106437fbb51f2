"""Toxicity: a character n-gram linear classifier whose features are scaled by naive Bayes log-count ratios.

A text's features are the distinct lower-cased character n-grams, hashed to `2 ** bits` places. Over all labelled rows that
may be learnt from, the number of texts of each class with a feature gives its log-count ratio r; logistic regression
then fits one factor a feature on the features times r. The counts cover every labelled row and are added up
by Spark; the factors are fitted on a bounded sample, `max_fit_rows` rows at most of each class in hash order, in one task.

Plan: counts are pre-added in each task (one row a feature), then by feature; the model is two arrays of fixed size. Scoring is
row by row.

Defined results: null and empty texts have no features and score by the intercept alone; unlabelled rows are scored like others;
a document with several labels counts once for each; without labels of both classes every score is 0; repeated rows get equal
scores; very long texts are scored whole; held_out is null for a null doc_id, which is never learnt from; an empty table gives an empty result; other columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mirrorframe.llm.common import column_or_null, released, ship, stage, table

NGRAMS = (3, 4, 5)
BITS = 18
MIN_Z = 3.0
#: Odd multipliers of the n-gram hash.
MULTIPLIERS = np.array([0x9E3779B97F4A7C15, 0xC2B2AE3D27D4EB4F, 0x165667B19E3779F9, 0xD6E8FEB86659FD93, 0xA0761D6478BD642F], np.uint64)


def feature_ids(text: str | None, mark: np.ndarray) -> np.ndarray:
    """Places of the text's distinct n-grams, ascending. mark: False throughout, of the size of the feature space; left so. Short texts sort their places instead."""
    x = np.frombuffer(f" {text.lower()} ".encode("utf-32-le", "surrogatepass"), "<u4").astype(np.uint64) if text else np.zeros(0, np.uint64)
    bits = np.uint64(64 - (len(mark).bit_length() - 1))
    short, places = len(x) * 8 < len(mark), []
    for n in NGRAMS:
        if len(x) >= n:
            h = x[: len(x) - n + 1] * MULTIPLIERS[0]
            for i in range(1, n):
                h = (h ^ (h >> np.uint64(29))) * MULTIPLIERS[i] + x[i : len(x) - n + 1 + i]
            h = ((h ^ (h >> np.uint64(32))) * MULTIPLIERS[0]) >> bits
            if short:
                places.append(h.astype(np.int64))
            else:
                mark[h] = True
    if short:
        return np.unique(np.concatenate(places)) if places else np.zeros(0, np.int64)
    found = np.flatnonzero(mark)
    mark[found] = False
    return found


@dataclass
class Model:
    """Weight of each place (its log-count ratio times its factor) and the intercept."""

    weights: np.ndarray
    intercept: float

    def score(self, ids: np.ndarray) -> float:
        if np.isneginf(self.intercept):
            return 0.0
        return float(1 / (1 + np.exp(-np.clip(self.weights[ids].sum() + self.intercept, -40, 40))))


def log_count_ratios(rows: DataFrame, bits: int) -> tuple[np.ndarray, tuple[int, int]]:
    """rows: text, label. Texts of each class, and for each place the log ratio of the share of each class's texts that have a feature, smoothed by one text of either class in proportion; 0 where that is chance."""
    size = 1 << bits

    @released
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, mark = np.zeros((2, size), np.int64), np.zeros(size, bool)
        n = [0, 0]
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                counts[label, feature_ids(text, mark)] += 1
                n[label] += 1
        if sum(n):
            some = np.flatnonzero(counts.any(axis=0))
            yield pa.RecordBatch.from_arrays([pa.array([*some.tolist(), -1]), pa.array([*counts[0, some].tolist(), n[0]]), pa.array([*counts[1, some].tolist(), n[1]])], names=["place", "clean", "toxic"])

    totals = rows.mapInArrow(count, "place long, clean long, toxic long").groupBy("place").agg(F.sum("clean").alias("clean"), F.sum("toxic").alias("toxic")).toPandas()  # 2 ** bits rows at most
    n = totals[totals.place < 0]
    if not len(n) or not int(n.clean.iloc[0]) or not int(n.toxic.iloc[0]):
        return np.zeros(0), (0, 0)
    counts = np.zeros((2, size))
    some = totals[totals.place >= 0]
    counts[0, some.place], counts[1, some.place] = some.clean, some.toxic
    texts = np.array([[n.clean.iloc[0]], [n.toxic.iloc[0]]], float)
    share = (counts + texts / texts.sum()) / (texts + 1)
    ratios = np.log(share[1] / share[0])
    error = np.sqrt((1 / (counts + 0.5)).sum(axis=0))
    return np.where(np.abs(ratios) >= MIN_Z * error, ratios, 0), (int(n.clean.iloc[0]), int(n.toxic.iloc[0]))


def first_by_hash(rows: DataFrame, label: int, n: int, most: int) -> DataFrame:
    """The `most` rows of a class that come first by the hash of their id, of n in all.

    A bound on the hash, just above what their share needs, keeps tasks from sending more than they have to; where it is too low by chance it is dropped.
    """
    own, order = rows.filter(F.col("label") == label), F.xxhash64("id")
    if n > most:
        share = (most + 6 * most**0.5 + 10) / n
        below = own.filter(order < -(1 << 63) + int(share * (1 << 64))) if share < 1 else own
        own = below if below.count() >= most else own
    return own.orderBy(order, "id").limit(most)


def adam(ids: list[np.ndarray], y: np.ndarray, ratios: np.ndarray, l2: float, rounds: int) -> tuple[np.ndarray, float, np.ndarray]:
    """Factors, intercept and the places that have factors, by gradient steps on the logistic loss with both classes of one weight.

    The factor of a place without a ratio has no gradient and stays 0, so only places with one take part.
    """
    used = np.flatnonzero(ratios)
    place = np.full(len(ratios), -1, np.int64)
    place[used] = np.arange(len(used))
    r = ratios[used]
    held = [place[x][place[x] >= 0] for x in ids]
    flat, row = np.concatenate(held), np.repeat(np.arange(len(ids)), np.fromiter(map(len, held), np.int64, len(ids)))
    each = np.where(y == 1, 0.5 / max(1, y.sum()), 0.5 / max(1, (1 - y).sum()))
    # They start at 0, so a feature that doesn't help stays out
    factor, bias = np.zeros(len(used), np.float32), 0.0
    m, v, mb, vb = np.zeros_like(factor), np.zeros_like(factor), 0.0, 0.0
    for t in range(1, rounds + 1):
        z = np.bincount(row, (factor * r)[flat], len(ids)) + bias
        d = (1 / (1 + np.exp(-np.clip(z, -40, 40))) - y) * each
        g = np.bincount(flat, d[row], len(used)).astype(np.float32) * r + l2 * factor
        m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
        mb, vb = 0.9 * mb + 0.1 * d.sum(), 0.99 * vb + 0.01 * d.sum() ** 2
        rate = 0.03
        factor -= rate * (m / (1 - 0.9**t)) / (np.sqrt(v / (1 - 0.99**t)) + 1e-6)
        bias -= rate * (mb / (1 - 0.9**t)) / (np.sqrt(vb / (1 - 0.99**t)) + 1e-8)
    return factor, bias, used


def fit(rows: DataFrame, *, bits: int = BITS, max_fit_rows: int = 2500, l2: float = 2e-4, rounds: int = 200) -> Model:
    """rows: id, text, label (0 or 1). See the module for what is counted and what is sampled."""
    ship(rows.sparkSession)
    rows = rows.filter("label in (0, 1)")
    ratios, n = log_count_ratios(rows.select("text", "label"), bits)
    if not len(ratios):
        return Model(np.zeros(1 << bits), -np.inf)
    spark = rows.sparkSession
    picked = first_by_hash(rows, 0, n[0], max_fit_rows).unionByName(first_by_hash(rows, 1, n[1], max_fit_rows))
    shared = spark.sparkContext.broadcast(ratios.astype(np.float32))

    @released
    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        mark, ids, labels = np.zeros(1 << bits, bool), [], []
        for batch in batches:
            for text, label in zip(batch.column("text").to_pylist(), batch.column("label").to_pylist(), strict=True):
                ids.append(feature_ids(text, mark).astype(np.int32))
                labels.append(label)
        if not ids:
            return
        factor, bias, used = adam(ids, np.array(labels, np.float32), shared.value, l2, rounds)
        weights = np.zeros(1 << bits, "<f4")
        weights[used] = factor * shared.value[used]
        yield pa.RecordBatch.from_arrays([pa.array([weights.tobytes()], pa.binary()), pa.array([float(bias)])], names=["weights", "bias"])

    made = picked.select("text", "label").coalesce(1).mapInArrow(train, "weights binary, bias double").first()
    return Model(np.frombuffer(bytes(made.weights), "<f4").astype(np.float64), made.bias)


def score(docs: DataFrame, model: Model, *, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """id and score (0 to 1)."""
    ship(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    @released
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = shared.value
        mark = np.zeros(len(own.weights), bool)
        for batch in batches:
            scores = [own.score(feature_ids(x.as_py(), mark)) for x in batch.column("text")]
            yield pa.RecordBatch.from_arrays([batch.column("id"), pa.array(scores, pa.float64())], names=["id", "score"])

    source = docs.select(column_or_null(docs, id_col, "long").alias("id"), column_or_null(docs, text_col, "string").alias("text"))
    return source.mapInArrow(run, "id long, score double").withColumnRenamed("id", id_col)


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Scores of all documents by a model of the labelled rows whose crc32(doc_id) mod 3 is not 1."""
    docs, labels = table(spark, sf_dir, "documents"), table(spark, sf_dir, "labels")
    held_out = F.crc32(F.col("doc_id").cast("string").cast("binary")) % 3 == 1
    # One plan at every size: texts are dealt by id, and labels are the hashed side
    learnt = docs.join(labels.filter(~held_out).select("doc_id", "toxic").hint("shuffle_hash"), "doc_id").select(F.col("doc_id").alias("id"), "text", F.col("toxic").cast("int").alias("label"))
    model = fit(stage(learnt, "toxic-learnt"))
    return score(docs, model).select("doc_id", held_out.alias("held_out"), "score", F.when(F.col("score") >= 0.7, 1).otherwise(0).alias("predicted"))


