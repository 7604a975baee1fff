"""Quality classifier (operator 1): ordinal cumulative-link regression on graded ratings.

One weight vector over hashed words and word endings is shared by all grades; ordered thresholds cut
its score into grades: P(grade > k) = sigmoid(score - threshold k). A document gets its expected
grade and the probability of the tail of grades from which on it is selected.

The model is fitted on a bounded sample of rated documents; scoring is one pass over all whole texts
against the broadcast weights (DIMENSION floats).

Defined cases: a null or empty text has no features and gets the score of the thresholds alone;
repeated rows are scored alike; ids rated several times count with their lowest grade; with no
ratings, every grade is as likely, with only one grade all texts get it; an empty table gives an
empty result; extra columns are ignored, whatever their names.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, functions as F

from .words import (LOWER, Texts, hashes, mix, packed, spans, texts_of, with_added, without_text,
                    words_of)

DIMENSION = 1 << 20
SAMPLE_ROWS = 16_000  # rated documents that the model may be fitted on
STEPS = 300
SHRINK = 1e-4
LEAST_DOCS, LEAST_Z = 6, 5.0  # a feature must be in so many rated documents, and tell grades apart

_LETTER = np.array([97 <= b <= 122 or b >= 128 for b in range(256)])  # of lower-cased text
GRADES = 3           # 0: low quality, 1: good but toxic, 2: good


def grade(quality: Column, toxic: Column) -> Column:
    """The rating of a labelled document."""
    return F.when(quality <= 0, 0).when(F.coalesce(toxic, F.lit(0)) > 0, 1).otherwise(2)


def text_features(texts: Texts) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(owner, feature, value): 1 for each hashed run of letters in a text, and for each way that
    words end (last byte and rough size) four times its share of the words."""
    data, n = LOWER[texts.data], len(texts)
    starts, ends = spans(_LETTER[data], texts.offsets)
    runs = texts.owner(starts) * DIMENSION + _slot(hashes(data, starts, ends))
    words = words_of(texts, lower=True)
    size = np.minimum(words.ends - words.starts, 40) // 4
    ending = mix(data[words.ends - 1].astype(np.uint64) * np.uint64(64) + size.astype(np.uint64))
    marks, times = np.unique(words.owner * DIMENSION + _slot(ending), return_counts=True)
    share = 4 * times / np.bincount(words.owner, minlength=n)[marks // DIMENSION]
    runs = np.unique(runs)
    cell, value = np.concatenate([runs, marks]), np.concatenate([np.ones(len(runs)), share])
    order = np.argsort(cell, kind="stable")
    return cell[order] // DIMENSION, cell[order] % DIMENSION, value[order]


def _slot(value: np.ndarray) -> np.ndarray:
    return (value % np.uint64(DIMENSION)).astype(np.int64)


def telling(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray,
            grades: int) -> np.ndarray:
    """Features whose mean differs clearly between the grades above and below some threshold."""
    n = len(y)
    total, square = (np.bincount(feature, weights=w, minlength=DIMENSION) / n
                     for w in (value, value ** 2))
    spread = np.maximum(square - total ** 2, 1e-12)
    keep = np.zeros(DIMENSION, bool)
    for k in range(grades - 1):
        above = y > k
        many = above.sum(), n - above.sum()
        if min(many):
            high = np.bincount(feature, weights=value * above[owner], minlength=DIMENSION)
            gap = high / many[0] - (total * n - high) / many[1]
            keep |= np.abs(gap) >= LEAST_Z * np.sqrt(spread * (1 / many[0] + 1 / many[1]))
    return keep & (np.bincount(feature, minlength=DIMENSION) >= LEAST_DOCS)


@dataclass
class Ordinal:
    weights: np.ndarray     # of the features
    thresholds: np.ndarray  # ascending, one less than grades

    def tails(self, score: np.ndarray) -> np.ndarray:
        """P(grade > k) for each k, one row per text."""
        return 1 / (1 + np.exp(np.clip(self.thresholds[None, :] - score[:, None], -500, 500)))


def fit_ordinal(owner: np.ndarray, feature: np.ndarray, value: np.ndarray, y: np.ndarray,
                grades: int = GRADES, steps: int = STEPS, rate: float = 0.2,
                shrink: float = SHRINK) -> Ordinal:
    """Maximum likelihood with shrinkage, by Adam over all rows. Thresholds are the first one and
    the logarithms of the gaps, so they stay in order."""
    n = len(y)
    if not n:
        return Ordinal(np.zeros(DIMENSION), np.log(np.arange(1, grades) / np.arange(grades - 1, 0, -1)))
    below = np.cumsum(np.bincount(y, minlength=grades))[:-1] / n
    start = np.log(np.clip(below, 0.02, 0.98) / (1 - np.clip(below, 0.02, 0.98)))
    if y.min() == y.max():
        return Ordinal(np.zeros(DIMENSION), np.where(np.arange(grades - 1) < y[0], -9.0, 9.0))
    clear = telling(owner, feature, value, y, grades)[feature]
    owner, feature, value = owner[clear], feature[clear], value[clear]
    used, column = np.unique(feature, return_inverse=True)
    gaps = np.log(np.maximum(np.diff(start), 0.05))
    theta = np.concatenate([np.zeros(len(used)), start[:1], gaps])
    k = len(used)
    first, second = np.zeros_like(theta), np.zeros_like(theta)
    best, kept = np.inf, theta
    for step in range(1, steps + 1):
        cuts = np.concatenate([theta[k:k + 1], theta[k] + np.cumsum(np.exp(theta[k + 1:]))])
        score = np.bincount(owner, weights=theta[column] * value, minlength=n)
        tail = 1 / (1 + np.exp(-np.clip(score[:, None] - cuts[None, :], -500, 500)))
        edge = np.concatenate([np.ones((n, 1)), tail, np.zeros((n, 1))], axis=1)
        rows = np.arange(n)
        p = np.maximum(edge[rows, y] - edge[rows, y + 1], 1e-12)
        loss = -np.log(p).mean() + shrink * (theta[:k] ** 2).sum() / 2
        if loss < best:
            best, kept = loss, theta.copy()
        slope = edge * (1 - edge)
        by_score = -(slope[rows, y] - slope[rows, y + 1]) / p / n
        by_cut = np.zeros((n, grades + 1))
        by_cut[rows, y] += slope[rows, y] / p / n
        by_cut[rows, y + 1] -= slope[rows, y + 1] / p / n
        by_cut = by_cut[:, 1:-1].sum(axis=0)
        ahead = np.cumsum(by_cut[::-1])[::-1]
        gradient = np.concatenate([
            np.bincount(column, weights=by_score[owner] * value, minlength=k) + shrink * theta[:k],
            ahead[:1], ahead[1:] * np.exp(theta[k + 1:])])
        first = 0.9 * first + 0.1 * gradient
        second = 0.99 * second + 0.01 * gradient ** 2
        theta = theta - rate * min(1.0, 30 / step) * first / (1 - 0.9 ** step) / (
            np.sqrt(second / (1 - 0.99 ** step)) + 1e-8)
    weights = np.zeros(DIMENSION)
    weights[used] = kept[:k]
    return Ordinal(weights, np.concatenate([kept[k:k + 1], kept[k] + np.cumsum(np.exp(kept[k + 1:]))]))


def _listed(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column("_text")):
            owner, feature, value = text_features(texts)
            borders = pa.array(np.searchsorted(owner, np.arange(len(texts) + 1)).astype(np.int32))
            columns, names = without_text(batch, texts)
            yield pa.RecordBatch.from_arrays(
                columns + [pa.ListArray.from_arrays(borders, pa.array(feature, pa.int32())),
                           pa.ListArray.from_arrays(borders, pa.array(value, pa.float32()))],
                names=names + ["feature", "value"])


def fit(docs: DataFrame, ratings: DataFrame, rows: int = SAMPLE_ROWS) -> Ordinal:
    """From at most `rows` of the ratings (doc_id, grade), picked by a hash of the id."""
    sample = (ratings.where("doc_id IS NOT NULL AND grade IS NOT NULL").groupBy("doc_id")
              .agg(F.min("grade").alias("grade")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = packed(docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id"),
                    "doc_id", "grade")
    table = picked.mapInArrow(_listed, with_added(
        picked, "feature array<int>, value array<float>")).select(
        "_row.doc_id", "_row.grade", "feature", "value").toArrow().combine_chunks()
    table = table.sort_by("doc_id")
    lists = table["feature"].combine_chunks() if table.num_rows else None
    if lists is None:
        return fit_ordinal(*[np.zeros(0, int)] * 4)
    size = np.diff(lists.offsets.to_numpy())
    return fit_ordinal(np.repeat(np.arange(table.num_rows), size), lists.flatten().to_numpy(),
                       table["value"].combine_chunks().flatten().to_numpy().astype(np.float64),
                       table["grade"].to_numpy().astype(np.int64))


def graded(docs: DataFrame, model: Ordinal, *keep: str, least: int = GRADES - 1,
           share: float = 0.5) -> DataFrame:
    """_row (a struct of the `keep` columns), expected_grade, tail_probability (of `least` or more)
    and selected (that probability reaches `share`)."""
    weights = model.weights.astype(np.float32)
    shared = docs.sparkSession.sparkContext.broadcast((weights, model.thresholds))

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Ordinal(*shared.value)
        for batch in batches:
            for texts in texts_of(batch.column("_text")):
                owner, feature, value = text_features(texts)
                total = np.bincount(owner, weights=own.weights[feature] * value, minlength=len(texts))
                tails = own.tails(total)
                columns, names = without_text(batch, texts)
                yield pa.RecordBatch.from_arrays(
                    columns + [pa.array(tails.sum(axis=1)), pa.array(tails[:, least - 1])],
                    names=names + ["expected_grade", "tail_probability"])

    rows = packed(docs, *keep)
    out = rows.mapInArrow(score, with_added(rows, "expected_grade double, tail_probability double"))
    return out.withColumn("selected", F.col("tail_probability") >= share)


def op1_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet").where("quality IS NOT NULL")
    ratings = labels.select("doc_id", grade(F.col("quality"), F.col("toxic")).alias("grade"))
    return graded(docs, fit(docs, ratings), "doc_id").select(
        "_row.doc_id", "expected_grade", "tail_probability", "selected")
