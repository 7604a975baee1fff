"""Quality rules (operator 8): gradient-boosted trees over document statistics.

`with_statistics` measures every whole text, `fit` grows the trees on a bounded sample of labelled
documents, `Trees.score` walks all rows through flat node arrays at once. Chosen statistics are
monotone: more symbols, repeated lines or repeated word windows never raise the score.

Defined cases: a null or empty text has zero in every count and fails the base rule; a row with
null in other columns is scored like any other; repeated rows give repeated results; an empty table
gives an empty result; without usable labels there are no trees and every text that passes the base
rule is kept; extra columns are ignored by `judged` and carried along by `kept_documents`.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass, field

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, functions as F

from .words import (HEAD, SPACE, hashes, packed, spans, texts_of, windows, with_added,
                    without_text, words_of)

COUNTS = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
# Further counts that only the trees see.
MORE = ["n_lines", "n_upper", "n_digits", "n_stops", "n_marks", "n_long_words", "n_short_words"]
FEATURES = ["words", "word_length", "symbols", "dup_lines", "repeats", "line_words", "upper",
            "digits", "stops", "marks", "long_words", "short_words"]
FALLING = ["symbols", "dup_lines", "repeats"]  # the score never rises with these

SAMPLE_ROWS = 20_000  # most labelled documents that the trees are fitted on
MIN_WORDS = 50

_ALL = np.arange(256)
_SYMBOL = np.isin(_ALL, list(b"#*$%&|<>"))
_UPPER = (_ALL >= 65) & (_ALL <= 90)
_DIGIT = (_ALL >= 48) & (_ALL <= 57)
_STOP = np.isin(_ALL, list(b".!?"))
_MARK = np.isin(_ALL, list(b",;:"))


def _measure(texts) -> dict[str, np.ndarray]:
    data, n = texts.data, len(texts)
    words = words_of(texts, lower=False)
    count = np.bincount(words.owner, minlength=n)
    in_word = ~SPACE[data]
    chars = np.concatenate([[0], np.cumsum(HEAD[data], dtype=np.int64)])
    length = chars[words.ends] - chars[words.starts]

    at, key = windows(words, 3)
    inside = key ^ (words.owner[at].astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, back, times = np.unique(inside, return_inverse=True, return_counts=True)
    again = at[times[back] >= 2]
    repeated = np.zeros(len(words.hash), bool)
    for k in range(3):
        repeated[again + k] = True

    starts, ends = spans(data != 10, texts.offsets)
    before = np.concatenate([[0], np.cumsum(in_word, dtype=np.int64)])
    filled = before[ends] > before[starts]
    starts, ends = starts[filled], ends[filled]
    owner = texts.owner(starts)
    line = hashes(data, starts, ends) ^ (owner.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
    _, first = np.unique(line, return_index=True)
    lines = np.bincount(owner, minlength=n)
    return {
        "n_words": count, "word_chars": texts.total(HEAD[data] & in_word),
        "n_symbols": texts.total(_SYMBOL[data]),
        "n_dup_lines": lines - np.bincount(owner[first], minlength=n),
        "n_repeat_words": np.bincount(words.owner[repeated], minlength=n),
        "n_lines": lines, "n_upper": texts.total(_UPPER[data]),
        "n_digits": texts.total(_DIGIT[data]), "n_stops": texts.total(_STOP[data]),
        "n_marks": texts.total(_MARK[data]),
        "n_long_words": np.bincount(words.owner[length > 12], minlength=n),
        "n_short_words": np.bincount(words.owner[length <= 3], minlength=n),
    }


def _statistics(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for texts in texts_of(batch.column("_text")):
            found = _measure(texts)
            columns, names = without_text(batch, texts)
            yield pa.RecordBatch.from_arrays(
                columns + [pa.array(found[c], pa.int64()) for c in COUNTS + MORE],
                names=names + COUNTS + MORE)


def with_statistics(docs: DataFrame, *keep: str) -> DataFrame:
    """_row (a struct of the `keep` columns) and the counts of each whole text."""
    rows = packed(docs, *keep)
    added = ", ".join(f"{c} long" for c in COUNTS + MORE)
    return rows.mapInArrow(_statistics, with_added(rows, added))


def features(counts: dict[str, np.ndarray]) -> np.ndarray:
    """One row of statistics per document, as the trees read them."""
    c = {k: np.asarray(v, np.float64) for k, v in counts.items()}
    words, chars = np.maximum(c["n_words"], 1), np.maximum(c["word_chars"], 1)
    columns = [np.log1p(c["n_words"]), c["word_chars"] / words, c["n_symbols"] / words,
               c["n_dup_lines"] / np.maximum(c["n_lines"], 1), c["n_repeat_words"] / words,
               np.log1p(words / np.maximum(c["n_lines"], 1)), c["n_upper"] / chars,
               c["n_digits"] / chars, c["n_stops"] / words, c["n_marks"] / words,
               c["n_long_words"] / words, c["n_short_words"] / words]
    return np.stack(columns, axis=1)


@dataclass
class Trees:
    """All trees in flat arrays. Node i asks x[feature[i]] <= cut[i]; yes goes to child[i], no to
    child[i] + 1; a leaf has feature -1 and adds value[i]."""

    start: float = 0.0
    roots: list[int] = field(default_factory=list)
    feature: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    cut: np.ndarray = field(default_factory=lambda: np.zeros(0))
    child: np.ndarray = field(default_factory=lambda: np.zeros(0, np.int32))
    value: np.ndarray = field(default_factory=lambda: np.zeros(0))

    def score(self, x: np.ndarray) -> np.ndarray:
        """Probability that a document is good, for all rows of x at once."""
        total = np.full(len(x), self.start)
        rows = np.arange(len(x))
        for root in self.roots:
            at = np.full(len(x), root)
            while True:
                asks = self.feature[at]
                inner = asks >= 0
                if not inner.any():
                    break
                right = x[rows, np.maximum(asks, 0)] > self.cut[at]
                at = np.where(inner, self.child[at] + right, at)
            total += self.value[at]
        return 1 / (1 + np.exp(-total))


def grow(x: np.ndarray, y: np.ndarray, trees: int = 60, depth: int = 3, rate: float = 0.2,
         bins: int = 64, smooth: float = 5.0, falling: list[str] = FALLING) -> Trees:
    """Boosted trees for P(y = 1), by second-order gain over binned statistics. On a falling
    statistic a split is taken only if its left side scores at least its right side, and both
    sides stay on their side of the middle below, so that the whole tree is monotone."""
    if not len(y) or y.min() == y.max():
        return Trees(start=0.0 if not len(y) else (4.0 if y.min() else -4.0))
    rate_of_good = y.mean()
    out = Trees(start=float(np.log(rate_of_good / (1 - rate_of_good))))
    cuts = [np.unique(np.quantile(column, np.linspace(0, 1, bins + 1)[1:-1])) for column in x.T]
    binned = np.stack([np.searchsorted(c, column) for c, column in zip(cuts, x.T)], axis=1)
    must_fall = np.array([f in falling for f in FEATURES])
    nodes: list[list[float]] = []
    score = np.full(len(y), out.start)
    for _ in range(trees):
        p = 1 / (1 + np.exp(-score))
        slope, bend = y - p, p * (1 - p)
        out.roots.append(len(nodes))
        nodes.append([-1, 0.0, 0, 0.0])
        work = [(out.roots[-1], np.arange(len(y)), -np.inf, np.inf, 0)]
        while work:
            node, rows, low, high, level = work.pop()
            g, h = slope[rows].sum(), bend[rows].sum()
            value = float(np.clip(g / (h + smooth), low, high))
            nodes[node][3] = rate * value
            split = _best(binned[rows], slope[rows], bend[rows], cuts, smooth, must_fall, low, high) \
                if level < depth else None
            if split is None:
                score[rows] += rate * value
                continue
            f, b, left, right = split
            goes_left = binned[rows, f] <= b
            nodes[node][:3] = [f, cuts[f][b], len(nodes)]
            bounds = [(low, high), (low, high)]
            if must_fall[f]:
                middle = (left + right) / 2
                bounds = [(middle, high), (low, middle)]
            for side, (lo, hi) in zip((goes_left, ~goes_left), bounds):
                nodes.append([-1, 0.0, 0, 0.0])
                work.append((len(nodes) - 1, rows[side], lo, hi, level + 1))
    flat = np.array(nodes)
    out.feature, out.cut = flat[:, 0].astype(np.int32), flat[:, 1]
    out.child, out.value = flat[:, 2].astype(np.int32), flat[:, 3]
    return out


def _best(binned, slope, bend, cuts, smooth, must_fall, low, high, least: int = 20):
    best, found = 1e-6, None
    whole = slope.sum() ** 2 / (bend.sum() + smooth)
    for f, edges in enumerate(cuts):
        n = len(edges) + 1
        g, h = (np.cumsum(np.bincount(binned[:, f], weights=w, minlength=n)) for w in (slope, bend))
        k = np.cumsum(np.bincount(binned[:, f], minlength=n))
        gl, hl, gr, hr = g[:-1], h[:-1], g[-1] - g[:-1], h[-1] - h[:-1]
        left, right = (np.clip(a / (b + smooth), low, high) for a, b in ((gl, hl), (gr, hr)))
        gain = gl ** 2 / (hl + smooth) + gr ** 2 / (hr + smooth) - whole
        allowed = (k[:-1] >= least) & (k[-1] - k[:-1] >= least)
        if must_fall[f]:
            allowed &= left >= right
        gain = np.where(allowed, gain, -np.inf)
        if len(gain) and gain.max() > best:
            b = int(gain.argmax())
            best, found = gain[b], (f, b, left[b], right[b])
    return found


def fit(docs: DataFrame, labels: DataFrame, rows: int = SAMPLE_ROWS) -> Trees:
    """Trees from at most `rows` labelled documents, picked by a hash of the id. Ids with
    contradicting labels count with their lower one."""
    sample = (labels.where("doc_id IS NOT NULL AND quality IS NOT NULL")
              .groupBy("doc_id").agg(F.min("quality").alias("quality"))
              .orderBy(F.xxhash64("doc_id"), "doc_id").limit(rows))
    picked = docs.select("doc_id", "text").join(F.broadcast(sample), "doc_id")
    table = with_statistics(picked, "doc_id", "quality").select("_row.*", *COUNTS, *MORE).toArrow()
    if not table.num_rows:
        return Trees()
    order = np.argsort(table["doc_id"].to_numpy(), kind="stable")
    x = features({c: table[c].to_numpy()[order] for c in COUNTS + MORE})
    usable = x[:, 0] >= np.log1p(MIN_WORDS)  # shorter ones fail the base rule anyway
    y = (table["quality"].to_numpy()[order] > 0).astype(np.float64)
    return grow(x[usable], y[usable])


def judged(docs: DataFrame, trees: Trees, *keep: str, threshold: float = 0.5) -> DataFrame:
    """_row (a struct of the `keep` columns), the counts, score, base_failed and kept."""
    def scored(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = features({c: batch.column(c).to_numpy() for c in COUNTS + MORE})
            yield batch.append_column("score", pa.array(trees.score(x), pa.float64()))

    counted = with_statistics(docs, *keep)
    out = counted.mapInArrow(scored, with_added(counted, "score double"))
    failed = (F.col("n_words") < MIN_WORDS) | (100 * F.col("n_repeat_words") > 50 * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn(
        "kept", ~F.col("base_failed") & (F.col("score") >= threshold)).drop(*MORE)


def op8_quality_rules(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, trees, "doc_id").select("_row.*", *COUNTS, "base_failed", "kept", "score")


def kept_documents(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pipeline stage: documents that the rules reject go; all columns stay as they are."""
    trees = fit(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    return judged(docs, trees, *docs.columns).where("kept").select("_row.*")
