"""Quality classifier: regularised quadratic discriminant analysis of document statistics.

A text becomes a vector of transformed statistics (log ratios of character
classes, of repeated words, lines and trigrams, and of lengths).  Each class
is a Gaussian whose covariance is shrunk towards its diagonal with a ridge;
its Cholesky factor is computed once, and with its solution for the unit
vectors cached in the model, so that scoring multiplies a batch at a time.  The score is the logistic of
the log-density difference plus the log prior odds; the difference counts by
n^2 / (n^2 + EVIDENCE_WORDS^2) for a text of n words, as ratios of a few
characters say little.

The model is fitted to all labelled rows by sums and cross products, which
partial aggregation brings down to two rows; nothing is sampled.  The texts
are read once: their statistics are a small table that fit and scoring read.

Defined cases: null and empty texts score the prior odds; labels other than
0 and 1 are ignored, a label repeated for an id counts once and an id with
both labels counts in both classes; a null id is never held out and never
trained on; with rows of fewer than two classes all scores are the smoothed
share of class 1; an empty table gives an empty result.
"""

from __future__ import annotations

import math
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_arrow, quoted, remainder, small_batches, text_or_empty, texts_of, written

THRESHOLD = 0.7
SHRINKAGE = 0.1
RIDGE = 0.02
EVIDENCE_WORDS = 8
FEATURES = ("upper", "odd", "digit", "mark", "space", "repeat_word", "repeat_line", "repeat_trigram", "repeat_next", "words", "mean_length", "spread_length", "unworded", "line_words")


def _class(*codes: int) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(codes)] = True
    return out


_UPPER, _LOWER, _DIGIT = _class(*range(65, 91)), _class(*range(97, 123), *range(128, 256)), _class(*range(48, 58))
_SPACE, _MARK = _class(32, *range(9, 14)), _class(*b".,;:'\"()-?")
_KNOWN = _UPPER | _LOWER | _DIGIT | _SPACE | _MARK
_WORD_END = frozenset(np.flatnonzero(_UPPER | _LOWER | _DIGIT).tolist()) | frozenset(b".,")


def statistics(text: bytes) -> tuple[list[float], int]:
    """The transformed statistics of UTF-8 text, as in FEATURES, and its count of words."""
    h = np.bincount(np.frombuffer(text, np.uint8), minlength=256)
    n, upper, lower = len(text), int(h[_UPPER].sum()), int(h[_LOWER].sum())
    digit, mark, space, odd = (int(h[c].sum()) for c in (_DIGIT, _MARK, _SPACE, ~_KNOWN))
    words = text.lower().split()
    count = len(words)
    lines = [x for x in map(bytes.strip, text.split(b"\n")) if x]
    trigrams = Counter(zip(words, words[1:], words[2:]))  # noqa: B905
    repeated = max(0, count - 2) - len(trigrams)
    next_same = sum(map(bytes.__eq__, words, words[1:]))
    unworded = sum(1 for w in words if w[0] < 48 or w[-1] not in _WORD_END)
    lengths = np.fromiter(map(len, words), np.float64, count) if count else np.zeros(1)
    log = math.log
    return [
        log((upper + 1) / (lower + 20)),
        log((odd + 0.5) / (n + 50)),
        log((digit + 0.5) / (n + 50)),
        log((mark + 1) / (n + 50)),
        log((space + 1) / (n + 6)),
        log((count - len(set(words)) + 2) / (count + 10)),
        log((len(lines) - len(set(lines)) + 0.5) / (len(lines) + 2)),
        log((repeated + 0.5) / (count + 20)),
        log((next_same + 0.5) / (count + 20)),
        log(count + 5),
        float(lengths.mean()),
        log(float(lengths.std()) + 1),
        log((unworded + 0.5) / (count + 20)),
        log((count + 5) / (len(lines) + 1)),
    ], count


@dataclass(frozen=True)
class Discriminant:
    """Means, Cholesky factors and log determinants of two classes, and the log odds of the prior."""

    prior: float
    means: tuple[np.ndarray, ...] = ()
    factors: tuple[np.ndarray, ...] = ()
    halves: tuple[float, ...] = ()
    inverses: tuple[np.ndarray, ...] = ()  # of the factors, solved for once

    def log_density(self, k: int, x: np.ndarray) -> np.ndarray:
        z = (x - self.means[k]) @ self.inverses[k].T
        return -0.5 * (z * z).sum(axis=1) - self.halves[k]

    def score(self, x: np.ndarray, words: np.ndarray) -> np.ndarray:
        odds = np.full(len(x), self.prior)
        if self.means and len(x):
            square = words.astype(np.float64) ** 2
            odds += (self.log_density(1, x) - self.log_density(0, x)) * square / (square + EVIDENCE_WORDS**2)
        return 1 / (1 + np.exp(-np.clip(odds, -500, 500)))


def discriminant(sums: dict[int, tuple[int, np.ndarray, np.ndarray]], shrinkage: float, ridge: float) -> Discriminant:
    """From each class's count, sums and cross products."""
    n0, n1 = (sums[k][0] if k in sums else 0 for k in (0, 1))
    prior = math.log((n1 + 1) / (n0 + 1))
    if min(n0, n1) < 2:
        return Discriminant(prior)
    total = n0 + n1
    centre = (sums[0][1] + sums[1][1]) / total
    pooled = np.diag(sums[0][2] + sums[1][2]) / total - centre**2
    floor = np.diag(ridge * np.maximum(pooled, 1e-6))
    means, factors, halves = [], [], []
    for k in (0, 1):
        n, first, second = sums[k]
        mean = first / n
        covariance = second / n - np.outer(mean, mean)
        shrunk = (1 - shrinkage) * covariance + shrinkage * np.diag(np.diag(covariance)) + floor
        factor = np.linalg.cholesky(shrunk)
        means.append(mean)
        factors.append(factor)
        halves.append(float(np.log(np.diag(factor)).sum()))
    inverses = tuple(np.linalg.solve(f, np.eye(len(f))) for f in factors)
    return Discriminant(prior, tuple(means), tuple(factors), tuple(halves), inverses)


def fit(training: DataFrame, label: str, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """The model of rows with the columns of FEATURES and a label of 0 or 1."""
    d = len(FEATURES)
    crossed = [(i, j) for i in range(d) for j in range(i, d)]
    sums = [F.sum(f).alias(f"s_{f}") for f in FEATURES] + [F.sum(F.col(FEATURES[i]) * F.col(FEATURES[j])).alias(f"c_{i}_{j}") for i, j in crossed]
    found = {}
    for row in training.groupBy(label).agg(F.count(F.lit(1)).alias("n"), *sums).collect():  # two rows
        second = np.zeros((d, d))
        for i, j in crossed:
            second[i, j] = second[j, i] = row[f"c_{i}_{j}"]
        found[row[label]] = (row["n"], np.array([row[f"s_{f}"] for f in FEATURES]), second)
    return discriminant(found, shrinkage, ridge)


def document_statistics(docs: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(__id, __content, __words, *FEATURES) of every row."""
    small_batches(docs.sparkSession)

    def of(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        found = [statistics(t) for t in texts_of(batch.column(2))]
        x = np.array([f for f, _ in found])
        columns = [pa.array(np.ascontiguousarray(x[:, i])) for i in range(len(FEATURES))]
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array([c for _, c in found], pa.int64()), *columns], ["__id", "__content", "__words", *FEATURES])

    text, kind = text_or_empty(quoted(text_col)), dict(docs.dtypes)[id_col]
    schema = f"__id {kind}, __content long, __words long, " + ", ".join(f"{f} double" for f in FEATURES)
    return map_arrow(docs.select(F.col(quoted(id_col)).alias("__id"), F.xxhash64(text).alias("__content"), text.alias("t")), of, schema)


def quality_scores(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_id: str = "doc_id", label_col: str = "quality", modulus: int = 4, held_out: int = 2, threshold: float = THRESHOLD) -> DataFrame:
    """(id, __content, held_out, score, predicted) of every row, from the labels of rows that aren't held out."""
    stats = written(document_statistics(docs, id_col, text_col), "quality-statistics")
    known = labels.select(F.col(quoted(label_id)).alias("__id"), F.col(quoted(label_col)).cast("int").alias("__label")).filter("__label IN (0, 1)").distinct()
    known = known.filter(remainder("__id", modulus) != held_out)
    model = docs.sparkSession.sparkContext.broadcast(fit(stats.join(known, "__id"), "__label"))

    def score(batch: pa.RecordBatch) -> Iterator[pa.RecordBatch]:
        x = np.stack([batch.column(i).to_numpy() for i in range(3, 3 + len(FEATURES))], axis=1)
        yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(model.value.score(x, batch.column(2).to_numpy()))], ["__id", "__content", "score"])

    kind = dict(docs.dtypes)[id_col]
    scored = map_arrow(stats, score, f"__id {kind}, __content long, score double")
    return scored.select(
        F.col("__id").alias(id_col),
        "__content",
        F.coalesce(remainder("__id", modulus) == held_out, F.lit(False)).alias("held_out"),
        "score",
        (F.col("score") >= threshold).cast("int").alias("predicted"),
    )


def keep_quality(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", **options) -> DataFrame:
    """The rows of docs that the classifier accepts."""
    from .exact_dedup import drop_keys

    rejected = quality_scores(docs, labels, id_col, text_col, **options).filter("predicted = 0")
    rejected = written(rejected.select(F.col(id_col).alias("__id"), "__content").distinct(), "quality-rejected")
    identity = {"__id": F.col(quoted(id_col)), "__content": F.xxhash64(text_or_empty(quoted(text_col)))}
    return drop_keys(docs.withColumns(identity), rejected).select(*[quoted(c) for c in docs.columns])
