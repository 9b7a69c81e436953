"""Quality classifier: regularised quadratic discriminant over document statistics.

Statistics of whole texts are transformed to numbers of like scale. Each class gets its mean
and a covariance shrunk towards the pooled variances; both come from sums and cross-products
that one aggregate collects over all labelled rows. A score is the logistic of the
difference of the two log densities (Mahalanobis distances by Cholesky factors computed
once) plus the log odds of the classes.

Defined results: null text counts as empty, whose statistics are all zero; a label row with
a null is not learned from, a repeated label of a document counts once; without labels of
both classes every score is the smoothed share of label 1; a null doc_id is not held out.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .arrays import Spans, column, pieces, stretches, tidy
from .common import stored

#: Share of the pooled variances in a class covariance, and what is added to each variance.
SHRINKAGE, RIDGE = 0.3, 1e-3
PIECE = 1 << 20
CLASSES = ("other", "space", "line", "upper", "lower", "digit", "symbol", "bang", "bar", "stop", "high")
FEATURES = ("words", "word_length", "word_spread", "upper", "digit", "symbol", "bang", "bar", "stop", "high", "distinct", "echo", "line_words")

_CLASS = np.zeros(256, np.int64)
for _k, _chars in enumerate(("", " \t\v\f\r", "\n", "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz", "0123456789", "#*$%&<>", "!", "|", ".,;:?")):
    _CLASS[[ord(c) for c in _chars]] = _k
_CLASS[0xC0:] = 10  # first bytes of characters beyond ASCII; the bytes that follow count as other


def statistics(data: np.ndarray, at: np.ndarray) -> np.ndarray:
    """One row of FEATURES a text."""
    n = len(at) - 1
    doc = np.repeat(np.arange(n), np.diff(at))
    kind = _CLASS[data]
    count = dict(zip(CLASSES, np.bincount(doc * len(CLASSES) + kind, minlength=n * len(CLASSES)).reshape(n, -1).T.astype(float)))
    head = np.zeros(len(data) + 1, bool)
    head[at] = True
    start, end = stretches((kind != 1) & (kind != 2), head[:-1])
    of = np.searchsorted(at, start, "right") - 1
    size = (end - start).astype(float)
    words = np.bincount(of, minlength=n).astype(float)
    some = np.maximum(words, 1)
    mean = np.bincount(of, size, n) / some
    spread = np.sqrt(np.maximum(np.bincount(of, size * size, n) / some - mean**2, 0))
    h = Spans(data).hash(start, end)
    order = np.lexsort((h, of))
    fresh = np.concatenate([[True], (h[order][1:] != h[order][:-1]) | (of[order][1:] != of[order][:-1])])[: len(order)]
    distinct = np.bincount(of[order][fresh], minlength=n) / some
    again = np.flatnonzero((h[1:] == h[:-1]) & (of[1:] == of[:-1]))
    echo = np.bincount(of[again], minlength=n) / some
    letters = np.maximum(count["upper"] + count["lower"] + count["high"], 1)
    return np.column_stack([
        np.log1p(words), mean, spread, np.sqrt(count["upper"] / letters), np.sqrt(count["digit"] / some), np.sqrt(count["symbol"] / some),
        np.sqrt(count["bang"] / some), np.sqrt(count["bar"] / some), np.sqrt(count["stop"] / some), np.sqrt(count["high"] / letters),
        distinct, np.sqrt(echo), np.log1p(words / (count["line"] + 1)),
    ])


def with_statistics(docs: DataFrame) -> DataFrame:
    """doc_id and ``x``, the statistics of its text."""

    def run(batches):
        for batch in batches:
            data, at = column(batch.column("text"))
            for i, j in pieces(at, PIECE):
                x = statistics(data[at[i] : at[j]], at[i : j + 1] - at[i])
                yield pa.RecordBatch.from_arrays(
                    [batch.column("doc_id").slice(i, j - i), pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))], ["doc_id", "x"]
                )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").mapInArrow(tidy(run), "doc_id long, x array<double>")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % 3 == 1, F.lit(False))


@dataclass(frozen=True)
class Discriminant:
    """Means and inverse Cholesky factors of class 0 and class 1, and the log odds of 1."""

    mean: tuple[np.ndarray, np.ndarray] | None
    whiten: tuple[np.ndarray, np.ndarray] | None
    log_odds: float

    def score(self, x: np.ndarray) -> np.ndarray:
        z = np.full(len(x), self.log_odds)
        if self.mean is not None:
            for sign, m, w in zip((-1, 1), self.mean, self.whiten):
                d = (x - m) @ w.T
                z += sign * (np.log(np.diag(w)).sum() - 0.5 * (d * d).sum(axis=1))
        return 0.5 * (1 + np.tanh(z / 2))


def fit(labelled: DataFrame, shrinkage: float = SHRINKAGE, ridge: float = RIDGE) -> Discriminant:
    """From rows (x, quality): one aggregate of sums and cross-products for each class."""
    k = len(FEATURES)
    at = lambda i: F.get("x", F.lit(i))
    pairs = [(i, j) for i in range(k) for j in range(i, k)]
    rows = labelled.groupBy("quality").agg(F.count(F.lit(1)).alias("n"), *[F.sum(at(i)).alias(f"s{i}") for i in range(k)], *[F.sum(at(i) * at(j)).alias(f"c{i}_{j}") for i, j in pairs]).collect()
    by = {int(r["quality"]): r for r in rows}
    n = [by[c]["n"] if c in by else 0 for c in (0, 1)]
    log_odds = float(np.log((n[1] + 1) / (n[0] + 1)))
    if min(n) == 0:
        return Discriminant(None, None, log_odds)
    mean, cov = [], []
    for c in (0, 1):
        m = np.array([by[c][f"s{i}"] for i in range(k)]) / n[c]
        s = np.zeros((k, k))
        for i, j in pairs:
            s[i, j] = s[j, i] = by[c][f"c{i}_{j}"] / n[c] - m[i] * m[j]
        mean.append(m)
        cov.append(s)
    pooled = np.diag(np.maximum(np.diag(n[0] * cov[0] + n[1] * cov[1]) / sum(n), 0))
    factors = [np.linalg.cholesky((1 - shrinkage) * s + shrinkage * pooled + ridge * np.eye(k)) for s in cov]
    return Discriminant(tuple(mean), tuple(np.linalg.inv(f) for f in factors), log_odds)


def scored(stats: DataFrame, model: Discriminant) -> DataFrame:
    """(doc_id, score) of every row of ``stats``."""
    def run(batches):
        for batch in batches:
            x = batch.column("x").flatten().to_numpy().reshape(-1, len(FEATURES))
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(model.score(x))], ["doc_id", "score"])

    return stats.mapInArrow(tidy(run), "doc_id long, score double")


def quality_scores(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """doc_id, held_out, score and predicted for every row of ``docs``, learned from the
    labels of documents that are not held out."""
    stats = stored(with_statistics(docs), "statistics")
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("quality").cast("int").alias("quality")).where("doc_id is not null and quality in (0, 1)").where(~held_out(F.col("doc_id"))).distinct()
    model = fit(stats.join(known, "doc_id"))
    return scored(stats, model).select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "score", (F.col("score") >= 0.5).cast("int").alias("predicted"))
