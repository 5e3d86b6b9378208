"""Text classes by multinomial naive Bayes over hashed words and punctuation, fitted by summing counts of tasks."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .tables import steps, text_buffers
from .words import PUNCTUATION, words_of

#: Buckets of words; the next 256 places count the bytes that are neither letters nor digits.
BUCKET_BITS = 12
BUCKETS = 1 << BUCKET_BITS
FEATURES = BUCKETS + 256


def text_counts(texts: pa.Array) -> np.ndarray:
    """Counts by feature of each text."""
    n = len(texts)
    words = words_of(texts, lower=True, separators=PUNCTUATION)
    place = words.owners() * FEATURES + (words.codes >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)
    data, offsets = text_buffers(texts)
    marks = np.flatnonzero(PUNCTUATION[data] & (data != 32) & ~((data >= 65) & (data <= 90)))
    owner = np.searchsorted(offsets, marks, "right") - 1
    place = np.concatenate([place, owner * FEATURES + BUCKETS + data[marks]])
    counts = np.bincount(place, minlength=n * FEATURES).reshape(n, FEATURES)
    return counts.astype(np.float32)


def text_features(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(counts by feature, number of words between white space) of each text."""
    return text_counts(texts), words_of(texts).counts


@dataclass
class TextModel:
    """Log-probabilities of features by class, log-priors, and the temperature of its scores."""

    features: np.ndarray
    priors: np.ndarray
    temperature: float = 1.0

    def scores(self, counts: np.ndarray) -> np.ndarray:
        """Log-scores by class; evidence grows with the root of a text's length, as its words aren't independent."""
        total = np.maximum(1.0, counts.sum(axis=1, keepdims=True))
        return counts @ self.features.T / np.sqrt(total) / self.temperature + self.priors


def softmax(scores: np.ndarray) -> np.ndarray:
    e = np.exp(scores - scores.max(axis=1, keepdims=True))
    return e / e.sum(axis=1, keepdims=True)


def fit_text_model(rows: DataFrame, classes: int, smoothing: float = 0.5) -> TextModel:
    """From rows (text, weights: one nonnegative number per class); each task sends one array per class."""
    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total, rows_of = np.zeros((classes, FEATURES)), np.zeros(classes)
        for batch in batches:
            for step in steps(batch):
                counts, _ = text_features(step.column("text"))
                weights = np.array(step.column("weights").to_pylist(), dtype=np.float64).reshape(step.num_rows, classes)
                # a long text says no more about its class than several short ones
                share = counts / np.sqrt(np.maximum(1.0, counts.sum(axis=1, keepdims=True)))
                total += weights.T @ share
                rows_of += weights.sum(axis=0)
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(classes)), pa.array(rows_of), pa.array(total.tolist())], names=["k", "n", "counts"])

    total, rows_of = np.zeros((classes, FEATURES)), np.zeros(classes)
    for row in rows.select("text", "weights").mapInArrow(count, "k long, n double, counts array<double>").toLocalIterator():
        total[row.k] += row.counts
        rows_of[row.k] += row.n
    features = np.log((total + smoothing) / (total + smoothing).sum(axis=1, keepdims=True))
    return TextModel(features, np.log((rows_of + 1) / (rows_of.sum() + classes)))


def log_loss(scores: np.ndarray, labels: np.ndarray) -> float:
    return float(-np.log(np.maximum(1e-12, softmax(scores)[np.arange(len(labels)), labels])).mean())


def best_temperature(scores: np.ndarray, priors: np.ndarray, labels: np.ndarray) -> float:
    """The factor on evidence that gives the best log-loss; scores were made at temperature 1."""
    if not len(labels):
        return 1.0
    grid = np.exp(np.linspace(np.log(0.02), np.log(50), 60))
    return float(min(grid, key=lambda t: log_loss((scores - priors) / t + priors, labels)))
