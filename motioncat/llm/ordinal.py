"""Cumulative-link (proportional odds) regression on hashed text features, in numpy.

P(grade <= k) = sigmoid(t_k - w.x) with one weight vector for all grades and ordered
thresholds t_0 < t_1 < ..., kept in order by learning the logarithms of their distances.
Weights are fitted by follow-the-regularised-leader steps, whose L1 term leaves features
without evidence at exactly zero.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from motioncat.llm.common import lowest_hashes, texts_of

BUCKETS = 1 << 20
SAMPLE_DOCUMENTS = 5000
CACHED_TOKENS = 150_000
LatentOf = Callable[[dict[int, float]], Callable[[str], float]]


def bucket(feature: str) -> int:
    return xxhash.xxh64_intdigest(feature.encode()) % BUCKETS


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


@dataclass
class OrdinalModel:
    """``grades`` are the ratings seen in training, ascending; a single one is always predicted."""

    grades: list[int]
    thresholds: np.ndarray
    buckets: np.ndarray  # those with a weight, ascending
    weights: np.ndarray

    def table(self) -> dict[int, float]:
        return dict(zip(self.buckets.tolist(), self.weights.tolist()))

    def probabilities(self, latent: np.ndarray) -> np.ndarray:
        """(rows, grades)"""
        if len(self.grades) < 2:
            return np.ones((len(latent), len(self.grades)))
        below = _sigmoid(self.thresholds[None, :] - latent[:, None])
        below = np.hstack([np.zeros((len(latent), 1)), below, np.ones((len(latent), 1))])
        return np.maximum(np.diff(below, axis=1), 0.0)


def fit_ordinal(rows: list[tuple[np.ndarray, np.ndarray]], grades: np.ndarray, epochs: int = 15, alpha: float = 1.0, l1: float = 10.0, l2: float = 0.01, batch: int = 32, seed: int = 7) -> OrdinalModel:
    """Fit on rows of (buckets, values); the same rows in the same order give the same model.

    Values are multiplied by how much more often a feature occurs above the least grade than at
    it, or the reverse (the absolute log-odds of its document frequencies), so that telling
    features are learned from few documents; the weights returned are those of the values as given.
    """
    seen = sorted(set(grades.tolist()))
    if len(seen) < 2:
        return OrdinalModel(seen, np.zeros(0), np.zeros(0, np.int64), np.zeros(0))
    y = np.searchsorted(seen, grades)
    k = len(seen) - 1
    counts = [np.bincount(np.concatenate([r[0] for r, up in zip(rows, y > 0) if up == side]), minlength=BUCKETS) for side in (True, False)]
    many = (y > 0).sum()
    telling = np.abs(np.log((counts[0] + 1) / (many + 2)) - np.log((counts[1] + 1) / (len(y) - many + 2)))
    rows = [(b, v * telling[b]) for b, v in rows]
    share = np.array([(y <= i).mean() for i in range(k)])
    start = np.log(share / (1 - share))
    theta0, gaps = start[0], np.log(np.maximum(np.diff(start), 0.1))
    z, n = np.zeros(BUCKETS), np.zeros(BUCKETS)
    moved = np.zeros(k)
    rng = np.random.default_rng(seed)
    lengths = np.array([len(r[0]) for r in rows])

    def weights(i: np.ndarray) -> np.ndarray:
        zi = z[i]
        return np.where(np.abs(zi) <= l1, 0.0, (np.sign(zi) * l1 - zi) / ((1 + np.sqrt(n[i])) / alpha + l2))

    for _ in range(epochs):
        order = rng.permutation(len(rows))
        for at in range(0, len(rows), batch):
            picked = order[at : at + batch]
            i = np.concatenate([rows[p][0] for p in picked])
            v = np.concatenate([rows[p][1] for p in picked])
            row = np.repeat(np.arange(len(picked)), lengths[picked])
            used, where = np.unique(i, return_inverse=True)
            w = weights(used)
            latent = np.bincount(row, weights=v * w[where], minlength=len(picked))
            theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
            high = np.where(y[picked] < k, _sigmoid(theta[np.minimum(y[picked], k - 1)] - latent), 1.0)
            low = np.where(y[picked] > 0, _sigmoid(theta[np.maximum(y[picked] - 1, 0)] - latent), 0.0)
            chance = np.maximum(high - low, 1e-9)
            up, down = high * (1 - high) / chance, low * (1 - low) / chance
            g = np.bincount(where, weights=v * (up - down)[row], minlength=len(used))
            root = np.sqrt(n[used] + g * g)
            z[used] += g - (root - np.sqrt(n[used])) / alpha * w
            n[used] += g * g
            slope = np.zeros(k)
            np.add.at(slope, np.minimum(y[picked], k - 1), np.where(y[picked] < k, -up, 0.0))
            np.add.at(slope, np.maximum(y[picked] - 1, 0), np.where(y[picked] > 0, down, 0.0))
            steps = np.concatenate([[slope.sum()], [slope[j:].sum() * np.exp(gaps[j - 1]) for j in range(1, k)]])
            moved += steps**2
            steps = 0.1 * steps / np.sqrt(moved + 1)
            theta0 -= steps[0]
            gaps -= steps[1:]
    theta = theta0 + np.concatenate([[0.0], np.cumsum(np.exp(gaps))])
    kept = np.nonzero(np.abs(z) > l1)[0]
    return OrdinalModel(seen, theta, kept, weights(kept) * telling[kept])


def sample_features(docs: DataFrame, rated: DataFrame, vector: Callable[[str], tuple[np.ndarray, np.ndarray]], key: str, text: str, limit: int) -> tuple[list[tuple[np.ndarray, np.ndarray]], np.ndarray]:
    """Feature rows and grades of at most ``limit`` rated documents: those whose ids hash lowest."""
    rated = rated.filter(F.col(key).isNotNull() & F.col("grade").isNotNull()).groupBy(key).agg(F.min("grade").cast("int").alias("grade"))
    chosen = lowest_hashes(rated, key, limit)
    kind = docs.schema[key].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [vector(t) for t in texts_of(batch.column(1))]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), batch.column(2), pa.array([f[0] for f in found], pa.list_(pa.int64())), pa.array([f[1] for f in found], pa.list_(pa.float32()))],
                names=["key", "grade", "buckets", "values"],
            )

    rows = docs.select(key, text).join(F.broadcast(chosen), key)  # at most ``limit`` ids
    rows = rows.groupBy(key).agg(F.min(text).alias(text), F.first("grade").alias("grade"))  # the least text of a repeated id
    rows = rows.mapInArrow(run, f"`{key}` {kind}, grade int, buckets array<long>, values array<float>")
    got = sorted(rows.collect(), key=lambda r: r[0])
    return [(np.array(r["buckets"], np.int64), np.array(r["values"], float)) for r in got], np.array([r["grade"] for r in got], int)


def _scorer(docs: DataFrame, model: OrdinalModel, latent_of: LatentOf) -> Callable[[], Callable[[list[str]], np.ndarray]]:
    """Makes, in a task, a function from texts to probabilities (rows, grades)."""
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def make() -> Callable[[list[str]], np.ndarray]:
        fitted = shared.value
        latent = latent_of(fitted.table())
        if not fitted.grades:
            return lambda texts: np.ones((len(texts), 1))
        return lambda texts: fitted.probabilities(np.array([latent(t) for t in texts]))

    return make


def score(docs: DataFrame, model: OrdinalModel, latent_of: LatentOf, key: str, text: str) -> DataFrame:
    """(key, expected double, tail array<double>): expected grade, and P(grade >= g) for every g but the least."""
    kind = docs.schema[key].dataType.simpleString()
    make = _scorer(docs, model, latent_of)
    grades = np.array(model.grades or [0], float)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = make()
        for batch in batches:
            p = probabilities(texts_of(batch.column(1)))
            tail = p[:, ::-1].cumsum(axis=1)[:, ::-1][:, 1:]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(p @ grades), pa.array(list(tail), pa.list_(pa.float64()))], names=["key", "expected", "tail"])

    return docs.select(key, text).mapInArrow(run, f"`{key}` {kind}, expected double, tail array<double>")


def keep_rows(docs: DataFrame, model: OrdinalModel, latent_of: LatentOf, text: str, keep: Callable[[np.ndarray], np.ndarray]) -> DataFrame:
    """Rows of ``docs``, with all their columns, for which ``keep`` holds of P(grade > least)."""
    if len(model.grades) < 2:
        return docs
    make, place = _scorer(docs, model, latent_of), docs.columns.index(text)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probabilities = make()
        for batch in batches:
            p = probabilities(texts_of(batch.column(place)))
            yield batch.filter(pa.array(keep(p[:, 1:].sum(axis=1))))

    return docs.mapInArrow(run, docs.schema)
