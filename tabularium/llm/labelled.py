"""What the two document classifiers share: which rows teach, and a small numpy network with a calibrated temperature."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

FOLDS, HELD = 3, 1
MOST_ROWS = 20_000


def held_out(doc_id: Column | str = "doc_id", folds: int = FOLDS, held: int = HELD) -> Column:
    """Whether a document only tests: crc32 of its id as text, modulo ``folds``. A null id tests nothing and teaches nothing."""
    doc_id = F.col(doc_id) if isinstance(doc_id, str) else doc_id
    return F.coalesce(F.crc32(doc_id.cast("string").cast("binary")) % folds == held, F.lit(False))


def teaching(labels: DataFrame, label: str, most_rows: int = MOST_ROWS) -> DataFrame:
    """``doc_id, y`` of at most ``most_rows`` labelled documents outside the held-out part, in the order of a hash of the id.

    Null labels and ids are left out; an id with several labels takes the commoner one (a tie counts as 1).
    """
    rows = (labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & ~held_out())
            .groupBy("doc_id").agg((F.avg(label) >= 0.5).cast("int").alias("y")))
    there = rows.count()
    if there > 2 * most_rows:
        rows = rows.where(F.pmod(F.xxhash64("doc_id", F.lit(7)), F.lit(1 << 20)) < int((1 << 20) * 2 * most_rows / there))
    return rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(most_rows)


class Network:
    """Two layers: standardised inputs, ``hidden`` tanh units, one logistic unit; Adam on the log loss.

    A fifth of the rows is kept back; it picks the epoch to stop at and the temperature that the logits are divided by.
    Without rows of both classes the network answers with their share (0.5 without rows).
    """

    def __init__(self, x: np.ndarray, y: np.ndarray, hidden: int = 24, steps: int = 6000, batch: int = 128, rate: float = 5e-3, seed: int = 11):
        self.prior = float(y.mean()) if len(y) else 0.5
        self.flat = len(np.unique(y)) < 2
        if self.flat:
            return
        rng = np.random.default_rng(seed)
        self.mean, self.spread = x.mean(axis=0), x.std(axis=0) + 1e-6
        x = self.scaled(x)
        order = rng.permutation(len(x))
        test, train = (order[:len(x) // 5], order[len(x) // 5:]) if len(x) >= 50 else (order, order)
        w = [rng.normal(0, x.shape[1] ** -0.5, (x.shape[1], hidden)), np.zeros(hidden), rng.normal(0, hidden ** -0.5, hidden), np.log((y.mean() + 1e-3) / (1 - y.mean() + 1e-3))]
        m, v, best, step = [0.0] * 4, [0.0] * 4, (np.inf, None), 0
        parts = max(1, len(train) // batch)
        for _ in range(max(1, steps // parts)):
            for part in np.array_split(rng.permutation(train), parts):
                h = np.tanh(x[part] @ w[0] + w[1])
                err = (1 / (1 + np.exp(-np.clip(h @ w[2] + w[3], -30, 30))) - y[part]) / len(part)
                back = np.outer(err, w[2]) * (1 - h * h)
                grads = [x[part].T @ back + 1e-4 * w[0], back.sum(axis=0), h.T @ err + 1e-4 * w[2], err.sum()]
                step += 1
                for i, g in enumerate(grads):
                    m[i], v[i] = 0.9 * m[i] + 0.1 * g, 0.999 * v[i] + 0.001 * g * g
                    w[i] = w[i] - rate * (m[i] / (1 - 0.9 ** step)) / (np.sqrt(v[i] / (1 - 0.999 ** step)) + 1e-8)
            loss = self.loss(np.tanh(x[test] @ w[0] + w[1]) @ w[2] + w[3], y[test])
            if loss < best[0]:
                best = loss, [np.copy(a) for a in w]
        self.weights, self.temperature = best[1], 1.0
        logits = self.logits(x[test])
        self.temperature = min(np.geomspace(0.25, 8, 121), key=lambda t: self.loss(logits / t, y[test]))

    @staticmethod
    def loss(z: np.ndarray, y: np.ndarray) -> float:
        return float(np.mean(np.logaddexp(0, z) - y * z))

    def scaled(self, x: np.ndarray) -> np.ndarray:
        return np.clip((x - self.mean) / self.spread, -8, 8)

    def logits(self, scaled: np.ndarray) -> np.ndarray:
        a, b, c, d = self.weights
        return np.tanh(scaled @ a + b) @ c + d

    def score(self, x: np.ndarray) -> np.ndarray:
        if self.flat:
            return np.full(len(x), self.prior)
        return 1 / (1 + np.exp(-np.clip(self.logits(self.scaled(x)) / self.temperature, -30, 30)))
