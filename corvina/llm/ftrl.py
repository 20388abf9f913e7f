"""Follow-the-regularised-leader logistic regression over hashed sparse features."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

MIX = np.uint64(0x9E3779B97F4A7C15)


def slots(x: np.ndarray, bits: int) -> np.ndarray:
    """Multiplicative hash of 64-bit integers to ``bits`` bits."""
    return ((x * MIX) >> np.uint64(64 - bits)).astype(np.int64)


def sigmoid(z: float) -> float:
    return 1.0 / (1.0 + np.exp(-min(max(z, -35.0), 35.0)))


class Ftrl:
    """Per-coordinate FTRL-proximal; slot ``size`` is the bias, free of the L1 term."""

    def __init__(self, size: int, alpha: float = 0.3, beta: float = 1.0, l1: float = 0.1, l2: float = 0.1) -> None:
        self.size, self.alpha, self.beta, self.l1, self.l2 = size, alpha, beta, l1, l2
        self.z, self.n = np.zeros(size + 1), np.zeros(size + 1)

    def _weights(self, i: np.ndarray) -> np.ndarray:
        z, free = self.z[i], i == self.size
        l1 = np.where(free, 0.0, self.l1)
        return np.where(np.abs(z) <= l1, 0.0, -(z - np.sign(z) * l1) / ((self.beta + np.sqrt(self.n[i])) / self.alpha + self.l2))

    def update(self, i: np.ndarray, x: np.ndarray, y: float) -> float:
        """One example with slots ``i`` (distinct, the bias among them); its probability before the update."""
        w = self._weights(i)
        p = sigmoid(float(w @ x))
        g = (p - y) * x
        n = self.n[i]
        self.z[i] += g - (np.sqrt(n + g * g) - np.sqrt(n)) / self.alpha * w
        self.n[i] = n + g * g
        return p

    def weights(self) -> np.ndarray:
        return self._weights(np.arange(self.size + 1))


def fit(rows: Sequence[tuple[np.ndarray, np.ndarray]], labels: np.ndarray, size: int, epochs: int, seed: int = 7, **options: float) -> np.ndarray:
    """Weights (the last is the bias) after ``epochs`` passes in a seeded order. One class alone gives its bias only."""
    model, order = Ftrl(size, **options), np.random.default_rng(seed)
    for _ in range(epochs):
        for k in order.permutation(len(rows)):
            i, x = rows[k]
            model.update(np.append(i, size), np.append(x, 1.0), float(labels[k]))
    return model.weights()
