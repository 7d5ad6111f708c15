"""Multinomial logistic regression, trained row by row with follow-the-regularised-leader and elastic-net penalties."""

from __future__ import annotations

from collections.abc import Iterable

import numpy as np


def softmax(logits: np.ndarray) -> np.ndarray:
    shifted = np.exp(logits - logits.max(-1, keepdims=True))
    return shifted / shifted.sum(-1, keepdims=True)


class FollowTheLeader:
    """Weights of shape (features, classes). Per coordinate it keeps the sum of shifted gradients and of their squares;
    a weight whose sum stays below `l1` is exactly zero."""

    def __init__(self, features: int, classes: int, rate: float = 1.0, offset: float = 1.0, l1: float = 0.05, l2: float = 0.01) -> None:
        self.z, self.n = np.zeros((features, classes)), np.zeros((features, classes))
        self.rate, self.offset, self.l1, self.l2 = rate, offset, l1, l2

    def weights(self, rows=slice(None)) -> np.ndarray:
        z, n = self.z[rows], self.n[rows]
        scale = (self.offset + np.sqrt(n)) / self.rate + self.l2
        return np.where(np.abs(z) > self.l1, (np.sign(z) * self.l1 - z) / scale, 0.0)

    def learn(self, rows: np.ndarray, values: np.ndarray, label: int) -> None:
        """One step on a sparse row; `rows` are distinct."""
        w = self.weights(rows)
        error = softmax(values @ w)
        error[label] -= 1
        gradient = values[:, None] * error
        n = self.n[rows]
        grown = n + gradient * gradient
        self.z[rows] += gradient - (np.sqrt(grown) - np.sqrt(n)) / self.rate * w
        self.n[rows] = grown

    def fit(self, data: list[tuple[np.ndarray, np.ndarray, int]], rounds: int, seed: int = 7) -> FollowTheLeader:
        order = np.random.default_rng(seed)
        for _ in range(rounds):
            for k in order.permutation(len(data)):
                self.learn(*data[k])
        return self


def temperature(logits: np.ndarray, labels: Iterable[int]) -> float:
    """The divisor of the logits that gives the least log loss on rows that weights were not learned from.

    Where the loss has no minimum within the limits, as on rows without an error, nothing is learned from it: the divisor is 1.
    """
    labels = np.fromiter(labels, np.int64)
    if not len(labels) or (logits.argmax(1) == labels).all():
        return 1.0

    def loss(t: float) -> float:
        scaled = logits / t
        top = scaled.max(1)
        return float(np.mean(np.log(np.exp(scaled - top[:, None]).sum(1)) + top - scaled[np.arange(len(labels)), labels]))

    limits = low, high = np.log(0.02), np.log(50.0)
    for _ in range(80):
        a, b = low + (high - low) / 3, high - (high - low) / 3
        low, high = (low, b) if loss(np.exp(a)) < loss(np.exp(b)) else (a, high)
    best = (low + high) / 2
    return 1.0 if min(best - limits[0], limits[1] - best) < 1e-3 else float(np.exp(best))
