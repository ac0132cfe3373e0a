"""A small ridge logistic regression, fitted on rows in memory or by sums over parts of them."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1.0 / (1.0 + np.exp(-np.clip(x, -35, 35)))


_ROWS = 2048  # that are looked at at once, in 64 bits whatever the features have


class Logistic:
    """Weights over standardised features, by Newton steps."""

    def __init__(self, ridge: float = 1.0, steps: int = 25):
        self.ridge, self.steps = ridge, steps

    def fit(self, x: np.ndarray, y: np.ndarray) -> Logistic:
        mean = x.mean(axis=0, dtype=float)
        self.start(mean, np.sqrt(sum(np.square(x[at : at + _ROWS] - mean).sum(axis=0) for at in range(0, len(x), _ROWS)) / len(x)))
        for _ in range(self.steps):
            if self.step(self.sums(x, y)) < 1e-6:
                break
        return self

    def start(self, mean: np.ndarray, scale: np.ndarray) -> Logistic:
        """Before the first step, from zero: Newton steps from another fit's weights may not converge."""
        self.mean, self.scale = mean, np.where(scale > 1e-9, scale, 1.0)
        self.weights = np.zeros(len(mean) + 1)
        return self

    def sums(self, x: np.ndarray, y: np.ndarray) -> np.ndarray:
        """Slope and curvature over these rows; those of several parts of the rows add up."""
        n = len(self.weights)
        slope, curvature = np.zeros(n), np.zeros((n, n))
        for at in range(0, len(x), _ROWS):
            z = np.column_stack([(x[at : at + _ROWS] - self.mean) / self.scale, np.ones(len(x[at : at + _ROWS]))])
            p = sigmoid(z @ self.weights)
            slope += z.T @ (p - y[at : at + _ROWS])
            curvature += (z * (p * (1 - p) + 1e-6)[:, None]).T @ z
        return np.concatenate([slope, curvature.ravel()])

    def step(self, sums: np.ndarray) -> float:
        """One Newton step, given the sums over all rows; how far it would go."""
        n = len(self.weights)
        penalty = np.full(n, self.ridge)
        penalty[-1] = 1e-6
        step = np.linalg.solve(sums[n:].reshape(n, n) + np.diag(penalty), sums[:n] + penalty * self.weights)
        self.weights = self.weights - step * min(1.0, 5.0 / max(1e-9, float(np.abs(step).max())))
        return float(np.abs(step).max())

    def decision(self, x: np.ndarray) -> np.ndarray:
        return ((x - self.mean) / self.scale) @ self.weights[:-1] + self.weights[-1]

    def predict(self, x: np.ndarray) -> np.ndarray:
        return sigmoid(self.decision(x))
