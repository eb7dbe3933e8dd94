"""Logistic regression on a few features of a bounded sample, fitted on the driver."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np

#: Weight of the penalty on the coefficients of the standardised features.
RIDGE = 1.0
STEPS = 50


@dataclass(frozen=True)
class Logistic:
    """Probability 1 / (1 + exp(-(bias + features @ weights)))."""

    bias: float
    weights: tuple[float, ...]

    def logit(self, features: np.ndarray) -> np.ndarray:
        return self.bias + features @ np.asarray(self.weights)

    def probability(self, features: np.ndarray) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.logit(features), -30, 30)))


def fit(features: np.ndarray, labels: np.ndarray, ridge: float = RIDGE) -> Logistic:
    """Newton's method. Without rows of both labels, the bias is all there is: the smoothed share of label 1."""
    n, k = features.shape
    share = (labels.sum() + 0.5) / (n + 1)
    if not n or labels.min() == labels.max():
        return Logistic(float(np.log(share / (1 - share))), (0.0,) * k)
    mean, spread = features.mean(0), features.std(0) + 1e-9
    x = np.column_stack((np.ones(n), (features - mean) / spread))
    penalty = np.diag([1e-6] + [ridge] * k)
    w = np.zeros(k + 1)
    w[0] = np.log(share / (1 - share))
    for _ in range(STEPS):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (p * (1 - p))[:, None]).T @ x + penalty, x.T @ (labels - p) - penalty @ w)
        size = float(np.abs(step).max())
        w += step * min(1.0, 4 / max(size, 1e-12))
        if size < 1e-8:
            break
    weights = w[1:] / spread
    return Logistic(float(w[0] - weights @ mean), tuple(map(float, weights)))
