"""Small linear learners in numpy, for models fitted on a bounded sample."""

from __future__ import annotations

import numpy as np


def svm(x: np.ndarray, y: np.ndarray, c: float = 4.0, epochs: int = 30, seed: int = 0) -> np.ndarray:
    """Weights of a linear support vector machine with squared hinge loss, by
    dual coordinate descent.  ``y`` is +1 or -1; a constant column is the bias.
    Classes are weighted to the same total."""
    rng, n = np.random.default_rng(seed), len(y)
    share = np.where(y > 0, n / (2 * max(1, (y > 0).sum())), n / (2 * max(1, (y < 0).sum())))
    slack = 1 / (2 * c * share)
    alpha, w = np.zeros(n), np.zeros(x.shape[1], np.float32)
    square = np.einsum("ij,ij->i", x, x) + slack
    for _ in range(epochs):
        most = 0.0
        for i in rng.permutation(n):
            g = y[i] * float(x[i] @ w) - 1 + slack[i] * alpha[i]
            if alpha[i] > 0 or g < 0:
                new = max(0.0, alpha[i] - g / square[i])
                if new != alpha[i]:
                    w += np.float32((new - alpha[i]) * y[i]) * x[i]
                    most = max(most, abs(new - alpha[i]))
                    alpha[i] = new
        if most < 1e-3:
            break
    return w


def slope(margin: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    """(a, b) for which 1 / (1 + exp(-(a * margin + b))) fits ``y`` (0 or 1), a >= 0."""
    a, b = 1.0, 0.0
    target = np.where(y > 0, (y.sum() + 1) / (y.sum() + 2), 1 / ((1 - y).sum() + 2))
    for _ in range(50):
        p = sigmoid(a * margin + b)
        h = np.maximum(p * (1 - p), 1e-9)
        ga, gb = ((p - target) * margin).sum() + 1e-3 * a, (p - target).sum()
        haa, hab, hbb = (h * margin * margin).sum() + 1e-3, (h * margin).sum(), h.sum() + 1e-6
        det = haa * hbb - hab * hab
        if det <= 1e-12:
            break
        da, db = (hbb * ga - hab * gb) / det, (haa * gb - hab * ga) / det
        a, b = a - float(np.clip(da, -2, 2)), b - float(np.clip(db, -2, 2))
        if abs(da) + abs(db) < 1e-6:
            break
    return max(a, 0.0), b


def sigmoid(x):  # noqa: ANN001, ANN201
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))
