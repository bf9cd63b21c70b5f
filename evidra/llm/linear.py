"""Small linear models, trained on the driver from bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -40, 40)))


def fit_logistic(x: np.ndarray, labels: np.ndarray, penalty: float = 1e-5, steps: int = 800, held: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Weights and biases of logistic models, one for each column of `labels` (0 or 1), by accelerated gradient steps.

    x is read in place, never copied; rows where `held` is true are left out of the fit.
    """
    n, width = x.shape
    used = np.ones((n, 1), np.float32) if held is None else (~held).astype(np.float32)[:, None]
    weights = np.zeros((width + 1, labels.shape[1]), np.float32)
    count = float(used.sum())
    if not count:
        return weights[:-1], weights[-1]

    def back(errors: np.ndarray) -> np.ndarray:
        return np.concatenate([x.T @ errors, errors.sum(0, keepdims=True)])

    probe = np.random.default_rng(1).normal(size=(width + 1, 1)).astype(np.float32)
    for _ in range(12):  # the largest curvature, by power iteration
        probe = back(used * (x @ probe[:-1] + probe[-1]))
        probe /= max(float(np.linalg.norm(probe)), 1e-12)
    rate = 1 / (0.25 * float(np.linalg.norm(used * (x @ probe[:-1] + probe[-1]))) ** 2 / count * 1.1 + penalty)
    decay = np.full((width + 1, 1), penalty, np.float32)
    decay[-1] = 0
    before = weights.copy()
    for step in range(steps):
        ahead = weights + (step / (step + 3)) * (weights - before)
        errors = used * (sigmoid(x @ ahead[:-1] + ahead[-1]) - labels).astype(np.float32)
        before, weights = weights, ahead - rate * (back(errors) / count + decay * ahead)
    return weights[:-1], weights[-1]
