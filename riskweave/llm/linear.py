"""Logistic regression on the driver, for bounded samples."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 0.5 * (1.0 + np.tanh(0.5 * z))


def scalar_logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> tuple[float, float]:
    """Slope and intercept of P(y = 1) over one feature, by Newton steps with a small ridge."""
    design = np.stack([x, np.ones_like(x)], axis=1)
    beta = np.zeros(2)
    ridge = np.diag([1e-3, 1e-3])
    for _ in range(50):
        p = sigmoid(design @ beta)
        curve = (design * (weight * p * (1 - p))[:, None]).T @ design + ridge
        step = np.linalg.solve(curve, design.T @ (weight * (y - p)) - ridge @ beta)
        beta += np.clip(step, -5, 5)
        if np.abs(step).max() < 1e-8:
            break
    return float(beta[0]), float(beta[1])


def sparse_logistic(
    rows: np.ndarray,
    columns: np.ndarray,
    values: np.ndarray,
    y: np.ndarray,
    width: int,
    ridge: float,
    steps: int = 200,
) -> tuple[np.ndarray, float]:
    """Weights and intercept for a sparse matrix in coordinates, by gradient steps with momentum.

    Both classes weigh the same in total. The step follows from a bound of the curvature, so that
    no rate has to be chosen.
    """
    n = len(y)
    ones = max(1.0, float(y.sum()))
    weight = np.where(y == 1, 0.5 / ones, 0.5 / max(1.0, n - float(y.sum())))
    # Largest eigenvalue of the weighted Gram matrix, by power iteration.
    v = np.ones(width)
    top = 1.0
    for _ in range(12):
        product = np.bincount(rows, values * v[columns], minlength=n)
        v = np.bincount(columns, values * (weight * product)[rows], minlength=width)
        top = float(np.linalg.norm(v))
        v /= max(top, 1e-12)
    rate = 1.0 / (0.25 * (top + 1.0) * 1.2 + ridge)
    beta, bias = np.zeros(width), 0.0
    look, look_bias, t = beta, bias, 1.0
    for _ in range(steps):
        z = np.bincount(rows, values * look[columns], minlength=n) + look_bias
        error = weight * (sigmoid(z) - y)
        gradient = np.bincount(columns, values * error[rows], minlength=width) + ridge * look
        new, new_bias = look - rate * gradient, look_bias - rate * float(error.sum())
        following = 0.5 * (1.0 + np.sqrt(1.0 + 4.0 * t * t))
        pull = (t - 1.0) / following
        look, look_bias = new + pull * (new - beta), new_bias + pull * (new_bias - bias)
        beta, bias, t = new, new_bias, following
    return beta, bias
