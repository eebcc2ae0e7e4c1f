"""Lasso logistic regression on the driver, for bounded samples only."""

from __future__ import annotations

import numpy as np


def lasso_logistic(
    x: np.ndarray, y: np.ndarray, penalty: float, ties: np.ndarray | None = None, steps: int = 400
) -> tuple[float, np.ndarray]:
    """Intercept and weights of the mean logistic loss + ``penalty`` * |w| + w' ``ties`` w, by accelerated proximal steps.

    ``x`` must not be negative.
    """
    n, m = x.shape
    if not n or y.min() == y.max():
        share = (y.sum() + 0.5) / (n + 1)
        return float(np.log(share / (1 - share))), np.zeros(m)
    # each coordinate's own step: for features that are never negative, row sums of the curvature bound it
    curve = np.concatenate(([1 + x.sum() / n], x.T @ (1 + x.sum(1)) / n)) / 4
    if ties is not None:
        curve[1:] += 2 * np.abs(ties).sum(1)
    step = 1 / (curve + 1e-6)
    w, ahead, momentum = np.zeros(m + 1), np.zeros(m + 1), 1.0
    w[0] = ahead[0] = np.log(y.mean() / (1 - y.mean()))
    for _ in range(steps):
        margin = x @ ahead[1:].astype(x.dtype) + ahead[0]
        error = 1 / (1 + np.exp(-np.clip(margin, -40, 40))) - y
        slope = np.concatenate(([error.mean()], error.astype(x.dtype) @ x / n))
        if ties is not None:
            slope[1:] += 2 * ties @ ahead[1:]
        new = ahead - step * slope
        new[1:] = np.sign(new[1:]) * np.maximum(np.abs(new[1:]) - step[1:] * penalty, 0)
        next_momentum = (1 + np.sqrt(1 + 4 * momentum * momentum)) / 2
        if np.dot((ahead - new) / step, new - w) > 0:  # restart when the momentum points uphill
            next_momentum = 1.0
        ahead = new + (momentum - 1) / next_momentum * (new - w)
        w, momentum = new, next_momentum
    return float(w[0]), w[1:]
