"""Logistic weights on a bounded sample: ridge by Newton steps, lasso by proximal steps."""

from __future__ import annotations

import numpy as np


def sigmoid(z: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(z, -40, 40)))


def ridge(x: np.ndarray, y: np.ndarray, penalty: float = 1e-3) -> np.ndarray:
    """Weights with the intercept last, which is not shrunk."""
    x = np.column_stack([x, np.ones(len(x))])
    shrink = np.full(x.shape[1], penalty * len(x))
    shrink[-1] = 1e-6
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = sigmoid(x @ w)
        slope = x.T @ (p - y) + shrink * w
        curve = (x * (p * (1 - p))[:, None]).T @ x + np.diag(shrink + 1e-9)
        step = np.linalg.solve(curve, slope)
        # Shorter steps where the data separate and Newton would run away.
        step *= min(1.0, 5.0 / max(np.abs(step).max(), 1e-12))
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def lasso(x: np.ndarray, y: np.ndarray, penalty: float, rounds: int = 400) -> np.ndarray:
    """Sparse weights with the intercept last, by accelerated proximal gradient steps."""
    x = np.column_stack([x, np.ones(len(x))]).astype(np.float64)
    rate = 4 * len(x) / max(np.linalg.norm(x, 2) ** 2, 1e-9)
    w = np.zeros(x.shape[1])
    ahead, momentum = w.copy(), 1.0
    for _ in range(rounds):
        slope = x.T @ (sigmoid(x @ ahead) - y) / len(x)
        new = ahead - rate * slope
        new[:-1] = np.sign(new[:-1]) * np.maximum(np.abs(new[:-1]) - rate * penalty, 0)
        following = (1 + np.sqrt(1 + 4 * momentum**2)) / 2
        ahead = new + (momentum - 1) / following * (new - w)
        w, momentum = new, following
    return w
