"""Scores as probabilities."""

from __future__ import annotations

import numpy as np


def fit_line(odds: np.ndarray, labels: np.ndarray, ridge: float = 0.01) -> tuple[float, float]:
    """(slope, shift) such that 1 / (1 + exp(-(slope * odds + shift))) is the share of label 1.

    Newton steps on the regularised logistic likelihood; the slope stays positive, so the order of the
    scores does. ``ridge`` pulls towards the odds as they are.
    """
    x, values, before = np.column_stack([odds, np.ones(len(odds))]), np.array([1.0, 0.0]), np.array([1.0, 0.0])
    for _ in range(50):
        share = 1 / (1 + np.exp(-np.clip(x @ values, -30, 30)))
        slope = x.T @ (labels - share) - ridge * (values - before)
        curve = (x * np.maximum(share * (1 - share), 1e-6)[:, None]).T @ x + ridge * np.eye(2)
        step = np.clip(np.linalg.solve(curve, slope), -2, 2)
        values = values + step
        values[0] = max(values[0], 0.05)
        if np.abs(step).max() < 1e-6:
            break
    return float(values[0]), float(values[1])


def log_odds(share: np.ndarray) -> np.ndarray:
    share = np.clip(share, 1e-6, 1 - 1e-6)
    return np.log(share / (1 - share))
