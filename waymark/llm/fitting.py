"""Logistic regression by Newton's method, shared by the operators that train one."""

from __future__ import annotations

import numpy as np


def logistic(x: np.ndarray, y: np.ndarray, ridge: float = 0.3, steps: int = 30, start: np.ndarray | None = None, weight: np.ndarray | None = None) -> np.ndarray:
    """Weights with an L2 penalty on their distance from ``start`` (zero if not given); a constant must be a column of ``x``; a row counts ``weight`` times.

    A step that would make the fit worse is halved until it doesn't.
    """
    of = np.ones(len(y)) if weight is None else np.asarray(weight, float)
    origin = np.zeros(x.shape[1]) if start is None else np.asarray(start, float)

    def loss(w: np.ndarray) -> float:
        z = x @ w
        return float((of * (np.logaddexp(0, z) - y * z)).sum() + ridge / 2 * ((w - origin) ** 2).sum())

    w, now = origin.copy(), loss(origin)
    for _ in range(steps):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        step = np.linalg.solve((x * (of * p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w)), x.T @ (of * (y - p)) - ridge * (w - origin))
        while (new := loss(w + step)) > now and np.abs(step).max() > 1e-7:
            step = step / 2
        if new >= now:
            break
        w, now = w + step, new
        if np.abs(step).max() < 1e-6:
            break
    return w
