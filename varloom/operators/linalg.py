"""Dense numerical kernels on sufficient statistics: sparse regression, ridge solves, least squares."""

from __future__ import annotations

import numpy as np


def _lipschitz(gram: np.ndarray) -> float:
    """Largest eigenvalue of a symmetric non-negative matrix: exact for small ones, else by power iteration
    from a fixed start, so that reruns agree."""
    p = len(gram)
    if p <= 512:
        return max(float(np.linalg.eigvalsh(gram)[-1]), 1e-10)
    v = np.ones(p) / np.sqrt(p)
    for _ in range(60):
        w = gram @ v
        v = w / max(np.linalg.norm(w), 1e-300)
    return max(float(v @ gram @ v) * 1.02, 1e-10)


def fista(gram: np.ndarray, xty: np.ndarray, alpha: float, positive: bool = False, ridge: float = 0.0, weights: np.ndarray | None = None, max_iter: int = 1000, tol: float = 1e-6, check_every: int = 10) -> np.ndarray:
    """LASSO by accelerated proximal gradients on (X'X/n, X'y/n): minimise quadratic + alpha * sum w |theta|."""
    p = len(xty)
    if p == 0:
        return np.zeros(0)
    g = gram + ridge * np.eye(p) if ridge else gram
    step = 0.95 / _lipschitz(g)
    cut = step * alpha * (np.ones(p) if weights is None else weights)
    theta, z, t = np.zeros(p), np.zeros(p), 1.0
    for k in range(1, max_iter + 1):
        v = z - step * (g @ z - xty)
        new = np.maximum(v - cut, 0) if positive else np.sign(v) * np.maximum(np.abs(v) - cut, 0)
        t_new = (1 + np.sqrt(1 + 4 * t * t)) / 2
        z = new + (t - 1) / t_new * (new - theta)
        moved = np.linalg.norm(new - theta)
        theta, t = new, t_new
        if k % check_every == 0 and moved < tol:
            break
    return theta


def ridge_solve(gram: np.ndarray, xty: np.ndarray, ridge: float) -> np.ndarray:
    """(X'X + ridge) b = X'y, by least squares where the matrix is singular."""
    a = gram + ridge * np.eye(len(gram))
    try:
        return np.linalg.solve(a, xty)
    except np.linalg.LinAlgError:
        return np.linalg.lstsq(a, xty, rcond=None)[0]


def lambda_grid(xty: np.ndarray, n: int, ratio: float = 1e-3, weights: np.ndarray | None = None) -> np.ndarray:
    """Log-spaced penalties from the largest useful one down to ``ratio`` of it."""
    w = np.maximum(np.ones(len(xty)) if weights is None else weights, 1e-3)
    top = float(np.max(np.abs(xty) / w)) if len(xty) else 0.0
    if not np.isfinite(top) or top <= 0:
        return np.logspace(-2, -6, n)
    return np.logspace(np.log10(top), np.log10(top * ratio), n)


def logistic(x: np.ndarray, y: np.ndarray, penalty: float = 1e-6, max_iter: int = 100) -> np.ndarray:
    """Newton logistic regression with an unpenalised intercept in column 0 of x."""
    b = np.zeros(x.shape[1])
    pen = np.full(x.shape[1], penalty)
    pen[0] = 0
    for _ in range(max_iter):
        m = 1 / (1 + np.exp(-np.clip(x @ b, -40, 40)))
        h = (x * np.maximum(m * (1 - m), 1e-12)[:, None]).T @ x + np.diag(pen)
        d = np.linalg.solve(h, x.T @ (y - m) - pen * b)
        b = b + d
        if np.abs(d).max() < 1e-10:
            break
    return b
