"""Plain versions of fits and resampling, for comparison."""

from __future__ import annotations

import numpy as np


def bootstrap_auc(reasoning: np.ndarray, final: np.ndarray, replicates: int = 10_000, seed: int = 0) -> tuple[float, float, float]:
    """AUC and percentile interval over resampled conversations; a kernel for small paired sets."""
    def auc(a: np.ndarray, b: np.ndarray) -> float:
        order = np.sort(b)
        below, upto = np.searchsorted(order, a, "left"), np.searchsorted(order, a, "right")
        return float((below + upto).mean() / (2 * b.size))

    rng, n = np.random.default_rng(seed), reasoning.size
    picks = rng.integers(0, n, (replicates, n))
    values = np.array([auc(reasoning[p], final[p]) for p in picks])
    low, high = np.quantile(values, (0.025, 0.975))
    return auc(reasoning, final), float(low), float(high)


def fit_softmax(x: np.ndarray, y: np.ndarray, classes: int, penalty: float, steps: int = 60) -> tuple[np.ndarray, np.ndarray, bool]:
    """Minimum of the summed loss plus penalty/2 times the squared weights; intercepts are free.

    Newton steps with backtracking; one class's parameters more than needed are fixed by the penalty
    and, for intercepts, by a tiny ridge.
    """
    n, d = x.shape
    z = np.hstack([x, np.ones((n, 1))])
    ridge = np.tile(np.append(np.full(d, penalty), 1e-8), classes)
    onehot = np.eye(classes)[y]
    w = np.zeros((classes, d + 1))

    def value(w: np.ndarray) -> tuple[float, np.ndarray]:
        s = z @ w.T
        top = s.max(1, keepdims=True)
        log = s - top - np.log(np.exp(s - top).sum(1, keepdims=True))
        return float(-(onehot * log).sum() + 0.5 * (ridge * w.ravel() ** 2).sum()), np.exp(log)

    best, p = value(w)
    for _ in range(steps):
        g = ((p - onehot).T @ z).ravel() + ridge * w.ravel()
        h = np.diag(ridge)
        for a in range(classes):
            for b in range(a, classes):
                block = (z * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ z
                h[a * (d + 1) : (a + 1) * (d + 1), b * (d + 1) : (b + 1) * (d + 1)] += block
                if a != b:
                    h[b * (d + 1) : (b + 1) * (d + 1), a * (d + 1) : (a + 1) * (d + 1)] += block.T
        move, size = np.linalg.solve(h, g).reshape(w.shape), 1.0
        while True:
            new = w - size * move
            now, q = value(new)
            if now <= best + 1e-12 * abs(best) or size < 1e-6:
                break
            size /= 2
        small = np.abs(new - w).max() < 1e-8
        w, best, p = new, now, q
        if small:
            return w, p, True
    return w, p, False
