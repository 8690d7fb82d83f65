"""Small-matrix work on the parameters of a few clusters: density bounds, probability floors, label matching.

Everything here runs on the driver or inside a task on arrays whose size is the number of clusters or columns, never the
number of rows.
"""

from __future__ import annotations

import math

import numpy as np

SQRT_2PI = math.sqrt(2 * math.pi)
CONDITION = 1e8


def least_sd(c_bound: float, p: int = 1) -> float:
    """The standard deviation at which a p-dimensional spherical normal density peaks at ``c_bound``."""
    return 1.0 / (SQRT_2PI * c_bound ** (1.0 / p))


def project_product(values: np.ndarray, target: float, condition: float = CONDITION) -> np.ndarray:
    """Scale positive eigenvalues so that their product is ``target``, none below the largest divided by ``condition``.

    Values that the floor would lift are frozen there, and the rest is scaled again, until none is left to freeze.
    """
    values = np.asarray(values, float)
    floor = values.max() / condition
    frozen = np.zeros(len(values), bool)
    out = values.copy()
    for _ in range(len(values) + 1):
        free = ~frozen
        if not free.any():
            break
        log_rest = math.log(target) - frozen.sum() * math.log(floor)
        scale = math.exp((log_rest - np.log(values[free]).sum()) / free.sum())
        out[free] = values[free] * scale
        out[frozen] = floor
        low = free & (out < floor)
        if not low.any():
            break
        frozen |= low
    return out


def bounded_covariance(
    cov: np.ndarray, weight: float, c_bound: float, small: float = 3.0, square_small: bool = False
) -> tuple[np.ndarray, bool]:
    """A covariance whose normal density peaks at ``c_bound`` or less, and whether the bound was met.

    A cluster of weight ``small`` or less gets the diagonal of the least standard deviations themselves, not their
    squares, unless ``square_small``; that unit is part of the results to match. A floored variance alone doesn't count
    as having met the bound.
    """
    cov = np.atleast_2d(np.asarray(cov, float))
    p = len(cov)
    sd = least_sd(c_bound, p)
    if weight <= small:
        return np.eye(p) * (sd * sd if square_small else sd), True
    var = np.maximum(np.diag(cov), sd * sd)
    fixed = cov.copy()
    np.fill_diagonal(fixed, var)
    least = (sd * sd) ** p
    det = np.linalg.det(fixed)
    if not (det < least * (1 - 1e-12)):
        return fixed, False
    root = np.sqrt(var)
    corr = fixed / np.outer(root, root)
    values, vectors = np.linalg.eigh((corr + corr.T) / 2)
    values = np.abs(values)
    positive = values[values > 0]
    values[values == 0] = positive.min() / 2 if len(positive) else 1.0
    target = least / var.prod()
    out = fixed
    if values.prod() < target:
        out = (vectors * project_product(values, target)) @ vectors.T * np.outer(root, root)
        out = (out + out.T) / 2
    if not np.isfinite(out).all() or np.linalg.det(out) <= 0:
        return np.diag(var), True
    return out, True


def floored_probabilities(counts: np.ndarray, least: float) -> tuple[np.ndarray, bool]:
    """Normalised level counts with no present level below ``least``; levels without any count stay at 0."""
    counts = np.asarray(counts, float)
    total = counts.sum()
    if total <= 0:
        return counts * 0.0, False
    p = counts / total
    present = p > 0
    if least <= 0:
        return p, False
    if present.sum() * least >= 1 and present.sum() > 1:
        raise ValueError("the floor leaves no room for the levels that are present")
    raised = np.zeros(len(p), bool)
    base = p.copy()
    while True:
        low = present & ~raised & (p < least)
        if not low.any():
            return p, bool(raised.any())
        raised |= low
        rest = present & ~raised
        p = np.where(raised, least, 0.0)
        if rest.any():
            p[rest] = base[rest] / base[rest].sum() * (1 - least * raised.sum())


def cholesky(matrix: np.ndarray, tries: int = 8) -> np.ndarray:
    """Lower factor; a matrix that isn't positive definite gets a growing multiple of the unit matrix added."""
    for k in range(-1, tries):
        try:
            return np.linalg.cholesky(matrix + (0.0 if k < 0 else 1e-10 * 10.0**k) * np.eye(len(matrix)))
        except np.linalg.LinAlgError:
            continue
    raise ValueError("covariance can't be factored")


def assignment(weights: np.ndarray) -> list[int]:
    """Columns that give the rows of a table the largest total, one to one (Hungarian method); -1 for rows left over."""
    w = np.asarray(weights, float)
    n, m = w.shape
    size = max(n, m)
    cost = np.zeros((size + 1, size + 1))
    cost[1 : n + 1, 1 : m + 1] = w.max(initial=0.0) - w
    cost[1:, 1:][n:, :] = w.max(initial=0.0)
    cost[1:, 1:][:, m:] = w.max(initial=0.0)
    u, v, match, way = np.zeros(size + 1), np.zeros(size + 1), np.zeros(size + 1, int), np.zeros(size + 1, int)
    for i in range(1, size + 1):
        match[0], j0 = i, 0
        least, used = np.full(size + 1, np.inf), np.zeros(size + 1, bool)
        while True:
            used[j0] = True
            i0 = match[j0]
            free = np.flatnonzero(~used)
            reduced = cost[i0, free] - u[i0] - v[free]
            better = reduced < least[free]
            least[free[better]], way[free[better]] = reduced[better], j0
            j1 = free[np.argmin(least[free])]
            delta = least[j1]
            u[match[used]] += delta
            v[used] -= delta
            least[free] -= delta
            j0 = j1
            if match[j0] == 0:
                break
        while j0:
            match[j0] = match[way[j0]]
            j0 = way[j0]
    out = [-1] * n
    for j in range(1, m + 1):
        if 1 <= match[j] <= n:
            out[match[j] - 1] = j - 1
    return out


def matched_count(table: np.ndarray) -> float:
    """The largest number of rows on which two labellings agree under one-to-one renaming."""
    return float(sum(table[i, j] for i, j in enumerate(assignment(table)) if j >= 0))


def adjusted_rand(table: np.ndarray) -> float:
    """Adjusted Rand index of a contingency table; 1 when it isn't defined."""
    t = np.asarray(table, float)
    n = t.sum()
    pairs = lambda x: (x * (x - 1) / 2).sum()
    total = n * (n - 1) / 2
    if n <= 1 or total == 0:
        return 1.0
    both, a, b = pairs(t), pairs(t.sum(1)), pairs(t.sum(0))
    expected = a * b / total
    top = (a + b) / 2
    return 1.0 if top == expected else float((both - expected) / (top - expected))


def contingency(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    xs, xi = np.unique(x, return_inverse=True)
    ys, yi = np.unique(y, return_inverse=True)
    return np.bincount(xi * len(ys) + yi, minlength=len(xs) * len(ys)).reshape(len(xs), len(ys))


def similarity(x: np.ndarray, y: np.ndarray, metric: str = "match") -> float:
    """Similarity of two labellings of the same rows; 1 for one row or none."""
    if len(x) != len(y):
        raise ValueError("labellings of different lengths")
    if len(x) <= 1:
        return 1.0
    table = contingency(x, y)
    return matched_count(table) / len(x) if metric == "match" else adjusted_rand(table)
