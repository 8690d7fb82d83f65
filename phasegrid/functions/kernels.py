"""One descent on an in-memory table: the parameter step, the assignment step and the objective, in numpy.

These kernels run inside Spark tasks for tables small enough to send whole to a task (``plans.paths``); ``plans.descent``
has the same steps as Catalyst queries for tables of any size.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

import numpy as np

from phasegrid.functions import linalg

LOG_2PI = math.log(2 * math.pi)


@dataclass
class Table:
    """Observations: numeric columns, integer codes of categorical columns, row weights (bootstrap multiplicities)."""

    x: np.ndarray  # n x p
    codes: np.ndarray = field(default_factory=lambda: np.empty((0, 0), np.int64))  # n x q, from 0
    levels: int = 0
    univariate: bool = False  # one numeric column under the one-dimensional rules
    family: str = ""  # a registered family's name; empty: by the columns

    @property
    def n(self) -> int:
        return len(self.x) if self.x.size or not self.codes.size else len(self.codes)


@dataclass
class Params:
    nu: np.ndarray
    mean: np.ndarray  # r x p
    cov: np.ndarray  # r x p x p
    raw_var: np.ndarray  # r, one-dimensional only: the variance before the bound
    prob: np.ndarray  # r x q x levels
    density_bound: np.ndarray
    floor_bound: np.ndarray

    @property
    def r(self) -> int:
        return len(self.nu)


def compress(labels: np.ndarray) -> np.ndarray:
    """Labels renumbered 0.. in their order, without gaps."""
    return np.unique(labels, return_inverse=True)[1]


def parameters(t: Table, labels: np.ndarray, c_bound: float, c_qual: float = math.inf, w: np.ndarray | None = None) -> Params:
    """Bounded maximum-likelihood parameters of the clusters of a labelling 0..r-1."""
    n, p, q = t.n, t.x.shape[1] if t.x.size else 0, t.codes.shape[1] if t.codes.size else 0
    w = np.ones(n) if w is None else w
    r = int(labels.max()) + 1
    mass = np.bincount(labels, w, r)
    mean, cov, raw = np.zeros((r, p)), np.zeros((r, p, p)), np.zeros(r)
    bound, floored = np.zeros(r, bool), np.zeros(r, bool)
    safe = np.maximum(mass, 1e-300)
    for j in range(p):
        mean[:, j] = np.bincount(labels, w * t.x[:, j], r) / safe
    if p:
        d = t.x - mean[labels]
        for i in range(p):
            for j in range(i, p):
                cov[:, i, j] = cov[:, j, i] = np.bincount(labels, w * d[:, i] * d[:, j], r) / safe
        if t.univariate:
            least = linalg.least_sd(c_bound)
            raw = cov[:, 0, 0].copy()
            bound = np.sqrt(raw) < least
            cov[:, 0, 0] = np.maximum(raw, least * least)
        else:
            for k in range(r):
                cov[k], bound[k] = linalg.bounded_covariance(cov[k], mass[k], c_bound)
    prob = np.zeros((r, q, t.levels))
    for j in range(q):
        counts = np.bincount(labels * t.levels + t.codes[:, j], w, r * t.levels).reshape(r, t.levels)
        for k in range(r):
            prob[k, j], low = linalg.floored_probabilities(counts[k], 0.0 if math.isinf(c_qual) else 1.0 / c_qual)
            floored[k] |= low
    return Params(mass / w.sum(), mean, cov, raw, prob, bound, floored)


def soft_parameters(t: Table, phi: np.ndarray, c_bound: float, c_qual: float = math.inf, w: np.ndarray | None = None) -> Params:
    """The parameter step from an assignment of weights, n x r; rows count by their sum."""
    phi = phi / np.maximum(phi.sum(1, keepdims=True), 1e-300)
    phi = phi if w is None else phi * w[:, None]
    phi = phi[:, phi.sum(0) > 0]
    mass = phi.sum(0)
    r, p, q = len(mass), t.x.shape[1] if t.x.size else 0, t.codes.shape[1] if t.codes.size else 0
    mean, cov, raw = np.zeros((r, p)), np.zeros((r, p, p)), np.zeros(r)
    bound, floored, prob = np.zeros(r, bool), np.zeros(r, bool), np.zeros((r, q, t.levels))
    least = linalg.least_sd(c_bound)
    if p:
        mean = phi.T @ t.x / mass[:, None]
    for k in range(r):
        if p:
            d = t.x - mean[k]
            cov[k] = (phi[:, k, None] * d).T @ d / mass[k]
            if t.univariate:
                raw[k] = cov[k, 0, 0]
                bound[k], cov[k, 0, 0] = math.sqrt(raw[k]) < least, max(raw[k], least * least)
            else:
                cov[k], bound[k] = linalg.bounded_covariance(cov[k], mass[k], c_bound)
        for j in range(q):
            counts = np.bincount(t.codes[:, j], phi[:, k], t.levels)
            prob[k, j], low = linalg.floored_probabilities(counts, 0.0 if math.isinf(c_qual) else 1.0 / c_qual)
            floored[k] |= low
    return Params(mass / mass.sum(), mean, cov, raw, prob, bound, floored)


def log_densities(t: Table, params: Params) -> np.ndarray:
    """n x r log densities; minus infinity where a level has probability 0."""
    n = t.n
    out = np.zeros((n, params.r))
    if t.x.size:
        p = t.x.shape[1]
        for k in range(params.r):
            d = t.x - params.mean[k]
            if p == 1:
                v = params.cov[k, 0, 0]
                out[:, k] += -0.5 * (LOG_2PI + math.log(v) + d[:, 0] ** 2 / v)
            else:
                low = linalg.cholesky(params.cov[k])
                z = np.linalg.solve(low, d.T)
                out[:, k] += -0.5 * (p * LOG_2PI + 2 * np.log(np.diag(low)).sum() + (z * z).sum(0))
    if t.codes.size:
        with np.errstate(divide="ignore"):
            logs = np.log(params.prob)
        for j in range(t.codes.shape[1]):
            out += logs[:, j, :][:, t.codes[:, j]].T
    return out


def assign(dens: np.ndarray, nu: np.ndarray, lam: float) -> np.ndarray:
    """argmax of ln nu + log density / lambda; the first on ties."""
    with np.errstate(divide="ignore"):
        return np.argmax(dens / lam + np.log(nu), axis=1)


def coefficients(t: Table, labels: np.ndarray, params: Params, w: np.ndarray | None = None, densities=None) -> tuple[float, float]:
    """(A, B) with objective A + B / lambda: class entropy and mean negative log density under the own cluster."""
    w = np.ones(t.n) if w is None else w
    nu = params.nu[params.nu > 0]
    dens = (densities or log_densities)(t, params)[np.arange(t.n), labels]
    use = w > 0
    return float(-(nu * np.log(nu)).sum()), float(-(w[use] * dens[use]).sum() / w.sum())


def default_clusters(n: int) -> int:
    return int(math.floor(math.log(max(n, 1)) + 1))


@dataclass
class Fit:
    labels: np.ndarray
    params: Params
    a: float
    b: float
    lam: float
    origin: str = "fresh"

    @property
    def h(self) -> float:
        return self.a + self.b / self.lam

    @property
    def reo(self) -> int:
        return self.params.r


def descend(
    t: Table, start: np.ndarray, lam: float, c_bound: float, c_qual: float = math.inf, loops: int = 300, w: np.ndarray | None = None, steps=None
) -> Fit:
    """Alternate parameters and assignment until one cluster is left, a labelling returns, or ``loops``.

    ``start`` is a labelling, or an assignment of weights (n x r) whose parameters give the first labelling. ``steps`` are
    a family's parameter step and log densities; by default those of the table's columns.
    """
    if steps is None and t.family:
        from phasegrid.functions import families

        steps = (families.family(t.family).parameters, families.family(t.family).log_densities)
    parameters_of, densities = steps or (parameters, log_densities)
    if start.ndim == 2:
        first = soft_parameters(t, start, c_bound, c_qual, w)
        start = assign(log_densities(t, first), first.nu, lam)
    labels = compress(start)
    seen = {labels.tobytes()}
    for _ in range(loops):
        params = parameters_of(t, labels, c_bound, c_qual, w)
        if params.r == 1:
            break
        labels = compress(assign(densities(t, params), params.nu, lam))
        if w is not None and not (w[labels == 0] > 0).any():
            labels = _by_mass(labels, w)
        key = labels.tobytes()
        if key in seen:
            break
        seen.add(key)
    if w is not None:
        labels = _by_mass(labels, w)
    params = parameters_of(t, labels, c_bound, c_qual, w)
    a, b = coefficients(t, labels, params, w, densities)
    return Fit(labels, params, a, b, lam)


def _by_mass(labels: np.ndarray, w: np.ndarray) -> np.ndarray:
    """Labels without clusters that hold no weight; their rows join the first that does (they weigh nothing)."""
    mass = np.bincount(labels, w)
    if (mass > 0).all():
        return labels
    keep = np.flatnonzero(mass > 0)
    return compress(np.where(mass[labels] > 0, labels, keep[0]))


def regrouped(
    t: Table,
    fit: Fit,
    c_bound: float,
    rng: np.random.Generator,
    smallest: float = 0.0,
    auto: bool = False,
    c_qual: float = math.inf,
    loops: int = 300,
) -> Fit:
    """Dissolve clusters and descend again until there is none left to dissolve.

    Those of fewer than ``smallest`` rows, all at once; with ``auto`` the smallest one that met the density bound among
    the smaller half (of several clusters). Their rows start in random other clusters.
    """
    for _ in range(t.n):
        size = np.round(fit.params.nu * t.n, 6)
        if auto:
            rank = np.array([(size < s).sum() + 1 for s in size])
            out = [k for k in np.flatnonzero(fit.params.density_bound) if rank[k] <= len(size) // 2]
            out = [min(out, key=lambda k: rank[k])] if out and len(size) > 1 else []
        else:
            out = list(np.flatnonzero(size < smallest))
        if not out or fit.reo == 1:
            return fit
        kept = [k for k in range(fit.reo) if k not in out] or [0]
        start = fit.labels.copy()
        loose = np.isin(start, out)
        start[loose] = rng.choice(kept, loose.sum())
        fit = descend(t, start, fit.lam, c_bound, c_qual, loops)
    return fit


def by_focus(t: Table, focus: np.ndarray, fit_level, c_qual: float = math.inf) -> Fit:
    """Separate fits of the levels of one category, put together: labels numbered on, parameters and H of the whole.

    ``fit_level`` fits the rows of one level; ``c_qual`` is the floor of the whole's level probabilities.
    """
    labels, at, lam, c_bound = np.zeros(t.n, np.int64), 0, 1.0, math.inf
    for level in np.unique(focus):
        rows = np.flatnonzero(focus == level)
        part = Table(t.x[rows] if t.x.size else t.x, t.codes[rows] if t.codes.size else t.codes, t.levels, t.univariate)
        fit, lam, c_bound = fit_level(part)
        labels[rows] = fit.labels + at
        at += fit.reo
    params = parameters(t, labels, c_bound, c_qual)
    a, b = coefficients(t, labels, params)
    return Fit(labels, params, a, b, lam)


def expanded(labels: np.ndarray, rng: np.random.Generator) -> np.ndarray:
    """A labelling as weights: each row's own cluster and a new one, by random numbers."""
    phi = np.zeros((len(labels), labels.max() + 2))
    phi[np.arange(len(labels)), labels] = rng.random(len(labels))
    phi[:, -1] = rng.random(len(labels))
    return phi


def perturbed(fit: Fit, rng: np.random.Generator) -> np.ndarray:
    """A fit's clusters of ten rows or more (else the largest), with a tenth of a random number added everywhere."""
    n = len(fit.labels)
    keep = np.flatnonzero(fit.params.nu * n >= 10)
    keep = keep if len(keep) else np.array([fit.params.nu.argmax()])
    return (fit.labels[:, None] == keep[None, :]) + 0.1 * rng.random((n, len(keep)))


def multistart(
    t: Table,
    lam: float,
    c_bound: float,
    rng: np.random.Generator,
    shots: int = 10,
    r0: int | None = None,
    c_qual: float = math.inf,
    loops: int = 300,
    warm: np.ndarray | None = None,
    w: np.ndarray | None = None,
    chained: bool = True,
) -> Fit | None:
    """Best of several descents; the first of equals. ``warm`` seeds the first shot and perturbations of it.

    Chained shots start from the last result's clusters with a random new one (a quarter of the time), from one cluster or
    few random ones (a quarter: one half the time, always if ``r0`` isn't given), or afresh; with more than 100 rows the
    last floor(shots / 10) + 1 perturb the best. Independent shots are all fresh.
    """
    given = r0 is not None
    r0 = r0 or default_clusters(t.n)
    best: Fit | None = None
    previous = warm
    tail = shots - shots // 10 - 1 if t.n > 100 else shots
    for shot in range(shots):
        u = rng.random()
        if shot == 0:
            start = warm if warm is not None else rng.integers(0, r0, t.n)
        elif chained and shot >= tail and best is not None:
            start = perturbed(best, rng)
        elif chained and u < 0.25 and previous is not None:
            start = expanded(previous, rng)
        elif chained and 0.25 <= u < 0.5:
            few = int(rng.integers(1, r0 + 1)) if given and rng.random() < 0.5 else 1
            start = rng.integers(0, few, t.n)
        else:
            start = rng.integers(0, r0, t.n)
        try:
            fit = descend(t, np.asarray(start), lam, c_bound, c_qual, loops, w)
        except (ValueError, np.linalg.LinAlgError):
            continue
        previous = fit.labels
        if math.isfinite(fit.h) and (best is None or fit.h < best.h):
            fit.origin = "warm" if warm is not None and shot == 0 else "fresh"
            best = fit
    return best


def lambda_path(
    t: Table,
    lambdas: list[float],
    c_bound: float,
    rng: np.random.Generator,
    forward: bool,
    shots: int,
    warm_shots: int,
    r0: int | None = None,
    c_qual: float = math.inf,
    loops: int = 300,
    w: np.ndarray | None = None,
) -> dict[float, Fit]:
    """Fits along the weights in one direction: the first afresh, each next the better of warm and fresh starts."""
    out: dict[float, Fit] = {}
    last: Fit | None = None
    for lam in sorted(set(lambdas), reverse=not forward):
        fits = []
        if last is not None:
            warm = multistart(t, lam, c_bound, rng, warm_shots, r0, c_qual, loops, last.labels, w)
            if warm is not None:
                warm.origin = "warm_forward" if forward else "warm_backward"
                fits.append(warm)
        fresh = multistart(t, lam, c_bound, rng, shots, r0, c_qual, loops, None, w)
        if fresh is not None:
            fits.append(fresh)
        if fits:
            out[lam] = last = min(fits, key=lambda f: f.h)
    return out


def project(t: Table, fit: Fit, c_bound: float, c_qual: float = math.inf) -> Fit:
    """A fit's partition of other rows: assigned by its parameters, then re-estimated on those rows."""
    labels = compress(assign(log_densities(t, fit.params), fit.params.nu, fit.lam))
    params = parameters(t, labels, c_bound, c_qual)
    a, b = coefficients(t, labels, params)
    return Fit(labels, params, a, b, fit.lam, fit.origin)


def saturation(params: Params) -> tuple[float, int]:
    """Share of rows in clusters that met the density bound, and the number of such clusters."""
    share = float(params.nu[params.density_bound].sum() / max(params.nu.sum(), 1e-300))
    return min(max(share, 0.0), 1.0), int(params.density_bound.sum())
