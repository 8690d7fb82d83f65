"""Hand-computed cases and invariants of the in-memory kernels."""

import itertools
import math

import numpy as np
import pytest

from phasegrid.functions import kernels, linalg
from phasegrid.functions.kernels import Table

ONE = 1 / math.sqrt(2 * math.pi)


def mixture(n=200, seed=1, means=(-2, 2)):
    r = np.random.default_rng(seed)
    return Table(np.concatenate([r.normal(m, 0.5, n // len(means)) for m in means])[:, None], univariate=True)


def test_probability_floor():
    p, raised = linalg.floored_probabilities(np.array([1, 4]), 0.0)
    assert p.tolist() == [0.2, 0.8] and not raised
    p, raised = linalg.floored_probabilities(np.array([1, 4]), 1 / 3)
    assert np.allclose(p, [1 / 3, 2 / 3]) and raised
    p, _ = linalg.floored_probabilities(np.array([0, 1, 9, 90]), 0.1)
    assert p[0] == 0 and np.isclose(p.sum(), 1) and p[1:].min() >= 0.1 - 1e-12
    with pytest.raises(ValueError):
        linalg.floored_probabilities(np.array([1, 1, 1]), 0.5)


def test_mixed_bounds_of_a_constant_column():
    t = Table(np.zeros((5, 1)), np.array([[0], [1], [1], [1], [1]]), 2)
    p = kernels.parameters(t, np.zeros(5, int), 10.0)
    assert not p.density_bound.any() and not p.floor_bound.any()
    p = kernels.parameters(t, np.zeros(5, int), 10.0, 3.0)
    assert p.floor_bound.tolist() == [True] and not p.density_bound.any() and np.allclose(p.prob[0, 0], [1 / 3, 2 / 3])


def test_small_clusters_meet_the_bound():
    t = Table(np.array([[0.0], [0], [1], [1], [1]]), np.zeros((5, 1), int), 1)
    p = kernels.parameters(t, np.array([0, 0, 1, 1, 1]), 10.0)
    assert p.density_bound.tolist() == [True, True]
    assert np.allclose(p.cov.ravel(), ONE / 10)  # the deviation itself, not its square


def test_assignment_takes_the_first_of_ties():
    z = np.array([-3.0, -1, 0, 1, 2, 4])
    nu, m, s, lam = np.array([0.25, 0.5, 0.25]), np.array([-2, 0.5, 3]), np.array([0.7, 1.1, 0.9]), 0.8
    dens = -np.log(s) - 0.5 * np.log(2 * np.pi) - 0.5 * ((z[:, None] - m) / s) ** 2
    want = [int(np.argmax(np.log(nu) - np.log(s) / lam - (v - m) ** 2 / (2 * lam * s * s))) for v in z]
    assert kernels.assign(dens, nu, lam).tolist() == want
    assert kernels.assign(np.zeros((2, 3)), np.ones(3) / 3, 1.0).tolist() == [0, 0]


def test_compression():
    assert kernels.compress(np.array([3, 3, 1, 5, 1])).tolist() == [1, 1, 0, 2, 0]
    assert kernels.compress(np.array([4, 4, 2, 2, 2, 5])).tolist() == [1, 1, 0, 0, 0, 2]


def test_cluster_sums():
    t = Table(np.array([-2.0, -1, 1, 3, 0, 5])[:, None], univariate=True)
    p = kernels.parameters(t, np.array([0, 1, 0, 1, 2, 2]), 100.0)
    assert np.allclose(p.nu * 6, 2) and np.allclose(p.mean[:, 0] * 2, [-1, 2, 5])


@pytest.mark.parametrize("lam,c", [(0.2, 1.0), (1.0, 1.0), (0.5, 0.2)])
def test_invariants_of_a_fit(lam, c):
    t = mixture()
    f = kernels.multistart(t, lam, c, np.random.default_rng(3), 6, 6)
    assert abs(f.params.nu.sum() - 1) < 1e-12 and set(f.labels) == set(range(f.reo))
    assert (np.sqrt(f.params.cov[:, 0, 0]) >= ONE / c - 1e-12).all()
    again = kernels.parameters(t, f.labels, c)
    assert np.allclose(again.mean, f.params.mean, atol=1e-12)
    a, b = kernels.coefficients(t, f.labels, again)
    assert abs(a + b / lam - f.h) < 1e-12
    # the closed form of one dimension
    v, g = again.raw_var, again.cov[:, 0, 0]
    closed = -(again.nu * np.log(again.nu)).sum() + (np.log(2 * np.pi) + (again.nu * np.log(g)).sum() + (again.nu * v / g).sum()) / (2 * lam)
    assert abs(closed - f.h) < 1e-10


def test_objective_falls_along_a_descent():
    t = mixture(300, 5, (-3, 0, 3))
    labels = np.random.default_rng(1).integers(0, 5, 300)
    last = math.inf
    for _ in range(30):
        labels = kernels.compress(labels)
        p = kernels.parameters(t, labels, 50.0)
        a, b = kernels.coefficients(t, labels, p)
        assert a + b / 0.7 <= last + 1e-9
        last = a + b / 0.7
        labels = kernels.assign(kernels.log_densities(t, p), p.nu, 0.7)


def test_weights_equal_repeated_rows():
    r = np.random.default_rng(2)
    x, w = r.normal(size=(40, 2)), r.integers(0, 4, 40).astype(float)
    labels = r.integers(0, 3, 40)
    rep = np.repeat(np.arange(40), w.astype(int))
    a = kernels.parameters(Table(x), labels, 5.0, w=w)
    b = kernels.parameters(Table(x[rep]), labels[rep], 5.0)
    assert np.allclose(a.mean, b.mean) and np.allclose(a.cov, b.cov) and np.allclose(a.nu, b.nu)


def test_matching_and_rand_by_brute_force():
    r = np.random.default_rng(4)
    for _ in range(60):
        t = r.integers(0, 9, (r.integers(1, 5), r.integers(1, 5)))
        n, m = t.shape
        size = max(n, m)
        square = np.zeros((size, size))
        square[:n, :m] = t
        best = max(sum(square[i, p[i]] for i in range(size)) for p in itertools.permutations(range(size)))
        assert linalg.matched_count(t) == best
    x, y = np.array([1, 1, 2, 2, 3]), np.array([1, 1, 2, 3, 3])
    pairs = list(itertools.combinations(range(5), 2))
    both = sum(x[i] == x[j] and y[i] == y[j] for i, j in pairs)
    px, py = sum(x[i] == x[j] for i, j in pairs), sum(y[i] == y[j] for i, j in pairs)
    want = (both - px * py / 10) / ((px + py) / 2 - px * py / 10)
    assert abs(linalg.adjusted_rand(linalg.contingency(x, y)) - want) < 1e-12
    assert linalg.similarity(x, x) == linalg.similarity(x, 5 - x) == 1.0
    assert linalg.similarity(np.array([1]), np.array([2])) == 1.0
    with pytest.raises(ValueError):
        linalg.similarity(x, y[:3])


def test_bounded_covariances():
    r = np.random.default_rng(6)
    for p in (2, 3, 5):
        x = r.normal(size=(50, p)) * r.uniform(1e-4, 1, p)
        cov, hit = linalg.bounded_covariance(np.cov(x.T, bias=True), 50, 10.0)
        assert np.linalg.det(cov) >= linalg.least_sd(10.0, p) ** (2 * p) * (1 - 1e-6)
        assert np.allclose(cov, cov.T) and np.linalg.eigvalsh(cov).min() > 0
    line = np.outer([1.0, 1], [1.0, 1]) + 1e-6 * np.eye(2)
    cov, hit = linalg.bounded_covariance(line, 50, 1.0)
    assert hit and np.isclose(np.linalg.det(cov), linalg.least_sd(1.0, 2) ** 4)
    cov, hit = linalg.bounded_covariance(np.ones((2, 2)) * 3, 50, 1.0)
    assert hit and np.array_equal(cov, 3 * np.eye(2))  # singular as it is: only the variances stay
    v = linalg.project_product(np.array([1.0, 1e-3, 1e-12]), 1e-6)
    assert np.isclose(v.prod(), 1e-6) and np.linalg.cholesky(np.diag(v)).shape == (3, 3)
    assert linalg.cholesky(np.zeros((2, 2))).shape == (2, 2)


def test_paths_and_projection():
    t = mixture(120)
    fits = kernels.lambda_path(t, [0.2, 1.0, 0.5], 1.0, np.random.default_rng(1), True, 3, 2, 5)
    assert list(fits) == [0.2, 0.5, 1.0] and fits[0.2].origin == "fresh"
    assert {f.origin for f in fits.values()} <= {"fresh", "warm_forward"}
    shown = kernels.project(t, fits[0.5], 1.0)
    assert shown.reo <= fits[0.5].reo and math.isfinite(shown.h)
    share, n = kernels.saturation(fits[0.2].params)
    assert 0 <= share <= 1 and n == fits[0.2].params.density_bound.sum()


def test_small_clusters_are_dissolved():
    t = mixture(100)
    labels = np.zeros(100, int)
    labels[:3], labels[50:] = 2, 1
    params = kernels.parameters(t, labels, 1.0)
    a, b = kernels.coefficients(t, labels, params)
    fit = kernels.regrouped(t, kernels.Fit(labels, params, a, b, 0.3), 1.0, np.random.default_rng(1), smallest=10)
    assert np.bincount(fit.labels).min() >= 10
    auto = kernels.regrouped(t, kernels.multistart(t, 0.1, 0.3, np.random.default_rng(2), 3, 8), 0.3, np.random.default_rng(1), auto=True)
    size = np.bincount(auto.labels)
    assert not any(auto.params.density_bound[k] and (size < size[k]).sum() + 1 <= len(size) // 2 for k in range(auto.reo)) or auto.reo == 1


def test_fits_by_level():
    t, focus = mixture(100), np.arange(100) % 2

    def fit_level(part):
        return kernels.multistart(part, 0.3, 1.0, np.random.default_rng(1), 3, 4), 0.3, 1.0

    fit = kernels.by_focus(t, focus, fit_level)
    assert not set(fit.labels[focus == 0]) & set(fit.labels[focus == 1]) and math.isfinite(fit.h) and fit.reo == len(set(fit.labels))


def test_soft_parameters_of_hard_weights_are_those_of_the_labels():
    r = np.random.default_rng(3)
    t = kernels.Table(r.normal(size=(60, 2)), r.integers(0, 3, (60, 2)), 3)
    labels, w = r.integers(0, 4, 60), r.integers(0, 3, 60).astype(float)
    for t_ in (t, kernels.Table(t.x[:, :1], univariate=True)):
        a = kernels.parameters(t_, labels, 2.0, 4.0, w)
        b = kernels.soft_parameters(t_, np.eye(4)[labels], 2.0, 4.0, w)
        for name in ("nu", "mean", "cov", "prob", "density_bound", "floor_bound"):
            assert np.allclose(getattr(a, name), getattr(b, name)), name


def test_soft_starts():
    r = np.random.default_rng(3)
    x = np.concatenate([r.normal(-3, 1, 80), r.normal(3, 1, 80)])[:, None]
    t = kernels.Table(x, univariate=True)
    fit = kernels.descend(t, (x[:, 0] > 0).astype(int), 1.0, 2.0)
    assert kernels.expanded(fit.labels, r).shape == (160, 3) and (kernels.expanded(fit.labels, r)[:, :2].argmax(1) == fit.labels).all()
    near = kernels.perturbed(fit, r)
    assert near.shape == (160, 2) and (near.argmax(1) == fit.labels).all()
    assert np.array_equal(kernels.descend(t, near, 1.0, 2.0).labels, fit.labels)


def test_focus_keeps_the_floor():
    t = kernels.Table(np.empty((0, 0)), np.array([[0], [1], [1], [1], [1], [0], [0], [0], [0], [1]]), 2)
    whole = lambda part: (kernels.descend(part, np.zeros(part.n, int), 1.0, 1.0, 3.0), 1.0, 1.0)
    fit = kernels.by_focus(t, np.arange(10) // 5, whole, 3.0)
    assert np.allclose(np.sort(fit.params.prob[0, 0]), [1 / 3, 2 / 3]) and fit.params.floor_bound.all()
