"""Column expressions of the model: log densities, scores, argmax, entropies.

Parameters of the few clusters enter as literals, so an assignment step is one projection inside whole-stage code
generation: no join, no shuffle, no lambda.
"""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from phasegrid.functions.kernels import LOG_2PI, Params

NEG_INF = float("-inf")


def safe_ln(x: Column) -> Column:
    """ln with minus infinity at 0 and below (Spark's own gives null there)."""
    return F.when(x > 0, F.ln(x)).otherwise(F.lit(NEG_INF))


def normal_log_density(x: Column, mean: float, sd: float) -> Column:
    z = (x - F.lit(float(mean))) / F.lit(float(sd))
    return F.lit(-math.log(sd) - 0.5 * LOG_2PI) - F.lit(0.5) * z * z


def multinormal_log_density(xs: Sequence[Column], mean: np.ndarray, cov: np.ndarray) -> Column:
    """Log density with the quadratic form unrolled over a precision matrix."""
    inverse = np.linalg.inv(cov)
    _, log_det = np.linalg.slogdet(cov)
    d = [x - F.lit(float(m)) for x, m in zip(xs, mean)]
    quad = F.lit(0.0)
    for i in range(len(d)):
        quad = quad + F.lit(float(inverse[i, i])) * d[i] * d[i]
        for j in range(i + 1, len(d)):
            quad = quad + F.lit(float(2 * inverse[i, j])) * d[i] * d[j]
    return F.lit(-0.5 * (len(d) * LOG_2PI + log_det)) - F.lit(0.5) * quad


def level_log_density(code: Column, prob: np.ndarray) -> Column:
    """Log probability of a level's code (from 0); minus infinity for a code that is null, unknown or of probability 0."""
    out = F.lit(NEG_INF)
    for level, p in enumerate(prob):
        if p > 0:
            out = F.when(code == level, F.lit(math.log(p))).otherwise(out)
    return out


def log_densities(params: Params, xs: Sequence[Column], codes: Sequence[Column]) -> list[Column]:
    """Log density of each cluster: the numeric part plus the categorical part."""
    out = []
    for k in range(params.r):
        parts = []
        if len(xs) == 1:
            parts.append(normal_log_density(xs[0], params.mean[k, 0], math.sqrt(params.cov[k, 0, 0])))
        elif len(xs) > 1:
            parts.append(multinormal_log_density(xs, params.mean[k], params.cov[k]))
        parts += [level_log_density(c, params.prob[k, j]) for j, c in enumerate(codes)]
        total = parts[0]
        for p in parts[1:]:
            total = total + p
        out.append(total)
    return out


def scores(densities: Sequence[Column], nu: Sequence[float], lam: float) -> list[Column]:
    return [d / F.lit(float(lam)) + F.lit(math.log(n) if n > 0 else NEG_INF) for d, n in zip(densities, nu)]


def first_largest(values: Sequence[Column]) -> Column:
    """Position, from 1, of the largest value; the first of equals. NaN never wins over a number."""
    if len(values) == 1:
        return F.lit(1)
    each = [F.struct(F.nanvl(v, F.lit(NEG_INF)).alias("v"), F.lit(-k).alias("k")) for k, v in enumerate(values, 1)]  # a score once
    return -F.array_max(F.array(*each))["k"]


def label(params: Params, xs: Sequence[Column], codes: Sequence[Column], lam: float) -> Column:
    """Assigned cluster, from 1."""
    return first_largest(scores(log_densities(params, xs, codes), params.nu, lam))


def picked(values: Sequence[Column], at: Column) -> Column:
    return F.element_at(F.array(*values), at)
