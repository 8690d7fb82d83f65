"""Soft starting assignments, and the EM algorithm as a starter: responsibilities are an array column."""

from __future__ import annotations

import math
from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import expressions as ex
from phasegrid.sources.generators import uniform


def normalised(phi: Column) -> Column:
    total = F.aggregate(phi, F.lit(0.0), lambda a, b: a + b)
    return F.transform(phi, lambda v: v / total)


def random_soft(id_col: str, clusters: int, seed: int = 1) -> Column:
    """Uniform numbers, divided by their sum."""
    return normalised(F.array(*[uniform(F.col(id_col), seed, k) for k in range(clusters)]))


def expanded(phi: Column, id_col: str, clusters: int, seed: int = 1) -> Column:
    """An assignment times uniform numbers, with a random new cluster; rows are normalised."""
    scaled = F.array(*[F.element_at(phi, k + 1) * uniform(F.col(id_col), seed, k) for k in range(clusters)])
    return normalised(F.concat(scaled, F.array(uniform(F.col(id_col), seed, "new"))))


def perturbed(phi: Column, nu: list[float], n: int, id_col: str, seed: int = 1) -> Column:
    """Clusters of ten rows or more (else the largest), plus a tenth of a uniform number; rows are normalised."""
    keep = [k for k, v in enumerate(nu) if v * n >= 10] or [int(np.argmax(nu))]
    return normalised(F.array(*[F.element_at(phi, k + 1) + 0.1 * uniform(F.col(id_col), seed, k) for k in keep]))


def hard(phi: Column) -> Column:
    """The first of the largest, from 1."""
    return F.array_position(phi, F.array_max(phi)).cast("int")


def is_hard(phi: Column, tol: float = 1.5e-8) -> Column:
    """Whether a row is one 1 and otherwise 0."""
    ones = F.size(F.filter(phi, lambda v: F.abs(v - 1) <= tol))
    return (ones == 1) & F.forall(phi, lambda v: (F.abs(v) <= tol) | (F.abs(v - 1) <= tol))


def one_hot(label: Column, clusters: int) -> Column:
    return F.transform(F.sequence(F.lit(1), F.lit(clusters)), lambda k: (k == label).cast("double"))


@dataclass
class Mixture:
    """Weights, means and variances by column, level probabilities by column."""

    weight: np.ndarray
    mean: np.ndarray
    var: np.ndarray
    prob: np.ndarray
    log_likelihood: float = -math.inf


def _log_joint(m: Mixture, xs: list[str], codes: list[str]) -> list[Column]:
    out = []
    for k in range(len(m.weight)):
        s = F.lit(math.log(max(m.weight[k], 1e-300)))
        for j, x in enumerate(xs):
            s = s + ex.normal_log_density(F.col(x), m.mean[k, j], math.sqrt(m.var[k, j]))
        for j, c in enumerate(codes):
            s = s + ex.level_log_density(F.col(c), m.prob[k, j])
        out.append(s)
    return out


def responsibilities(df: DataFrame, m: Mixture, xs: list[str], codes: list[str]) -> DataFrame:
    """Adds ``phi`` and ``log_p`` (log of the row's density), by log-sum-exp."""
    df = df.withColumn("_s", F.array(*_log_joint(m, xs, codes))).withColumn("_top", F.array_max("_s"))
    sum_exp = F.aggregate(F.transform("_s", lambda v: F.exp(v - F.col("_top"))), F.lit(0.0), lambda a, b: a + b)
    df = df.withColumn("log_p", F.col("_top") + F.ln(sum_exp))
    return df.withColumn("phi", F.transform("_s", lambda v: F.exp(v - F.col("log_p")))).drop("_s", "_top")


def em_step(df: DataFrame, m: Mixture, xs: list[str], codes: list[str], levels: int, floor: float = 1e-6) -> Mixture:
    """One iteration: responsibilities and all weighted sums in one aggregate."""
    r = len(m.weight)
    rows = responsibilities(df, m, xs, codes)
    phi = [F.element_at("phi", k + 1) for k in range(r)]
    aggs = [F.count("*").alias("n"), F.sum("log_p").alias("ll")]
    for k in range(r):
        aggs.append(F.sum(phi[k]).alias(f"w{k}"))
        for j, x in enumerate(xs):
            d = F.col(x) - F.lit(float(m.mean[k, j]))  # centred at the old mean
            aggs += [F.sum(phi[k] * d).alias(f"a{k}_{j}"), F.sum(phi[k] * d * d).alias(f"b{k}_{j}")]
        for j, c in enumerate(codes):
            aggs += [F.sum(F.when(F.col(c) == v, phi[k]).otherwise(0.0)).alias(f"c{k}_{j}_{v}") for v in range(levels)]
    row = rows.agg(*aggs).first()
    w = np.array([row[f"w{k}"] for k in range(r)])
    mean, var, prob = m.mean.copy(), m.var.copy(), m.prob.copy()
    for k in range(r):
        for j in range(len(xs)):
            shift = row[f"a{k}_{j}"] / w[k]
            mean[k, j] += shift
            var[k, j] = max(row[f"b{k}_{j}"] / w[k] - shift * shift, floor)
        for j in range(len(codes)):
            prob[k, j] = np.array([row[f"c{k}_{j}_{v}"] for v in range(levels)]) / w[k]
    return Mixture(w / row["n"], mean, var, prob, row["ll"])


def em(df: DataFrame, start: Mixture, xs: list[str], codes: list[str] = (), levels: int = 0, loops: int = 100, tol: float = 1e-6) -> Mixture:
    """Iterate until the log-likelihood changes by less than ``tol``."""
    m = start
    for _ in range(loops):
        new = em_step(df, m, xs, list(codes), levels)
        done = abs(new.log_likelihood - m.log_likelihood) < tol
        m = new
        if done:
            break
    return m


def index_table(df: DataFrame, id_col: str, clusters: int) -> DataFrame:
    """Every (row, cluster) of an assignment, clusters from 1."""
    return df.select(F.col(id_col).alias("id"), F.explode(F.sequence(F.lit(1), F.lit(clusters))).alias("k"))
