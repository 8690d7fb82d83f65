"""Synthetic tables and resampling. Draws are hashes of row numbers and a seed, so a plan that runs again agrees."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

MIXTURE_MEANS = [2 * math.sqrt(3) * v for v in (-3, -1.75, -0.75, 0, 0.75, 1.75, 3)]
MIXTURE_SDS = [0.2, 1.0, 0.5, 1.0, 0.5, 1.0, 0.2]
MIXTURE_WEIGHTS = [0.5, 2.0, 0.5, 1.0, 0.5, 2.0, 0.5]


def uniform(key: Column, *salt: int | str) -> Column:
    """A number in (0, 1) from a hash."""
    h = F.pmod(F.xxhash64(key, *[F.lit(s) for s in salt]), F.lit(2**52)).cast("double")
    return (h + 0.5) / float(2**52)


def normal(key: Column, *salt: int | str) -> Column:
    """A standard normal number (Box and Muller) from a hash."""
    return F.sqrt(-2 * F.ln(uniform(key, "a", *salt))) * F.cos(2 * math.pi * uniform(key, "b", *salt))


def _component(u: Column, weights: list[float]) -> Column:
    total, at, out = sum(weights), 0.0, F.lit(len(weights))
    cuts = []
    for k, w in enumerate(weights[:-1]):
        at += w / total
        cuts.append((at, k + 1))
    for cut, k in reversed(cuts):
        out = F.when(u < cut, k).otherwise(out)
    return out


def _components(means, sds, weights) -> tuple[list[float], list[float], list[float]]:
    """The standard mixture where no means are given; else standard deviations and weights of 1 where they aren't."""
    if means is None:
        return MIXTURE_MEANS, sds or MIXTURE_SDS, weights or MIXTURE_WEIGHTS
    return means, sds or [1.0] * len(means), weights or [1.0] * len(means)


def gaussian_mixture(spark: SparkSession, n: int = 5000, means=None, sds=None, weights=None, seed: int = 13) -> DataFrame:
    """``id, z, component`` of a one-dimensional normal mixture."""
    means, sds, weights = _components(means, sds, weights)
    df = spark.range(n).withColumn("component", _component(uniform(F.col("id"), seed, "k"), weights))
    pick = lambda v: F.element_at(F.array(*[F.lit(float(x)) for x in v]), F.col("component"))
    return df.withColumn("z", pick(means) + pick(sds) * normal(F.col("id"), seed))


def mixture_density(points: DataFrame, x: str, means=None, sds=None, weights=None) -> DataFrame:
    """Adds ``density`` of the mixture at a column's values."""
    means, sds, weights = _components(means, sds, weights)
    total = F.lit(0.0)
    for m, s, w in zip(means, sds, weights):
        z = (F.col(x) - m) / s
        total = total + F.lit(w / sum(weights) / (s * math.sqrt(2 * math.pi))) * F.exp(F.lit(-0.5) * z * z)
    return points.withColumn("density", total)


def mixed_benchmark(spark: SparkSession, n: int = 2500, p_num: int = 8, p_fac: int = 4, clusters: int = 4, levels: int = 4, seed: int = 1) -> DataFrame:
    """``id, component, x1.., f1..``: normal numbers around cluster means, categories from each cluster's own shares."""
    rng = np.random.default_rng(seed)
    means = rng.normal(0, 2, (clusters, p_num))
    shares = rng.exponential(1, (clusters, p_fac, levels))
    df = spark.range(n).withColumn("component", F.floor(uniform(F.col("id"), seed, "z") * clusters).cast("int") + 1)
    for j in range(p_num):
        mean = F.element_at(F.array(*[F.lit(float(v)) for v in means[:, j]]), F.col("component"))
        df = df.withColumn(f"x{j + 1}", mean + normal(F.col("id"), seed, f"x{j}"))
    for j in range(p_fac):
        u, out = uniform(F.col("id"), seed, f"f{j}"), F.lit(None).cast("int")
        for k in reversed(range(clusters)):
            out = F.when(F.col("component") == k + 1, _component(u, shares[k, j].tolist())).otherwise(out)
        df = df.withColumn(f"f{j + 1}", F.concat(F.lit("L"), out.cast("string")))
    return df


def sampled(df: DataFrame, id_col: str, n_max: int, seed: int = 1) -> DataFrame:
    """At most ``n_max`` rows without replacement: those of smallest hash."""
    return df.orderBy(F.xxhash64(F.col(id_col), F.lit(seed)), id_col).limit(n_max)


def lambda_grid(first: float, last: float, by: float) -> list[float]:
    n = int(math.floor((last - first) / by + 1e-9))
    return [round(first + i * by, 10) for i in range(n + 1)]


def bootstrap_weights(df: DataFrame, id_col: str, seed: int = 1, replace: bool = True) -> DataFrame:
    """Adds ``w``, how often a bootstrap sample of as many rows as the table drew each row; the sum is exactly n.

    Each of n draws picks a row number; row numbers are counted within hashed buckets and offset by the buckets before,
    so neither ranking nor drawing passes through one task.
    """
    if not replace:
        return df.withColumn("w", F.lit(1).cast("long"))
    spark = df.sparkSession
    n = df.count()
    buckets = max(1, n // 50_000)
    ids = df.select(F.col(id_col).alias("_id")).withColumn("_b", F.pmod(F.xxhash64("_id", F.lit(seed)), F.lit(buckets)))
    sizes = ids.groupBy("_b").agg(F.count("*").alias("m"))
    sizes = sizes.withColumn("_off", F.sum("m").over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, 0)) - F.col("m"))
    placed = ids.join(sizes, "_b").withColumn("_pos", F.col("_off") + F.row_number().over(Window.partitionBy("_b").orderBy("_id")) - 1)
    draws = spark.range(n).select(F.floor(uniform(F.col("id"), seed, "draw") * n).alias("_pos")).groupBy("_pos").agg(F.count("*").alias("w"))
    counted = placed.join(draws, "_pos", "left").select("_id", F.coalesce("w", F.lit(0)).alias("w"))
    return df.join(counted, F.col(id_col) == F.col("_id")).drop("_id")


def uniform_path(spark: SparkSession, lambdas: list[float], bounds: list[float], m_max: int = 64) -> DataFrame:
    """For rows spread evenly over an interval of length 1, the best number of equal pieces at each (c, lambda).

    ``c, lambda, m, value``: the least of lambda ln m + 1/2 ln(2 pi s^2) + l^2 / (24 s^2), with l = 1/m and s the larger
    of l / sqrt(12) and the bound's least; the first of equals. ``m_max`` doubles until the best lies inside; weights so
    small that more than 65,536 pieces would be best raise.
    """
    while True:
        grid = spark.createDataFrame([(float(c), float(v)) for c in bounds for v in lambdas], "c double, lambda double")
        m = grid.select("*", F.explode(F.sequence(F.lit(1), F.lit(m_max))).alias("m"))
        length = F.lit(1.0) / F.col("m")
        s = F.greatest(length / math.sqrt(12.0), F.lit(1.0 / math.sqrt(2 * math.pi)) / F.col("c"))
        value = F.col("lambda") * F.ln("m") + F.lit(0.5) * F.ln(F.lit(2 * math.pi) * s * s) + length * length / (F.lit(24.0) * s * s)
        best = m.withColumn("value", value).groupBy("c", "lambda").agg(F.min(F.struct(F.round("value", 12).alias("v"), F.col("m"))).alias("b"))
        best = best.select("c", "lambda", F.col("b.m").alias("m"), F.col("b.v").alias("value"))
        if best.agg(F.max("m")).first()[0] < m_max:
            return best
        if m_max > 1 << 16:
            raise ValueError(f"the best number of pieces is {m_max} or more")
        m_max *= 2
