"""Parameter step as Catalyst aggregates: partial sums on the map side, one small row a cluster after the shuffle."""

from __future__ import annotations

import math
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import linalg
from phasegrid.functions.kernels import Params


def gaussian_stats(
    df: DataFrame, by: Sequence[str], xs: Sequence[str], weight: str | None = None, extra: Sequence[Column] = ()
) -> DataFrame:
    """Weight, means ``m_i`` and population covariances ``s_i_j`` (i <= j) of each group, with ``extra`` aggregates.

    Unweighted groups use Welford-merging built-ins; weighted ones sum products of values centred at the overall mean,
    which keeps the digits that raw second moments would cancel.
    """
    if weight is None:
        aggs = [F.count("*").cast("double").alias("w")]
        aggs += [F.avg(x).alias(f"m_{i}") for i, x in enumerate(xs)]
        aggs += [
            (F.var_pop(xs[i]) if i == j else F.covar_pop(xs[i], xs[j])).alias(f"s_{i}_{j}")
            for i in range(len(xs))
            for j in range(i, len(xs))
        ]
        return df.groupBy(*by).agg(*aggs, *extra)
    w = F.col(weight)
    centre = df.agg(*[F.coalesce(F.avg(x), F.lit(0.0)).alias(f"c_{i}") for i, x in enumerate(xs)]).first() if xs else ()
    z = [F.col(x) - F.lit(float(c)) for x, c in zip(xs, centre)]
    sums = [F.sum(w).cast("double").alias("w")] + [F.sum(w * z[i]).alias(f"a_{i}") for i in range(len(xs))]
    sums += [F.sum(w * z[i] * z[j]).alias(f"b_{i}_{j}") for i in range(len(xs)) for j in range(i, len(xs))]
    g = df.groupBy(*by).agg(*sums, *extra).where("w > 0")
    mean = lambda i: F.col(f"a_{i}") / F.col("w")
    out = [F.col(b) for b in by] + [F.col("w")] + [(mean(i) + F.lit(float(centre[i]))).alias(f"m_{i}") for i in range(len(xs))]
    for i in range(len(xs)):
        for j in range(i, len(xs)):
            s = F.col(f"b_{i}_{j}") / F.col("w") - mean(i) * mean(j)
            out.append((F.greatest(s, F.lit(0.0)) if i == j else s).alias(f"s_{i}_{j}"))
    return g.select(*out, *g.columns[len(by) + len(sums) :])


def level_sums(codes: Sequence[str], levels: int, weight: str | None = None) -> list[Column]:
    """Level weights as aggregates ``c_<column>_<code>``, for use in one job with other statistics."""
    w = F.col(weight).cast("double") if weight else F.lit(1.0)
    return [F.sum(F.when(F.col(c) == v, w).otherwise(0.0)).alias(f"c_{j}_{v}") for j, c in enumerate(codes) for v in range(levels)]


def bounded_1d(stats: DataFrame, total: Column, c_bound: Column | float) -> DataFrame:
    """One-dimensional parameters ``n, nu, m, var, s, bound`` from ``w, m_0, s_0_0``; ``bound``: sd below the least."""
    c = c_bound if isinstance(c_bound, Column) else F.lit(float(c_bound))
    least = F.lit(1.0 / linalg.SQRT_2PI) / c
    var = F.greatest(F.col("s_0_0"), F.lit(0.0))
    return stats.withColumns(
        {
            "n": F.col("w").cast("long"),
            "nu": F.col("w") / total,
            "m": F.col("m_0"),
            "var": var,
            "s": F.greatest(F.sqrt(var), least),
            "bound": F.sqrt(var) < least,
        }
    ).drop("w", "m_0", "s_0_0")


def level_counts(df: DataFrame, by: Sequence[str], codes: Sequence[str], weight: str | None = None) -> DataFrame:
    """Weight of each level of each categorical column in each group: ``by..., col, code, n``; one pass, one shuffle."""
    entries = F.explode(F.array(*[F.struct(F.lit(j).alias("col"), F.col(c).alias("code")) for j, c in enumerate(codes)]))
    rows = df.select(*by, *([weight] if weight else []), entries.alias("e"))
    n = F.sum(weight).cast("double") if weight else F.count("*").cast("double")
    return rows.groupBy(*by, F.col("e.col").alias("col"), F.col("e.code").alias("code")).agg(n.alias("n"))


def floored_levels(counts: DataFrame, by: Sequence[str], c_qual: float) -> DataFrame:
    """Level probabilities with present levels raised to 1/``c_qual``; the rest is scaled, and raised again if need be.

    The rounds are bounded by the number of levels, so they run inside an expression over each group's few levels.
    """
    from pyspark.sql import Window

    w = Window.partitionBy(*by, "col")
    p = counts.withColumn("share", F.col("n") / F.sum("n").over(w)).where("n > 0")
    if math.isinf(c_qual):
        return p.withColumn("p", F.col("share")).withColumn("raised", F.lit(False)).drop("share")
    least = F.lit(1.0 / c_qual)
    # Sorted by share, the raised levels are the first m: the smallest m for which no further level falls below.
    up = Window.partitionBy(*by, "col").orderBy("share", "code")
    before = up.rowsBetween(Window.unboundedPreceding, -1)
    p = p.withColumn("m", F.row_number().over(up) - 1).withColumn("lost", F.coalesce(F.sum("share").over(before), F.lit(0.0)))
    scaled = F.col("share") / (1 - F.col("lost")) * (1 - least * F.col("m"))
    p = p.withColumn("fits", scaled >= least)
    first = F.min(F.when(F.col("fits"), F.struct("m", "lost"))).over(w)
    p = p.withColumn("cut", first)
    raised = F.col("m") < F.col("cut.m")
    value = F.when(raised, least).otherwise(F.col("share") / (1 - F.col("cut.lost")) * (1 - least * F.col("cut.m")))
    return p.withColumn("p", value).withColumn("raised", raised).drop("share", "m", "lost", "fits", "cut")


def collected(
    gauss: list | None, levels: list | None, p: int, q: int, n_levels: int, total: float, c_bound: float, c_qual: float, univariate: bool
) -> Params:
    """Parameters from the collected statistics of one run's clusters 1..r (a row a cluster)."""
    rows = gauss or []
    order = sorted(r["k"] for r in rows) if rows else sorted({r["k"] for r in levels})
    at = {k: i for i, k in enumerate(order)}
    r = len(order)
    mass = np.zeros(r)
    mean, cov, raw = np.zeros((r, p)), np.zeros((r, p, p)), np.zeros(r)
    bound, floored = np.zeros(r, bool), np.zeros(r, bool)
    prob = np.zeros((r, q, n_levels))
    for row in rows:
        k = at[row["k"]]
        mass[k] = row["w"]
        for i in range(p):
            mean[k, i] = row[f"m_{i}"]
            for j in range(i, p):
                cov[k, i, j] = cov[k, j, i] = row[f"s_{i}_{j}"]
    if p and univariate:
        least = linalg.least_sd(c_bound)
        raw = np.maximum(cov[:, 0, 0], 0)
        bound = np.sqrt(raw) < least
        cov[:, 0, 0] = np.maximum(raw, least * least)
    elif p:
        for k in range(r):
            cov[k], bound[k] = linalg.bounded_covariance(cov[k], mass[k], c_bound)
    for row in levels or []:
        if row["code"] is not None:
            prob[at[row["k"]], row["col"], row["code"]] += row["n"]
    if q:
        if not rows:
            mass = prob[:, 0].sum(1)
        for k in range(r):
            for j in range(q):
                prob[k, j], low = linalg.floored_probabilities(prob[k, j], 0.0 if math.isinf(c_qual) else 1.0 / c_qual)
                floored[k] |= low
    return Params(mass / total, mean, cov, raw, prob, bound, floored)
