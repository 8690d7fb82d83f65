"""Assigning and completing new rows by a fitted model, with whatever columns they have."""

from __future__ import annotations

import itertools

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import expressions as ex
from phasegrid.functions.kernels import Params


def _marginal(params: Params, keep: list[int]) -> Params:
    return Params(params.nu, params.mean[:, keep], params.cov[:, keep][:, :, keep], params.raw_var, params.prob, params.density_bound, params.floor_bound)


def classify(df: DataFrame, params: Params, xs: list[str], codes: list[str], lam: float, observed_x: list[int], observed_c: list[int], name: str = "cluster") -> DataFrame:
    """Cluster of each row by the columns at the observed positions alone (the marginal model)."""
    sub = _marginal(params, observed_x)
    sub.prob = params.prob[:, observed_c] if params.prob.size else params.prob
    return df.withColumn(name, ex.label(sub, [F.col(xs[i]) for i in observed_x], [F.col(codes[j]) for j in observed_c], lam))


def _by_cluster(values: list, cluster: Column) -> Column:
    return F.element_at(F.array(*[v if isinstance(v, Column) else F.lit(v) for v in values]), cluster)


def conditional_mean(params: Params, k: int, xs: list[str], missing: int, observed: list[int]) -> Column:
    """Mean of one numeric column given the observed ones, under cluster k's normal distribution."""
    mean, cov = params.mean[k], params.cov[k]
    out = F.lit(float(mean[missing]))
    if observed:
        slope = np.linalg.solve(cov[np.ix_(observed, observed)], cov[observed, missing])
        for i, b in zip(observed, slope):
            out = out + F.lit(float(b)) * (F.col(xs[i]) - F.lit(float(mean[i])))
    return out


def impute(df: DataFrame, params: Params, xs: list[str], codes: list[str], lam: float, hide_x: list[int], hide_c: list[int] = ()) -> DataFrame:
    """Adds ``cluster`` and a column ``pred_<name>`` for each hidden one.

    The cluster comes from the other columns; numbers are conditional means (the cluster's mean when no number is left),
    categories the cluster's most likely level (the first of equals).
    """
    seen_x = [i for i in range(len(xs)) if i not in hide_x]
    seen_c = [j for j in range(len(codes)) if j not in hide_c]
    if seen_x or seen_c:
        df = classify(df, params, xs, codes, lam, seen_x, seen_c)
    else:
        df = df.withColumn("cluster", F.lit(int(np.argmax(params.nu)) + 1))
    at = F.col("cluster")
    for i in hide_x:
        df = df.withColumn(f"pred_{xs[i]}", _by_cluster([conditional_mean(params, k, xs, i, seen_x) for k in range(params.r)], at))
    for j in hide_c:
        df = df.withColumn(f"pred_{codes[j]}", _by_cluster([int(np.argmax(params.prob[k, j])) for k in range(params.r)], at))
    return df


def impute_missing(df: DataFrame, params: Params, xs: list[str], codes: list[str], lam: float) -> DataFrame:
    """Fills null cells row by row: ``cluster`` and all columns completed. One branch for each pattern of nulls in use."""
    columns = [*xs, *codes]
    mask = F.concat(*[F.when(F.col(c).isNull(), "1").otherwise("0") for c in columns])
    patterns = [r[0] for r in df.select(mask.alias("m")).distinct().collect()]  # at most two to the number of columns
    parts = []
    for pattern in patterns:
        hidden = [m == "1" for m in pattern]
        hx = [i for i in range(len(xs)) if hidden[i]]
        hc = [j for j in range(len(codes)) if hidden[len(xs) + j]]
        part = impute(df.where(mask == pattern), params, xs, codes, lam, hx, hc)
        for c in itertools.chain((xs[i] for i in hx), (codes[j] for j in hc)):
            part = part.withColumn(c, F.col(f"pred_{c}").cast(df.schema[c].dataType)).drop(f"pred_{c}")
        parts.append(part.select(*df.columns, "cluster"))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out
