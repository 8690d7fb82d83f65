"""Comparing partitions: contingency, adjusted Rand, one-to-one matching, stability over runs, relabelling."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.functions import linalg


def contingency(df: DataFrame, x: str, y: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., x, y, n``: rows with each pair of labels. One shuffle of pre-aggregated counts."""
    return df.groupBy(*by, F.col(x).alias("x"), F.col(y).alias("y")).agg(F.count("*").alias("n"))


def ari_of(table: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """``by..., ari`` of contingency tables; 1 where the index isn't defined (one row, or two trivial partitions)."""
    pairs = lambda c: F.sum(c.cast("double") * (c.cast("double") - 1) / 2)
    n = F.col("n")
    total = table.groupBy(*by).agg(F.sum("n").cast("double").alias("rows"), pairs(n).alias("both"))
    rows = table.groupBy(*by, "x").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(n).alias("px"))
    cols = table.groupBy(*by, "y").agg(F.sum("n").alias("n")).groupBy(*by).agg(pairs(n).alias("py"))
    joined = total.join(rows, list(by)).join(cols, list(by)) if by else total.crossJoin(rows).crossJoin(cols)  # one row each
    every = F.col("rows") * (F.col("rows") - 1) / 2
    expected = F.col("px") * F.col("py") / F.when(every > 0, every)
    gap = (F.col("px") + F.col("py")) / 2 - expected
    value = F.when(gap != 0, (F.col("both") - expected) / F.when(gap != 0, gap)).otherwise(F.lit(1.0))
    return joined.select(*by, F.coalesce(value, F.lit(1.0)).alias("ari"))


def match_of(table: DataFrame, by: Sequence[str]) -> DataFrame:
    """``by..., match``: share of rows that agree under the best one-to-one renaming. A table a group, so a few numbers."""
    fields = ", ".join(f"{f.name} {f.dataType.simpleString()}" for f in table.schema if f.name in by)

    def solve(pdf: pd.DataFrame) -> pd.DataFrame:
        t = pdf.pivot_table(index="x", columns="y", values="n", fill_value=0, aggfunc="sum").to_numpy(float)
        out = pdf.iloc[:1][list(by)].copy()
        out["match"] = linalg.matched_count(t) / t.sum()
        return out

    return table.groupBy(*by).applyInPandas(solve, f"{fields}, match double")


def similarity(df: DataFrame, x: str, y: str, metric: str = "match") -> DataFrame:
    """One row ``similarity, distance`` of two label columns."""
    table = contingency(df, x, y).withColumn("g", F.lit(0))
    value = match_of(table, ["g"]).select(F.col("match").alias("similarity")) if metric == "match" else ari_of(table).select(F.col("ari").alias("similarity"))
    return value.withColumn("distance", 1 - F.col("similarity"))


def pairwise(df: DataFrame, labels: Sequence[str], metric: str = "ari", by: Sequence[str] = ()) -> DataFrame:
    """``by..., a, b, similarity`` for every two label columns, a < b by position; all tables in one aggregate."""
    pairs = [(i, j) for i in range(len(labels)) for j in range(i + 1, len(labels))]
    text = lambda i: F.col(labels[i]).cast("string")
    each = F.explode(F.array(*[F.struct(F.lit(i).alias("a"), F.lit(j).alias("b"), text(i).alias("x"), text(j).alias("y")) for i, j in pairs]))
    rows = df.select(*by, each.alias("p")).select(*by, "p.*")
    keys = [*by, "a", "b"]
    table = rows.groupBy(*keys, "x", "y").agg(F.count("*").alias("n"))
    return ari_of(table, keys).withColumnRenamed("ari", "similarity") if metric == "ari" else match_of(table, keys).withColumnRenamed("match", "similarity")


def stability(similarities: DataFrame, runs: int, by: Sequence[str] = ()) -> DataFrame:
    """Mean, sd, median, least and largest similarity of pairs, and the medoid run (largest mean, its own 1 included)."""
    s = F.col("similarity")
    sides = similarities.select(*by, F.explode(F.array("a", "b")).alias("run"), "similarity")
    mean = sides.groupBy(*by, "run").agg(((F.sum(s) + 1) / runs).alias("mean"))
    medoid = mean.groupBy(*by).agg(F.min_by("run", F.struct(-F.col("mean"), F.col("run"))).alias("medoid"))
    stats = similarities.groupBy(*by).agg(
        F.avg(s).alias("mean"), F.stddev_samp(s).alias("sd"), F.median(s).alias("median"), F.min(s).alias("min"), F.max(s).alias("max")
    )
    return stats.join(medoid, list(by)) if by else stats.crossJoin(medoid)  # one row each


def reference_stability(df: DataFrame, labels: Sequence[str], objective: Sequence[float | None], metric: str = "ari") -> DataFrame:
    """Similarity of every run to the one of least finite objective, that one (1) included: ``ref, n, mean, sd, min, max``."""
    valid = [i for i, h in enumerate(objective) if h is not None and np.isfinite(h)]
    ref = min(valid, key=lambda i: (objective[i], i))
    order = [ref, *(i for i in valid if i != ref)]
    pairs = pairwise(df, [labels[i] for i in order], metric).where("a = 0").select("similarity")
    one = df.sparkSession.range(1).select(F.lit(1.0).alias("similarity"))
    s = F.col("similarity")
    return pairs.unionByName(one).agg(
        F.lit(ref).alias("ref"), F.count("*").alias("n"), F.avg(s).alias("mean"), F.coalesce(F.stddev_samp(s), F.lit(0.0)).alias("sd"), F.min(s).alias("min"), F.max(s).alias("max")
    )


def weights(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., label, n, nu``."""
    counts = df.groupBy(*by, label).agg(F.count("*").alias("n"))
    return counts.withColumn("nu", F.col("n") / F.sum("n").over(Window.partitionBy(*by)))


def relabelled_by_weight(df: DataFrame, label: str, by: Sequence[str] = ()) -> DataFrame:
    """``by..., label, n, nu, new_label``: 1.. by falling weight, ties by label."""
    order = Window.partitionBy(*by).orderBy(F.col("n").desc(), label)
    return weights(df, label, by).withColumn("new_label", F.row_number().over(order))


def relabelled_to_reference(df: DataFrame, label: str, reference: str) -> list[tuple]:
    """(label, new label) by optimal matching to a reference's integer labels; those left over get new numbers above."""
    rows = contingency(df, label, reference).collect()
    xs, ys = sorted({r["x"] for r in rows}), sorted({r["y"] for r in rows})
    t = np.zeros((len(xs), len(ys)))
    for r in rows:
        t[xs.index(r["x"]), ys.index(r["y"])] = r["n"]
    out, next_label = [], max(ys) + 1
    for x, j in zip(xs, linalg.assignment(t)):
        if j >= 0 and t[xs.index(x), j] > 0:
            out.append((x, ys[j]))
        else:
            out.append((x, next_label))
            next_label += 1
    return out


def compressed(df: DataFrame, label: str) -> Column:
    """Labels renumbered 1.. without gaps, as a literal map from the few labels there are."""
    found = [r[0] for r in df.select(label).distinct().orderBy(label).collect()]
    return F.create_map(*[F.lit(v) for k, x in enumerate(found) for v in (x, k + 1)])[F.col(label)]


def path_distance(path: dict[float, str], others: dict[int, str], df: DataFrame) -> list[tuple[float, int, float | None]]:
    """(lambda, clusters, match distance) of each weight's label column to the outside one with as many clusters, if any."""
    counts = df.agg(*[F.count_distinct(c).alias(c) for c in set(path.values())]).first()
    out = []
    for lam, c in sorted(path.items()):
        k = counts[c]
        other = others.get(k)
        out.append((lam, k, None if other is None else similarity(df, c, other).first()["distance"]))
    return out
