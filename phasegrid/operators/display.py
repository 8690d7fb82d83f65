"""The tables behind pictures: histograms, level shares, principal axes, coordinates by cluster, paths."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def histogram(df: DataFrame, value: str, bins: int, by: Sequence[str] = (), low: float | None = None, high: float | None = None) -> DataFrame:
    """``by..., bin, low, high, n`` with equal bins 1..bins over the range; the largest value is in the last bin."""
    if low is None or high is None:
        low, high = df.agg(F.min(value), F.max(value)).first()
    width = (high - low) / bins or 1.0
    at = F.least(F.floor((F.col(value) - F.lit(low)) / F.lit(width)) + 1, F.lit(bins)).cast("int")
    counts = df.where(F.col(value).between(low, high)).groupBy(*by, at.alias("bin")).agg(F.count("*").alias("n"))
    return counts.withColumn("low", F.lit(low) + (F.col("bin") - 1) * width).withColumn("high", F.lit(low) + F.col("bin") * width)


def level_shares(df: DataFrame, level: str, cluster: str) -> DataFrame:
    """``level, cluster, n, percent`` of every level in every cluster, zeros included."""
    n = df.groupBy(F.col(level).alias("level"), F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    levels, clusters = n.select("level").distinct(), n.select("cluster").distinct()
    full = levels.crossJoin(F.broadcast(clusters)).join(n, ["level", "cluster"], "left").fillna(0, ["n"])  # levels x clusters
    share = F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy("cluster"))
    return full.withColumn("percent", share)


def cluster_shares(df: DataFrame, cluster: str) -> DataFrame:
    """``cluster, n, percent``."""
    n = df.groupBy(F.col(cluster).alias("cluster")).agg(F.count("*").alias("n"))
    return n.withColumn("percent", F.lit(100.0) * F.col("n") / F.sum("n").over(Window.partitionBy()))


def principal_axes(df: DataFrame, columns: Sequence[str], scale: bool = True) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(means, sds, axes as columns by falling variance) from one aggregate; an axis's largest entry is positive."""
    p = len(columns)
    pairs = [(i, j) for i in range(p) for j in range(i, p)]
    row = df.na.drop(subset=list(columns)).agg(
        *[F.avg(c).alias(f"m{i}") for i, c in enumerate(columns)],
        *[F.covar_samp(F.col(columns[i]), F.col(columns[j])).alias(f"s{i}_{j}") for i, j in pairs],
    ).first()
    mean = np.array([row[f"m{i}"] for i in range(p)], float)
    cov = np.zeros((p, p))
    for i, j in pairs:
        cov[i, j] = cov[j, i] = row[f"s{i}_{j}"]
    sd = np.sqrt(np.diag(cov)) if scale else np.ones(p)
    sd[sd == 0] = 1.0
    values, vectors = np.linalg.eigh(cov / np.outer(sd, sd))
    vectors = vectors[:, np.argsort(-values, kind="stable")]
    signs = np.sign(vectors[np.abs(vectors).argmax(0), np.arange(p)])
    return mean, sd, vectors * np.where(signs == 0, 1, signs)


def principal_scores(df: DataFrame, columns: Sequence[str], k: int = 2, scale: bool = True) -> DataFrame:
    """Adds ``pc1..pck``: centred (and scaled) values on the axes; null where a column is null."""
    mean, sd, axes = principal_axes(df, columns, scale)
    for a in range(k):
        score = F.lit(0.0)
        for i, c in enumerate(columns):
            score = score + F.lit(float(axes[i, a] / sd[i])) * (F.col(c) - F.lit(float(mean[i])))
        df = df.withColumn(f"pc{a + 1}", score)
    return df


def partition_path(df: DataFrame, columns: Sequence[str], labels: dict[float, str]) -> DataFrame:
    """Long table ``pc1, pc2, lambda, cluster`` of the label columns of several weights."""
    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("lambda"), F.col(c).alias("cluster")) for v, c in labels.items()]))
    return principal_scores(df, columns).select("pc1", "pc2", each.alias("e")).select("pc1", "pc2", "e.*")


def numeric_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("double", "float", "int", "bigint", "smallint", "tinyint") or t.startswith("decimal")]


def categorical_columns(df: DataFrame) -> list[str]:
    return [n for n, t in df.dtypes if t in ("string", "boolean")]


def evolution_1d(df: DataFrame, z: str, labels: dict[float, str], subset: Sequence[float] | None = None) -> DataFrame:
    """Long table ``lambda, z, cluster`` of several weights' labels, each renamed to match the weight before.

    With ``subset``, other weights show the last chosen one at or below them.
    """
    from phasegrid.operators import compare

    order = sorted(labels)
    shown = {v: max((u for u in subset if u <= v), default=min(subset)) if subset else v for v in order}
    last = None
    for v in order:
        c = labels[v]
        if last is None:
            df = df.withColumn(f"_e{order.index(v)}", F.col(c).cast("int"))
        else:
            names = compare.relabelled_to_reference(df, c, last)
            mapped = F.create_map(*[F.lit(x) for pair in names for x in pair])[F.col(c)]
            df = df.withColumn(f"_e{order.index(v)}", mapped.cast("int"))
        last = f"_e{order.index(v)}"
    each = [F.struct(F.lit(float(v)).alias("lambda"), F.col(f"_e{order.index(shown[v])}").alias("cluster")) for v in order]
    return df.select(F.col(z).alias("z"), F.explode(F.array(*each)).alias("e")).select("e.lambda", "z", "e.cluster")


def display_data(*candidates: DataFrame | None) -> DataFrame:
    """The first table there is to show: the one kept for display, else the observations; a single column is named ``Z``."""
    for df in candidates:
        if df is not None:
            return df.toDF("Z") if len(df.columns) == 1 else df
    raise ValueError("no table to show")


def display_choices(df: DataFrame) -> list[str]:
    """The variables that can be shown: two principal axes if there are two numbers or more, then the numbers."""
    numbers = numeric_columns(df)
    return (["PCA1", "PCA2"] if len(numbers) > 1 else []) + numbers


def display_vector(df: DataFrame, name: str) -> DataFrame:
    """The table with ``shown``, the variable of that name: an axis, a column, or nulls if there is none."""
    numbers = numeric_columns(df)
    if name in ("PCA1", "PCA2") and len(numbers) > 1:
        return principal_scores(df, numbers, 2).withColumn("shown", F.col("pc" + name[-1])).drop("pc1", "pc2")
    return df.withColumn("shown", F.col(f"`{name}`") if name in df.columns else F.lit(None).cast("double"))


def lambda_key(c: Column) -> Column:
    """A weight as a key: up to twelve significant digits, without zeros at the end."""
    return _significant(c, 12)


def lambda_label(c: Column) -> Column:
    """A weight as a title, with four significant digits."""
    return F.concat(F.lit("lambda = "), _significant(c, 4))


def _significant(c: Column, digits: int) -> Column:
    places = F.when(c == 0, 0).otherwise(digits - 1 - F.floor(F.log10(F.abs(c))).cast("int"))
    scale = F.pow(F.lit(10.0), places)
    text = F.format_string(f"%.{2 * digits}f", F.round(c * scale) / scale)
    text = F.format_string(f"%.{digits + 6}f", text.cast("double"))
    return F.regexp_replace(F.regexp_replace(text, "(\\.[0-9]*?)0+$", "$1"), "\\.$", "")


def valid_partitions(best: DataFrame, n: int, labels: str = "labels") -> DataFrame:
    """Cells whose partition is of n rows, with their ``key``; raises if there is none."""
    rows = best.where(F.size(labels) == n).withColumn("key", lambda_key(F.col("lambda")))
    if rows.isEmpty():
        raise ValueError(f"no partition has {n} rows")
    return rows


def selected_partitions(best: DataFrame, keys: Sequence[str] | None = None) -> DataFrame:
    """The cells of the keys given, all without any."""
    return best if keys is None else best.where(lambda_key(F.col("lambda")).isin(list(keys)))


def default_lambda_key(best: DataFrame) -> str | None:
    """The key of the smallest weight."""
    return best.agg(lambda_key(F.min("lambda"))).first()[0]


def component_means(params: DataFrame, columns: Sequence[str], name: str) -> DataFrame:
    """``run, k, mean`` of one variable of a parameter table; the only one if there is one; nothing for an unknown name."""
    if len(columns) > 1 and name not in columns:
        return params.where("false").select("run", "k", F.lit(None).cast("double").alias("mean"))
    at = columns.index(name) if name in columns else 0
    return params.select("run", "k", F.col("mean")[at].alias("mean"))


def sorted_labels(df: DataFrame, label: str) -> DataFrame:
    """``label, position`` of the distinct labels: as numbers if all are, else as strings. A row a label."""
    d = df.where(F.col(label).isNotNull()).select(F.col(label).cast("string").alias("label")).distinct()
    number = F.expr("try_cast(label AS double)")
    numeric = F.min(number.isNotNull()).over(Window.partitionBy())
    d = d.select("label", F.when(numeric, number).alias("_n"))
    return d.select("label", F.row_number().over(Window.orderBy("_n", "label")).alias("position"))


def cluster_levels(best: DataFrame, labels: str = "labels") -> DataFrame:
    """``label, position`` of all labels of the cells' partitions."""
    return sorted_labels(best.select(F.explode(F.array_distinct(labels)).alias("label")), "label")


def single_lambda_clusters(best: DataFrame, labels: str = "labels") -> DataFrame:
    """``label, position`` of the one weight there is; nothing for several."""
    one = best.agg(F.count_distinct("lambda")).first()[0] == 1
    return cluster_levels(best if one else best.where("false"), labels)


def filtered_cluster(df: DataFrame, cluster: object = None, column: str = "cluster") -> DataFrame:
    """The rows of one cluster; all without one."""
    return df if cluster is None else df.where(F.col(column) == F.lit(cluster))


def shown_lambdas(lambdas: Sequence[float], subset: Sequence[float] | None = None, at_most: int = 6) -> list[float]:
    """The weights to draw: of those in the subset, evenly chosen if there are more than ``at_most``."""
    own = [v for v in sorted(lambdas) if subset is None or v in subset]
    if len(own) <= at_most:
        return own
    step = (len(own) - 1) / max(1, at_most - 1)
    return [own[round(i * step)] for i in range(at_most)]


def partition_histograms(df: DataFrame, z: str, labels: dict[float, str], bins: int = 30, subset: Sequence[float] | None = None, at_most: int = 6) -> DataFrame:
    """``lambda, cluster, bin, low, high, n``: histograms by cluster of a column, for the weights to draw."""
    chosen = shown_lambdas(list(labels), subset, at_most)
    if not chosen:
        raise ValueError("no partition to draw")
    each = F.explode(F.array(*[F.struct(F.lit(float(v)).alias("lambda"), F.col(labels[v]).alias("cluster")) for v in chosen]))
    low, high = df.agg(F.min(z), F.max(z)).first()
    return histogram(df.select(F.col(z).alias("z"), each.alias("e")).select("z", "e.*"), "z", bins, ["lambda", "cluster"], low, high)


def best_partitions(obj: DataFrame) -> DataFrame:
    """Best partitions from either a table of them (with ``run``) or of all fits (with ``task_type``), one row a weight."""
    from phasegrid.operators import trajectory

    if "task_type" in obj.columns:
        by = [c for c in ("c", "lambda") if c in obj.columns]
        return trajectory.best_of(obj, by, ties=("task_type", "task_idx"))
    if "labels" in obj.columns and "lambda" in obj.columns:
        return obj
    raise ValueError("neither best partitions nor fits")
