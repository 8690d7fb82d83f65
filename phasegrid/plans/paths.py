"""Fits over tasks for tables small enough to send whole to a task.

A task is one path along lambda at one density bound: fixed rows or a bootstrap sample, forward or backward. Paths are
independent, so each is a row of a DataFrame and runs inside ``applyInPandas`` on numpy kernels, with the observations
broadcast behind a check of their size; larger tables take ``plans.descent``. Results are one row a task and lambda.
"""

from __future__ import annotations

import hashlib
import math
from dataclasses import dataclass, field

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import kernels, linalg
from phasegrid.functions.kernels import Table
from phasegrid.plans import checkpoints

#: Most bytes of observations that may be broadcast to tasks.
BROADCAST_LIMIT = 256 << 20

TASKS = "c double, task_type string, task_idx int, forward boolean, seed bigint"
FITS = (
    "c double, task_type string, task_idx int, direction string, lambda double, origin string, h double, h_raw double, a double, b double,"
    " h_class double, h_cond double, reo int, k_fit int, sat double, n_sat_clusters int, labels array<int>"
)


@dataclass
class Settings:
    lambdas: list[float]
    bounds: list[float]
    fixed: int = 5
    boot: int = 5
    shots: int = 10
    warm_shots: int = 5
    clusters: int | None = None
    c_qual: float = math.inf
    loops: int = 300
    seed: int = 1
    metric: str = "match"
    stability: str = "pairwise"  # or "reference"
    extra: dict = field(default_factory=dict)


def local_table(df: DataFrame, xs: list[str], codes: list[str], levels: int, id_col: str, univariate: bool = False) -> tuple[Table, np.ndarray]:
    """The observations on the driver, ordered by id, after a check of their size."""
    size = df.count() * 8 * (len(xs) + len(codes) + 1)
    if size > BROADCAST_LIMIT:
        raise ValueError(f"{size} bytes of observations exceed the {BROADCAST_LIMIT} that tasks may hold; use plans.descent")
    pdf = df.select(id_col, *xs, *codes).orderBy(id_col).toPandas()
    x = pdf[xs].to_numpy(float) if xs else np.empty((len(pdf), 0))
    c = pdf[codes].to_numpy(np.int64) if codes else np.empty((0, 0), np.int64)
    return Table(x, c, levels, univariate and len(xs) == 1), pdf[id_col].to_numpy()


def task_seed(*parts: object) -> int:
    """A seed from all that names a task, so no two share a stream."""
    return int.from_bytes(hashlib.sha256("|".join(map(str, parts)).encode()).digest()[:7], "big")


def tasks(spark: SparkSession, s: Settings, bounds: list[float] | None = None) -> DataFrame:
    """Task table: fixed 1..k and bootstrap 1..B at each bound; odd ones run forward."""
    rows = [
        (float(c), kind, i, i % 2 == 1, task_seed(s.seed, c, kind, i))
        for c in (bounds or s.bounds)
        for kind, n in (("fixed", s.fixed), ("boot", s.boot))
        for i in range(1, n + 1)
    ]
    return spark.createDataFrame(rows, TASKS)


def pending(all_tasks: DataFrame, finished: DataFrame) -> DataFrame:
    """Tasks without results yet: an anti join on what names a task."""
    return all_tasks.join(finished.select("c", "task_type", "task_idx").distinct(), ["c", "task_type", "task_idx"], "left_anti")


def run_path(t: Table, s: Settings, c: float, kind: str, idx: int, forward: bool, seed: int) -> pd.DataFrame:
    """One task's results."""
    rng = np.random.default_rng(seed)
    w = np.bincount(rng.integers(0, t.n, t.n), minlength=t.n).astype(float) if kind == "boot" else None
    fits = kernels.lambda_path(t, s.lambdas, c, rng, forward, s.shots, s.warm_shots, s.clusters, s.c_qual, s.loops, w)
    rows = []
    for lam, fit in fits.items():
        shown = kernels.project(t, fit, c, s.c_qual) if kind == "boot" else fit
        sat, n_sat = kernels.saturation(shown.params)
        rows.append(
            (c, kind, idx, "forward" if forward else "backward", lam, fit.origin, shown.h, fit.h, shown.a, shown.b, shown.a, shown.b / lam, shown.reo, fit.reo, sat, n_sat, (shown.labels + 1).astype(np.int32))
        )
    return pd.DataFrame(rows, columns=[f.split()[0] for f in FITS.split(",")])


def fit_paths(spark: SparkSession, t: Table, s: Settings, todo: DataFrame) -> DataFrame:
    """Results of tasks, each in its own Spark task."""
    shared = spark.sparkContext.broadcast(t)

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        parts = [run_path(shared.value, s, r.c, r.task_type, int(r.task_idx), bool(r.forward), int(r.seed)) for r in pdf.itertuples()]
        return pd.concat(parts)

    n = max(1, s.fixed + s.boot) * max(1, len(s.bounds))
    return todo.repartition(n, "c", "task_type", "task_idx").groupBy("c", "task_type", "task_idx").applyInPandas(work, FITS)


def stability_of(labels: list[np.ndarray], h: list[float], metric: str, mode: str) -> float:
    """Mean similarity: of all pairs, or to the labelling of least objective (itself included)."""
    if not labels:
        return math.nan
    if mode == "pairwise":
        if len(labels) == 1:
            return 1.0
        return float(np.mean([linalg.similarity(labels[i], labels[j], metric) for i in range(len(labels)) for j in range(i)]))
    valid = [i for i, v in enumerate(h) if math.isfinite(v)]
    if not valid:
        return math.nan
    ref = min(valid, key=lambda i: h[i])
    return float(np.mean([linalg.similarity(labels[ref], labels[i], metric) for i in valid]))


def lambda_summary(fits: DataFrame, s: Settings) -> DataFrame:
    """One row a cell: stability of fixed and bootstrap runs, their ratio, and the best run's partition and parameters' share.

    ``c, lambda, stab_algo, stab_boot, rsi, h, a, b, reo, k_hat, sat, n_sat_clusters, run, labels``; a group holds the few
    runs of a cell.
    """
    schema = "c double, lambda double, stab_algo double, stab_boot double, rsi double, h double, a double, b double, reo int, k_hat int, sat double, n_sat_clusters int, any_bound_saturation boolean, run string, labels array<int>"

    def work(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["task_type", "task_idx"], kind="stable")
        part = lambda kind: pdf[pdf["task_type"] == kind]
        stab = {k: stability_of([np.asarray(x) for x in part(k)["labels"]], list(part(k)["h"]), s.metric, s.stability) for k in ("fixed", "boot")}
        own = part("fixed") if len(part("fixed")) else pdf
        best = own.loc[own["h"].idxmin()]
        rsi = stab["boot"] / stab["fixed"] if stab["fixed"] else math.nan
        row = (best["c"], best["lambda"], stab["fixed"], stab["boot"], rsi, best["h"], best["a"], best["b"], int(best["reo"]), int(best["reo"]), best["sat"], int(best["n_sat_clusters"]), bool(best["n_sat_clusters"]), f"{best['c']}:{best['task_type']}:{best['task_idx']}:{best['lambda']}", best["labels"])
        return pd.DataFrame([row], columns=[f.split()[0] for f in schema.split(", ")])

    return fits.groupBy("c", "lambda").applyInPandas(work, schema)


def checkpointed(spark: SparkSession, t: Table, s: Settings, path: str) -> DataFrame:
    """Results of all tasks, kept in a folder: a second call runs only the tasks without results there.

    The folder names the data and settings it is for (``checkpoints``); others raise instead of taking its results.
    """
    checkpoints.prepare(spark, path, checkpoints.task_meta(t, s))
    every = tasks(spark, s)
    try:
        done = spark.read.schema(FITS).parquet(f"{path}/fits")
        done.limit(1).count()
    except Exception as e:  # nothing written yet
        if "PATH_NOT_FOUND" not in str(e):
            raise
        done = spark.createDataFrame([], FITS)
    checkpoints.validate_lengths(done, t.n)
    todo = pending(every, done)
    if not todo.isEmpty():
        fit_paths(spark, t, s, todo).write.mode("append").parquet(f"{path}/fits")
    return spark.read.schema(FITS).parquet(f"{path}/fits")


def candidates(fits: DataFrame) -> DataFrame:
    """Fits as candidates for the best of a cell."""
    return fits.select("c", "lambda", F.col("task_type").alias("source"), F.col("task_idx").alias("idx"), "h", "a", "b", "reo", "labels")
