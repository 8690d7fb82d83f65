"""Descents on tables of any size, many runs in lock step.

A run's labels are a function of its few parameters, so an iteration is one pass over the (cached) observations: labels
of all active runs as literal-coefficient expressions, then one aggregate by (run, cluster). The driver sees one row a
cluster and run; observations never move and no lineage grows. Runs stop when only one cluster is left, when a
fingerprint of their labels returns, or after ``loops`` iterations, and then cost nothing more.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import expressions as ex
from phasegrid.functions.kernels import Params
from phasegrid.operators import mstep


#: Most level counts that are computed as columns of one aggregate.
FEW_LEVELS = 64


@dataclass
class Spec:
    """Which columns take part: numeric ``xs``, integer codes ``codes`` (from 0, ``levels`` in all), a unique ``id``."""

    xs: list[str] = field(default_factory=list)
    codes: list[str] = field(default_factory=list)
    levels: int = 0
    id: str = "id"
    univariate: bool = False

    @property
    def family(self) -> str:
        if self.xs and self.codes:
            return "mixed"
        return "discrete" if self.codes else "gauss1" if self.univariate else "gauss"


@dataclass
class Run:
    """One descent: its settings, its starting labels (a column, from 1) and, once run, its parameters."""

    name: str
    lam: float
    c_bound: float
    start: Column
    c_qual: float = math.inf
    params: Params | None = None
    a: float = math.nan
    b: float = math.nan
    iterations: int = 0
    done: bool = False
    seen: set = field(default_factory=set)

    @property
    def h(self) -> float:
        return self.a + self.b / self.lam


def _labels(run: Run, spec: Spec) -> Column:
    if run.params is None:
        return run.start
    return ex.label(run.params, [F.col(x) for x in spec.xs], [F.col(c) for c in spec.codes], run.lam)


def _step(obs: DataFrame, spec: Spec, runs: list[Run], weight: str | None, total: float) -> None:
    """Parameters of every run from its current labels; finished runs are marked."""
    tagged = F.explode(F.array(*[F.struct(F.lit(i).alias("run"), _labels(r, spec).alias("k")) for i, r in enumerate(runs)]))
    columns = [*spec.xs, *spec.codes, spec.id, *([weight] if weight else [])]
    rows = obs.select(*columns, tagged.alias("t")).select(*columns, F.col("t.run").alias("run"), F.col("t.k").alias("k"))
    # One job: statistics, level counts (if there are few levels) and a fingerprint of the labels.
    few = len(spec.codes) * spec.levels <= FEW_LEVELS
    extra = [F.expr(f"bit_xor(xxhash64({spec.id}, k))").alias("mark")]
    extra += mstep.level_sums(spec.codes, spec.levels, weight) if few else []
    gauss = mstep.gaussian_stats(rows, ["run", "k"], spec.xs, weight, extra).collect()
    if few:
        levels = [
            {"run": g["run"], "k": g["k"], "col": j, "code": v, "n": g[f"c_{j}_{v}"]}
            for g in gauss
            for j in range(len(spec.codes))
            for v in range(spec.levels)
        ]
    else:
        levels = mstep.level_counts(rows, ["run", "k"], spec.codes, weight).collect()
    mark: dict[int, int] = {}
    for g in gauss:
        mark[g["run"]] = mark.get(g["run"], 0) ^ g["mark"]
    for i, r in enumerate(runs):
        own = [g for g in gauss if g["run"] == i]
        own_levels = [x for x in levels if x["run"] == i]
        r.params = mstep.collected(
            own, own_levels, len(spec.xs), len(spec.codes), spec.levels, total, r.c_bound, r.c_qual, spec.univariate
        )
        r.iterations += 1
        if r.params.r == 1 or mark[i] in r.seen:
            r.done = True
        r.seen.add(mark[i])


def descend(obs: DataFrame, spec: Spec, runs: list[Run], loops: int = 300, weight: str | None = None) -> list[Run]:
    """Run all descents to their end; ``loops`` counts assignment steps."""
    total = float(obs.agg(F.sum(weight) if weight else F.count("*")).first()[0] or 0)
    if not total:
        return runs
    _step(obs, spec, runs, weight, total)
    for _ in range(loops):
        active = [r for r in runs if not r.done]
        if not active:
            break
        _step(obs, spec, active, weight, total)
    return runs


def objective(obs: DataFrame, spec: Spec, runs: list[Run], weight: str | None = None) -> list[Run]:
    """Fill in (a, b) of finished runs: the objective at any weight lambda is a + b / lambda. One pass for all runs."""
    xs, codes = [F.col(x) for x in spec.xs], [F.col(c) for c in spec.codes]
    w = F.col(weight) if weight else F.lit(1.0)
    aggs = []
    for i, r in enumerate(runs):
        dens = ex.log_densities(r.params, xs, codes)
        own = ex.picked(dens, ex.label(r.params, xs, codes, r.lam))
        aggs.append((-F.sum(w * own) / F.sum(w)).alias(f"b_{i}"))
    row = obs.agg(*aggs).first()
    for i, r in enumerate(runs):
        nu = r.params.nu[r.params.nu > 0]
        r.a, r.b = float(-(nu * [math.log(v) for v in nu]).sum()), float(row[f"b_{i}"])
    return runs


def labelled(obs: DataFrame, spec: Spec, run: Run, name: str = "cluster") -> DataFrame:
    """The observations with a run's final labels."""
    return obs.withColumn(name, _labels(run, spec))


def random_start(spec: Spec, clusters: int, seed: int) -> Column:
    """Uniform labels 1..clusters from a hash of the row's id: the same whenever the plan runs again."""
    u = F.pmod(F.xxhash64(F.col(spec.id), F.lit(seed)), F.lit(clusters))
    return (u + 1).cast("int")


def fit(
    obs: DataFrame,
    spec: Spec,
    lam: float,
    c_bound: float,
    shots: int = 10,
    clusters: int | None = None,
    c_qual: float = math.inf,
    loops: int = 100,
    seed: int = 1,
) -> Run:
    """Best of ``shots`` independent descents from random labels; the first of equals."""
    obs = obs.select(spec.id, *spec.xs, *spec.codes).persist()
    try:
        n = obs.count()
        r0 = clusters or int(math.floor(math.log(max(n, 1)) + 1))
        runs = [Run(f"shot{i}", lam, c_bound, random_start(spec, r0, seed * 7919 + i), c_qual) for i in range(shots)]
        objective(obs, spec, descend(obs, spec, runs, loops))
        valid = [r for r in runs if math.isfinite(r.h)]
        return min(valid, key=lambda r: r.h)
    finally:
        obs.unpersist()


def params_table(spark, runs: list[Run]) -> DataFrame:
    """Parameters of runs as a table: ``run, k, nu, mean, cov, density_bound, floor_bound``."""
    rows = [
        (r.name, k + 1, float(p.nu[k]), p.mean[k].tolist(), p.cov[k].ravel().tolist(), bool(p.density_bound[k]), bool(p.floor_bound[k]))
        for r in runs
        for p in [r.params]
        for k in range(p.r)
    ]
    return spark.createDataFrame(
        rows, "run string, k int, nu double, mean array<double>, cov array<double>, density_bound boolean, floor_bound boolean"
    )
