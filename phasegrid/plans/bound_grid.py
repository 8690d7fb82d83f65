"""The phase diagram: fits over bounds and weights, repairs, a last descent, thresholds, zones, and readers of it.

Labels stay in a table by run (``run, labels``): fits, the scores of every run at every bound, last descents and the
similarities of neighbouring cells are tasks. The driver holds one row a cell and (a, b) of each run and bound, on which
repairs are arithmetic (``trajectory``); it fetches the labels of one run where a caller asks for a partition, and those of
the cells that zones compare.
"""

from __future__ import annotations

import math
from dataclasses import dataclass, field, replace

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions import kernels, linalg
from phasegrid.functions.kernels import Table
from phasegrid.operators import cells, diagnose, trajectory
from phasegrid.plans import paths
from phasegrid.plans.paths import Settings

SUMMARY = (
    "c double, c_source double, c_reused boolean, lambda double, reo int, h double, k_hat int, stab_algo double, rsi double, sat double,"
    " n_sat_clusters int, any_bound_saturation boolean, final_descent boolean, repaired boolean, propagated_from_c double,"
    " propagated_from_lambda double, run string"
)
#: Partitions that a grid object remembers on the driver.
REMEMBERED = 64


@dataclass
class Grid:
    """A fitted grid: settings, observations' ids, one row a cell, and the labels (from 1) of each run that a cell names."""

    spark: SparkSession
    settings: Settings
    ids: np.ndarray
    rows: list[dict]
    stop_c: float | None
    repair_log: list[tuple]
    descent_log: list[tuple]
    labels: DataFrame
    known: dict = field(default_factory=dict, repr=False)

    def labels_of(self, run: str) -> np.ndarray:
        """A run's labels, from 1."""
        if run not in self.known:
            while len(self.known) >= REMEMBERED:
                self.known.pop(next(iter(self.known)))
            self.known[run] = np.asarray(self.labels.where(F.col("run") == run).select("labels").first()[0])
        return self.known[run]

    def summary(self, stab: float = 0.8, rsi: float = 0.8, sat: float = 0.1, strict: bool = False) -> DataFrame:
        """All cells with thresholds applied."""
        names = [f.strip().split()[0] for f in SUMMARY.split(",")]
        df = self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], SUMMARY)
        return diagnose.apply_thresholds(df, stab, rsi, sat, strict)

    def cell(self, c: float, lam: float) -> dict:
        """The cell nearest to (c, lambda): nearest bound first, then nearest weight."""
        at_c = min({r["c"] for r in self.rows}, key=lambda v: (abs(v - c), v))
        return min((r for r in self.rows if r["c"] == at_c), key=lambda r: (abs(r["lambda"] - lam), r["lambda"]))

    def partition(self, c: float, lam: float, by_weight: bool = False) -> DataFrame:
        """``id, cluster`` of the nearest cell; ``by_weight`` numbers clusters by falling size."""
        labels = self.labels_of(self.cell(c, lam)["run"])
        if by_weight:
            values, counts = np.unique(labels, return_counts=True)
            order = {v: i + 1 for i, v in enumerate(values[np.lexsort((values, -counts))])}
            labels = np.array([order[v] for v in labels])
        return self.spark.createDataFrame([(int(i), int(k)) for i, k in zip(self.ids, labels)], "id long, cluster int")

    def zones(self, at_least: float = 0.95, **thresholds) -> DataFrame:
        """``c, lambda, zone`` of kept cells."""
        keep = {(r["c"], r["lambda"]): r["keep"] for r in self.summary(**thresholds).select("c", "lambda", "keep").collect()}
        marked = [{**r, "keep": keep[(r["c"], r["lambda"])]} for r in self.rows]
        same = lambda a, b: 1.0 if a["run"] == b["run"] else linalg.similarity(self.labels_of(a["run"]), self.labels_of(b["run"]))
        found = cells.zones(marked, same, at_least)
        return self.spark.createDataFrame([(c, v, z) for (c, v), z in found.items()], "c double, lambda double, zone int")

    def changes(self, at_least: float = 0.8) -> DataFrame:
        """Change flags along lambda at each bound."""
        lines = [sorted((r for r in self.rows if r["c"] == c), key=lambda r: r["lambda"]) for c in sorted({r["c"] for r in self.rows})]
        alike = similarities(self.labels, {(a["run"], b["run"]) for line in lines for a, b in zip(line, line[1:])})
        rows = [
            (r["c"], r["lambda"], r["reo"], None if before is None else alike[before["run"], r["run"]])
            for line in lines
            for before, r in zip([None, *line], line)
        ]
        df = self.spark.createDataFrame(rows, "c double, lambda double, reo int, similarity double")
        return trajectory.change_points(df, at_least=at_least, by=["c"])

    def save(self, path: str) -> None:
        names = [f.strip().split()[0] for f in SUMMARY.split(",")]
        rows = self.spark.createDataFrame([tuple(r[n] for n in names) for r in self.rows], SUMMARY)
        rows.join(self.labels, "run").select(*names, "labels").write.mode("overwrite").parquet(path)


def _kept(df: DataFrame) -> DataFrame:
    """The same rows, computed once: in the shared checkpoint folder if there is one, else kept by the executors."""
    context = df.sparkSession.sparkContext
    shared = context.getConf().get("spark.checkpoint.dir")
    if context.getCheckpointDir() is None and shared:
        context.setCheckpointDir(shared)
    return df.checkpoint() if context.getCheckpointDir() else df.persist()


def similarities(labels: DataFrame, pairs: set[tuple[str, str]]) -> dict[tuple[str, str], float]:
    """Similarity of pairs of runs, computed where their labels meet; 1 for a run and itself."""
    todo = [p for p in pairs if p[0] != p[1]]
    found = {p: 1.0 for p in pairs if p[0] == p[1]}
    if not todo:
        return found

    def work(batches):
        for pdf in batches:
            like = [linalg.similarity(np.asarray(x), np.asarray(y)) for x, y in zip(pdf["lx"], pdf["ly"])]
            yield pd.DataFrame({"x": pdf["x"], "y": pdf["y"], "s": like})

    side = lambda n: labels.select(F.col("run").alias(n), F.col("labels").alias(f"l{n}"))
    both = labels.sparkSession.createDataFrame(todo, "x string, y string").join(side("x"), "x").join(side("y"), "y")
    rows = both.select("x", "y", "lx", "ly").mapInPandas(work, "x string, y string, s double").collect()
    return found | {(r.x, r.y): r.s for r in rows}


def evaluations(t: Table, labels: DataFrame, bounds: list[float], c_qual: float) -> DataFrame:
    """``run, c, a, b``: every run's coefficients at every bound."""
    shared = labels.sparkSession.sparkContext.broadcast(t)

    def work(batches):
        for pdf in batches:
            rows = []
            for run, own in zip(pdf["run"], pdf["labels"]):
                own = np.asarray(own, np.int64) - 1
                for c in bounds:
                    rows.append((run, c, *kernels.coefficients(shared.value, own, kernels.parameters(shared.value, own, c, c_qual))))
            yield pd.DataFrame(rows, columns=["run", "c", "a", "b"])

    return labels.select("run", "labels").mapInPandas(work, "run string, c double, a double, b double")


def last_descents(t: Table, cells_: DataFrame, labels: DataFrame, s: Settings) -> DataFrame:
    """A descent from each cell's own partition (``c, lambda, run, h``), taken where it improves the objective.

    Adds ``h_new, tried, better, reo, sat, n_sat_clusters`` of the partition that the cell ends with, and its labels if they
    are new. A cell is a task.
    """
    shared = cells_.sparkSession.sparkContext.broadcast(t)

    def work(batches):
        for pdf in batches:
            rows = []
            for r in pdf.itertuples(index=False):
                c, lam, run, h, own = r
                own, h_new, new = np.asarray(own, np.int64) - 1, math.nan, None
                if own.max() > 0:
                    fit = kernels.descend(shared.value, own, lam, c, s.c_qual, s.loops)
                    h_new = fit.h
                    if math.isfinite(h_new) and h_new < h - trajectory.TOLERANCE:
                        new = own = fit.labels
                params = kernels.parameters(shared.value, own, c, s.c_qual)
                sat, n_sat = kernels.saturation(params)
                rows.append((c, lam, run, h, h_new, bool(own.max() > 0 or new is not None), new is not None, params.r, sat, n_sat, None if new is None else (new + 1).astype(np.int32)))
            yield pd.DataFrame(rows, columns=[f.split()[0] for f in schema.split(", ")])

    schema = "c double, lambda double, run string, h double, h_new double, tried boolean, better boolean, reo int, sat double, n_sat_clusters int, labels array<int>"
    joined = cells_.select("c", "lambda", "run", "h").join(labels, "run").select("c", "lambda", "run", "h", "labels")
    return joined.repartition("c", "lambda").mapInPandas(work, schema)


def _evaluate(t: Table, labels: np.ndarray, c: float, s: Settings) -> tuple[float, float]:
    return kernels.coefficients(t, labels, kernels.parameters(t, labels, c, s.c_qual))


def fit_lambda_grid(spark: SparkSession, t: Table, s: Settings, c: float) -> DataFrame:
    """Cells of one bound: all paths, then stability and the best partition of each weight."""
    one = replace(s, bounds=[c])
    return paths.lambda_summary(paths.fit_paths(spark, t, one, paths.tasks(spark, one)), one)


def fit_bound_grid(spark: SparkSession, t: Table, ids: np.ndarray, s: Settings, early_stop: bool = True, rounds: int = 20) -> Grid:
    """Fit all cells; bounds above the first without any saturation reuse its results."""
    bounds, lambdas = sorted({round(c, 10) for c in s.bounds}), sorted({round(v, 10) for v in s.lambdas})
    s = replace(s, bounds=bounds, lambdas=lambdas)
    rows: list[dict] = []
    parts: list[DataFrame] = []
    stop_c: float | None = None
    cells_of = lambda df: [r.asDict() for r in df.drop("labels").collect()]
    if early_stop:
        for c in bounds:
            if stop_c is None:
                parts.append(_kept(fit_lambda_grid(spark, t, s, c)))
                got = cells_of(parts[-1])
                if got and not any(r["any_bound_saturation"] for r in got):
                    stop_c = c
                rows += [{**r, "c_source": c, "c_reused": False} for r in got]
            else:
                rows += [{**r, "c": c, "c_source": stop_c, "c_reused": True} for r in rows if r["c"] == stop_c and not r["c_reused"]]
    else:
        parts.append(_kept(paths.lambda_summary(paths.fit_paths(spark, t, s, paths.tasks(spark, s)), s)))
        rows = [{**r, "c_source": r["c"], "c_reused": False} for r in cells_of(parts[0])]
    for r in rows:
        r["repaired"] = r["final_descent"] = False
        r["propagated_from_c"] = r["propagated_from_lambda"] = None
    labels = parts[0].select("run", "labels")
    for p in parts[1:]:
        labels = labels.unionByName(p.select("run", "labels"))
    known = {(r.run, r.c): (r.a, r.b) for r in evaluations(t, labels, bounds, s.c_qual).collect()}  # few numbers a run and bound
    repair_log = _alternate(s, rows, known, rounds)
    todo = spark.createDataFrame([(r["c"], r["lambda"], r["run"], r["h"]) for r in rows], "c double, lambda double, run string, h double")
    done = _kept(last_descents(t, todo, labels, s))
    new_run = F.concat(F.lit("final:"), F.col("c"), F.lit(":"), F.col("lambda"))
    labels = labels.unionByName(done.where("better").select(new_run.alias("run"), "labels"))
    found = {(r.c, r["lambda"]): r for r in done.drop("labels").withColumn("new_run", new_run).collect()}
    descent_log = []
    for r in rows:
        d = found[r["c"], r["lambda"]]
        if d.tried:
            descent_log.append((r["c"], r["lambda"], r["h"], d.h_new, d.better))
        if d.better:
            r["run"], r["h"], r["final_descent"] = d.new_run, d.h_new, True
        r["sat"], r["n_sat_clusters"], r["any_bound_saturation"] = d.sat, d.n_sat_clusters, d.n_sat_clusters > 0
        r["reo"] = r["k_hat"] = d.reo
    return Grid(spark, s, ids, rows, stop_c, repair_log, descent_log, labels)


def _alternate(s: Settings, rows: list[dict], known: dict[tuple, tuple[float, float]], rounds: int) -> list[tuple]:
    """Copy better partitions along the bound, then along lambda, until one of the two copies nothing.

    ``known``: (a, b) of every run at every bound. Rows get the run that is best for them and the cell it was fitted in.
    """
    home = {r["run"]: (r["c_source"], r["lambda"]) for r in rows}
    at = {(r["c"], r["lambda"]): r for r in rows}
    log: list[tuple] = []

    def take(axis: str, c: float, lam: float, run: str, h: float) -> None:
        r = at[c, lam]
        r["run"], r["repaired"] = run, True
        r["propagated_from_c"], r["propagated_from_lambda"] = home[run]
        log.append((axis, c, lam, *home[run], h))

    def along_lambda() -> int:
        n = len(log)
        for c in s.bounds:
            line = [(r["lambda"], r["run"], *known[r["run"], c]) for r in rows if r["c"] == c]
            out = trajectory.repaired_fold(pd.DataFrame(line, columns=["lambda", "run", "a", "b"]))
            for x in out[out["repaired"]].to_dict("records"):
                take("lambda", c, x["lambda"], x["run"], x["h"])
        return len(log) - n

    def along_c() -> int:
        n = len(log)
        for lam in s.lambdas:
            line = [(r["c"], r["lambda"], r["run"]) for r in rows if r["lambda"] == lam]
            out = trajectory.repair_c_fold(pd.DataFrame(line, columns=["c", "lambda", "run"]), known)
            for x in out[out["repaired"]].to_dict("records"):
                take("c", x["c"], lam, x["run"], x["h"])
        return len(log) - n

    along_lambda()
    for _ in range(rounds):
        if not along_c() or not along_lambda():
            break
    for r in rows:
        a, b = known[r["run"], r["c"]]
        r["h"] = a + b / r["lambda"]
    return log


def select_stable(grid: DataFrame, **options) -> DataFrame:
    """Kept weights of a grid's summary, bound by bound."""
    return diagnose.select_stable(grid.drop("keep_stability", "exclude_saturation"), by=["c"], **options)


def preset(spark: SparkSession, name: str, df: DataFrame, id_col: str, columns: list[str], representation: str = "raw", **settings) -> Grid:
    """A grid with the settings of a named preset on a table of ours: ``line`` (one column), ``table`` (several)."""
    from phasegrid.sources import features

    shown, xs = features.represented(features.complete(df, columns), columns, representation)
    base = {
        "line": Settings([0.1, 0.3, 0.6, 1.0], [0.3, 1.0, 3.0], 3, 3, 5, 3),
        "table": Settings([0.2, 0.4, 0.8], [1.0, 10.0], 3, 3, 5, 3),
    }[name]
    t, ids = paths.local_table(shown, xs, [], 0, id_col, univariate=len(xs) == 1)
    return fit_bound_grid(spark, t, ids, replace(base, **settings))


def compacted(rows: DataFrame) -> DataFrame:
    """A grid's table without label arrays."""
    return rows.select(*[c for c in rows.columns if c != "labels"])


def long_partitions(rows: DataFrame) -> DataFrame:
    """``c, lambda, pos, cluster``: label arrays as rows."""
    return rows.select("c", "lambda", F.posexplode("labels").alias("pos", "cluster"))


def nearest_summary(grid: DataFrame, c: float, lam: float) -> DataFrame:
    """The summary row of the cell nearest to (c, lambda)."""
    return cells.nearest(cells.nearest(grid, "c", c), "lambda", lam)
