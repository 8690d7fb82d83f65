"""Representative partitions along the grid: best of each cell, coherence, repairs, change points.

The objective of a fixed partition is a + b / lambda at a given density bound, so all of this works on a small table of
(a, b); sequential rules run as one fold a group inside ``applyInPandas``.
"""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators.diagnose import finite

TOLERANCE = 1e-10


def best_of(candidates: DataFrame, by: Sequence[str], h: str = "h", ties: Sequence[str] = ("source", "idx")) -> DataFrame:
    """The candidate of least finite objective in each group; ties in the order given."""
    order = Window.partitionBy(*by).orderBy(F.col(h), *ties)
    rows = candidates.where(finite(F.col(h))).withColumn("_rn", F.row_number().over(order))
    return rows.where("_rn = 1").drop("_rn")


def coherence(best: DataFrame, by: Sequence[str] = (), tol: float = TOLERANCE) -> DataFrame:
    """Adds what the neighbours' partitions would score here and whether the own one is at least as good."""
    w = Window.partitionBy(*by).orderBy("lambda")
    own = F.col("a") + F.col("b") / F.col("lambda")
    before = F.lag("a").over(w) + F.lag("b").over(w) / F.col("lambda")
    after = F.lead("a").over(w) + F.lead("b").over(w) / F.col("lambda")
    df = best.withColumns({"h": own, "h_before": before, "h_after": after})
    ok = (F.coalesce(F.col("h_before"), F.lit(float("inf"))) >= F.col("h") - tol) & (F.coalesce(F.col("h_after"), F.lit(float("inf"))) >= F.col("h") - tol)
    return df.withColumn("coherent", ok)


def _sweep(lam: np.ndarray, a: list, b: list, source: list, tol: float) -> int:
    """Copy a neighbour's partition wherever it scores better: to the right, then to the left; number of copies."""
    changed = 0
    for step in (1, -1):
        at = range(1, len(lam)) if step == 1 else range(len(lam) - 2, -1, -1)
        for i in at:
            j = i - step
            if a[j] is None:
                continue
            new = a[j] + b[j] / lam[i]
            if a[i] is None or new < a[i] + b[i] / lam[i] - tol:
                a[i], b[i], source[i] = a[j], b[j], source[j]
                changed += 1
    return changed


def repaired_fold(pdf: pd.DataFrame, tol: float = TOLERANCE, rounds: int = 100) -> pd.DataFrame:
    """Repair along lambda of one group's rows (lambda, run, a, b)."""
    pdf = pdf.sort_values("lambda", kind="stable").reset_index(drop=True)
    lam = pdf["lambda"].to_numpy(float)
    a = [None if pd.isna(v) else float(v) for v in pdf["a"]]
    b = [None if pd.isna(v) else float(v) for v in pdf["b"]]
    source = list(pdf["run"])
    for _ in range(rounds):
        if not _sweep(lam, a, b, source, tol):
            break
    out = pdf.copy()
    out["repaired"] = [s != t for s, t in zip(source, pdf["run"])]
    out["run"], out["a"], out["b"] = source, a, b
    out["h"] = [None if x is None else x + y / v for x, y, v in zip(a, b, lam)]
    return out


def repair_lambda(best: DataFrame, by: Sequence[str] = (), tol: float = TOLERANCE, rounds: int = 100) -> DataFrame:
    """``by..., lambda, run, a, b, h, repaired``: neighbours copied along lambda until nothing improves.

    A group is one bound's trajectory, a row a lambda.
    """
    keys = [f for f in best.schema if f.name in by]
    fields = ", ".join([f"`{f.name}` {f.dataType.simpleString()}" for f in keys] + ["lambda double", f"run {best.schema['run'].dataType.simpleString()}", "a double", "b double", "repaired boolean", "h double"])
    names = [*(f.name for f in keys), "lambda", "run", "a", "b"]
    rows = best.select(*names)
    group = rows.groupBy(*by) if by else rows.groupBy(F.lit("all"))
    return group.applyInPandas(lambda p: repaired_fold(p[names], tol, rounds)[[*names, "repaired", "h"]], fields)


def repair_c_fold(pdf: pd.DataFrame, evaluate: dict, tol: float = TOLERANCE) -> pd.DataFrame:
    """Repair along the density bound at one lambda: up, then down; ``evaluate[(run, c)]`` is (a, b) at that bound."""
    pdf = pdf.sort_values("c", kind="stable").reset_index(drop=True)
    run, c, lam = list(pdf["run"]), list(pdf["c"]), float(pdf["lambda"].iloc[0])
    score = lambda r, k: evaluate[(r, k)][0] + evaluate[(r, k)][1] / lam
    for step, order in ((1, range(1, len(c))), (-1, range(len(c) - 2, -1, -1))):
        for i in order:
            j = i - step
            if (run[j], c[i]) in evaluate and score(run[j], c[i]) < score(run[i], c[i]) - tol:
                run[i] = run[j]
    out = pdf.copy()
    out["repaired"] = [x != y for x, y in zip(run, pdf["run"])]
    out["run"] = run
    out["h"] = [score(r, k) for r, k in zip(run, c)]
    return out


def repair_c(best: DataFrame, evaluations: DataFrame, tol: float = TOLERANCE) -> DataFrame:
    """``c, lambda, run, h, repaired`` from the best runs of cells and every run's (a, b) at every bound.

    Rows are cogrouped by lambda: a cell a bound, and an evaluation a run and bound.
    """
    kind = best.schema["run"].dataType.simpleString()

    def fold(cells: pd.DataFrame, values: pd.DataFrame) -> pd.DataFrame:
        if not len(cells):
            return pd.DataFrame({"c": [], "lambda": [], "run": [], "h": [], "repaired": []})
        table = {(r, c): (x, y) for r, c, x, y in zip(values["run"], values["c"], values["a"], values["b"])}
        return repair_c_fold(cells, table, tol)[["c", "lambda", "run", "h", "repaired"]]

    values = evaluations.select(F.col("lambda").alias("lambda_e"), "run", "c", "a", "b")
    return (
        best.select("c", "lambda", "run")
        .groupBy("lambda")
        .cogroup(values.groupBy("lambda_e"))
        .applyInPandas(fold, f"c double, lambda double, run {kind}, h double, repaired boolean")
    )


def change_points(path: DataFrame, similarity: str = "similarity", at_least: float = 0.8, by: Sequence[str] = ()) -> DataFrame:
    """Flags along lambda: the number of clusters differs from the row before, its similarity to it is low, either, both.

    ``similarity`` is a row's similarity to the one before. The first row is flagged.
    """
    w = Window.partitionBy(*by).orderBy("lambda")
    first = F.row_number().over(w) == 1
    reo = F.col("reo") != F.lag("reo").over(w)
    low = F.col(similarity) < at_least
    return path.withColumns(
        {
            "reo_change": first | F.coalesce(reo, F.lit(False)),
            "similarity_change": first | F.coalesce(low, F.lit(False)),
            "either_change": first | F.coalesce(reo, F.lit(False)) | F.coalesce(low, F.lit(False)),
            "both_change": first | (F.coalesce(reo, F.lit(False)) & F.coalesce(low, F.lit(False))),
        }
    )


CRITERIA = {
    "reo_or_similarity": lambda r, s: r or s,
    "reo": lambda r, s: r,
    "similarity": lambda r, s: s,
    "reo_and_similarity": lambda r, s: r and s,
}


def changes_fold(pdf: pd.DataFrame, similar: dict, at_least: float, criterion: str, method: str, include_first: bool) -> pd.DataFrame:
    """Changes along lambda of one group's rows (lambda, run, reo); ``similar`` by pairs of runs, 1 for a run and itself."""
    pdf = pdf.sort_values("lambda", kind="stable").reset_index(drop=True)
    lam, run, reo = (list(pdf[c]) for c in ("lambda", "run", "reo"))
    like = lambda a, b: 1.0 if a == b else similar.get((a, b), similar.get((b, a)))
    decide, ref, regime, rows = CRITERIA[criterion], 0, 1, []
    for i in range(len(pdf)):
        if not i:
            rows.append((lam[0], run[0], int(reo[0]), None, lam[0], None, False, False, include_first, 1))
            continue
        at = i - 1 if method == "consecutive" else ref
        before, s = like(run[i - 1], run[i]), like(run[at], run[i])
        by_reo, by_similarity = reo[i] != reo[at], s is not None and s < at_least
        change = decide(by_reo, by_similarity)
        regime += change
        rows.append((lam[i], run[i], int(reo[i]), before, lam[at], s, bool(by_reo), bool(by_similarity), bool(change), regime))
        ref = i if change else ref
    return pd.DataFrame(rows, columns=["lambda", "run", "reo", "sim_prev", "ref_lambda", "sim_ref", "reo_change", "similarity_change", "change", "regime"])


def detect_changes(
    path: DataFrame,
    similarities: dict,
    at_least: float = 0.8,
    criterion: str = "reo_or_similarity",
    method: str = "regime",
    lambdas: Sequence[float] | None = None,
    include_first: bool = True,
    by: Sequence[str] = (),
) -> DataFrame:
    """One row a weight: its number of clusters and its partition held against the weight before (``consecutive``) or the
    first of its regime (``regime``), and whether they differ by one of four criteria.

    ``path``: ``by..., lambda, run, reo`` and, if known, ``n`` rows of each partition; partitions of another length than
    most (the longer of equals) are left out. ``lambdas`` restricts the weights. ``similarities``: by pairs of runs.
    """
    if criterion not in CRITERIA or method not in ("consecutive", "regime"):
        raise ValueError(f"unknown criterion {criterion} or method {method}")
    if lambdas is not None:
        path = path.where(F.col("lambda").isin([float(v) for v in lambdas]))
    if "n" in path.columns:
        most = path.groupBy(*by, "n").agg(F.count("*").alias("_rows")).groupBy(*by).agg(F.max(F.struct("_rows", "n"))["n"].alias("_n"))
        path = (path.join(F.broadcast(most), list(by)) if by else path.crossJoin(F.broadcast(most))).where("n = _n")  # one row a group
    keys = [f for f in path.schema if f.name in by]
    names = [*(f.name for f in keys), "lambda", "run", "reo"]
    fields = ", ".join(
        [f"`{f.name}` {f.dataType.simpleString()}" for f in keys]
        + [f"lambda double, run {path.schema['run'].dataType.simpleString()}, reo int, sim_prev double, ref_lambda double, sim_ref double"]
        + ["reo_change boolean, similarity_change boolean, change boolean, regime int"]
    )

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        out = changes_fold(pdf, similarities, at_least, criterion, method, include_first)
        for k, f in enumerate(keys):
            out.insert(k, f.name, pdf[f.name].iloc[0])
        return out

    rows = path.select(*names)
    return (rows.groupBy(*by) if by else rows.groupBy(F.lit("all"))).applyInPandas(fold, fields)


def regime_fold(pdf: pd.DataFrame, similar: dict, at_least: float) -> pd.DataFrame:
    pdf = pdf.sort_values("lambda", kind="stable").reset_index(drop=True)
    regime, ref, out, flags = 0, None, [], []
    for run, reo in zip(pdf["run"], pdf["reo"]):
        new = ref is None or reo != ref[1] or similar.get((ref[0], run), 1.0 if ref[0] == run else 0.0) < at_least
        if new:
            regime, ref = regime + 1, (run, reo)
        out.append(regime)
        flags.append(bool(new))
    return pdf.assign(regime=out, change=flags)


def regimes(path: DataFrame, similarities: dict, at_least: float = 0.8) -> DataFrame:
    """Adds ``regime`` and ``change``: each row is held against the first of its regime, not the row before.

    ``path`` has one row a lambda; ``similarities`` is by (run of the regime's first row, run), for the few runs.
    """
    kind = path.schema["run"].dataType.simpleString()
    return (
        path.select("lambda", "run", "reo")
        .groupBy(F.lit("all"))
        .applyInPandas(
            lambda p: regime_fold(p[["lambda", "run", "reo"]], similarities, at_least),
            f"lambda double, run {kind}, reo int, regime int, change boolean",
        )
    )
