"""Cells of the (density bound, weight) grid: lookup, bounds, best row, zones."""

from __future__ import annotations

import math
from collections.abc import Callable, Sequence

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from phasegrid.operators.diagnose import finite


#: Most ranges of positions that ``bands`` makes.
MAX_RANGES = 4096


def nearest(df: DataFrame, column: str, value: float, tol: float | None = None) -> DataFrame:
    """The rows whose value is nearest (the smaller of equals); none if ``tol`` is given and it is further off."""
    near = df.agg(F.min_by(column, F.struct(F.abs(F.col(column) - F.lit(value)), F.col(column))).alias("_near"))
    rows = df.join(F.broadcast(near), F.col(column) == F.col("_near")).drop("_near")  # one row
    return rows if tol is None else rows.where(F.abs(F.col(column) - F.lit(value)) <= tol)


def nearest_cells(grid: DataFrame, wanted: DataFrame) -> DataFrame:
    """For each row (id, at_c, at_lambda) of ``wanted`` the nearest cell in range-normalised L1 distance.

    The grid is small (bounds times weights), so each wanted row carries it as one array of structs.
    """
    spread = grid.agg(
        F.collect_list(F.struct("c", "lambda")).alias("cells"), (F.max("c") - F.min("c")).alias("rc"), (F.max("lambda") - F.min("lambda")).alias("rl")
    )
    rows = wanted.crossJoin(F.broadcast(spread))  # one row
    part = lambda a, b, r: F.abs(a - b) / F.when(F.col(r) > 0, F.col(r)).otherwise(1.0)
    best = F.array_min(
        F.transform("cells", lambda s: F.struct((part(s["c"], F.col("at_c"), "rc") + part(s["lambda"], F.col("at_lambda"), "rl")).alias("d"), s["c"].alias("c"), s["lambda"].alias("lambda")))
    )
    return rows.withColumn("_best", best).select("id", "at_c", "at_lambda", F.col("_best.c").alias("c"), F.col("_best.lambda").alias("lambda"))


def best_row(grid: DataFrame) -> DataFrame:
    """The kept cell with fewest clusters; without kept cells any with a finite number; else the first."""
    kept = F.coalesce(F.col("keep"), F.lit(False))
    known = finite(F.col("reo").cast("double"))
    rank = F.when(kept & known, 0).when(known, 1).otherwise(2)
    return grid.orderBy(rank, F.when(known, F.col("reo")), "c", "lambda").limit(1)


def reo_range(grid: DataFrame) -> DataFrame:
    """``low, high`` of the number of clusters over kept cells; widened by a half when they are equal."""
    r = grid.where("keep").agg(F.min("reo").cast("double").alias("low"), F.max("reo").cast("double").alias("high"))
    equal = F.col("low") == F.col("high")
    return r.select((F.col("low") - F.when(equal, 0.5).otherwise(0.0)).alias("low"), (F.col("high") + F.when(equal, 0.5).otherwise(0.0)).alias("high"))


def extended(results: DataFrame, bounds: Sequence[float]) -> DataFrame:
    """Results of the first saturation-free bound repeated for all larger ones: adds ``c_source, c_reused``.

    ``results`` has ``c, any_bound_saturation`` and other columns, a row a cell.
    """
    spark = results.sparkSession
    free = results.groupBy("c").agg(F.bool_or(F.coalesce("any_bound_saturation", F.lit(False))).alias("sat")).where("NOT sat")
    stop = free.agg(F.min("c").alias("stop_c"))
    grid = spark.createDataFrame([(float(c),) for c in bounds], "c_wanted double").crossJoin(F.broadcast(stop))  # one row
    source = F.when(F.col("stop_c").isNotNull() & (F.col("c_wanted") > F.col("stop_c")), F.col("stop_c")).otherwise(F.col("c_wanted"))
    grid = grid.withColumn("c_source", source)
    joined = grid.join(results, F.col("c_source") == F.col("c")).drop("c", "stop_c")
    return joined.withColumnRenamed("c_wanted", "c").withColumn("c_reused", F.col("c") != F.col("c_source"))


def zones(cells: list[dict], similar: Callable[[dict, dict], float], at_least: float = 0.95) -> dict[tuple[float, float], int]:
    """Zone of each kept cell (c, lambda).

    Scanned bound by bound and weight by weight, a cell joins the zone of the cell before it at the same bound or of the
    same weight at the bound before, if that zone's first cell has as many clusters and is as similar as asked; joining
    both merges them, to the one seen first. A grid has few cells; partitions are compared through ``similar``.
    """
    cs, ls = sorted({x["c"] for x in cells}), sorted({x["lambda"] for x in cells})
    at = {(x["c"], x["lambda"]): x for x in cells if x["keep"]}
    parent: dict[tuple, tuple] = {}

    def root(k: tuple) -> tuple:
        while parent[k] != k:
            k = parent[k]
        return k

    order = [(c, v) for c in cs for v in ls if (c, v) in at]
    rank = {k: i for i, k in enumerate(order)}
    for k in order:
        parent[k] = k
        c, v = k
        for n in ((cs[cs.index(c) - 1], v) if cs.index(c) else None, (c, ls[ls.index(v) - 1]) if ls.index(v) else None):
            if n is None or n not in parent:
                continue
            z, own = root(n), root(k)
            if z == own:
                continue
            a, b = at[z].get("reo"), at[k].get("reo")
            same = (a is None and b is None) or (a is not None and b is not None and math.isclose(a, b, abs_tol=1.5e-8))
            if same and similar(at[z], at[k]) >= at_least:
                first, second = sorted((z, own), key=rank.__getitem__)
                parent[second] = first
    number: dict[tuple, int] = {}
    return {k: number.setdefault(root(k), len(number) + 1) for k in order}


def zone_table(grid: DataFrame, similarities: dict[tuple, float], at_least: float = 0.95) -> DataFrame:
    """``c, lambda, zone`` of kept cells, folded in one task over the few cells; ``similarities`` by pairs of runs."""

    def fold(pdf: pd.DataFrame) -> pd.DataFrame:
        same = lambda a, b: 1.0 if a["run"] == b["run"] else similarities.get((a["run"], b["run"]), similarities.get((b["run"], a["run"]), 0.0))
        found = zones(pdf.to_dict("records"), same, at_least)
        return pd.DataFrame([(c, v, z) for (c, v), z in found.items()], columns=["c", "lambda", "zone"])

    return grid.select("c", "lambda", "reo", "keep", "run").groupBy(F.lit("all")).applyInPandas(fold, "c double, lambda double, zone int")


def bands(df: DataFrame, x: str, label: str, range_rows: int = 100_000) -> DataFrame:
    """Stretches of equal label along a numeric column: ``band_label, low, high, n``; edges lie midway between stretches.

    Equal values are one position with their smallest label. Positions are cut into ranges at approximate quantiles, about
    ``range_rows`` each and at most ``MAX_RANGES``, and stretches are numbered within ranges; a range's first one goes on
    from the range before if the labels agree. Only the table of ranges, one row each, is ordered in one task.
    """
    points = df.where(F.col(x).isNotNull()).groupBy(F.col(x).cast("double").alias("x")).agg(F.min(label).alias("l"), F.count("*").alias("m"))
    ranges = min(MAX_RANGES, points.count() // range_rows + 1)
    cuts = []
    if ranges > 1:
        share = [i / ranges for i in range(1, ranges)]
        cuts = sorted(set(points.agg(F.percentile_approx("x", share, 100 * ranges)).first()[0]))
    bounds = F.split(F.lit(",".join(map(repr, cuts))), ",").cast("array<double>") if cuts else None
    place = F.aggregate(bounds, F.lit(0), lambda n, v: n + (v <= F.col("x")).cast("int")) if cuts else F.lit(0)
    points = points.withColumn("r", place)
    w = Window.partitionBy("r").orderBy("x")
    new = F.when(F.col("l").eqNullSafe(F.lag("l").over(w)) & (F.row_number().over(w) > 1), 0).otherwise(1)
    part = points.withColumn("new", new).withColumn("s", F.sum("new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    part = part.groupBy("r", "s").agg(F.first("l").alias("l"), F.min("x").alias("x0"), F.max("x").alias("x1"), F.sum("m").alias("m"))
    ends = part.groupBy("r").agg(F.min(F.struct("s", "l"))["l"].alias("first"), F.max(F.struct("s", "l"))["l"].alias("last"), F.max("s").alias("stretches"))
    g = Window.orderBy("r")  # a row a range
    goes_on = F.when(F.col("first").eqNullSafe(F.lag("last").over(g)) & (F.row_number().over(g) > 1), 1).otherwise(0)
    ends = ends.withColumn("goes_on", goes_on)
    own = F.col("stretches") - F.col("goes_on")
    ends = ends.withColumn("before", F.sum(own).over(g.rowsBetween(Window.unboundedPreceding, 0)) - own - F.col("goes_on"))
    part = part.join(F.broadcast(ends.select("r", "before")), "r").withColumn("s", F.col("before") + F.col("s"))
    runs = part.groupBy("s").agg(F.first("l").alias("band_label"), F.min("x0").alias("x0"), F.max("x1").alias("x1"), F.sum("m").alias("n"))
    left = runs.select((F.col("s") + 1).alias("s"), F.col("x1").alias("x1_before"))
    right = runs.select((F.col("s") - 1).alias("s"), F.col("x0").alias("x0_after"))
    runs = runs.join(left, "s", "left").join(right, "s", "left")
    low, high = F.coalesce((F.col("x0") + F.col("x1_before")) / 2, F.col("x0")), F.coalesce((F.col("x1") + F.col("x0_after")) / 2, F.col("x1"))
    return runs.select("band_label", low.alias("low"), high.alias("high"), "n")


def zone_borders(zones: DataFrame, grid: DataFrame) -> DataFrame:
    """The edges of cells (c, lambda, zone) that part zones: ``zone, side, c0, lambda0, c1, lambda1``.

    A cell's edges lie midway to the neighbouring bounds and weights of the grid; one is a border unless the cell beyond
    it is of the same zone.
    """
    from phasegrid.operators import diagnose

    edges = lambda v, x: diagnose.intervals(grid.select(v).distinct(), v).select(
        F.col(v), F.col("low").alias(f"{x}_low"), F.col("high").alias(f"{x}_high"), F.row_number().over(Window.orderBy(v)).alias(f"{x}_i")
    )  # a row a bound or weight
    cells = zones.join(F.broadcast(edges("c", "c")), "c").join(F.broadcast(edges("lambda", "l")), "lambda")
    marked = cells
    sides = {"left": ("c", -1, "l"), "right": ("c", 1, "l"), "lower": ("l", -1, "c"), "upper": ("l", 1, "c")}
    for side, (along, step, other) in sides.items():
        w = Window.partitionBy(f"{other}_i").orderBy(f"{along}_i")
        beyond = lambda c: F.lag(c).over(w) if step < 0 else F.lead(c).over(w)  # noqa: B023, E731
        same = (beyond(f"{along}_i") == F.col(f"{along}_i") + step) & (beyond("zone") == F.col("zone"))
        marked = marked.withColumn(side, ~F.coalesce(same, F.lit(False)))
    corner = {
        "left": ("c_low", "l_low", "c_low", "l_high"), "right": ("c_high", "l_low", "c_high", "l_high"),
        "lower": ("c_low", "l_low", "c_high", "l_low"), "upper": ("c_low", "l_high", "c_high", "l_high"),
    }
    each = [
        F.struct(F.lit(k).alias("side"), F.col(k).alias("border"), *[F.col(x).alias(n) for x, n in zip(v, ("c0", "lambda0", "c1", "lambda1"))])
        for k, v in corner.items()
    ]
    return marked.select("zone", F.explode(F.array(*each)).alias("e")).where("e.border").select("zone", "e.side", "e.c0", "e.lambda0", "e.c1", "e.lambda1")
