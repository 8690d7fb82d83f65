"""Diagnostics along the weight axis: summaries, smoothing, runs, saturation, selection. All window and group queries."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def finite(c: Column) -> Column:
    return c.isNotNull() & ~F.isnan(c) & (F.abs(c) < F.lit(float("inf")))


def numeric_summary(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """n, mean, sd (0 for one value), least, quartiles (linear interpolation), largest; nulls are left out."""
    v = F.col(value)
    q = F.percentile(v, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)))
    out = df.groupBy(*by).agg(
        F.count(v).alias("n"), F.avg(v).alias("mean"), F.stddev_samp(v).alias("sd"), F.min(v).alias("min"), q.alias("q"), F.max(v).alias("max")
    )
    sd = F.when(F.col("n") == 1, F.lit(0.0)).otherwise(F.col("sd"))
    return out.select(
        *by, "n", "mean", sd.alias("sd"), "min", F.col("q")[0].alias("q25"), F.col("q")[1].alias("median"), F.col("q")[2].alias("q75"), "max"
    )


def moving_average(value: str, order: str, k: int = 3, by: Sequence[str] = ()) -> Column:
    """Mean over k//2 rows to either side, clipped at the ends, nulls left out; an even k acts like k + 1."""
    if k <= 1:
        return F.col(value)
    w = Window.partitionBy(*by).orderBy(order).rowsBetween(-(k // 2), k // 2)
    return F.avg(value).over(w)


def smoothed(df: DataFrame, values: Sequence[str], order: str = "lambda", k: int = 3, by: Sequence[str] = ()) -> DataFrame:
    return df.withColumns({f"{v}_smooth": moving_average(v, order, k, by) for v in values})


def with_runs(df: DataFrame, condition: str, order: str, by: Sequence[str] = (), name: str = "run") -> DataFrame:
    """Numbers maximal stretches of equal condition (null counts as false) along the order: ``run``, ``run_length``."""
    c = F.coalesce(F.col(condition), F.lit(False))
    along = Window.partitionBy(*by).orderBy(order)
    same = Window.partitionBy(*by, c).orderBy(order)
    df = df.withColumn("_island", F.row_number().over(along) - F.row_number().over(same)).withColumn("_c", c)
    stretch = Window.partitionBy(*by, "_c", "_island")
    df = df.withColumn("_first", F.min(order).over(stretch)).withColumn(f"{name}_length", F.count("*").over(stretch))
    return df.withColumn(name, F.dense_rank().over(Window.partitionBy(*by).orderBy("_first"))).drop("_island", "_c", "_first")


def stable_mask(df: DataFrame, condition: str, order: str, at_least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """Adds ``stable``: the condition holds and its stretch has ``at_least`` rows."""
    return with_runs(df, condition, order, by).withColumn(
        "stable", F.coalesce(F.col(condition), F.lit(False)) & (F.col("run_length") >= at_least)
    )


def stable_runs(df: DataFrame, condition: str, order: str, at_least: int = 1, by: Sequence[str] = ()) -> DataFrame:
    """One row a stable stretch: ``by..., first, last, length``."""
    s = stable_mask(df, condition, order, at_least, by).where("stable")
    return s.groupBy(*by, "run").agg(F.min(order).alias("first"), F.max(order).alias("last"), F.count("*").alias("length")).drop("run")


def saturation(params: DataFrame, by: Sequence[str], nu: str = "nu", flag: str = "density_bound") -> DataFrame:
    """Share of weight in clusters that met the density bound, their number, and whether there are any."""
    hit = F.coalesce(F.col(flag), F.lit(False))
    share = F.sum(F.when(hit, F.col(nu)).otherwise(0.0)) / F.sum(nu)
    return params.groupBy(*by).agg(
        F.greatest(F.lit(0.0), F.least(F.lit(1.0), share)).alias("sat"),
        F.count_if(hit).alias("n_sat_clusters"),
        F.coalesce(F.bool_or(hit), F.lit(False)).alias("any_bound_saturation"),
    )


def select_stable(
    df: DataFrame,
    ratio: str = "rsi",
    stab: str = "stab_algo",
    sat: str | None = "sat",
    order: str = "lambda",
    ratio_at_least: float = 0.8,
    stab_at_least: float = 0.8,
    sat_at_most: float = 0.8,
    rule: str = "both",
    at_least: int = 1,
    strict: bool = False,
    by: Sequence[str] = (),
) -> DataFrame:
    """Adds ``keep_stability``, ``exclude_saturation``, ``stable`` and ``first_stable`` (the least weight kept).

    A row is rejected for saturation when its share exceeds ``sat_at_most`` (``strict``: reaches it); an unknown share
    isn't a reason. Runs shorter than ``at_least`` are dropped, of stability alone and of both together.
    """
    r, s = F.col(ratio) >= ratio_at_least, F.col(stab) >= stab_at_least
    ok = {"both": r & s, "ratio": r, "stab": s}[rule]
    over = F.lit(False)
    if sat:
        over = F.coalesce(F.col(sat) >= sat_at_most if strict else F.col(sat) > sat_at_most, F.lit(False))
    df = df.withColumn("_ok", F.coalesce(ok, F.lit(False))).withColumn("exclude_saturation", over)
    df = stable_mask(df, "_ok", order, at_least, by).withColumnRenamed("stable", "keep_stability").drop("run", "run_length")
    df = df.withColumn("_both", F.col("keep_stability") & ~F.col("exclude_saturation"))
    df = stable_mask(df, "_both", order, at_least, by).drop("_ok", "_both", "run", "run_length")
    return df.withColumn("first_stable", F.min(F.when(F.col("stable"), F.col(order))).over(Window.partitionBy(*by)))


def apply_thresholds(
    summary: DataFrame, stab_at_least: float = 0.8, rsi_at_least: float = 0.8, sat_at_most: float = 0.1, strict: bool = False
) -> DataFrame:
    """Cells judged anew: ``keep_stability, exclude_saturation, keep, fail_reason``; values that aren't finite fail."""
    ok = finite(F.col("stab_algo")) & (F.col("stab_algo") >= stab_at_least) & finite(F.col("rsi")) & (F.col("rsi") >= rsi_at_least)
    over = finite(F.col("sat")) & (F.col("sat") >= sat_at_most if strict else F.col("sat") > sat_at_most)
    df = summary.withColumn("keep_stability", ok).withColumn("exclude_saturation", over)
    df = df.withColumn("keep", F.col("keep_stability") & ~F.col("exclude_saturation"))
    reason = (
        F.when(F.col("keep"), "ok")
        .when(~F.col("keep_stability") & F.col("exclude_saturation"), "stability_rsi_and_saturation")
        .when(~F.col("keep_stability"), "stability_or_rsi")
        .otherwise("saturation")
    )
    return df.withColumn("fail_reason", reason)


def intervals(df: DataFrame, order: str = "lambda", by: Sequence[str] = ()) -> DataFrame:
    """Adds ``low`` and ``high``: midpoints to the neighbours, mirrored at the ends; a lone value gets the larger of 0.5 and 5 %."""
    w = Window.partitionBy(*by).orderBy(order)
    x, before, after = F.col(order), F.lag(order).over(w), F.lead(order).over(w)
    lone = F.greatest(F.lit(0.5), F.abs(x) * 0.05)
    low = F.coalesce((x + before) / 2, x - (after - x) / 2, x - lone)
    high = F.coalesce((x + after) / 2, x + (x - before) / 2, x + lone)
    return df.withColumn("low", low).withColumn("high", high)


def rejected_bands(df: DataFrame, keep: str, order: str = "lambda", by: Sequence[str] = ()) -> DataFrame:
    """Neighbouring rejected values merged to bands: ``by..., band_low, band_high, cells``."""
    d = intervals(df, order, by).withColumn("_out", ~F.coalesce(F.col(keep), F.lit(False)))
    d = with_runs(d, "_out", order, by).where("_out")
    return d.groupBy(*by, "run").agg(F.min("low").alias("band_low"), F.max("high").alias("band_high"), F.count("*").alias("cells")).drop("run")


def origin_counts(fits: DataFrame, by: Sequence[str], origin: str = "origin") -> DataFrame:
    return fits.groupBy(*by).agg(*[F.count_if(F.col(origin) == o).alias(f"n_{o}") for o in ("fresh", "warm_forward", "warm_backward")])


def summary_rows(fits: DataFrame, by: Sequence[str], kind: str = "task_type", h: str = "h", reo: str = "reo") -> DataFrame:
    """One wide row a group: objective and cluster statistics of fixed and bootstrap fits side by side."""
    aggs = []
    for name in ("fixed", "boot"):
        mine = F.col(kind) == name
        v, k = F.when(mine & finite(F.col(h)), F.col(h)), F.when(mine, F.col(reo))
        aggs += [
            F.count(v).alias(f"{name}_n"), F.avg(v).alias(f"{name}_h_mean"), F.min(v).alias(f"{name}_h_min"),
            F.coalesce(F.stddev_samp(v), F.when(F.count(v) == 1, 0.0)).alias(f"{name}_h_sd"), F.avg(k).alias(f"{name}_reo_mean"),
        ]
    return fits.groupBy(*by).agg(*aggs)


def ratio(top: str, bottom: str) -> Column:
    """Null when either side is null or the bottom is 0."""
    return F.try_divide(F.col(top), F.col(bottom))
