"""Scoring a stream by a fitted model: the assignment step is map-only, so it runs unchanged on a streaming DataFrame."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from phasegrid.functions import expressions as ex
from phasegrid.functions.kernels import Params


def scored(stream: DataFrame, params: Params, xs: list[str], codes: list[str], lam: float) -> DataFrame:
    """Adds ``cluster`` and ``log_density`` (of the row under its cluster)."""
    x, c = [F.col(v) for v in xs], [F.col(v) for v in codes]
    out = stream.withColumn("cluster", ex.label(params, x, c, lam))
    return out.withColumn("log_density", ex.picked(ex.log_densities(params, x, c), F.col("cluster")))


def windowed_shares(scored_stream: DataFrame, ts: str, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Rows and mean log density of each cluster and time window, finished windows only once ``late`` has passed.

    A falling mean log density shows that the model no longer fits.
    """
    w = F.window(ts, window)
    return (
        scored_stream.withWatermark(ts, late)
        .groupBy(w.alias("w"), "cluster")
        .agg(F.count("*").alias("n"), F.avg("log_density").alias("mean_log_density"))
        .select(F.col("w.start").alias("start"), F.col("w.end").alias("end"), "cluster", "n", "mean_log_density")
    )
