"""What a folder of finished tasks is for: names, a manifest of data and settings, and checks before its results are taken."""

from __future__ import annotations

import dataclasses
import hashlib
import json
import re
import time
from datetime import datetime, timezone

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from phasegrid.functions.kernels import Table

MANIFEST = "manifest"


def clean_token(value: object) -> str:
    """A value as part of a file name: every run of other characters than letters and digits becomes one p."""
    text = f"{value:.15g}" if isinstance(value, float) and "e" not in f"{value:.15g}" else format(value)
    return re.sub(r"[^A-Za-z0-9]+", "p", text)


def compact_token(value: object, n: int = 16) -> str:
    """The first digits of a digest of all that names something."""
    return hashlib.sha256(json.dumps(value, sort_keys=True, default=str).encode()).hexdigest()[:n]


def temp_dir(root: str, signature: str | None = None, prefix: str = "lambda-grid") -> str:
    """A folder below a shared root: by signature, so that the same run finds it again, or by the time."""
    return f"{root.rstrip('/')}/{prefix}-{signature[:16] if signature else f'{time.time_ns():x}'}"


def grid_dir(root: str, n: int, seed: int, **settings: object) -> str:
    """The folder of a grid, named by its size, seed and a token of all its settings."""
    return f"{root.rstrip('/')}/grid-n{n}-a{seed}-{compact_token({'n': n, 'seed': seed, **settings})}"


def forced_dir(path: str, at: datetime | None = None) -> str:
    """A new folder beside the one given, named by the time, so that nothing in it is found."""
    parent = path.rstrip("/").rpartition("/")[0] or "."
    return f"{parent}/fr_{(at or datetime.now(timezone.utc)).strftime('%Y%m%d_%H%M%S')}"


def data_signature(t: Table) -> str:
    """A digest of a local table: shape, values and rules."""
    h = hashlib.sha256(f"{t.x.shape}|{t.codes.shape}|{t.levels}|{t.univariate}".encode())
    h.update(np.ascontiguousarray(t.x, float).tobytes())
    h.update(np.ascontiguousarray(t.codes, np.int64).tobytes())
    return h.hexdigest()


def task_meta(t: Table, settings) -> dict:
    """What a run's results depend on, and a signature of it. The lists of bounds and weights and the numbers of tasks are
    no part of it where a task's own result doesn't depend on them."""
    payload = dataclasses.asdict(settings)
    for name in ("bounds", "fixed", "boot", "metric", "stability"):
        payload.pop(name)
    payload["data"] = data_signature(t)
    return {"version": 1, "created_at": datetime.now(timezone.utc).isoformat(), "payload": payload, "signature": compact_token(payload, 64)}


def prepare(spark: SparkSession, path: str, meta: dict) -> None:
    """Open a folder for a run: writes its manifest, or raises if the one there is of other data or settings."""
    try:
        saved = [json.loads(r.value)["signature"] for r in spark.read.text(f"{path}/{MANIFEST}").collect()]  # one row
    except Exception as e:
        if "PATH_NOT_FOUND" not in str(e):
            raise
        saved = []
    if saved and saved != [meta["signature"]]:
        raise ValueError(f"the results in {path} are of other data or settings; choose another folder or remove them")
    if not saved:
        spark.createDataFrame([(json.dumps(meta, default=str),)], "value string").coalesce(1).write.text(f"{path}/{MANIFEST}")


def partition_lengths(results: DataFrame, labels: str = "labels") -> list[int]:
    """The different lengths of the partitions of results."""
    lengths = results.where(F.col(labels).isNotNull()).select(F.size(labels).alias("n")).distinct()
    return sorted(r.n for r in lengths.collect())


def validate_lengths(results: DataFrame, n: int) -> None:
    """Raise if any result's partition isn't of n rows."""
    wrong = [k for k in partition_lengths(results) if k != n]
    if wrong:
        raise ValueError(f"stored partitions of {wrong[:5]} rows don't fit data of {n} rows; choose another folder or remove them")
