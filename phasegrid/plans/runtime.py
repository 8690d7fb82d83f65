"""How a session runs: a report of what there is, and settings by profile."""

from __future__ import annotations

import os
from dataclasses import dataclass, field

from pyspark.sql import SparkSession

#: What each profile sets; ``base`` is one core and no adaptive planning, for comparisons.
PROFILES = {
    "auto": {"spark.sql.adaptive.enabled": "true", "spark.sql.adaptive.skewJoin.enabled": "true"},
    "fast": {
        "spark.sql.adaptive.enabled": "true",
        "spark.sql.adaptive.skewJoin.enabled": "true",
        "spark.sql.adaptive.coalescePartitions.enabled": "true",
        "spark.sql.execution.arrow.pyspark.enabled": "true",
    },
    "base": {"spark.sql.adaptive.enabled": "false"},
}


@dataclass
class RuntimeConfig:
    """The outcome of ``configure``: what was chosen and what it was chosen from."""

    profile: str
    cores: int
    max_cores: int
    prefer_multicore: bool
    performance: dict = field(repr=False)

    def __str__(self) -> str:
        p = self.performance
        return f"profile {self.profile}: {self.cores} cores (of {p['cores']}, at most {self.max_cores}), Spark {p['spark']}, BLAS {p['blas']}"


def performance_info(spark: SparkSession) -> dict:
    """Cores, versions and the settings that decide how fast a fit is."""
    import numpy as np
    import pyarrow

    blas = np.show_config(mode="dicts").get("Build Dependencies", {}).get("blas", {}).get("name")
    conf = lambda name: spark.conf.get(name, None)
    return {
        "spark": spark.version,
        "master": spark.sparkContext.master,
        "cores": spark.sparkContext.defaultParallelism,
        "driver_cores": os.cpu_count(),
        "numpy": np.__version__,
        "blas": blas,
        "arrow": pyarrow.__version__,
        "codegen": conf("spark.sql.codegen.wholeStage") != "false",
        "adaptive": conf("spark.sql.adaptive.enabled") != "false",
        "shuffle_partitions": int(conf("spark.sql.shuffle.partitions") or 200),
    }


def default_cores(available: int | None = None, max_cores: int = 8) -> int:
    """At most ``max_cores`` of those there are; at least one."""
    return max(1, min(max_cores, available or os.cpu_count() or 1))


def configure(spark: SparkSession, profile: str = "auto", cores: int | None = None, max_cores: int = 8, prefer_multicore: bool = True) -> RuntimeConfig:
    """Apply a profile's settings to a session and say how many cores its tasks should be planned for."""
    if profile not in PROFILES:
        raise ValueError(f"unknown profile {profile}")
    for name, value in PROFILES[profile].items():
        spark.conf.set(name, value)
    info = performance_info(spark)
    if profile == "base" or not prefer_multicore and cores is None:
        chosen = 1
    else:
        chosen = max(1, cores) if cores is not None else default_cores(info["cores"], max_cores)
    return RuntimeConfig(profile, chosen, max_cores, prefer_multicore, info)
