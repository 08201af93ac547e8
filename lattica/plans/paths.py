"""Stochastic paths as rows: Euler-Maruyama in column expressions, all in the JVM and without a shuffle.

The numbers equal those of the block executor for the same seed, block and cell."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from lattica.functions import rng
from lattica.plans.schema import stream_of


def step_paths(paths: DataFrame, drift: dict[str, Column], amplitudes: dict[str, dict[str, Column]], rates: dict[str, Column], t: float, dt: float, seed: int, project: Callable[[DataFrame], DataFrame] | None = None) -> DataFrame:
    """One step of rows with ``block_id`` and ``cell``. ``amplitudes`` has for each driver, in order, what
    it moves; ``rates`` the intensity of each jump driver. All are read before the step."""
    kept = paths.columns
    old = {f"_d_{k}": v for k, v in drift.items()}
    for n, (driver, moved) in enumerate(amplitudes.items()):
        old |= {f"_a{n}_{k}": v for k, v in moved.items()}
        if driver in rates:
            old[f"_r{n}"] = rates[driver]
    paths = paths.withColumns(old) if old else paths
    paths = paths.withColumns({k: F.col(k) + F.lit(dt) * F.col(f"_d_{k}") for k in drift}) if drift else paths
    for n, (driver, moved) in enumerate(amplitudes.items()):
        paths = rng.with_key(paths, "_k", seed, [rng.time_bits(t), stream_of(driver), F.col("block_id"), F.col("cell")])
        if driver in rates:
            fire = (F.col(f"_r{n}") > 0) & (rng.unit_open_col(F.col("_k")) < -F.expm1(-F.col(f"_r{n}") * F.lit(dt)))
            paths = paths.withColumns({k: F.when(fire, F.col(k) + F.col(f"_a{n}_{k}")).otherwise(F.col(k)) for k in moved})
        else:
            paths = rng.with_normal(paths, "_n", "_k")
            paths = paths.withColumns({k: F.col(k) + F.lit(math.sqrt(dt)) * F.col(f"_a{n}_{k}") * F.col("_n") for k in moved})
    paths = paths.select(*kept)
    return project(paths) if project else paths
