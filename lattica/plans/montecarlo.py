"""Ensembles of independent paths."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.functions import rng
from lattica.operators.stats import ensemble_stats
from lattica.plans.executor import Simulation
from lattica.sources.grid import path_grid


class MonteCarlo:
    """A model run on many paths, and statistics of functionals of a path."""

    def __init__(self, spark: SparkSession, model, integrator, paths: int, block: int, initial: dict):
        self.simulation = Simulation(spark, path_grid(paths, block), model, integrator, initial)

    def run(self, steps: int, dt: float) -> DataFrame:
        return self.simulation.run(steps, dt)

    def paths(self) -> DataFrame:
        return self.simulation.cells().withColumnRenamed("i", "path_id")

    def stats(self, functional: Column, *by: str) -> DataFrame:
        return ensemble_stats(self.paths(), functional, *by)


def random_seeds(spark: SparkSession, n: int, extent: tuple[float, float], radius: float, seed: int, spacing: float) -> DataFrame:
    """(grain_id, cx, cy, radius, orientation): seeds placed by counter-based numbers, a margin of two
    radii from the walls; a single one sits in the corner."""
    rows = spark.range(n).withColumnRenamed("id", "grain_id")
    if n <= 1:
        return rows.select("grain_id", F.lit(spacing).alias("cx"), F.lit(spacing).alias("cy"), F.lit(radius).alias("radius"), F.lit(0.0).alias("orientation"))
    for k, name in enumerate(("_x", "_y", "_a")):
        rows = rng.with_key(rows, name, seed, [F.col("grain_id"), k])
    margin = 2 * radius
    place = lambda name, size: F.lit(margin) + rng.unit_open_col(F.col(name)) * F.lit(size - 2 * margin)
    return rows.select("grain_id", place("_x", extent[0]).alias("cx"), place("_y", extent[1]).alias("cy"), F.lit(radius).alias("radius"), (rng.unit_open_col(F.col("_a")) * F.lit(1.5707963267948966)).alias("orientation"))


def diffuse_arrays(table: DataFrame, column: str, rate: float, steps: int) -> DataFrame:
    """Diffuse each row's array along itself with mirrored ends: a fold of higher-order functions, all
    in the JVM, one independent field a row, no shuffle."""

    def once(u: Column) -> Column:
        n = F.size(u)

        def cell(v, i):
            left = F.element_at(u, F.greatest(i, F.lit(1)))
            right = F.element_at(u, F.least(i + 2, n))
            return v + F.lit(rate) * (right - (v + v) + left)

        return F.transform(u, cell)

    first = F.transform(column, lambda x: x.cast("double"))
    return table.withColumn(column, F.aggregate(F.sequence(F.lit(1), F.lit(steps)), first, lambda u, s: once(u)))
