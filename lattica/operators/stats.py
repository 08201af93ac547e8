"""Reductions of fields and ensembles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def ensemble_stats(paths: DataFrame, functional: Column, *by: str) -> DataFrame:
    """count, mean, population variance (not below zero), std, min and max of a functional of each path."""
    v = paths.select(*by, functional.cast("double").alias("v"))
    agg = (v.groupBy(*by) if by else v).agg(F.count("v").alias("count"), F.avg("v").alias("mean"), F.greatest(F.lit(0.0), F.var_pop("v")).alias("variance"), F.min("v").alias("min"), F.max("v").alias("max"))
    return agg.withColumn("std", F.sqrt("variance"))


def field_stats(cells: DataFrame, field: str, threshold: float) -> DataFrame:
    """min, max, mean, and the share of cells strictly above a threshold."""
    return cells.agg(F.min(field).alias("min"), F.max(field).alias("max"), F.avg(field).alias("mean"), (F.count_if(F.col(field) > threshold) / F.count("*")).alias("above"))


def largest_error(left: DataFrame, right: DataFrame, field: str, keys: list[str]) -> DataFrame:
    return left.select(*keys, F.col(field).alias("_a")).join(right.select(*keys, F.col(field).alias("_b")), keys).agg(F.max(F.abs(F.col("_a") - F.col("_b"))).alias("error"))


def solid_fraction(phi: str = "phi") -> Column:
    """The share of cells with phi > 0, as an aggregate."""
    return F.avg(F.when(F.col(phi) > 0, 1.0).otherwise(0.0))


def arm_length(phi: str, center: tuple[float, float], directions: list[float], wedge: float) -> Column:
    """The greatest distance from ``center`` of a solid cell that is seen less than ``wedge`` off one of the
    directions (angles), as an aggregate over (x, y, phi); 0 where there is none."""
    dx, dy = F.col("x") - F.lit(center[0]), F.col("y") - F.lit(center[1])
    inside = F.lit(False)
    for d in directions:
        apart = F.pmod(F.abs(F.atan2(dy, dx) - F.lit(d)), F.lit(2 * math.pi))
        inside = inside | (F.least(apart, F.lit(2 * math.pi) - apart) < wedge)
    return F.max(F.when((F.col(phi) > 0) & inside, F.sqrt(dx * dx + dy * dy)).otherwise(0.0))
