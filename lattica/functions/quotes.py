"""Scalar functions of the market-making and jump models, as columns."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fill_rate(rate: float, decay: float, depth: Column) -> Column:
    """rate * exp(-decay * depth); 0 at an infinite depth."""
    infinite = F.abs(depth) == F.lit(float("inf"))
    return F.when(infinite, F.lit(0.0)).otherwise(F.lit(rate) * F.exp(F.lit(-decay) * depth))


def jump_probability(rate: Column, dt: float) -> Column:
    return -F.expm1(-rate * F.lit(dt))


def depth(side, alpha: float, q: Column, sign: int, u: Column, neighbor: Column, floor: float) -> Column:
    """Optimal depth of one side (sign +1 bid, -1 ask) at inventory q; infinite where there is no
    neighbouring inventory."""
    raw = F.lit(1.0 / side.decay + side.half_spread) + F.lit(alpha) * (F.lit(1.0) + F.lit(2.0 * sign) * q) - neighbor + u
    return F.when(neighbor.isNull(), F.lit(float("inf"))).otherwise(F.greatest(raw, F.lit(floor)))
