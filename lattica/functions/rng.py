"""Counter-based random numbers: pure functions of a key, in numpy and as column expressions.

Nothing depends on the order or number of partitions. Column arithmetic works on two 32-bit halves,
so it never overflows a signed 64-bit integer and needs no change of the session's ANSI setting.
"""

from __future__ import annotations

import math
import struct
from collections.abc import Sequence

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values of the published generator and of the second stream of a normal deviate.
GAMMA = 0x9E3779B97F4A7C15
MULTIPLIER_A = 0xBF58476D1CE4E5B9
MULTIPLIER_B = 0x94D049BB133111EB
SECOND = 0xD1B54A32D192ED03
TIME, WIENER, JUMP = 0, 1, 2

U = np.uint64


def signed(x: int) -> int:
    """The signed 64-bit integer with the bits of ``x``."""
    x &= (1 << 64) - 1
    return x - (1 << 64) if x >> 63 else x


def stream_tag(kind: int, index: int = 0) -> int:
    """The stream of a driver: its kind above bit 32, its index below."""
    return kind << 32 | index if kind else 0


def time_bits(t: float) -> int:
    return struct.unpack("<Q", struct.pack("<d", t))[0]


# --- numpy


def splitmix(z):
    with np.errstate(over="ignore"):
        z = np.asarray(z, U) + U(GAMMA)
        z = (z ^ (z >> U(30))) * U(MULTIPLIER_A)
        z = (z ^ (z >> U(27))) * U(MULTIPLIER_B)
    return z ^ (z >> U(31))


def mix_key(seed: int, parts: Sequence) -> np.ndarray:
    state = splitmix(U(seed))
    for part in parts:
        state = splitmix(state ^ np.asarray(part, U))
    return state


def unit_open(bits):
    """In (0, 1]."""
    return ((np.asarray(bits, U) >> U(11)) + U(1)).astype(np.float64) * 2.0**-53


def standard_normal(key):
    first = splitmix(key)
    second = splitmix(first ^ U(SECOND))
    return np.sqrt(-2.0 * np.log(unit_open(first))) * np.cos(2.0 * np.pi * unit_open(second))


def cell_keys(seed: int, t: float, stream: int, block, cell):
    """One key a cell for the draw of one driver in the step that starts at ``t``."""
    return splitmix(mix_key(seed, [time_bits(t), stream, block]) ^ np.asarray(cell, U))


# --- columns


def _low(x: Column) -> Column:
    return x.bitwiseAND(F.lit(0xFFFFFFFF))


def _join(high: Column, low: Column) -> Column:
    return F.shiftleft(_low(high), 32).bitwiseOR(low)


def add64(x: Column, constant: int) -> Column:
    """x + constant modulo 2^64."""
    low = _low(x) + F.lit(constant & 0xFFFFFFFF)
    high = F.shiftrightunsigned(x, 32) + F.lit(constant >> 32) + F.shiftrightunsigned(low, 32)
    return _join(high, _low(low))


def mul64(x: Column, constant: int) -> Column:
    """x * constant modulo 2^64: 16-bit digits of the constant keep each product under 2^48."""
    a, b = _low(x), F.shiftrightunsigned(x, 32)
    d = [(constant >> s) & 0xFFFF for s in (0, 16, 32, 48)]
    low0, low1 = a * F.lit(d[0]), a * F.lit(d[1])
    mid = F.shiftrightunsigned(low0, 16) + low1
    low = F.shiftleft(mid.bitwiseAND(F.lit(0xFFFF)), 16).bitwiseOR(low0.bitwiseAND(F.lit(0xFFFF)))
    high = F.shiftrightunsigned(mid, 16) + _low(a * F.lit(d[2])) + F.shiftleft((a * F.lit(d[3])).bitwiseAND(F.lit(0xFFFF)), 16) + _low(b * F.lit(d[0])) + F.shiftleft((b * F.lit(d[1])).bitwiseAND(F.lit(0xFFFF)), 16)
    return _join(high, low)


def splitmix_col(z: Column) -> Column:
    z = add64(z, GAMMA)
    z = mul64(z.bitwiseXOR(F.shiftrightunsigned(z, 30)), MULTIPLIER_A)
    z = mul64(z.bitwiseXOR(F.shiftrightunsigned(z, 27)), MULTIPLIER_B)
    return z.bitwiseXOR(F.shiftrightunsigned(z, 31))


def chain_col(start: int, parts: Sequence[Column]) -> list[Column]:
    """States after each part; evaluate them stage by stage (``with_key``) to keep expressions small."""
    state = F.lit(signed(start))
    out = []
    for part in parts:
        state = splitmix_col(state.bitwiseXOR(part))
        out.append(state)
    return out


def _staged_splitmix(df, name: str):
    """``splitmix`` of a column in place, each step a projection of its own: as one expression the
    halves would be written out again at every use."""
    step = F.col(name)
    df = df.withColumn(name, add64(step, GAMMA))
    df = df.withColumn(name, step.bitwiseXOR(F.shiftrightunsigned(step, 30))).withColumn(name, mul64(step, MULTIPLIER_A))
    df = df.withColumn(name, step.bitwiseXOR(F.shiftrightunsigned(step, 27))).withColumn(name, mul64(step, MULTIPLIER_B))
    return df.withColumn(name, step.bitwiseXOR(F.shiftrightunsigned(step, 31)))


def with_key(df, name: str, seed: int, parts: Sequence[Column | int]):
    """Add ``mix_key(seed, parts)`` as a column; leading constant parts are folded on the driver."""
    parts = list(parts)
    state = int(splitmix(U(seed & (1 << 64) - 1)))
    while parts and isinstance(parts[0], int):
        state = int(splitmix(U(state) ^ U(parts.pop(0) & (1 << 64) - 1)))
    df = df.withColumn(name, F.lit(signed(state)))
    for part in parts:
        part = F.lit(signed(part)) if isinstance(part, int) else part
        df = _staged_splitmix(df.withColumn(name, F.col(name).bitwiseXOR(part.cast("long"))), name)
    return df


def unit_open_col(bits: Column) -> Column:
    return (F.shiftrightunsigned(bits, 11) + F.lit(1)).cast("double") * F.lit(2.0**-53)


def with_normal(df, name: str, key: str):
    """Add a standard normal deviate of the key column."""
    a, b = f"_{name}_a", f"_{name}_b"
    df = _staged_splitmix(df.withColumn(a, F.col(key)), a)
    df = _staged_splitmix(df.withColumn(b, F.col(a).bitwiseXOR(F.lit(signed(SECOND)))), b)
    draw = F.sqrt(F.lit(-2.0) * F.ln(unit_open_col(F.col(a)))) * F.cos(F.lit(2.0 * math.pi) * unit_open_col(F.col(b)))
    return df.withColumn(name, draw).drop(a, b)
