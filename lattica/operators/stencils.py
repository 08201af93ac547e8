"""Local operators: Laplacian and anisotropic flux divergence, as window expressions over cell tables
and as numpy shifts over padded slabs.

Cell tables order by global index, so the block decomposition never changes a result. A window
partitions by the other axes: one line of cells a task group, never a whole plane.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.boundary import Faces, neighbor_columns, rule_at
from lattica.sources.grid import AXES, CartesianGrid


@dataclass(frozen=True)
class Laplacian:
    """Tag of the Laplacian."""


@dataclass(frozen=True)
class AnisotropicDivergence:
    """Tag of the flux divergence with fourfold anisotropy of strength ``eps4``."""

    eps4: float


@dataclass(frozen=True)
class FiniteDifference:
    """Policy: central differences."""


@dataclass(frozen=True)
class FiniteVolume:
    """Policy: face fluxes; gradients whose squared square is at most ``tol`` count as flat."""

    tol: float = 1e-8


def stencil(policy, op, grid):
    """The numpy stencil (ghost width, function of a padded slab) of an operator under a policy."""
    spacing = grid.finest_spacing
    if isinstance(op, Laplacian):
        return 1, lambda slab: laplacian(slab, spacing)
    if isinstance(op, AnisotropicDivergence) and isinstance(policy, FiniteVolume):
        if grid.dim != 2:
            raise ValueError("the anisotropic divergence is two-dimensional")
        constants = Anisotropy(op.eps4, policy.tol)
        return 1, lambda slab: constants.divergence(slab, spacing)
    raise ValueError(f"{type(policy).__name__} has no stencil for {type(op).__name__}")


# --- windows over cell tables


PIECE, REACH = 1 << 16, 2


def axis_window(dim: int, axis: int, *also: str):
    others = [a for d, a in enumerate(AXES[:dim]) if d != axis]
    return Window.partitionBy(*also, *others).orderBy(AXES[axis]) if others or also else Window.partitionBy(F.lit(0)).orderBy(AXES[axis])


def with_neighbors(cells: DataFrame, grid: CartesianGrid, field: str, faces: Faces = None, also: tuple[str, ...] = ()) -> DataFrame:
    """Add ``<field>_m<d>`` and ``<field>_p<d>``: the values before and after along each dimension."""
    if grid.dim == 1 and not also:
        return _along_a_line(cells, grid, field, faces)
    for d in range(grid.dim):
        before, after = neighbor_columns(F.col(field), axis_window(grid.dim, d, *also), grid.spacing[d], rule_at(faces, d, -1), rule_at(faces, d, 1), grid.periodic[d], grid.cells_per_dim[d])
        cells = cells.withColumns({f"{field}_m{d}": before, f"{field}_p{d}": after})
    return cells


def _along_a_line(cells: DataFrame, grid: CartesianGrid, field: str, faces: Faces) -> DataFrame:
    """``with_neighbors`` of a line, in pieces of ``PIECE`` cells; each gets ``REACH`` cells of its neighbours too."""
    n, i = grid.cells_per_dim[0], F.col(AXES[0])
    rows = cells.withColumn("_at", i)
    if grid.periodic[0] and n > 2 * REACH:
        rows = cells.withColumn("_at", F.explode(F.when(i < REACH, F.array(i, i + n)).when(i >= n - REACH, F.array(i, i - n)).otherwise(F.array(i))))
    pieces = F.array_distinct(F.array(F.floor((F.col("_at") - REACH) / PIECE), F.floor((F.col("_at") + REACH) / PIECE)))
    rows = rows.withColumn("_piece", F.explode(pieces))
    over = Window.partitionBy("_piece").orderBy("_at")
    before, after = neighbor_columns(F.col(field), over, grid.spacing[0], rule_at(faces, 0, -1), rule_at(faces, 0, 1), grid.periodic[0], n)
    wide = rows.withColumns({f"{field}_m0": before, f"{field}_p0": after})
    return wide.where((F.col("_at") == i) & (F.col("_piece") == F.floor(i / PIECE))).drop("_at", "_piece")


def laplacian_column(grid: CartesianGrid, field: str) -> Column:
    """The Laplacian from the columns of ``with_neighbors``: per dimension, in order, (p - 2u + m) / h^2."""
    u, total = F.col(field), F.lit(0.0)
    for d, h in enumerate(grid.spacing):
        total = total + (F.col(f"{field}_p{d}") - (u + u) + F.col(f"{field}_m{d}")) * F.lit(1.0 / (h * h))
    return total


def apply_laplacian(cells: DataFrame, grid: CartesianGrid, field: str, faces: Faces = None, name: str = "lap") -> DataFrame:
    wide = with_neighbors(cells, grid, field, faces)
    return wide.withColumn(name, laplacian_column(grid, field)).select(*cells.columns, name)


def with_corners(cells: DataFrame, grid: CartesianGrid, field: str, faces: Faces = None) -> DataFrame:
    """Add all eight neighbours of a plane: ``<field>_<a><b>`` with a, b of m (before), c, p (after)."""
    wide = with_neighbors(cells, grid, field, faces)
    own = {f"{field}_m0": f"{field}_mc", f"{field}_p0": f"{field}_pc", f"{field}_m1": f"{field}_cm", f"{field}_p1": f"{field}_cp"}
    for old, new in own.items():
        wide = wide.withColumnRenamed(old, new)
    for side in ("m", "p"):
        column = f"{field}_{side}c"
        before, after = neighbor_columns(F.col(column), axis_window(2, 1), grid.spacing[1], rule_at(faces, 1, -1), rule_at(faces, 1, 1), grid.periodic[1], grid.cells_per_dim[1])
        wide = wide.withColumns({f"{field}_{side}m": before, f"{field}_{side}p": after})
    return wide


# --- numpy


def laplacian(slab: np.ndarray, spacing) -> np.ndarray:
    """Of the interior of a slab with one ghost layer."""
    core = (slice(1, -1),) * slab.ndim
    u, total = slab[core], 0.0
    for d, h in enumerate(spacing):
        def side(s, d=d):
            return slab[tuple(slice(1 + s, slab.shape[a] - 1 + s) if a == d else slice(1, -1) for a in range(slab.ndim))]

        total = total + (side(1) - (u + u) + side(-1)) * (1.0 / (h * h))
    return total


class Anisotropy:
    """Fourfold anisotropy: A and A' of a gradient, and what is built from them."""

    def __init__(self, eps4: float, tol: float = 1e-8):
        self.tol = tol
        self.a = 1.0 - 3.0 * eps4
        self.e = 3.0 * eps4 / self.a
        self.d = 4.0 * self.a * self.e

    def pair(self, dx, dy):
        x2, y2 = dx * dx, dy * dy
        m = x2 + y2
        m *= m
        weak = m <= self.tol
        m[weak] = 1.0
        slope = -self.d * dx
        slope *= dy
        slope *= x2 - y2
        slope /= m
        x2 *= x2
        y2 *= y2
        x2 += y2
        x2 *= self.e
        x2 /= m
        x2 += 1.0
        x2 *= self.a
        x2[weak] = self.a
        slope[weak] = 0.0
        return x2, slope

    def pair_columns(self, dx: Column, dy: Column) -> tuple[Column, Column]:
        x2, y2 = dx * dx, dy * dy
        s = x2 + y2
        m = s * s
        value = F.when(m > self.tol, F.lit(self.a) * (F.lit(1.0) + F.lit(self.e) * (x2 * x2 + y2 * y2) / m)).otherwise(F.lit(self.a))
        slope = F.when(m > self.tol, F.lit(-self.d) * dx * dy * (x2 - y2) / m).otherwise(F.lit(0.0))
        return value, slope

    @staticmethod
    def turned(dx, dy, angle):
        """A gradient in the frame of a grain at ``angle``; None is the frame of the grid."""
        if angle is None:
            return dx, dy
        c, s = np.cos(angle), np.sin(angle)
        return c * dx + s * dy, c * dy - s * dx

    def center(self, slab: np.ndarray, angle=None) -> np.ndarray:
        """A at cell centres, from half central differences."""
        dx = 0.5 * (slab[2:, 1:-1] - slab[:-2, 1:-1])
        dy = 0.5 * (slab[1:-1, 2:] - slab[1:-1, :-2])
        return self.pair(*self.turned(dx, dy, angle))[0]

    def divergence(self, slab: np.ndarray, spacing, angle=None) -> np.ndarray:
        """Of the anisotropic flux over the four faces of each cell; ``angle`` is the cell's own. Without one, the
        two cells at a face share its flux."""
        if angle is None:
            gx = slab[1:, 1:-1] - slab[:-1, 1:-1]
            gy = 0.25 * (slab[1:, 2:] - slab[1:, :-2] + slab[:-1, 2:] - slab[:-1, :-2])
            a, da = self.pair(gx, gy)
            across = a * (a * gx - da * gy)
            gx = 0.25 * (slab[2:, 1:] - slab[:-2, 1:] + slab[2:, :-1] - slab[:-2, :-1])
            gy = slab[1:-1, 1:] - slab[1:-1, :-1]
            a, da = self.pair(gx, gy)
            along = a * (a * gy + da * gx)
            return (across[1:] - across[:-1] + along[:, 1:] - along[:, :-1]) / (spacing[0] * spacing[1])
        c = slab[1:-1, 1:-1]
        w, e, s, n = slab[:-2, 1:-1], slab[2:, 1:-1], slab[1:-1, :-2], slab[1:-1, 2:]
        sw, se, nw, ne = slab[:-2, :-2], slab[2:, :-2], slab[:-2, 2:], slab[2:, 2:]
        faces = (
            (e - c, 0.25 * (ne - se + n - s)),
            (c - w, 0.25 * (n - s + nw - sw)),
            (0.25 * (ne - nw + e - w), n - c),
            (0.25 * (e - w + se - sw), c - s),
        )
        flux = []
        for number, (gx, gy) in enumerate(faces):
            a, da = self.pair(*self.turned(gx, gy, angle))
            flux.append(a * (a * gx - da * gy) if number < 2 else a * (a * gy + da * gx))
        return (flux[0] - flux[1] + flux[2] - flux[3]) / (spacing[0] * spacing[1])

    def turned_columns(self, dx: Column, dy: Column, angle: Column | None) -> tuple[Column, Column]:
        if angle is None:
            return dx, dy
        c, s = F.cos(angle), F.sin(angle)
        return c * dx + s * dy, c * dy - s * dx

    def divergence_column(self, field: str, spacing, angle: Column | None = None) -> Column:
        """The same from the columns of ``with_corners``; ``angle`` is the cell's own."""
        v = lambda a: F.col(f"{field}_{a}")
        c = F.col(field)
        faces = (
            (v("pc") - c, F.lit(0.25) * (v("pp") - v("pm") + v("cp") - v("cm"))),
            (c - v("mc"), F.lit(0.25) * (v("cp") - v("cm") + v("mp") - v("mm"))),
            (F.lit(0.25) * (v("pp") - v("mp") + v("pc") - v("mc")), v("cp") - c),
            (F.lit(0.25) * (v("pc") - v("mc") + v("pm") - v("mm")), c - v("cm")),
        )
        flux = []
        for number, (gx, gy) in enumerate(faces):
            a, da = self.pair_columns(*self.turned_columns(gx, gy, angle))
            flux.append(a * (a * gx - da * gy) if number < 2 else a * (a * gy + da * gx))
        return (flux[0] - flux[1] + flux[2] - flux[3]) / F.lit(spacing[0] * spacing[1])

    def center_column(self, field: str, angle: Column | None = None) -> Column:
        v = lambda a: F.col(f"{field}_{a}")
        return self.pair_columns(*self.turned_columns(F.lit(0.5) * (v("pc") - v("mc")), F.lit(0.5) * (v("cp") - v("cm")), angle))[0]


def upwind(slab: np.ndarray, velocity: np.ndarray, h: float) -> np.ndarray:
    """First difference along axis 0 against the drift: forward where velocity > 0, else backward."""
    c = slab[1:-1]
    return np.where(velocity > 0, (slab[2:] - c) / h, (c - slab[:-2]) / h)
