"""Boundary rules at physical faces, as column expressions and for numpy slabs.

A rule gives the ghost value ``k`` cells outside a face (k = 0 next to it) from interior values
counted inwards. A model or query names a rule by face: ``{(dim, side): rule}`` or a function of them.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass

import numpy as np
from pyspark.sql import functions as F


@dataclass(frozen=True)
class Mirror:
    """Zero gradient: the ghost equals its mirror image."""

    depth = 1

    def ghost(self, inner, k: int, h: float):
        return inner(k)


@dataclass(frozen=True)
class Dirichlet:
    """A fixed value on the face."""

    value: float
    depth = 1

    def ghost(self, inner, k: int, h: float):
        return 2.0 * self.value - inner(k)


@dataclass(frozen=True)
class Flux:
    """A fixed gradient along the outward normal."""

    gradient: float
    depth = 1

    def ghost(self, inner, k: int, h: float):
        return inner(k) + (2 * k + 1) * h * self.gradient


@dataclass(frozen=True)
class Extrapolate:
    """Linear continuation of the two cells next to the face."""

    depth = 2

    def ghost(self, inner, k: int, h: float):
        return (k + 2.0) * inner(0) - (k + 1.0) * inner(1)


Rule = Mirror | Dirichlet | Flux | Extrapolate
Faces = Mapping[tuple[int, int], Rule] | Callable[[int, int], Rule] | Rule | None


def rule_at(faces: Faces, dim: int, side: int) -> Rule:
    if faces is None:
        return Mirror()
    if isinstance(faces, Mapping):
        return faces.get((dim, side), Mirror())
    return faces if isinstance(faces, Mirror | Dirichlet | Flux | Extrapolate) else faces(dim, side)


def reflect(c: int, lo: int, hi: int) -> int:
    """The mirror image in [lo, hi) of an index just outside it."""
    return 2 * lo - 1 - c if c < lo else 2 * hi - 1 - c if c >= hi else c


def reflect_col(c, lo, hi):
    return F.when(c < lo, 2 * F.lit(lo) - 1 - c).when(c >= hi, 2 * F.lit(hi) - 1 - c).otherwise(c)


def check_width(ghost: int, extent) -> None:
    if any(ghost > n for n in extent):
        raise ValueError(f"a ghost width of {ghost} exceeds the block extent {tuple(extent)}")


def neighbor_columns(field, axis_window, h: float, low: Rule, high: Rule, periodic: bool, n: int):
    """(previous, next) value of a field along the axis of ``axis_window``; past a face, by its rule."""
    at = lambda off: F.lag(field, -off).over(axis_window) if off < 0 else F.lead(field, off).over(axis_window)
    before, after = F.lag(field, 1).over(axis_window), F.lead(field, 1).over(axis_window)
    if periodic:
        if n == 1:
            return field, field
        before = F.coalesce(before, F.last(field).over(axis_window.rowsBetween(_FIRST, _LAST)))
        after = F.coalesce(after, F.first(field).over(axis_window.rowsBetween(_FIRST, _LAST)))
        return before, after
    inner_low = lambda k: field if k == 0 else at(k)
    inner_high = lambda k: field if k == 0 else F.lag(field, k).over(axis_window)
    return F.coalesce(before, low.ghost(inner_low, 0, h)), F.coalesce(after, high.ghost(inner_high, 0, h))


_FIRST, _LAST = -(1 << 63), (1 << 63) - 1


def fill_faces(slab: np.ndarray, ghost: int, faces: Faces, spacing, at_face: Mapping[tuple[int, int], int]) -> None:
    """Fill, in place, ghosts that lie past physical faces of a padded slab (axes in order of dimension).

    ``at_face`` gives for each physical face the padded index of the first interior cell next to it;
    all cells beyond are filled, one dimension after the other, so that corners agree.
    """
    for (dim, side), first in sorted(at_face.items()):
        rule, h = rule_at(faces, dim, side), spacing[dim]
        view = np.moveaxis(slab, dim, 0)
        inner = (lambda k, v=view, f=first, s=side: v[f - s * k])
        for k in range(first if side < 0 else view.shape[0] - first - 1):
            view[first + side * (k + 1)] = rule.ghost(inner, k, h)
