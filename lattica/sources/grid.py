"""Block-structured grids: uniform tilings and refined forests, as plans of cell tables.

A grid owns no data. Cells are numbered with dimension 0 fastest, and so are blocks. ``cells(spark)``
gives a lazy table that is computed by ``spark.range`` and index arithmetic, so it is generated in
parallel and never built on the driver.
"""

from __future__ import annotations

import itertools
import math
from dataclasses import dataclass, field
from functools import reduce

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

AXES = ("i", "j", "k")
COORDS = ("x", "y", "z")


class GridError(ValueError):
    """A grid that cannot be built."""


@dataclass(frozen=True)
class CellBox:
    """A half-open box of cells, lo <= c < hi."""

    lo: tuple[int, ...]
    hi: tuple[int, ...]

    @property
    def extent(self) -> tuple[int, ...]:
        return tuple(max(b - a, 0) for a, b in zip(self.lo, self.hi, strict=True))

    @property
    def cells(self) -> int:
        return math.prod(self.extent)

    @property
    def empty(self) -> bool:
        return self.cells == 0

    def contains(self, c) -> bool:
        return all(a <= x < b for a, x, b in zip(self.lo, c, self.hi, strict=True))

    def intersects(self, other: CellBox) -> bool:
        return all(a < d and c < b for a, b, c, d in zip(self.lo, self.hi, other.lo, other.hi, strict=True))

    def clipped(self, other: CellBox) -> CellBox:
        return CellBox(tuple(map(max, self.lo, other.lo)), tuple(map(min, self.hi, other.hi)))

    def grown(self, by: int) -> CellBox:
        return CellBox(tuple(a - by for a in self.lo), tuple(b + by for b in self.hi))

    def refined(self, ratio: int) -> CellBox:
        return CellBox(tuple(a * ratio for a in self.lo), tuple(b * ratio for b in self.hi))

    def coarsened(self, ratio: int) -> CellBox:
        """The smallest coarse box that covers this one."""
        return CellBox(tuple(a // ratio for a in self.lo), tuple(-(-b // ratio) for b in self.hi))

    def __iter__(self):
        """All cells, dimension 0 fastest."""
        for c in itertools.product(*(range(a, b) for a, b in zip(reversed(self.lo), reversed(self.hi), strict=True))):
            yield tuple(reversed(c))

    @staticmethod
    def bounding(cells) -> CellBox:
        cells = list(cells)
        return CellBox(tuple(map(min, zip(*cells, strict=True))), tuple(max(x) + 1 for x in zip(*cells, strict=True)))


def linear(index, extent, ghost: int = 0) -> int:
    """Offset of a signed index in a slab with a ghost ring, dimension 0 fastest."""
    offset, stride = 0, 1
    for x, n in zip(index, extent, strict=True):
        offset += (x + ghost) * stride
        stride *= n + 2 * ghost
    return offset


@dataclass(frozen=True)
class CartesianGrid:
    """A uniform tiling of one to three dimensions by equal blocks."""

    cells_per_dim: tuple[int, ...]
    block_cells: tuple[int, ...]
    origin: tuple[float, ...]
    spacing: tuple[float, ...]
    periodic: tuple[bool, ...] = field(default=())

    def __post_init__(self):
        dim = len(self.cells_per_dim)
        if not 1 <= dim <= 3 or any(len(x) != dim for x in (self.block_cells, self.origin, self.spacing)):
            raise GridError("a grid has one to three dimensions, the same for all of its parameters")
        if not self.periodic:
            object.__setattr__(self, "periodic", (False,) * dim)
        if len(self.periodic) != dim:
            raise GridError("periodic needs one flag a dimension")
        for n, b, h in zip(self.cells_per_dim, self.block_cells, self.spacing, strict=True):
            if n <= 0 or b <= 0:
                raise GridError("cells and block cells must be positive")
            if n % b:
                raise GridError(f"{n} cells are not divisible into blocks of {b}")
            if not (math.isfinite(h) and h > 0):
                raise GridError("spacing must be finite and positive")

    @classmethod
    def single_block(cls, cells, origin, spacing, periodic=()) -> CartesianGrid:
        return cls(tuple(cells), tuple(cells), tuple(origin), tuple(spacing), tuple(periodic))

    @property
    def dim(self) -> int:
        return len(self.cells_per_dim)

    @property
    def blocks_per_dim(self) -> tuple[int, ...]:
        return tuple(n // b for n, b in zip(self.cells_per_dim, self.block_cells, strict=True))

    @property
    def num_blocks(self) -> int:
        return math.prod(self.blocks_per_dim)

    @property
    def block_len(self) -> int:
        return math.prod(self.block_cells)

    @property
    def finest_spacing(self) -> tuple[float, ...]:
        return self.spacing

    def block_coords(self, block: int) -> tuple[int, ...]:
        out = []
        for n in self.blocks_per_dim:
            block, x = divmod(block, n)
            out.append(x)
        return tuple(out)

    def block_id(self, coords) -> int:
        return linear(coords, self.blocks_per_dim)

    def neighbor(self, block: int, dim: int, side: int) -> int | None:
        """The block across a face; None at a physical face."""
        at = list(self.block_coords(block))
        at[dim] += side
        n = self.blocks_per_dim[dim]
        if not 0 <= at[dim] < n:
            if not self.periodic[dim]:
                return None
            at[dim] %= n
        return self.block_id(at)

    def center(self, block: int, index) -> tuple[float, ...]:
        return tuple(o + (b * n + x + 0.5) * h for o, b, n, x, h in zip(self.origin, self.block_coords(block), self.block_cells, index, self.spacing, strict=True))

    def cell_key(self, index) -> int | None:
        """Number of an interior cell in its block, whatever the ghost width; None for a ghost."""
        if any(not 0 <= x < n for x, n in zip(index, self.block_cells, strict=True)):
            return None
        return linear(index, self.block_cells)

    def cells(self, spark: SparkSession) -> DataFrame:
        """(epoch, level, block_id, cell, i[, j, k], x[, y, z]) for every cell; i, j, k are global."""
        total = math.prod(self.cells_per_dim)
        rest, cols = F.col("id"), []
        for d, n in enumerate(self.cells_per_dim):
            cols.append(F.pmod(rest, F.lit(n)).alias(AXES[d]))
            rest = F.floor(rest / F.lit(n))
        table = spark.range(total).select(*cols)
        block, cell = self.locate([F.col(a) for a in AXES[: self.dim]])
        coords = [(F.lit(o) + (F.col(a) + F.lit(0.5)) * F.lit(h)).alias(c) for o, a, h, c in zip(self.origin, AXES, self.spacing, COORDS, strict=False)]
        return table.select(F.lit(0).cast("long").alias("epoch"), F.lit(0).alias("level"), block.alias("block_id"), cell.alias("cell"), *AXES[: self.dim], *coords)

    def locate(self, index: list[Column]) -> tuple[Column, Column]:
        """(block id, cell in block) of global indices."""
        block, cell, block_stride, stride = F.lit(0).cast("long"), F.lit(0).cast("long"), 1, 1
        for c, n, blocks in zip(index, self.block_cells, self.blocks_per_dim, strict=True):
            block = block + F.floor(c / F.lit(n)) * F.lit(block_stride)
            cell = cell + F.pmod(c, F.lit(n)) * F.lit(stride)
            block_stride *= blocks
            stride *= n
        return block, cell

    def neighbors(self, spark: SparkSession) -> DataFrame:
        """(block_id, dim, side, neighbor): the faces of all blocks; null at a physical face."""
        rows = spark.range(self.num_blocks).select(F.col("id").alias("block_id"))
        faces = F.explode(F.array(*[F.struct(F.lit(d).alias("dim"), F.lit(s).alias("side")) for d in range(self.dim) for s in (-1, 1)]))
        rows = rows.withColumn("face", faces).select("block_id", "face.dim", "face.side")
        found, stride = None, 1
        for d, n in enumerate(self.blocks_per_dim):
            at = F.pmod(F.floor(F.col("block_id") / F.lit(stride)), F.lit(n))
            to = at + F.col("side")
            wrapped = F.pmod(to, F.lit(n)) if self.periodic[d] else F.when((to >= 0) & (to < n), to)
            value = F.col("block_id") + (wrapped - at) * F.lit(stride)
            found = F.when(F.col("dim") == d, value) if found is None else found.when(F.col("dim") == d, value)
            stride *= n
        return rows.withColumn("neighbor", found.cast("long"))


def path_grid(paths: int, block: int) -> CartesianGrid:
    """An ensemble: one independent path a cell, origin 0, spacing 1."""
    return CartesianGrid((paths,), (block,), (0.0,), (1.0,))


@dataclass(frozen=True)
class Patch:
    level: int
    box: CellBox


@dataclass(frozen=True)
class AmrGrid:
    """A forest of patches: level 0 is the base tiling, finer levels are boxes of their own cells.

    Patches are level-major. Boxes of one level are disjoint, ratio-aligned and inside the domain, and
    each lies, coarsened and grown by one cell, on the level below it (proper nesting).
    """

    base: CartesianGrid
    ratios: tuple[int, ...]
    boxes: tuple[tuple[CellBox, ...], ...] = ()

    def __post_init__(self):
        if len(self.boxes) > len(self.ratios):
            raise GridError("more levels than ratios")
        if any(r < 2 for r in self.ratios):
            raise GridError("a refinement ratio is 2 or more")
        for level, boxes in enumerate(self.boxes, 1):
            ratio, domain = self.ratios[level - 1], self.level_domain(level)
            below = self.level_boxes(level - 1)
            for n, box in enumerate(boxes):
                if box.empty:
                    raise GridError("an empty patch")
                if box.clipped(domain) != box:
                    raise GridError("a patch leaves the domain")
                if any(c % ratio for c in (*box.lo, *box.hi)):
                    raise GridError("a patch is not aligned to the ratio")
                if any(box.intersects(other) for other in boxes[:n]):
                    raise GridError("patches of one level overlap")
                if not covered(box.coarsened(ratio).grown(1).clipped(self.level_domain(level - 1)), below):
                    raise GridError("a patch is not nested in the level below")

    @property
    def dim(self) -> int:
        return self.base.dim

    @property
    def num_levels(self) -> int:
        """Populated levels."""
        return 1 + len(self.boxes)

    @property
    def max_levels(self) -> int:
        return 1 + len(self.ratios)

    def base_boxes(self) -> list[CellBox]:
        out = []
        for b in range(self.base.num_blocks):
            lo = tuple(c * n for c, n in zip(self.base.block_coords(b), self.base.block_cells, strict=True))
            out.append(CellBox(lo, tuple(a + n for a, n in zip(lo, self.base.block_cells, strict=True))))
        return out

    def level_boxes(self, level: int) -> list[CellBox]:
        return self.base_boxes() if level == 0 else list(self.boxes[level - 1]) if level <= len(self.boxes) else []

    def level_domain(self, level: int) -> CellBox:
        scale = math.prod(self.ratios[:level])
        return CellBox((0,) * self.dim, tuple(n * scale for n in self.base.cells_per_dim))

    def spacing_at(self, level: int) -> tuple[float, ...]:
        scale = math.prod(self.ratios[:level])
        return tuple(h / scale for h in self.base.spacing)

    @property
    def finest_spacing(self) -> tuple[float, ...]:
        """Of the finest level there is room for, populated or not."""
        return self.spacing_at(len(self.ratios))

    @property
    def patches(self) -> list[Patch]:
        return [Patch(level, box) for level in range(self.num_levels) for box in self.level_boxes(level)]

    def find_patch(self, level: int, cell) -> int | None:
        """The number of the patch that owns a cell."""
        first = sum(len(self.level_boxes(n)) for n in range(level))
        return next((first + n for n, box in enumerate(self.level_boxes(level)) if box.contains(cell)), None)

    def center(self, level: int, cell) -> tuple[float, ...]:
        return tuple(o + (c + 0.5) * h for o, c, h in zip(self.base.origin, cell, self.spacing_at(level), strict=True))

    def patch_table(self, spark: SparkSession, epoch: int = 0) -> DataFrame:
        """(epoch, block_id, level, lo, hi)."""
        rows = [(epoch, n, p.level, list(map(int, p.box.lo)), list(map(int, p.box.hi))) for n, p in enumerate(self.patches)]
        return spark.createDataFrame(rows, "epoch long, block_id long, level int, lo array<long>, hi array<long>")

    def cells(self, spark: SparkSession, epoch: int = 0) -> DataFrame:
        """(epoch, level, block_id, cell, i[, j, k], x[, y, z]) of every patch cell."""
        table = self.patch_table(spark, epoch)
        size = reduce(lambda a, b: a * b, [F.col("hi")[d] - F.col("lo")[d] for d in range(self.dim)])
        table = table.withColumn("cell", F.explode(F.sequence(F.lit(0).cast("long"), size - 1)))
        rest, cols = F.col("cell"), []
        for d in range(self.dim):
            n = F.col("hi")[d] - F.col("lo")[d]
            cols.append((F.col("lo")[d] + F.pmod(rest, n)).alias(AXES[d]))
            rest = F.floor(rest / n)
        table = table.select("epoch", "level", "block_id", "cell", *cols)
        coords = []
        for d in range(self.dim):
            h = F.element_at(F.array(*[F.lit(self.spacing_at(n)[d]) for n in range(self.max_levels)]), F.col("level") + 1)
            coords.append((F.lit(self.base.origin[d]) + (F.col(AXES[d]) + F.lit(0.5)) * h).alias(COORDS[d]))
        return table.select("*", *coords)


def covered(box: CellBox, by) -> bool:
    """Whether boxes cover a box, by cutting off what each covers."""
    left = [box]
    for other in by:
        rest = []
        for b in left:
            if not b.intersects(other):
                rest.append(b)
                continue
            for d in range(len(b.lo)):
                if b.lo[d] < other.lo[d]:
                    rest.append(CellBox(b.lo, (*b.hi[:d], other.lo[d], *b.hi[d + 1 :])))
                    b = CellBox((*b.lo[:d], other.lo[d], *b.lo[d + 1 :]), b.hi)
                if b.hi[d] > other.hi[d]:
                    rest.append(CellBox((*b.lo[:d], other.hi[d], *b.lo[d + 1 :]), b.hi))
                    b = CellBox(b.lo, (*b.hi[:d], other.hi[d], *b.hi[d + 1 :]))
        left = rest
    return not left
