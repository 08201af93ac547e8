"""Grid operators as joins, windows and aggregates over cell tables (level, i, j, fields).

Each is one or two equi-joins or partial aggregates on cell keys, so work and shuffle follow the number of
cells. Small tables (grains, patches) are joined without a hint: Spark broadcasts them if they are small.
"""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lattica.operators.boundary import reflect_col
from lattica.operators.stencils import with_neighbors
from lattica.sources.grid import AXES, CartesianGrid


def axes(dim: int) -> list[str]:
    return list(AXES[:dim])


def restrict(fine: DataFrame, field: str, ratio: int, dim: int = 2) -> DataFrame:
    """Means of the ratio^dim children of each coarse cell, where all children are there."""
    parents = [F.floor(F.col(a) / ratio).cast("long").alias(a) for a in axes(dim)]
    full = ratio**dim
    grouped = fine.groupBy(*parents).agg((F.sum(field) / F.lit(full)).alias(field), F.count("*").alias("_n"))
    return grouped.where(F.col("_n") == full).drop("_n")


def restricted_onto(coarse: DataFrame, fine: DataFrame, field: str, ratio: int, dim: int = 2) -> DataFrame:
    """``coarse`` with covered cells replaced by the means of their children."""
    means = restrict(fine, field, ratio, dim).withColumnRenamed(field, "_mean")
    return coarse.join(means, axes(dim), "left").withColumn(field, F.coalesce("_mean", field)).drop("_mean").select(*coarse.columns)


def prolong(coarse: DataFrame, wanted: DataFrame, field: str, ratio: int, extent: tuple[int, ...], dim: int = 2) -> DataFrame:
    """Multilinear values of ``field`` at the fine cells of ``wanted``; donors past the domain are mirrored.

    Each fine cell meets its 2^dim corner donors by an equi-join; weights multiply to the sum."""
    corners = None
    for d, a in enumerate(axes(dim)):
        p = (F.col(a) + F.lit(0.5)) / F.lit(float(ratio)) - F.lit(0.5)
        c0, w = F.floor(p), p - F.floor(p)
        side = F.array(F.struct(reflect_col(c0, 0, extent[d]).alias("c"), (F.lit(1.0) - w).alias("w"), F.lit(0).alias("n")), F.struct(reflect_col(c0 + 1, 0, extent[d]).alias("c"), w.alias("w"), F.lit(1).alias("n")))
        wanted = wanted.withColumn(f"_s{d}", F.explode(side))
        corners = F.col("_s0.w") if d == 0 else corners * F.col(f"_s{d}.w")
    for d, a in enumerate(axes(dim)):
        wanted = wanted.withColumn(f"_c{d}", F.col(f"_s{d}.c"))
    wanted = wanted.withColumn("_w", corners).where("_w <> 0")
    donors = coarse.select(*[F.col(a).alias(f"_c{d}") for d, a in enumerate(axes(dim))], F.col(field).alias("_v"))
    joined = wanted.join(donors, [f"_c{d}" for d in range(dim)])
    return joined.groupBy(*axes(dim)).agg(F.sum(F.col("_v") * F.col("_w")).alias(field))


def owners(cells: DataFrame, patches: DataFrame, dim: int = 2) -> DataFrame:
    """Each cell (level, i, ...) with the block that owns it, or null: patches are exploded along
    dimension 0 and met by an equi-join on (level, i), then tested on the other axes."""
    lines = patches.withColumn("i", F.explode(F.sequence(F.col("lo")[0], F.col("hi")[0] - 1))).select("level", "i", "block_id", "lo", "hi")
    inside = F.lit(True)
    for d, a in list(enumerate(axes(dim)))[1:]:
        inside = inside & (F.col(f"c.{a}") >= F.col("p.lo")[d]) & (F.col(f"c.{a}") < F.col("p.hi")[d])
    on = (F.col("c.level") == F.col("p.level")) & (F.col("c.i") == F.col("p.i")) & inside
    return cells.alias("c").join(lines.alias("p"), on, "left").select("c.*", F.col("p.block_id").alias("owner"))


def migrate(old: DataFrame, prolonged: DataFrame, wanted: DataFrame, field: str, dim: int = 2) -> DataFrame:
    """Values for the cells of a new level: the old level's where it had them, else prolonged ones."""
    keys = axes(dim)
    same = old.select(*keys, F.col(field).alias("_old"))
    coarse = prolonged.select(*keys, F.col(field).alias("_new"))
    return wanted.join(same, keys, "left").join(coarse, keys, "left").withColumn(field, F.coalesce("_old", "_new")).drop("_old", "_new")


def time_blend(old: DataFrame, new: DataFrame, field: str, alpha: float, keys: list[str]) -> DataFrame:
    """(1 - alpha) old + alpha new, cell by cell."""
    return old.select(*keys, F.col(field).alias("_a")).join(new.select(*keys, F.col(field).alias("_b")), keys).select(*keys, (F.lit(1.0 - alpha) * F.col("_a") + F.lit(alpha) * F.col("_b")).alias(field))


def axpy(cells: DataFrame, field: str, tendency: str, a: float) -> DataFrame:
    return cells.withColumn(field, F.col(field) + F.lit(a) * F.col(tendency))


def copied(cells: DataFrame, source: DataFrame, fields: list[str], keys: list[str]) -> DataFrame:
    """``cells`` with these fields taken from ``source``; cells that it lacks keep their own."""
    other = source.select(*keys, *[F.col(f).alias(f"_{f}") for f in fields])
    return cells.join(other, keys, "left").withColumns({f: F.coalesce(f"_{f}", f) for f in fields}).select(*cells.columns)


def filled(cells: DataFrame, fields: list[str], value: float = 0.0) -> DataFrame:
    return cells.withColumns({f: F.lit(float(value)) for f in fields})


def gradient_flags(cells: DataFrame, grid: CartesianGrid, field: str, threshold: float) -> DataFrame:
    """Cells whose largest half central difference exceeds the threshold (strictly)."""
    wide = with_neighbors(cells, grid, field)
    slopes = [F.abs(F.col(f"{field}_p{d}") - F.col(f"{field}_m{d}")) / F.lit(2.0) for d in range(grid.dim)]
    steep = slopes[0] if len(slopes) == 1 else F.greatest(*slopes)
    return wide.where(steep > threshold).select(*axes(grid.dim))


def dilate(flags: DataFrame, by: int, extent: tuple[int, ...]) -> DataFrame:
    """Flags and all cells within ``by`` of one, inside the domain, once each."""
    for d, a in enumerate(axes(len(extent))):
        flags = flags.withColumn(a, F.explode(F.sequence(F.col(a) - by, F.col(a) + by))).where((F.col(a) >= 0) & (F.col(a) < extent[d])).distinct()
    return flags


def nesting_flags(boxes: DataFrame, fine_ratio: int, source_ratio: int, dim: int = 2) -> DataFrame:
    """Cells that must be flagged so that finer boxes (lo, hi in their own cells) nest: the box in cells
    of its parent level, grown by one, in cells of the level below that."""
    for d, a in enumerate(axes(dim)):
        lo = F.floor((F.floor(F.col("lo")[d] / fine_ratio) - 1) / source_ratio)
        hi = F.ceil((F.ceil(F.col("hi")[d] / fine_ratio) + 1) / source_ratio)
        boxes = boxes.withColumn(a, F.explode(F.sequence(lo, hi - 1)))
    return boxes.select(*axes(dim)).distinct()


def uncovered(need: DataFrame, cover: DataFrame, dim: int = 2) -> DataFrame:
    """Cells of ``need`` that ``cover`` lacks."""
    return need.join(cover, axes(dim), "left_anti")


def flag_union(*tables: DataFrame, dim: int = 2) -> DataFrame:
    """Flags of any of the tables, once each."""
    out = tables[0].select(*axes(dim))
    for more in tables[1:]:
        out = out.union(more.select(*axes(dim)))
    return out.distinct()


def of_level(cells: DataFrame, level: int) -> DataFrame:
    return cells.where(F.col("level") == level)


def ghost_ring(patches: DataFrame, width: int, dim: int = 2) -> DataFrame:
    """(block_id, i, ...): the cells within ``width`` of each patch (lo, hi) and outside of it, once each.

    Two strips an axis cover the ring without overlap: along the axes before theirs they are as long as the
    patch, along those after as long as the patch with its ghosts."""
    out = None
    for d in range(dim):
        for side in (0, 1):
            strip = patches
            for e, a in enumerate(axes(dim)):
                low, high = F.col("lo")[e], F.col("hi")[e]
                if e == d:
                    first, last = (low - width, low - 1) if side == 0 else (high, high + width - 1)
                else:
                    first, last = (low, high - 1) if e < d else (low - width, high + width - 1)
                strip = strip.withColumn(a, F.explode(F.sequence(first, last)))
            strip = strip.select("block_id", *axes(dim))
            out = strip if out is None else out.union(strip)
    return out


def signatures(flags: DataFrame, dim: int = 2) -> DataFrame:
    """(axis, plane, n): flags in each coordinate plane of their bounding box; empty planes have 0."""
    planes = F.explode(F.array(*[F.struct(F.lit(d).alias("axis"), F.col(a).alias("plane")) for d, a in enumerate(axes(dim))])).alias("p")
    counts = flags.select(planes).groupBy("p.axis", "p.plane").agg(F.count("*").alias("n"))
    every = counts.groupBy("axis").agg(F.min("plane").alias("lo"), F.max("plane").alias("hi")).select("axis", F.explode(F.sequence("lo", "hi")).alias("plane"))
    return every.join(counts, ["axis", "plane"], "left").select("axis", "plane", F.coalesce("n", F.lit(0)).alias("n"))


def bounding_box(flags: DataFrame, dim: int = 2) -> DataFrame:
    """lo, hi per axis, the number of flags, and flags per cell of the box."""
    cols = []
    cells: Column = F.lit(1)
    for a in axes(dim):
        cols += [F.min(a).alias(f"{a}_lo"), (F.max(a) + 1).alias(f"{a}_hi")]
        cells = cells * (F.max(a) + 1 - F.min(a))
    return flags.agg(*cols, F.count("*").alias("n"), (F.count("*") / cells).alias("efficiency"))


def _distance(ax, ay, bx, by) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def near_grains(cells: DataFrame, grains: DataFrame, side: float) -> DataFrame:
    """Each square tile of ``side`` that holds a cell, with the grains that can win some place in it.

    A grain can only be the nearest, or have the greatest profile, within a tile if at the tile's centre its
    distance (less its radius) is at most a tile's diagonal more than that of the best grain there. Tiles
    meet all grains, which are some hundred cells' worth of work less than cells meeting them."""
    tiles = cells.select(F.floor(F.col("x") / side).alias("tx"), F.floor(F.col("y") / side).alias("ty")).distinct()
    far = _distance((F.col("tx") + 0.5) * F.lit(side), (F.col("ty") + 0.5) * F.lit(side), F.col("cx"), F.col("cy"))
    pairs = tiles.join(grains, F.lit(True)).withColumn("far", far).withColumn("edge", F.col("far") - F.col("radius"))
    here, diagonal = Window.partitionBy("tx", "ty"), side * math.sqrt(2) * (1 + 1e-9)
    best = pairs.withColumn("least", F.min("far").over(here)).withColumn("most", F.min("edge").over(here))
    return best.where((F.col("far") <= F.col("least") + diagonal) | (F.col("edge") <= F.col("most") + diagonal)).drop("far", "edge", "least", "most")


def grain_profile(cells: DataFrame, grains: DataFrame, side: float | None = None) -> DataFrame:
    """phi at each cell: the greatest of -tanh((distance - radius) / sqrt 2), floored at -1; and the nearest
    grain's orientation (the first of equals). Cells meet only the grains that can win in their tile;
    ``side`` is the width of a tile, by default a sixteenth of the cells' extent."""
    if side is None:
        x = cells.agg((F.max("x") - F.min("x")).alias("w"), (F.max("y") - F.min("y")).alias("h")).first()
        side = max(x["w"] or 0.0, x["h"] or 0.0) / 16 or 1.0
    keys = cells.columns
    tiled = cells.withColumns({"tx": F.floor(F.col("x") / side), "ty": F.floor(F.col("y") / side)})
    pairs = tiled.join(near_grains(cells, grains, side), ["tx", "ty"])
    far = F.sqrt((F.col("x") - F.col("cx")) ** 2 + (F.col("y") - F.col("cy")) ** 2)
    near = F.struct(((F.col("x") - F.col("cx")) * (F.col("x") - F.col("cx")) + (F.col("y") - F.col("cy")) * (F.col("y") - F.col("cy"))).alias("d"), F.col("grain_id"))
    return pairs.groupBy(*keys).agg(F.greatest(F.lit(-1.0), F.max(-F.tanh((far - F.col("radius")) / F.lit(math.sqrt(2))))).alias("phi"), F.min_by("orientation", near).alias("theta0"), F.min_by("grain_id", near).alias("grain"))


def finest_wins(cells: DataFrame, ratios: tuple[int, ...], field: str) -> DataFrame:
    """A picture on the finest level: each cell paints its pixels, finer levels over coarser ones."""
    scale = [math.prod(ratios[n:]) for n in range(len(ratios) + 1)]
    s = F.element_at(F.array(*[F.lit(x) for x in scale]), F.col("level") + 1)
    pixels = cells.withColumn("_s", s)
    for a in ("i", "j"):
        pixels = pixels.withColumn(f"p{a}", F.explode(F.sequence(F.col(a) * F.col("_s"), F.col(a) * F.col("_s") + F.col("_s") - 1)))
    return pixels.groupBy("pi", "pj").agg(F.max_by(field, "level").alias(field), F.max("level").alias("level"))


def patch_outlines(cells: DataFrame) -> DataFrame:
    """Extent of each patch in x and y, half a cell beyond the outer centres. A level's spacing along an axis is
    the least that its patches show; a level of patches one cell wide along it takes the other axis's."""
    box = cells.groupBy("level", "block_id").agg(*[f(c).alias(f"{n}_{c}") for c in ("x", "y") for n, f in (("lo", F.min), ("hi", F.max), ("n", F.count_distinct))])
    step = lambda c: F.min(F.when(F.col(f"n_{c}") > 1, (F.col(f"hi_{c}") - F.col(f"lo_{c}")) / (F.col(f"n_{c}") - 1)))
    spacing = box.groupBy("level").agg(step("x").alias("hx"), step("y").alias("hy"))
    half = {"x": F.coalesce("hx", "hy") / 2, "y": F.coalesce("hy", "hx") / 2}
    edges = [(F.col(f"{end}_{c}") + sign * half[c]).alias(f"{c}{k}") for c in ("x", "y") for k, (end, sign) in enumerate((("lo", -1), ("hi", 1)))]
    return box.join(spacing, "level").select("level", "block_id", *edges)
