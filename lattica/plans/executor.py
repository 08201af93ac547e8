"""Running a model over a block table.

``advance`` uses deep halos: blocks send strips as wide as several steps need to their neighbours, one
shuffle moves them, and each block then steps alone; what goes stale is the rim that is thrown away.
Ensembles need no neighbours and no shuffle. Each round is cut by checkpoint(), so a lost executor
costs one round. Strips are as large as faces, not blocks, and a block is one task's unit of memory.
"""

from __future__ import annotations

import itertools

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, DoubleType, IntegerType, LongType, StructField, StructType

from lattica.operators.boundary import check_width, fill_faces
from lattica.plans.models import Context
from lattica.session import with_checkpoints
from lattica.sources.grid import CartesianGrid


STRIP = 8192


class Place:
    """A region of the grid, a block with its halo, in which a model is evaluated."""

    def __init__(self, grid: CartesianGrid, model, layout, lo, shape):
        self.grid, self.model, self.layout = grid, model, layout
        axes, self.edges = [], {}
        for d, (a, n) in enumerate(zip(lo, shape, strict=True)):
            total = grid.cells_per_dim[d]
            index = np.arange(a, a + n)
            axes.append(index % total if grid.periodic[d] else index)
            if not grid.periodic[d]:
                if a == 0:
                    self.edges[d, -1] = 0
                if a + n == total:
                    self.edges[d, 1] = n - 1
        mesh = np.meshgrid(*axes, indexing="ij")
        self.centers = tuple(o + (m + 0.5) * h for o, m, h in zip(grid.origin, mesh, grid.spacing, strict=True))
        self.block, self.cell = np.zeros(shape, np.int64), np.zeros(shape, np.int64)
        block_stride = stride = 1
        for m, n, blocks in zip(mesh, grid.block_cells, grid.blocks_per_dim, strict=True):
            self.block += m // n * block_stride
            self.cell += m % n * stride
            block_stride *= blocks
            stride *= n

    def at(self, t: float) -> Context:
        return Context(self.grid.spacing, t, self.centers)

    def padded(self, name: str, values: np.ndarray, t: float) -> np.ndarray:
        ghost = self.layout[name].ghost
        if not ghost:
            return values
        slab = np.pad(values, ghost, mode="edge")
        fill_faces(slab, ghost, self.model.faces(name, t), self.grid.spacing, {k: v + ghost for k, v in self.edges.items()})
        return slab

    def drift(self, core, t):
        """Tendencies, computed in strips along the first axis whose temporaries stay in cache."""
        slabs = {k: self.padded(k, v, t) for k, v in core.items()}
        rows, cells = self.block.shape[0], self.block.size
        strip = max(1, STRIP * rows // max(cells, 1))
        if strip >= rows:
            return self.model.drift(slabs, core, self.at(t))
        out: dict[str, np.ndarray] = {}
        for a in range(0, rows, strip):
            b = min(rows, a + strip)
            slab = {k: v[a : b + 2 * self.layout[k].ghost] for k, v in slabs.items()}
            at = Context(self.grid.spacing, t, tuple(c[a:b] for c in self.centers))
            for k, v in self.model.drift(slab, {k: v[a:b] for k, v in core.items()}, at).items():
                if k not in out:
                    out[k] = np.empty(self.block.shape)
                out[k][a:b] = v
        return out

    def amplitude(self, driver, core, t):
        return self.model.amplitude(driver, core, self.at(t))


def fill_blocks(spark: SparkSession, grid: CartesianGrid, layout, functions: dict) -> DataFrame:
    """A block table whose fields are numpy functions of cell centres (0 where none is given)."""

    def make(batches):
        for pdf in batches:
            rows = []
            for block in pdf["id"]:
                lo = [c * n for c, n in zip(grid.block_coords(int(block)), grid.block_cells, strict=True)]
                axes = [o + (a + np.arange(n) + 0.5) * h for o, a, n, h in zip(grid.origin, lo, grid.block_cells, grid.spacing, strict=True)]
                mesh = np.meshgrid(*axes, indexing="ij")
                row = {"block_id": int(block)}
                for name in layout.names:
                    value = functions[name](*mesh) if name in functions else 0.0
                    row[name] = np.broadcast_to(np.asarray(value, float), mesh[0].shape).ravel(order="F")
                rows.append(row)
            yield pd.DataFrame(rows, columns=["block_id", *layout.names])

    return spark.range(grid.num_blocks).mapInPandas(make, layout.block_schema())


def to_cells(state: DataFrame, grid: CartesianGrid, names: list[str]) -> DataFrame:
    """A row a cell: (block_id, cell, i[, j, k], fields)."""
    rows = state.select("block_id", F.posexplode(F.arrays_zip(*names)).alias("cell", "v"))
    stride, block_stride, cols = 1, 1, []
    for a, n, blocks in zip(("i", "j", "k"), grid.block_cells, grid.blocks_per_dim, strict=False):
        inner = F.pmod(F.floor(F.col("cell") / stride), F.lit(n))
        outer = F.pmod(F.floor(F.col("block_id") / block_stride), F.lit(blocks))
        cols.append((outer * n + inner).alias(a))
        stride *= n
        block_stride *= blocks
    return rows.select("block_id", F.col("cell").cast("long").alias("cell"), *cols, *[F.col(f"v.{n}").alias(n) for n in names])


def to_blocks(cells: DataFrame, names: list[str]) -> DataFrame:
    """The block table of a cell table (block_id, cell, fields)."""
    rows = F.array_sort(F.collect_list(F.struct("cell", *names)))
    sorted_ = cells.groupBy("block_id").agg(rows.alias("r"))
    return sorted_.select("block_id", *[F.col(f"r.{n}").alias(n) for n in names])


def _run(place, integrator, core, t, dt, steps):
    for _ in range(steps):
        core = place.model.project(integrator.step(place, core, t, dt))
        t += dt
    return core


def _times(t: float, dt: float, steps: int) -> float:
    for _ in range(steps):
        t += dt
    return t


def advance(state: DataFrame, grid: CartesianGrid, model, integrator, t: float, dt: float, steps: int, depth: int | None = None) -> DataFrame:
    """The block table after ``steps`` steps from time ``t``. ``depth`` is the number of steps between
    exchanges; by default halos take an eighth of a block, or 16 cells, and never more than half of one."""
    with_checkpoints(state.sparkSession)
    integrator.check(model)
    layout = model.layout()
    names, width = layout.names, layout.ghost * integrator.stages
    schema = layout.block_schema()
    shape = tuple(grid.block_cells)

    if not width:

        def alone(batches):
            for pdf in batches:
                out = {"block_id": pdf["block_id"], **{n: [] for n in names}}
                for row in pdf.to_dict("records"):
                    lo = [c * n for c, n in zip(grid.block_coords(int(row["block_id"])), shape, strict=True)]
                    core = {n: np.asarray(row[n], float).reshape(shape, order="F") for n in names}
                    core = _run(Place(grid, model, layout, lo, shape), integrator, core, t, dt, steps)
                    for n in names:
                        out[n].append(core[n].ravel(order="F"))
                yield pd.DataFrame(out)

        return state.mapInPandas(alone, schema)

    check_width(layout.ghost, shape)
    if depth is None:
        side = min(shape)
        depth = max(1, min(64, max(side // 8, min(16, side // 2))) // width)
    if depth * width > min(shape) and grid.num_blocks > 1:
        raise ValueError(f"{depth} steps need halos of {depth * width}, wider than a block")
    sent = StructType([StructField("target", LongType()), StructField("shift", ArrayType(IntegerType())), *[StructField(n, ArrayType(DoubleType())) for n in names]])
    halo_dims = [d for d in range(grid.dim) if grid.blocks_per_dim[d] > 1 or grid.periodic[d]]
    shifts = [s for s in itertools.product(*[(-1, 0, 1) if d in halo_dims else (0,) for d in range(grid.dim)])]

    # a fixed number of partitions: by size alone, adaptive execution would put small blocks into one task
    parts = min(grid.num_blocks, 4 * state.sparkSession.sparkContext.defaultParallelism)
    done = 0
    while done < steps:
        round_ = min(depth, steps - done)
        halo = min(round_ * width, *[shape[d] for d in halo_dims]) if halo_dims else 0
        start = _times(t, dt, done)

        def send(batches):
            for pdf in batches:
                rows = []
                for row in pdf.to_dict("records"):
                    at = grid.block_coords(int(row["block_id"]))
                    for shift in shifts:
                        to = [a + s for a, s in zip(at, shift, strict=True)]
                        if any(not grid.periodic[d] and not 0 <= to[d] < grid.blocks_per_dim[d] for d in range(grid.dim)):
                            continue
                        to = [c % n for c, n in zip(to, grid.blocks_per_dim, strict=True)]
                        cut = tuple(slice(None) if s == 0 else slice(n - halo, n) if s > 0 else slice(0, halo) for s, n in zip(shift, shape, strict=True))
                        one = {"target": grid.block_id(to), "shift": list(shift)}
                        for n in names:
                            one[n] = np.asarray(row[n], float).reshape(shape, order="F")[cut].ravel(order="F")
                        rows.append(one)
                yield pd.DataFrame(rows, columns=["target", "shift", *names])

        def step(pdf: pd.DataFrame) -> pd.DataFrame:
            target = int(pdf["target"].iloc[0])
            at = grid.block_coords(target)
            low = [halo if d in halo_dims and (grid.periodic[d] or at[d] > 0) else 0 for d in range(grid.dim)]
            high = [halo if d in halo_dims and (grid.periodic[d] or at[d] < grid.blocks_per_dim[d] - 1) else 0 for d in range(grid.dim)]
            wide = tuple(a + n + b for a, n, b in zip(low, shape, high, strict=True))
            core = {n: np.zeros(wide) for n in names}
            for row in pdf.to_dict("records"):
                put, size = [], []
                for d, s in enumerate(row["shift"]):
                    a = low[d] if s == 0 else 0 if s > 0 else low[d] + shape[d]
                    size.append(shape[d] if s == 0 else halo)
                    put.append(slice(a, a + size[-1]))
                for n in names:
                    core[n][tuple(put)] = np.asarray(row[n], float).reshape(size, order="F")
            lo = [c * n - a for c, n, a in zip(at, shape, low, strict=True)]
            core = _run(Place(grid, model, layout, lo, wide), integrator, core, start, dt, round_)
            inner = tuple(slice(a, a + n) for a, n in zip(low, shape, strict=True))
            return pd.DataFrame([{"block_id": target, **{n: core[n][inner].ravel(order="F") for n in names}}])

        # checkpoint() runs the round now, while its functions still see this round's values
        state = state.mapInPandas(send, sent).repartition(parts, "target").groupBy("target").applyInPandas(step, schema).checkpoint()
        done += round_
    return state


class Simulation:
    """A model on a grid, its state and time, and the observers that follow it."""

    def __init__(self, spark: SparkSession, grid: CartesianGrid, model, integrator, initial: dict | DataFrame, depth: int | None = None):
        integrator.check(model)
        self.spark, self.grid, self.model, self.integrator, self.depth = spark, grid, model, integrator, depth
        self.layout = model.layout()
        self.state = initial if isinstance(initial, DataFrame) else fill_blocks(spark, grid, self.layout, initial)
        self.t, self.step, self.epoch, self.observers = 0.0, 0, 0, []

    def stable_dt(self) -> float | None:
        return self.model.stable_dt(self.grid.finest_spacing)

    def observe(self, observer) -> None:
        self.observers.append(observer)

    def run(self, steps: int, dt: float) -> DataFrame:
        """Advance; stop at the steps that an observer wants and show it the state after projection."""
        end = self.step + steps
        while self.step < end:
            stops = [o.next_stop(self.step) for o in self.observers]
            until = min([end, *[s for s in stops if s is not None]])
            self.state = advance(self.state, self.grid, self.model, self.integrator, self.t, dt, until - self.step, self.depth)
            self.t = _times(self.t, dt, until - self.step)
            self.step = until
            for o in self.observers:
                if o.wants(self.step):
                    o.observe(self.step, self.t, self.epoch, self.grid, self.state)
        return self.state

    def finish(self) -> None:
        for o in self.observers:
            o.finish()

    def cells(self) -> DataFrame:
        return to_cells(self.state, self.grid, self.layout.names)
