"""Parquet snapshots: coordinates and static fields once per epoch, dynamic fields per observed step.

Snapshots keep (block_id, cell), so they join their statics by key, whatever the order of rows.
"""

from __future__ import annotations

import logging
import sys
import time

from py4j.protocol import Py4JError
from pyspark.errors import PySparkException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lattica.operators.stats import field_stats
from lattica.plans.executor import to_cells
from lattica.sources.grid import COORDS

log = logging.getLogger("lattica")


class SinkError(ValueError):
    """A sink that cannot be built or cannot write."""


class InvalidDimension(SinkError):
    """A grid of more or fewer dimensions than the sink can write."""


class NoFields(SinkError):
    """No fields to observe."""


class Cadence:
    """Step 1 and all multiples of ``every``."""

    def __init__(self, every: int):
        if every < 1:
            raise SinkError("a cadence is at least 1")
        self.every = every

    def wants(self, step: int) -> bool:
        return step == 1 or (step > 0 and step % self.every == 0)

    def next_stop(self, step: int) -> int:
        return 1 if step < 1 else (step // self.every + 1) * self.every

    def observe(self, step, t, epoch, grid, state) -> None:
        raise NotImplementedError

    def finish(self) -> None:
        pass


class ParquetSink(Cadence):
    """Writes ``<folder>/static/epoch=E`` and ``<folder>/snap/epoch=E/step=S``; errors of the storage or of Spark
    are logged, not raised. Files hold at most ``rows`` rows. With ``grid`` its dimensions are checked at once;
    ``group_bytes`` is the size at which a row group is closed."""

    def __init__(self, folder: str, fields: list[str], statics: list[str] = (), every: int = 1, rows: int = 1 << 22, grid=None, group_bytes: int | None = None):
        super().__init__(every)
        if not fields:
            raise NoFields("a snapshot needs a field")
        if grid is not None:
            self._check(grid)
        self.folder, self.fields, self.statics, self.rows, self.epochs = folder, list(fields), list(statics), rows, set()
        self.options = {"maxRecordsPerFile": rows} | ({"parquet.block.size": group_bytes} if group_bytes else {})

    @staticmethod
    def _check(grid) -> None:
        if not 1 <= grid.dim <= 3:
            raise InvalidDimension(f"{grid.dim} dimensions; one to three can be written")

    def _write(self, table: DataFrame, path: str) -> None:
        table.write.mode("overwrite").options(**self.options).parquet(path)

    def observe(self, step, t, epoch, grid, state):
        self._check(grid)
        try:
            if epoch not in self.epochs:
                at = grid.cells(state.sparkSession).select("block_id", "cell", *COORDS[: grid.dim], F.col("level").cast("double").alias("level"), F.col("block_id").cast("double").alias("patch"))
                if self.statics:
                    at = at.join(to_cells(state, grid, self.statics).select("block_id", "cell", *self.statics), ["block_id", "cell"])
                self._write(at, f"{self.folder}/static/epoch={epoch}")
                self.epochs.add(epoch)
            cells = to_cells(state, grid, self.fields).select("block_id", "cell", F.lit(float(t)).alias("t"), *self.fields)
            self._write(cells, f"{self.folder}/snap/epoch={epoch}/step={step}")
        except (OSError, PySparkException, Py4JError):
            log.exception("snapshot of step %s was not written", step)


class FieldStats(Cadence):
    """Collects (step, t, field, min, max, mean, above) rows and logs them."""

    def __init__(self, fields: dict[str, float], every: int = 1):
        super().__init__(every)
        self.fields, self.found = fields, []

    def observe(self, step, t, epoch, grid, state):
        cells = to_cells(state, grid, list(self.fields))
        for name, threshold in self.fields.items():
            row = field_stats(cells, name, threshold).first()
            self.found.append((step, t, name, row["min"], row["max"], row["mean"], row["above"]))
            log.info("step %d t %.6g %s: min %.6g max %.6g mean %.6g, %.2f %% above %g", step, t, name, row["min"], row["max"], row["mean"], 100 * row["above"], threshold)


class Progress(Cadence):
    """A line of progress at each observed step: steps done, steps a second, time left, and what ``message`` (a
    ``FieldStats`` that runs beside it, or any callable) has to say."""

    def __init__(self, total: int, every: int = 1, message=None, out=None, clock=time.monotonic):
        super().__init__(every)
        self.total, self.message, self.out, self.clock = total, message, out, clock
        self.began, self.lines = clock(), []

    def observe(self, step, t, epoch, grid, state):
        spent = max(self.clock() - self.began, 1e-9)
        rate = step / spent
        line = f"[{spent:.0f} s] {step}/{self.total} ({rate:.3g} steps/s, {max(self.total - step, 0) / rate:.0f} s left) t={t:.6g}"
        last = self.message.found[-1:] if isinstance(self.message, FieldStats) else [self.message()] if self.message else []
        for found in last:
            line += f" | {found[2]} in [{found[3]:.4g}, {found[4]:.4g}], mean {found[5]:.4g}, above {100 * found[6]:.1f} %" if isinstance(found, tuple) else f" | {found}"
        self.lines.append(line)
        print(line, file=self.out or sys.stderr)


class Callback(Cadence):
    """A user's own observer."""

    def __init__(self, function, every: int = 1, done=None):
        super().__init__(every)
        self.function, self.done = function, done

    def observe(self, step, t, epoch, grid, state):
        self.function(step, t, epoch, grid, state)

    def finish(self):
        if self.done:
            self.done()


def read_snapshots(spark: SparkSession, folder: str) -> DataFrame:
    """Every snapshot row with the coordinates and statics of its epoch."""
    return spark.read.parquet(f"{folder}/snap").join(spark.read.parquet(f"{folder}/static"), ["epoch", "block_id", "cell"])


def snapshot_steps(spark: SparkSession, folder: str) -> list[int]:
    """The observed steps, in order; FileNotFoundError if there are none."""
    steps = [r["step"] for r in spark.read.parquet(f"{folder}/snap").select("step").distinct().orderBy("step").collect()]
    if not steps:
        raise FileNotFoundError(folder)
    return steps


def frame(spark: SparkSession, folder: str, step: int, field: str) -> DataFrame:
    """(coordinates, level, field) of one observed step; KeyError if it was not observed."""
    rows = read_snapshots(spark, folder).where(F.col("step") == step)
    if rows.isEmpty():
        raise KeyError(step)
    return rows.select(*[c for c in COORDS if c in rows.columns], "level", field)


def value_range(spark: SparkSession, folder: str, field: str) -> DataFrame:
    """(low, high) of a field over the first and the last observed step: one colour scale for all frames."""
    steps = snapshot_steps(spark, folder)
    rows = spark.read.parquet(f"{folder}/snap").where(F.col("step").isin(steps[0], steps[-1]))
    return rows.agg(F.min(field).alias("low"), F.max(field).alias("high"))


def middle_plane(cells: DataFrame, axis: str = "z", grid=None) -> DataFrame:
    """Rows of the middle one of the distinct coordinates along an axis; with ``grid`` it is known without a look."""
    if grid is not None:
        d = COORDS.index(axis)
        middle = grid.origin[d] + (grid.cells_per_dim[d] // 2 + 0.5) * grid.spacing[d]
        return cells.where(F.abs(F.col(axis) - middle) < grid.spacing[d] / 2)
    distinct = cells.select(axis).distinct()
    n = distinct.count()
    at = distinct.orderBy(axis).offset(n // 2).limit(1).first()[axis]
    return cells.where(F.col(axis) == at)


def downsampled(cells: DataFrame, extent: int, most: int) -> DataFrame:
    """Every s-th row and column, the least s for which at most ``most`` are left a side."""
    s = -(-extent // most)
    return cells.where((F.pmod("i", F.lit(s)) == 0) & (F.pmod("j", F.lit(s)) == 0))


def grain_hue(cells: DataFrame, phi: str = "phi", angle: str = "theta0") -> DataFrame:
    """Hue in [0, 1) of solid cells (phi > 0), from the grain's angle; null in the liquid."""
    turn = F.col(angle) / F.lit(1.5707963267948966)
    return cells.withColumn("hue", F.when(F.col(phi) > 0, turn - F.floor(turn)))
