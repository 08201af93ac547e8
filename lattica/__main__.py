"""An example: dendritic growth from a corner seed, with snapshots. ``python -m lattica --help``."""

from __future__ import annotations

import argparse

from pyspark.sql import SparkSession

from lattica.plans import executor, integrators, models
from lattica.sources.grid import CartesianGrid
from lattica.sources.snapshots import FieldStats, ParquetSink, Progress


def main(argv: list[str] | None = None) -> None:
    ask = argparse.ArgumentParser(prog="lattica", description=__doc__)
    ask.add_argument("--cells", type=int, default=256, help="cells a side")
    ask.add_argument("--block", type=int, default=128, help="cells a side of a block")
    ask.add_argument("--steps", type=int, default=200)
    ask.add_argument("--every", type=int, default=100, help="steps between snapshots")
    ask.add_argument("--noise", type=float, default=0.0)
    ask.add_argument("--angle", type=float, default=0.0, help="orientation of the grain")
    ask.add_argument("--seed", type=int, default=1)
    ask.add_argument("--out", help="folder of the snapshots; none are written without it")
    args = ask.parse_args(argv)
    spark = SparkSession.builder.appName("lattica").getOrCreate()
    grid = CartesianGrid((args.cells, args.cells), (args.block, args.block), (0.0, 0.0), (0.4, 0.4))
    model = models.ModelC(noise=args.noise, oriented=bool(args.angle))
    sim = executor.Simulation(spark, grid, model, integrators.EulerMaruyama(args.seed), models.grain_fields([((0.4, 0.4), 4.0, args.angle)], 0.7))
    stats = FieldStats({"phi": 0.0}, args.every)
    for observer in (stats, Progress(args.steps, args.every, stats), *([ParquetSink(args.out, ["phi", "u"], every=args.every, grid=grid)] if args.out else [])):
        sim.observe(observer)
    sim.run(args.steps, sim.stable_dt())
    sim.finish()


if __name__ == "__main__":
    main()
