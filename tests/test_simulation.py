import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import stats, stencils
from lattica.operators.boundary import Dirichlet, Mirror
from lattica.plans import executor, models
from lattica.plans.integrators import EulerMaruyama, ForwardEuler, RungeKutta4, substeps
from lattica.plans.montecarlo import MonteCarlo, diffuse_arrays, random_seeds
from lattica.plans.schema import StateBuilder, jump, wiener
from lattica.sources.grid import CartesianGrid
from lattica.sources.snapshots import Callback, FieldStats, ParquetSink, SinkError, middle_plane, read_snapshots, snapshot_steps
from lattica.streaming.observers import AsyncObserver, binned_events


def mode(spark, n, block, integrator, steps, periodic=False, dim=2, h=0.1, kappa=0.7):
    length = n * h
    k = (2 if periodic else 1) * math.pi / length
    grid = CartesianGrid((n,) * dim, (block,) * dim, (0.0,) * dim, (h,) * dim, (periodic,) * dim)
    dt = 0.5 / (2 * dim) * h * h / kappa
    sim = executor.Simulation(spark, grid, models.Heat(kappa, dim), integrator, {"u": lambda x, *_: np.cos(k * x)})
    sim.run(steps, dt)
    cells = sim.cells().toPandas()
    z = dt * kappa * (2 - 2 * math.cos(k * h)) / h**2
    factor = 1 - z if integrator.stages == 1 else 1 - z + z * z / 2 - z**3 / 6 + z**4 / 24
    return np.abs(cells.u - np.cos(k * (cells.i + 0.5) * h) * factor**steps).max()


@pytest.mark.parametrize("n,block,integrator,steps,periodic,dim", [(32, 8, ForwardEuler(), 24, False, 2), (32, 16, RungeKutta4(), 6, False, 2), (16, 8, ForwardEuler(), 20, True, 2), (16, 16, ForwardEuler(), 20, True, 2), (8, 4, ForwardEuler(), 6, False, 3), (16, 4, ForwardEuler(), 10, True, 1)])
def test_heat_modes_decay_as_they_must(spark, n, block, integrator, steps, periodic, dim):
    assert mode(spark, n, block, integrator, steps, periodic, dim) < 1e-12


def state_of(spark, block, partitions=None):
    grid = CartesianGrid((16, 16), (block, block), (0.0, 0.0), (0.4, 0.4))
    model = models.ModelC()
    fields = models.grain_fields([((0.4, 0.4), 2.0, 0.0)], 0.7)
    state = executor.fill_blocks(spark, grid, model.layout(), fields)
    state = state.repartition(partitions) if partitions else state
    out = executor.advance(state, grid, model, EulerMaruyama(1), 0.0, 0.01, 12)
    return executor.to_cells(out, grid, ["phi", "u"]).toPandas().sort_values(["j", "i"])[["phi", "u"]].to_numpy()


def test_blocks_and_partitions_do_not_change_a_run(spark):
    whole = state_of(spark, 16)
    assert np.abs(state_of(spark, 8) - whole).max() < 1e-12
    assert (state_of(spark, 8, 1) == state_of(spark, 8, 4)).all()
    assert -1.1 < whole[:, 0].min() and whole[:, 0].max() < 1.1


def test_unoriented_grain_equals_angle_zero(spark):
    grid = CartesianGrid((12, 12), (6, 6), (0.0, 0.0), (0.4, 0.4))
    fields = models.grain_fields([((2.4, 2.4), 1.5, 0.0)], 0.7)
    found = []
    for oriented in (False, True):
        model = models.ModelC(oriented=oriented)
        state = executor.advance(executor.fill_blocks(spark, grid, model.layout(), fields), grid, model, ForwardEuler(), 0.0, 0.01, 4) if not model.drivers else None
        found.append(executor.to_cells(state, grid, ["phi"]).toPandas().sort_values(["block_id", "cell"]).phi.to_numpy())
    assert (found[0] == found[1]).all()


def test_window_and_slab_stencils_agree(spark):
    grid = CartesianGrid.single_block((9, 7), (0.0, 0.0), (0.4, 0.3))
    values = np.random.default_rng(1).normal(size=(9, 7))
    cells = grid.cells(spark).withColumn("u", F.element_at(F.array(*[F.lit(float(x)) for x in values.ravel(order="F")]), (F.col("cell") + 1).cast("int")))
    lap = stencils.apply_laplacian(cells, grid, "u", Dirichlet(0.5)).toPandas()
    slab = np.pad(values, 1)
    stencils_at = {(0, -1): 1, (0, 1): 9, (1, -1): 1, (1, 1): 7}
    from lattica.operators.boundary import fill_faces

    fill_faces(slab, 1, Dirichlet(0.5), grid.spacing, stencils_at)
    assert np.abs(lap.lap - stencils.laplacian(slab, grid.spacing)[lap.i, lap.j]).max() < 1e-12
    shape = stencils.Anisotropy(0.06)
    wide = stencils.with_corners(cells, grid, "u").select("i", "j", shape.divergence_column("u", grid.spacing).alias("v"), shape.center_column("u").alias("a")).toPandas()
    edge = np.pad(values, 1, mode="edge")
    assert np.abs(wide.v - shape.divergence(edge, grid.spacing)[wide.i, wide.j]).max() < 1e-10
    assert np.abs(wide.a - shape.center(edge)[wide.i, wide.j]).max() < 1e-12
    assert (shape.divergence(edge, grid.spacing, np.zeros((9, 7))) == shape.divergence(edge, grid.spacing)).all()


def test_policies():
    grid = CartesianGrid((8, 8), (8, 8), (0.0, 0.0), (0.5, 0.5))
    u = np.random.default_rng(0).normal(size=(10, 10))
    for policy in (stencils.FiniteDifference(), stencils.FiniteVolume()):
        assert (stencils.stencil(policy, stencils.Laplacian(), grid)[1](u) == stencils.laplacian(u, grid.spacing)).all()
    assert stencils.stencil(stencils.FiniteVolume(), stencils.AnisotropicDivergence(0.06), grid)[0] == 1
    with pytest.raises(ValueError):
        stencils.stencil(stencils.FiniteDifference(), stencils.AnisotropicDivergence(0.06), grid)


def decay(spark, integrator, dt):
    sim = executor.Simulation(spark, CartesianGrid((1,), (1,), (0.0,), (1.0,)), models.CubicDecay(), integrator, {"u": lambda x: 1.0})
    sim.run(round(0.5 / dt), dt)
    return abs(sim.cells().first().u - 1 / math.sqrt(2))


def test_convergence_orders(spark):
    for rule, low, high in ((ForwardEuler(), 0.9, 1.1), (RungeKutta4(), 3.7, 4.3)):
        assert low < math.log2(decay(spark, rule, 0.02) / decay(spark, rule, 0.01)) < high
    assert decay(spark, EulerMaruyama(3), 0.02) == decay(spark, ForwardEuler(), 0.02)


def test_drivers_are_checked(spark):
    builder = StateBuilder()
    builder.register("w", 0, ("time",))
    with pytest.raises(ValueError):
        builder.layout().check((wiener(0),))
    with pytest.raises(ValueError):
        builder.layout().check((jump(0), wiener(0)))
    with pytest.raises(ValueError):
        builder.register("w")
    with pytest.raises(ValueError):
        ForwardEuler().check(models.StochasticVol())
    layout = models.JumpDiffusion().layout()
    assert layout.moved_by(jump(0)) == ["count", "jsum"] and layout["lam"].static and layout.dynamic == ["w", "count", "jsum"]
    assert substeps(1.0, 0.25) == 4 and substeps(2.5, 1.0) == 3 and substeps(0.1, 1.0) == 1


def test_square_root_variance(spark):
    mc = MonteCarlo(spark, models.StochasticVol(), EulerMaruyama(7), 40_000, 4_000, {"nu": lambda x: 2.0, "mid": lambda x: 100.0})
    mc.run(100, 0.01)
    row = mc.stats(F.col("nu")).first()
    assert row["count"] == 40_000 and abs(row["mean"] - (1 + math.exp(-1))) < 0.01 and row["min"] >= 0
    flat = mc.stats(F.lit(3.5)).first()
    assert (flat["mean"], flat["min"], flat["max"], flat["variance"]) == (3.5, 3.5, 3.5, 0)


def test_jumps(spark):
    mc = MonteCarlo(spark, models.JumpDiffusion(), EulerMaruyama(1), 50_000, 5_000, {"lam": lambda x: np.where(x < 25_000, 2.0, 0.0)})
    mc.run(100, 0.01)
    p = mc.paths().toPandas()
    hot = p[p.path_id < 25_000]
    assert abs(hot["count"].mean() - 100 * (1 - math.exp(-0.02))) < 0.04 and (p.jsum == 2 * p["count"]).all() and p[p.path_id >= 25_000]["count"].max() == 0


def test_path_rows_equal_block_rows(spark):
    from lattica.plans.paths import step_paths

    mc = MonteCarlo(spark, models.StochasticVol(), EulerMaruyama(5), 60, 20, {"nu": lambda x: 1 + x / 60, "mid": lambda x: 100.0})
    rows = mc.paths().select("block_id", "cell", "nu", "mid")
    plus = F.greatest(F.col("nu"), F.lit(0.0))
    rows = step_paths(rows, {"nu": F.lit(1.0) - plus, "mid": F.lit(0.0)}, {wiener(0): {"nu": F.lit(0.1) * F.sqrt(plus)}, wiener(1): {"mid": F.sqrt(plus)}}, {}, 0.0, 0.01, 5).toPandas().sort_values(["block_id", "cell"])
    mc.run(1, 0.01)
    want = mc.paths().toPandas().sort_values(["block_id", "cell"])
    assert np.abs(rows.nu.to_numpy() - want.nu.to_numpy()).max() < 1e-12 and np.abs(rows.mid.to_numpy() - want.mid.to_numpy()).max() < 1e-12


def test_market_maker(spark):
    model = models.MarketMaker()
    grid = CartesianGrid((16,), (16,), (0.001,), (1.999 / 16,))
    sim = executor.Simulation(spark, grid, model, ForwardEuler(), {})
    sim.run(1, 1e-3)
    zero = sim.cells().toPandas()[model.name(0)].to_numpy()
    floor = 1e-3 * sum(s.rate * math.exp(-s.decay * (s.half_spread + model.alpha)) / s.decay for s in (model.sell, model.buy))
    assert np.allclose(zero, floor, rtol=1e-14)
    even = models.MarketMaker(mu=0.0, sell=models.Side(1.5, 2, 0.004), buy=models.Side(1.5, 2, 0.004))
    sim = executor.Simulation(spark, CartesianGrid((32,), (16,), (0.001,), (1.999 / 32,)), even, ForwardEuler(), {})
    sim.run(30, even.stable_dt((1.999 / 32,)))
    p = sim.cells().toPandas()
    assert all(np.abs(p[even.name(q)] - p[even.name(-q)]).max() < 1e-12 for q in range(1, 6))
    flat = {q: 0.0 for q in range(-5, 6)}
    assert model.depths(flat, 0) == pytest.approx((0.514, 0.514)) and math.isinf(model.depths(flat, 5)[0]) and math.isinf(model.depths(flat, -5)[1])
    assert float(model.sell.fills(math.inf)) == 0 and model.num_levels == 11


def test_observers_see_projected_states_at_their_cadence(spark, tmp_path):
    grid = CartesianGrid((8,), (4,), (0.0,), (1.0,))
    sim = executor.Simulation(spark, grid, models.ClampedDecay(), ForwardEuler(), {"v": lambda x: 0.05})
    seen, closed = [], []
    field_stats = FieldStats({"v": 0.01}, 3)
    sink = ParquetSink(str(tmp_path / "out"), ["v"], every=2)
    sim.observe(Callback(lambda step, t, epoch, g, state: seen.append((step, executor.to_cells(state, g, ["v"]).agg(F.min("v")).first()[0])), 2, lambda: closed.append(1)))
    sim.observe(field_stats)
    sim.observe(sink)
    sim.run(5, 0.1)
    sim.finish()
    assert seen == [(1, 0.0), (2, 0.0), (4, 0.0)] and closed == [1]
    assert [r[0] for r in field_stats.found] == [1, 3] and field_stats.found[0][-1] == 0
    assert snapshot_steps(spark, str(tmp_path / "out")) == [1, 2, 4]
    rows = read_snapshots(spark, str(tmp_path / "out")).where("step = 4").collect()
    assert len(rows) == 8 and sorted(r.x for r in rows) == [n + 0.5 for n in range(8)]
    with pytest.raises(SinkError):
        ParquetSink(str(tmp_path), [])


def test_async_observer_drops_and_counts():
    import threading

    gate, got = threading.Event(), []

    class Slow:
        def observe(self, *snapshot):
            gate.wait(5)
            got.append(snapshot[0])

        def finish(self):
            got.append("finished")

    observer = AsyncObserver([Slow()], ring=1)
    for step in range(1, 6):
        observer.observe(step)
    gate.set()
    observer.finish()
    assert got[-1] == "finished" and len(got) - 1 + observer.dropped == 5 and observer.dropped >= 3


def test_reductions_and_frames(spark):
    grid = CartesianGrid.single_block((4, 4, 4), (0.0,) * 3, (1.0,) * 3)
    cells = grid.cells(spark).withColumn("u", F.col("x"))
    row = stats.field_stats(cells, "u", 1.5).first()
    assert (row["min"], row["max"], row["mean"], row["above"]) == (0.5, 3.5, 2.0, 0.5)
    assert {r.z for r in middle_plane(cells).collect()} == {2.5}
    assert stats.largest_error(cells, cells.withColumn("u", F.col("u") + 0.25), "u", ["i", "j", "k"]).first()[0] == 0.25


def test_fold_of_arrays(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 4.0])], "id long, v array<float>")
    assert diffuse_arrays(df, "v", 0.25, 1).first().v == pytest.approx([1.25, 2.25, 3.5])


def test_seed_placement(spark):
    rows = random_seeds(spark, 50, (20.0, 10.0), 1.0, 3, 0.4).collect()
    assert all(2 <= r.cx <= 18 and 2 <= r.cy <= 8 and 0 <= r.orientation <= math.pi / 2 for r in rows)
    assert [(r.cx, r.cy) for r in random_seeds(spark, 1, (20.0, 10.0), 1.0, 3, 0.4).collect()] == [(0.4, 0.4)]


def test_mixed_walls_keep_a_linear_profile(spark):
    grid = CartesianGrid((16, 16), (8, 8), (0.0, 0.0), (0.5, 0.5))
    walls = lambda dim, side: (Dirichlet(0.3) if side < 0 else Dirichlet(1.7)) if dim == 0 else Mirror()
    line = lambda x, y: 0.3 + 1.4 * x / 8.0
    sim = executor.Simulation(spark, grid, models.Heat(0.7, rule=walls), ForwardEuler(), {"u": line})
    sim.run(20, 0.25 * 0.25 / 0.7)
    p = sim.cells().toPandas()
    assert np.abs(p.u - (0.3 + 1.4 * (p.i + 0.5) * 0.5 / 8.0)).max() < 1e-11


def test_stream_of_events(spark, tmp_path):
    import datetime as dt

    rows = [(dt.datetime(2024, 1, 1, h, 5), "a", 1.0) for h in range(6)]
    spark.createDataFrame(rows, "ts timestamp, event_type string, value double").write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema("ts timestamp, event_type string, value double").parquet(str(tmp_path / "in"))
    query = binned_events(stream).writeStream.outputMode("append").format("memory").queryName("binned").start()
    query.processAllAvailable()
    query.stop()
    assert spark.sql("select * from binned").count() >= 4


def test_example_run_with_progress_and_snapshots(spark, tmp_path, capsys):
    from lattica.__main__ import main
    from lattica.sources.snapshots import frame, read_snapshots, snapshot_steps, value_range

    main(["--cells", "16", "--block", "8", "--steps", "4", "--every", "2", "--angle", "0.3", "--out", str(tmp_path / "run")])
    lines = [x for x in capsys.readouterr().err.splitlines() if "steps/s" in x]
    assert [x.split()[2] for x in lines] == ["1/4", "2/4", "4/4"] and "phi in [" in lines[-1]
    assert snapshot_steps(spark, str(tmp_path / "run")) == [1, 2, 4]
    assert read_snapshots(spark, str(tmp_path / "run")).count() == 3 * 256
    seen = frame(spark, str(tmp_path / "run"), 4, "phi")
    assert seen.count() == 256 and seen.columns == ["x", "y", "level", "phi"]
    low, high = value_range(spark, str(tmp_path / "run"), "phi").first()
    assert low <= seen.agg({"phi": "min"}).first()[0] and high >= seen.agg({"phi": "max"}).first()[0]
    with pytest.raises(KeyError):
        frame(spark, str(tmp_path / "run"), 3, "phi")


def test_sinks_reject_what_they_cannot_write():
    from types import SimpleNamespace

    from lattica.sources import snapshots

    with pytest.raises(snapshots.NoFields):
        snapshots.ParquetSink("x", [])
    with pytest.raises(snapshots.InvalidDimension):
        snapshots.ParquetSink("x", ["u"], grid=SimpleNamespace(dim=4))


def test_arm_length_within_a_wedge(spark):
    from lattica.operators import stats

    rows = [(3.0, 0.0, 1.0), (0.0, 5.0, 1.0), (-2.0, 0.1, 1.0), (9.0, 0.0, -1.0)]
    cells = spark.createDataFrame(rows, "x double, y double, phi double")
    got = cells.agg(stats.arm_length("phi", (0.0, 0.0), [0.0], 0.2).alias("a"), stats.arm_length("phi", (0.0, 0.0), [np.pi / 2, -np.pi], 0.2).alias("b"), stats.arm_length("phi", (0.0, 0.0), [np.pi / 4], 0.2).alias("c"), stats.solid_fraction().alias("s")).first()
    assert (got.a, got.b, got.c, got.s) == (3.0, 5.0, 0.0, 0.75)


def test_middle_plane_by_grid(spark):
    from lattica.sources.grid import CartesianGrid
    from lattica.sources.snapshots import middle_plane

    grid = CartesianGrid((4, 4, 5), (4, 4, 5), (0.0, 0.0, 1.0), (0.5, 0.5, 0.2))
    cells = grid.cells(spark)
    assert sorted(middle_plane(cells, "z", grid).collect()) == sorted(middle_plane(cells, "z").collect())
