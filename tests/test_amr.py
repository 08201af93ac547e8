import numpy as np
import pytest
from pyspark.sql import functions as F

from lattica.operators import relational as rel
from lattica.operators.cluster import ClusterParams
from lattica.plans import amr, models
from lattica.plans.amr import AmrSimulation, ForwardEuler, GradientTagger, Hierarchy, Regrid, Subcycling, restricted
from lattica.sources.grid import AmrGrid, CartesianGrid, CellBox


def gauss(x, y):
    return np.exp(-((x - 4) ** 2 + (y - 4) ** 2) / 0.4)


def run(policy, n=16, h=0.5):
    sim = AmrSimulation(amr.uniform((n, n), (n // 2, n // 2), h), models.Heat(0.7), ForwardEuler(), policy)
    sim.state.fill({"u": gauss})
    sim.run(60, 0.2 * 0.25**2 / 0.7)
    return sim


def test_adaptive_run_matches_published_errors():
    adaptive, coarse, fine = run(Regrid(GradientTagger("u", 0.05), 4, 2, ClusterParams(0.7, 2))), run(None), run(None, 32, 0.25)
    adaptive.state.restrict()
    want = restricted(fine.state.values[0]["u"], 2)
    assert abs(np.abs(adaptive.state.values[0]["u"] - want).max() - 0.0016809) < 1e-6
    assert abs(np.abs(coarse.state.values[0]["u"] - want).max() - 0.003716) < 1e-6
    assert adaptive.peak == 400


def test_linear_fields_pass_levels_exactly():
    grid = AmrGrid(CartesianGrid((8, 8), (4, 4), (0.0, 0.0), (0.5, 0.5)), (2,), ((CellBox((4, 4), (8, 12)), CellBox((8, 4), (12, 12))),))
    h = Hierarchy(grid, models.Heat())
    line = lambda x, y: 3 * x + 2 - y
    h.fill({"u": line})
    h.values[0]["u"][2:4, 2:6] = 99
    h.restrict()
    at = h.centers(0)
    assert np.abs(h.values[0]["u"] - line(*at)).max() < 1e-12
    around, at = h.around(1, "u"), h.centers(1)
    ring = np.s_[3:13, 3:13]
    assert np.abs(around[ring] - line(*at)[ring]).max() < 1e-12


def test_full_tiling_equals_a_uniform_grid_under_subcycling():
    base = amr.uniform((8, 8), (4, 4), 1.0).base
    tiled = AmrGrid(base, (2,), ((CellBox((0, 0), (8, 16)), CellBox((8, 0), (16, 16))),))
    field = lambda x, y: np.cos(0.6 * x) + np.sin(1.1 * y)
    a = AmrSimulation(tiled, models.Heat(0.7), Subcycling())
    b = AmrSimulation(amr.uniform((16, 16), (8, 8), 0.5), models.Heat(0.7), ForwardEuler())
    for sim in (a, b):
        sim.state.fill({"u": field})
    dt = 0.5 * a.stable_dt()
    a.run(25, dt)
    b.run(100, dt / 4)
    assert np.abs(a.state.values[1]["u"] - b.state.values[0]["u"]).max() < 1e-12


def test_migration_keeps_values():
    line = lambda x, y: 3 * x + 2 - y
    boxes = iter([CellBox((2, 2), (6, 6)), CellBox((4, 4), (8, 8))])

    def tag(h, level):
        box, flags = next(boxes), np.zeros(h.mask[level].shape, bool)
        flags[tuple(slice(a, b) for a, b in zip(box.lo, box.hi, strict=True))] = True
        return flags

    sim = AmrSimulation(amr.uniform((16, 16), (8, 8), 0.5), models.Heat(0.0), ForwardEuler(), Regrid(tag, 1, 0, ClusterParams(0.7, 2)))
    sim.state.fill({"u": line})
    sim.run(2, 0.01)
    assert sim.grid.boxes == ((CellBox((8, 8), (16, 16)),),) and sim.epoch == 2
    at = sim.state.centers(1)
    assert np.abs(sim.state.values[1]["u"] - line(*at))[8:16, 8:16].max() < 1e-12


def test_policies_that_keep_or_reject(spark):
    grid = amr.uniform((16, 16), (8, 8), 0.5)
    assert amr.acceptable(grid, []) and not amr.acceptable(grid, [[CellBox((8, 8), (16, 16))]])
    h = Hierarchy(grid, models.Heat())
    assert amr.regrid(h, Regrid(GradientTagger("u", 0.1), every=4), 3) is None
    with pytest.raises(KeyError):
        amr.regrid(h, Regrid(GradientTagger("nope", 0.1)), 0)


def test_relational_operators_agree_with_arrays(spark):
    grid = CartesianGrid((8, 6), (4, 3), (0.0, 0.0), (1.0, 1.0))
    values = np.random.default_rng(2).normal(size=(8, 6))
    cells = spark.createDataFrame([(int(i), int(j), float(values[i, j])) for i in range(8) for j in range(6)], "i long, j long, u double")
    wanted = CartesianGrid.single_block((16, 12), (0.0, 0.0), (0.5, 0.5)).cells(spark).select("i", "j")
    fine = rel.prolong(cells, wanted, "u", 2, (8, 6)).toPandas()
    assert np.abs(fine.u - amr.prolonged(values, 2)[fine.i, fine.j]).max() < 1e-12
    means = rel.restrict(cells, "u", 2).toPandas()
    assert np.abs(means.u - restricted(values, 2)[means.i, means.j]).max() < 1e-12
    flags = {(r.i, r.j) for r in rel.gradient_flags(cells, grid, "u", 0.8).collect()}
    wide = np.pad(values, 1, mode="edge")
    steep = np.maximum(np.abs(wide[2:, 1:-1] - wide[:-2, 1:-1]), np.abs(wide[1:-1, 2:] - wide[1:-1, :-2])) / 2 > 0.8
    assert flags == {tuple(map(int, c)) for c in np.argwhere(steep)}


def test_nesting_flags_match_boxes(spark):
    box = CellBox((8, 4), (16, 12))
    need = box.coarsened(2).grown(1).coarsened(2)
    rows = rel.nesting_flags(spark.createDataFrame([(list(box.lo), list(box.hi))], "lo array<long>, hi array<long>"), 2, 2).collect()
    assert {(r.i, r.j) for r in rows} == set(need)


def test_studies_run_in_parallel(spark):
    from lattica.queries import study

    studies = spark.range(3).withColumnRenamed("id", "study").repartition(3)
    out = amr.run_hierarchies(studies, study, 4, lambda sim, row: 0.2 * 0.25**2 / 0.7, ["u"]).cache()
    assert out.select("study").distinct().count() == 3
    assert out.where("level = 0").groupBy("study").count().where("count = 256").count() == 3
    assert out.agg(F.max("u")).first()[0] <= 1.0


def test_three_levels_under_subcycling_equal_a_plain_recursion():
    """A lower level keeps its own half-advanced state until its substeps end: only the next level is restricted."""
    base = amr.uniform((16, 16), (8, 8), 0.5).base
    grid = AmrGrid(base, (2, 2), ((CellBox((8, 8), (24, 24)),), (CellBox((24, 24), (40, 40)),)))
    model = models.Heat(0.7)
    sim = AmrSimulation(grid, model, Subcycling())
    sim.state.fill({"u": gauss})
    u = [v["u"].copy() for v in sim.state.values]
    mask = [m.copy() for m in sim.state.mask]
    h = [0.5, 0.25, 0.125]

    def laplacian(x, h):
        wide = np.pad(x, 1, mode="edge")
        return sum((np.roll(wide, 1, d) - 2 * wide + np.roll(wide, -1, d))[1:-1, 1:-1] for d in (0, 1)) / h**2

    def view(level, before=None, alpha=1.0):
        if not level:
            return u[0]
        below = view(level - 1)
        if before is not None:
            below = np.where(mask[level - 1], (1 - alpha) * before[level - 1] + alpha * u[level - 1], below)
        return np.where(mask[level], u[level], amr.prolonged(below, 2))

    def advance(level, dt, before=None, alpha=1.0):
        old = [x.copy() for x in u]
        u[level] = u[level] + dt * 0.7 * laplacian(view(level, before, alpha), h[level])
        if level < 2:
            for s in range(4):
                advance(level + 1, dt / 4, old, s / 4)
            covered = restricted(mask[level + 1].astype(float), 2) == 1
            u[level] = np.where(covered, restricted(u[level + 1], 2), u[level])

    dt = 0.5 * sim.stable_dt()
    sim.run(5, dt)
    for _ in range(5):
        advance(0, dt)
    for level in range(3):
        assert np.abs((sim.state.values[level]["u"] - u[level])[mask[level]]).max() < 1e-12


def test_dilation_equals_boxes_around_cells():
    flags = np.random.default_rng(3).random((9, 7)) < 0.1
    want = np.zeros_like(flags)
    for i, j in np.argwhere(flags):
        want[max(i - 2, 0) : i + 3, max(j - 2, 0) : j + 3] = True
    assert (amr.dilated(flags, 2) == want).all() and (amr.dilated(flags, 0) == flags).all()


def test_boxes_of_a_table_equal_boxes_of_arrays(spark):
    from lattica.operators.cluster import cluster, cluster_table

    rng = np.random.default_rng(5)
    cells = [(level, int(i), int(j)) for level in (0, 3) for i, j in rng.integers(0, 20, (40, 2))]
    rows = cluster_table(spark.createDataFrame(cells, "level int, i long, j long"), ClusterParams(0.7, 2)).collect()
    for level in (0, 3):
        want = {(b.lo, b.hi, b.cells) for b in cluster([c[1:] for c in cells if c[0] == level], ClusterParams(0.7, 2))}
        assert {(tuple(r.lo), tuple(r.hi), r.cells) for r in rows if r.level == level} == want


def test_grains_pruned_by_tiles_equal_all_grains(spark):
    rng = np.random.default_rng(7)
    grains = [(int(k), float(x), float(y), float(r), float(k)) for k, (x, y, r) in enumerate(zip(rng.uniform(0, 40, 60), rng.uniform(0, 40, 60), rng.uniform(0.5, 4, 60), strict=True))]
    cells = spark.createDataFrame([(i, j, i + 0.5, j + 0.5) for i in range(40) for j in range(40)], "i long, j long, x double, y double")
    table = spark.createDataFrame(grains, "grain_id long, cx double, cy double, radius double, orientation double")
    g = np.array(grains)
    for side in (None, 3.0, 100.0):
        for r in rel.grain_profile(cells, table, side).collect():
            d2 = (r.x - g[:, 1]) * (r.x - g[:, 1]) + (r.y - g[:, 2]) * (r.y - g[:, 2])
            assert r.grain == int(np.argmin(d2)) and r.theta0 == float(r.grain)
            assert abs(r.phi - max(-1.0, (-np.tanh((np.sqrt(d2) - g[:, 3]) / np.sqrt(2))).max())) < 1e-12
    met = rel.near_grains(cells, table, 3.0).count()
    assert met < 0.2 * 196 * 60


def test_outlines_of_unequal_spacings_and_thin_patches(spark):
    rows = [(0, 0, 1.0 + 2 * i, 0.25 + 0.5 * j) for i in range(4) for j in range(3)] + [(1, 1, 0.5, 0.5 + j) for j in range(2)]
    cells = spark.createDataFrame(rows, "level int, block_id int, x double, y double")
    found = {r.block_id: (r.x0, r.x1, r.y0, r.y1) for r in rel.patch_outlines(cells).collect()}
    assert found == {0: (0.0, 8.0, 0.0, 1.5), 1: (0.0, 1.0, 0.0, 2.0)}


def test_copied_and_filled_fields(spark):
    cells = spark.createDataFrame([(0, 1.0, 2.0), (1, 3.0, 4.0)], "i long, a double, b double")
    other = spark.createDataFrame([(1, 7.0, 8.0)], "i long, a double, b double")
    assert sorted(rel.copied(cells, other, ["a"], ["i"]).collect()) == [(0, 1.0, 2.0), (1, 7.0, 4.0)]
    assert sorted(rel.filled(cells, ["b"]).collect()) == [(0, 1.0, 0.0), (1, 3.0, 0.0)]
    assert rel.of_level(cells.withColumn("level", F.col("i")), 1).count() == 1
    assert models.ModelC(oriented=True).layout().ghost_widths == [1]


def test_ring_in_three_dimensions(spark):
    patch = spark.createDataFrame([(0, [1, 2, 3], [3, 3, 5])], "block_id int, lo array<long>, hi array<long>")
    rows = [(r.i, r.j, r.k) for r in rel.ghost_ring(patch, 1, 3).collect()]
    assert len(rows) == len(set(rows)) == 4 * 3 * 4 - 2 * 1 * 2
