import math
import random

import numpy as np
import pytest

from lattica.functions import rng
from lattica.operators.boundary import Dirichlet, Extrapolate, Flux, Mirror, check_width, fill_faces, reflect
from lattica.operators.cluster import ClusterParams, cluster
from lattica.sources.grid import AmrGrid, CartesianGrid, CellBox, GridError, covered, linear, path_grid


@pytest.mark.parametrize("args", [((0,), (1,), (0.0,), (1.0,)), ((10,), (3,), (0.0,), (1.0,)), ((4,), (2,), (0.0,), (-1.0,)), ((4,), (2,), (0.0,), (math.nan,)), ((4, 4), (2,), (0.0, 0.0), (1.0, 1.0))])
def test_bad_grids_are_rejected(args):
    with pytest.raises(GridError):
        CartesianGrid(*args)


def test_topology():
    g = CartesianGrid((8, 6), (4, 3), (0.0, 1.0), (0.5, 0.25), (True, False))
    assert g.num_blocks == 4 and g.block_len == 12 and g.block_coords(3) == (1, 1) and g.block_id((1, 0)) == 1
    assert g.neighbor(0, 0, -1) == 1 and g.neighbor(0, 1, -1) is None and g.neighbor(0, 1, 1) == 2
    assert g.center(3, (0, 2)) == (0.0 + 4.5 * 0.5, 1.0 + 5.5 * 0.25)
    assert g.cell_key((3, 2)) == 11 and g.cell_key((-1, 0)) is None and linear((-1, -1), (4, 3), 1) == 0
    assert list(CellBox((0, 0), (2, 2))) == [(0, 0), (1, 0), (0, 1), (1, 1)] and list(CellBox((1,), (1,))) == []


def test_cell_table(spark):
    g = CartesianGrid((8, 6, 4), (4, 3, 2), (0.0, 1.0, 2.0), (0.5, 0.25, 1.0))
    rows = g.cells(spark).collect()
    assert len(rows) == 192 and len({(r.block_id, r.cell) for r in rows}) == 192
    for r in rows:
        at = [c * n for c, n in zip(g.block_coords(r.block_id), g.block_cells, strict=True)]
        index = (r.i - at[0], r.j - at[1], r.k - at[2])
        assert g.cell_key(index) == r.cell and g.center(r.block_id, index) == pytest.approx((r.x, r.y, r.z))
    found = {(r.block_id, r.dim, r.side): r.neighbor for r in g.neighbors(spark).collect()}
    assert all(found[b, d, s] == g.neighbor(b, d, s) for b, d, s in found) and len(found) == g.num_blocks * 6
    assert path_grid(100, 25).num_blocks == 4


BASE = CartesianGrid((8, 8), (4, 4), (0.0, 0.0), (0.5, 0.5))


@pytest.mark.parametrize("boxes", [(((4, 4), (8, 12)), ((6, 4), (12, 12))), (((5, 4), (8, 12)),), (((4, 4), (4, 12)),), (((4, 4), (8, 40)),)])
def test_bad_hierarchies_are_rejected(boxes):
    with pytest.raises(GridError):
        AmrGrid(BASE, (2,), (tuple(CellBox(a, b) for a, b in boxes),))


def test_nesting_and_ratio():
    inner = CellBox((16, 16), (24, 24))
    with pytest.raises(GridError):
        AmrGrid(BASE, (2, 2), ((CellBox((8, 8), (12, 12)),), (inner,)))
    with pytest.raises(GridError):
        AmrGrid(BASE, (1,))
    g = AmrGrid(BASE, (2, 2), ((CellBox((4, 4), (16, 16)),), (inner,)))
    assert g.num_levels == 3 and g.spacing_at(2) == (0.125, 0.125) and g.find_patch(2, (17, 17)) == 5 and g.find_patch(1, (0, 0)) is None
    assert covered(CellBox((0, 0), (4, 4)), [CellBox((0, 0), (4, 2)), CellBox((0, 2), (4, 4))]) and not covered(CellBox((0, 0), (4, 5)), [CellBox((0, 0), (4, 4))])


def test_amr_cells(spark):
    g = AmrGrid(BASE, (2,), ((CellBox((4, 4), (8, 12)),),))
    rows = g.cells(spark).collect()
    assert len(rows) == 64 + 32 and all(g.find_patch(r.level, (r.i, r.j)) == r.block_id for r in rows)
    assert all(g.center(r.level, (r.i, r.j)) == pytest.approx((r.x, r.y)) for r in rows)


@pytest.mark.parametrize("flags", [[(i, j) for i in range(3, 9) for j in range(2, 6)], [(i, j) for a in (0, 12) for i in range(a, a + 4) for j in range(4)], [(i, j) for i in range(12) for j in range(12) if i < 3 or j < 3], [(i, i) for i in range(16)], [(i, j, k) for a in (0, 9) for i in range(a, a + 3) for j in range(3) for k in range(3)], []])
def test_clusters_cover_and_are_disjoint(flags):
    boxes = cluster(flags, ClusterParams(0.7, 2))
    assert all(sum(b.contains(c) for b in boxes) == 1 for c in flags)
    assert all(not a.intersects(b) for n, a in enumerate(boxes) for b in boxes[:n])
    mixed = list(flags)
    random.Random(1).shuffle(mixed)
    assert cluster(mixed, ClusterParams(0.7, 2)) == boxes


def test_clusters_split_at_holes():
    flags = [(i, j) for a in (0, 12) for i in range(a, a + 4) for j in range(4)]
    assert cluster(flags) == [CellBox((0, 0), (4, 4)), CellBox((12, 0), (16, 4))]
    with pytest.raises(ValueError):
        ClusterParams(0.0, 1)


def test_boundary_rules():
    u = np.array([1.0, 2.0, 4.0, 8.0])
    for rule, low, high in ((Mirror(), [2, 1], [8, 4]), (Dirichlet(2.5), [3, 4], [-3, 1]), (Flux(1.5), [2 + 3 * 0.5 * 1.5, 1 + 0.75], [8.75, 4 + 2.25]), (Extrapolate(), [-1, 0], [12, 16])):
        slab = np.pad(u, 2)
        fill_faces(slab, 2, rule, (0.5,), {(0, -1): 2, (0, 1): 5})
        assert slab[:2].tolist() == pytest.approx(low) and slab[-2:].tolist() == pytest.approx(high)
    assert [reflect(c, 0, 4) for c in (-2, -1, 0, 3, 4, 5)] == [1, 0, 0, 3, 3, 2]
    with pytest.raises(ValueError):
        check_width(5, (4, 8))


def test_randomness_is_a_function_of_its_key():
    assert int(rng.splitmix(np.uint64(0))) == 16294208416658607535
    keys = rng.mix_key(1234, [np.arange(200_000, dtype=np.uint64)])
    z = rng.standard_normal(keys)
    assert abs(z.mean()) < 0.01 and abs(z.var() - 1) < 0.02
    u = rng.unit_open(keys)
    assert u.min() > 0 and u.max() <= 1
    assert rng.stream_tag(rng.WIENER, 3) == (1 << 32) | 3 and rng.signed(2**64 - 1) == -1 and rng.time_bits(0.0) == 0


def test_column_randomness_equals_numpy(spark):
    from pyspark.sql import functions as F

    df = spark.range(500).withColumn("p", F.col("id") * 7919 - 500000)
    df = rng.with_normal(rng.with_key(df, "k", 42, [3, F.col("p"), F.col("id")]), "z", "k").withColumn("u", rng.unit_open_col(F.col("k")))
    p = df.toPandas()
    keys = rng.mix_key(42, [3, p.p.to_numpy().view(np.uint64), p.id.to_numpy().astype(np.uint64)])
    assert (keys.view(np.int64) == p.k).all() and (rng.unit_open(keys) == p.u).all()
    assert np.abs(rng.standard_normal(keys) - p.z).max() < 1e-14


@pytest.mark.parametrize("periodic", [False, True])
def test_a_line_in_pieces(spark, monkeypatch, periodic):
    from lattica.operators import stencils
    from lattica.operators.boundary import Extrapolate

    u = np.random.default_rng(4).normal(size=23)
    grid = CartesianGrid((23,), (23,), (0.0,), (0.5,), (periodic,))
    cells = spark.createDataFrame([(i, float(x)) for i, x in enumerate(u)], "i long, u double")
    faces = None if periodic else {(0, -1): Extrapolate(), (0, 1): Extrapolate()}
    wide = np.concatenate([[u[-1]], u, [u[0]]]) if periodic else np.concatenate([[2 * u[0] - u[1]], u, [2 * u[-1] - u[-2]]])
    for piece in (1 << 16, 11, 4, 22):
        monkeypatch.setattr(stencils, "PIECE", piece)
        rows = {r.i: (r.u_m0, r.u_p0) for r in stencils.with_neighbors(cells, grid, "u", faces).collect()}
        assert len(rows) == 23 and all(abs(rows[i][0] - wide[i]) < 1e-12 and abs(rows[i][1] - wide[i + 2]) < 1e-12 for i in range(23))
