"""The registered queries of the simulation engine and their SQL.

Initial data come from the tables: events binned to a grid of 30 days by 24 hours, customers and orders as
paths, suppliers as grains, embeddings as independent fields. Results are rounded to nine digits or fewer,
since the two engines' mathematical functions differ in the last ones.
"""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from lattica.functions import quotes, rng
from lattica.operators import relational as rel
from lattica.operators import stats, stencils
from lattica.operators.boundary import Dirichlet, Extrapolate, Flux
from lattica.operators.cluster import ClusterParams, cluster_table
from lattica.plans import amr, executor, integrators, models, paths
from lattica.plans.montecarlo import diffuse_arrays, random_seeds
from lattica.plans.schema import jump, wiener
from lattica.sources.grid import AmrGrid, CartesianGrid, CellBox

GRID = CartesianGrid((30, 24), (10, 8), (0.0, 0.0), (1.0, 0.5))
RING = CartesianGrid((30, 24), (10, 8), (0.0, 0.0), (1.0, 0.5), (True, True))
SEED = 42

Query = Callable[[SparkSession, str], DataFrame]
QUERIES: dict[str, Query] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f: Query) -> Query:
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def field(spark: SparkSession, sf_dir: str, grid: CartesianGrid = GRID) -> DataFrame:
    """Grid cells with u, the events' value by day and hour."""
    events = table(spark, sf_dir, "events")
    bins = events.groupBy(F.datediff(F.to_date("ts"), F.lit("2024-01-01")).cast("long").alias("i"), F.hour("ts").cast("long").alias("j")).agg(F.round(F.sum("value"), 6).alias("u"))
    return grid.cells(spark).join(bins, ["i", "j"], "left").withColumn("u", F.coalesce("u", F.lit(0.0)))


BASE = """WITH bins AS (SELECT CAST(date_diff('day', DATE '2024-01-01', CAST(ts AS DATE)) AS BIGINT) AS i, CAST(hour(ts) AS BIGINT) AS j,
  round(sum(value), 6) AS u FROM events GROUP BY 1, 2),
g AS (SELECT a.i, b.j, a.i // 10 + 3 * (b.j // 8) AS block_id, a.i % 10 + 10 * (b.j % 8) AS cell, (a.i + 0.5) * 1.0 AS x, (b.j + 0.5) * 0.5 AS y,
  coalesce(bins.u, 0.0) AS u
  FROM (SELECT unnest(range(30)) AS i) a CROSS JOIN (SELECT unnest(range(24)) AS j) b LEFT JOIN bins ON bins.i = a.i AND bins.j = b.j)"""
XM, XP = "lag({f}) OVER (PARTITION BY j ORDER BY i)", "lead({f}) OVER (PARTITION BY j ORDER BY i)"
YM, YP = "lag({f}) OVER (PARTITION BY i ORDER BY j)", "lead({f}) OVER (PARTITION BY i ORDER BY j)"


def sides(f: str = "u", low_x="{f}", high_x="{f}", low_y="{f}", high_y="{f}") -> str:
    """SQL columns xm, xp, ym, yp with the given values past each face."""
    parts = [("xm", XM, low_x), ("xp", XP, high_x), ("ym", YM, low_y), ("yp", YP, high_y)]
    return ", ".join(f"coalesce({w.format(f=f)}, {v.format(f=f)}) AS {n}" for n, w, v in parts)


LAP = "((xp - (u + u) + xm) * 1.0 + (yp - (u + u) + ym) * 4.0)"


def lap_sql(**past) -> str:
    return f"{BASE}, n AS (SELECT *, {sides(**past)} FROM g) SELECT i, j, round({LAP}, 6) AS lap FROM n"


ALL = "ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING"


def lap(spark, sf_dir, faces=None, grid=GRID):
    return stencils.apply_laplacian(field(spark, sf_dir, grid), grid, "u", faces).select("i", "j", F.round("lap", 6).alias("lap"))


@query(f"{BASE} SELECT i, j, block_id, cell, x, y, u FROM g")
def grid_scan(spark, sf_dir):
    return field(spark, sf_dir).select("i", "j", "block_id", "cell", "x", "y", "u")


@query("""WITH b AS (SELECT unnest(range(9)) AS block_id), f AS (SELECT block_id, d AS dim, s AS side, block_id % 3 AS b_col, block_id // 3 AS b_row
  FROM b CROSS JOIN (VALUES (0, -1), (0, 1), (1, -1), (1, 1)) v(d, s))
SELECT block_id, CAST(dim AS INTEGER) AS dim, CAST(side AS INTEGER) AS side, CASE WHEN dim = 0 AND b_col + side BETWEEN 0 AND 2 THEN block_id + side
  WHEN dim = 1 AND b_row + side BETWEEN 0 AND 2 THEN block_id + 3 * side END AS neighbor FROM f""")
def block_neighbors(spark, sf_dir):
    return GRID.neighbors(spark)


@query(f"""{BASE} SELECT round(min(u), 6) AS "min", round(max(u), 6) AS "max", round(avg(u), 6) AS mean,
  round(count(*) FILTER (u > 100.0) / CAST(count(*) AS DOUBLE), 9) AS above FROM g""")
def field_stats(spark, sf_dir):
    s = stats.field_stats(field(spark, sf_dir), "u", 100.0)
    return s.select(F.round("min", 6).alias("min"), F.round("max", 6).alias("max"), F.round("mean", 6).alias("mean"), F.round("above", 9).alias("above"))


@query(lap_sql())
def laplacian_mirror(spark, sf_dir):
    return lap(spark, sf_dir)


@query(lap_sql(low_x="2.0 * 5.0 - {f}", high_x="2.0 * 5.0 - {f}", low_y="2.0 * 5.0 - {f}", high_y="2.0 * 5.0 - {f}"))
def laplacian_dirichlet(spark, sf_dir):
    return lap(spark, sf_dir, Dirichlet(5.0))


@query(lap_sql(low_x="{f} + 1.0 * 1.5", high_x="{f} + 1.0 * 1.5", low_y="{f} + 0.5 * 1.5", high_y="{f} + 0.5 * 1.5"))
def laplacian_flux(spark, sf_dir):
    return lap(spark, sf_dir, Flux(1.5))


@query(lap_sql(low_x=f"2.0 * {{f}} - {XP}", high_x=f"2.0 * {{f}} - {XM}", low_y=f"2.0 * {{f}} - {YP}", high_y=f"2.0 * {{f}} - {YM}"))
def laplacian_extrapolate(spark, sf_dir):
    return lap(spark, sf_dir, Extrapolate())


@query(lap_sql(low_x=f"last_value({{f}}) OVER (PARTITION BY j ORDER BY i {ALL})", high_x=f"first_value({{f}}) OVER (PARTITION BY j ORDER BY i {ALL})", low_y=f"last_value({{f}}) OVER (PARTITION BY i ORDER BY j {ALL})", high_y=f"first_value({{f}}) OVER (PARTITION BY i ORDER BY j {ALL})"))
def laplacian_periodic(spark, sf_dir):
    return lap(spark, sf_dir, None, RING)


@query(lap_sql(low_x="2.0 * 5.0 - {f}", high_x="{f} + 1.0 * 1.5"))
def laplacian_mixed_faces(spark, sf_dir):
    return lap(spark, sf_dir, {(0, -1): Dirichlet(5.0), (0, 1): Flux(1.5)})


def heat_sql(steps: int, rate: float) -> str:
    text = BASE + ", s0 AS (SELECT i, j, u FROM g)"
    for n in range(steps):
        text += f", n{n} AS (SELECT *, {sides()} FROM s{n}), s{n + 1} AS (SELECT i, j, u + {rate!r} * (1.0 * {LAP}) AS u FROM n{n})"
    return f"{text} SELECT i, j, round(u, 6) AS u FROM s{steps}"


@query(heat_sql(1, 0.05))
def heat_step(spark, sf_dir):
    wide = stencils.with_neighbors(field(spark, sf_dir), GRID, "u")
    moved = rel.axpy(wide.withColumn("du", stencils.laplacian_column(GRID, "u")), "u", "du", 0.05)
    return moved.select("i", "j", F.round("u", 6).alias("u"))


def engine(spark, sf_dir, model, integrator, steps, dt, fields=None, grid=GRID):
    cells = field(spark, sf_dir, grid)
    for name, expr in (fields or {}).items():
        cells = cells.withColumn(name, expr)
    names = model.layout().names
    state = executor.advance(executor.to_blocks(cells, names), grid, model, integrator, 0.0, dt, steps)
    return executor.to_cells(state, grid, names)


@query(heat_sql(10, 0.05))
def heat_10_steps(spark, sf_dir):
    cells = engine(spark, sf_dir, models.Heat(1.0), integrators.ForwardEuler(), 10, 0.05)
    return cells.select("i", "j", F.round("u", 6).alias("u"))


def rk4_sql(dt: float) -> str:
    text = BASE + f", k1 AS (SELECT *, {LAP} AS d1 FROM (SELECT i, j, u AS u0, u, {sides()} FROM g))"
    for n, h in ((2, 0.5 * dt), (3, 0.5 * dt), (4, dt)):
        keep = ", ".join(f"d{m}" for m in range(1, n))
        text += f", m{n} AS (SELECT i, j, u0, {keep}, u0 + {h!r} * d{n - 1} AS u FROM k{n - 1}), k{n} AS (SELECT *, {LAP} AS d{n} FROM (SELECT *, {sides()} FROM m{n}))"
    return f"{text} SELECT i, j, round(u0 + {dt / 6!r} * d1 + {dt / 3!r} * d2 + {dt / 3!r} * d3 + {dt / 6!r} * d4, 6) AS u FROM k4"


@query(rk4_sql(0.05))
def heat_rk4_step(spark, sf_dir):
    cells = engine(spark, sf_dir, models.Heat(1.0), integrators.RungeKutta4(), 1, 0.05)
    return cells.select("i", "j", F.round("u", 6).alias("u"))


@query(f"""{BASE}, w AS (SELECT 1 AS side, block_id, j, i - 10 * (block_id % 3) AS k, u FROM g WHERE i % 10 >= 8 AND i < 20
  UNION ALL SELECT -1, block_id, j, i - 10 * (block_id % 3), u FROM g WHERE i % 10 < 2 AND i >= 10)
SELECT block_id + side AS block_id, CAST(CASE WHEN side = 1 THEN k - 10 ELSE k + 10 END AS BIGINT) AS ghost, j, u FROM w""")
def halo_exchange(spark, sf_dir):
    cells = field(spark, sf_dir).withColumn("k", F.pmod("i", F.lit(10)))
    faces = GRID.neighbors(spark).where("dim = 0 and neighbor is not null").select("block_id", "side", "neighbor")
    strips = cells.where("k >= 8 or k < 2").join(faces, "block_id").where((F.col("side") == 1) & (F.col("k") >= 8) | (F.col("side") == -1) & (F.col("k") < 2))
    return strips.select(F.col("neighbor").alias("block_id"), (F.col("k") - 10 * F.col("side")).cast("long").alias("ghost"), "j", "u")


@query("""WITH RECURSIVE s AS (SELECT vec_id, 0 AS n, list_transform(embedding, lambda x: CAST(x AS DOUBLE)) AS u FROM embeddings
  UNION ALL SELECT vec_id, n + 1, list_transform(range(1, len(u) + 1), lambda k: u[k] + 0.2 * (u[least(k + 1, len(u))] - (u[k] + u[k]) + u[greatest(k - 1, 1)])) FROM s WHERE n < 5)
SELECT vec_id, round(u[1], 9) AS first, round(u[32], 9) AS middle, round(u[len(u)], 9) AS last FROM s WHERE n = 5""")
def embedding_diffusion(spark, sf_dir):
    out = diffuse_arrays(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), "embedding", 0.2, 5)
    return out.select("vec_id", *[F.round(F.element_at("embedding", k), 9).alias(n) for k, n in ((1, "first"), (32, "middle"), (-1, "last"))])


THRESHOLD = 60.0
FLAGS = f"{BASE}, n AS (SELECT *, {sides()} FROM g), flags AS (SELECT i, j FROM n WHERE greatest(abs(xp - xm) / 2.0, abs(yp - ym) / 2.0) > {THRESHOLD})"


def flags(spark, sf_dir):
    return rel.gradient_flags(field(spark, sf_dir), GRID, "u", THRESHOLD)


@query(f"{FLAGS} SELECT i, j FROM flags")
def gradient_tags(spark, sf_dir):
    return flags(spark, sf_dir)


@query(f"{FLAGS} SELECT DISTINCT g.i, g.j FROM g JOIN flags f ON abs(g.i - f.i) <= 2 AND abs(g.j - f.j) <= 2")
def tag_dilate(spark, sf_dir):
    return rel.dilate(flags(spark, sf_dir), 2, GRID.cells_per_dim)


@query(f"""{FLAGS}, p AS (SELECT CAST(0 AS INTEGER) AS axis, i AS plane FROM flags UNION ALL SELECT 1, j FROM flags),
  every AS (SELECT axis, unnest(range(min(plane), max(plane) + 1)) AS plane FROM p GROUP BY axis)
  SELECT e.axis, e.plane, count(p.plane) AS n FROM every e LEFT JOIN p ON p.axis = e.axis AND p.plane = e.plane GROUP BY e.axis, e.plane""")
def flag_signatures(spark, sf_dir):
    return rel.signatures(flags(spark, sf_dir))


@query(f"{FLAGS} SELECT i, j FROM flags UNION SELECT i, j FROM g WHERE i < 3 UNION SELECT i, j FROM flags")
def flag_union(spark, sf_dir):
    found = flags(spark, sf_dir)
    return rel.flag_union(found, GRID.cells(spark).where("i < 3"), found)


@query("""SELECT b AS block_id, i, j FROM (SELECT 9 AS b, 4 AS i0, 8 AS i1, 1 AS j0, 3 AS j1 UNION ALL SELECT 10, 0, 2, 0, 5) p, (SELECT unnest(range(-2, 12)) AS i) x, (SELECT unnest(range(-2, 12)) AS j) y
  WHERE i >= i0 - 2 AND i < i1 + 2 AND j >= j0 - 2 AND j < j1 + 2 AND NOT (i >= i0 AND i < i1 AND j >= j0 AND j < j1)""")
def ghost_ring(spark, sf_dir):
    patches = spark.createDataFrame([(9, [4, 1], [8, 3]), (10, [0, 0], [2, 5])], "block_id int, lo array<long>, hi array<long>")
    return rel.ghost_ring(patches, 2)


@query(f"{FLAGS} SELECT min(i) AS i_lo, max(i) + 1 AS i_hi, min(j) AS j_lo, max(j) + 1 AS j_hi, count(*) AS n, round(count(*) / CAST((max(i) + 1 - min(i)) * (max(j) + 1 - min(j)) AS DOUBLE), 9) AS efficiency FROM flags")
def flag_bbox(spark, sf_dir):
    box = rel.bounding_box(flags(spark, sf_dir))
    return box.withColumn("efficiency", F.round("efficiency", 9))


@query(f"{FLAGS}, core AS (SELECT i, j FROM flags WHERE i % 3 = 0) SELECT i, j FROM flags EXCEPT SELECT i, j FROM core")
def tag_coverage(spark, sf_dir):
    found = flags(spark, sf_dir)
    return rel.uncovered(found, found.where("i % 3 = 0"))


BOXES = [([8, 4], [16, 12]), ([20, 12], [28, 20])]


@query("""WITH b AS (SELECT * FROM (VALUES (8, 4, 16, 12), (20, 12, 28, 20)) v(x0, y0, x1, y1)),
  n AS (SELECT floor((x0 // 2 - 1) / 2.0) AS a0, floor((y0 // 2 - 1) / 2.0) AS b0, ceil((ceil(x1 / 2.0) + 1) / 2.0) AS a1, ceil((ceil(y1 / 2.0) + 1) / 2.0) AS b1 FROM b)
SELECT DISTINCT CAST(x.i AS BIGINT) AS i, CAST(y.j AS BIGINT) AS j FROM n, (SELECT unnest(range(-5, 40)) AS i) x, (SELECT unnest(range(-5, 40)) AS j) y WHERE x.i >= a0 AND x.i < a1 AND y.j >= b0 AND y.j < b1""")
def nesting_flags(spark, sf_dir):
    boxes = spark.createDataFrame(BOXES, "lo array<long>, hi array<long>")
    return rel.nesting_flags(boxes, 2, 2).select(F.col("i").cast("long").alias("i"), F.col("j").cast("long").alias("j"))


@query(f"{BASE} SELECT i // 2 AS i, j // 2 AS j, round(sum(u) / 4.0, 6) AS u FROM g GROUP BY 1, 2")
def restrict_mean(spark, sf_dir):
    return rel.restrict(field(spark, sf_dir), "u", 2).withColumn("u", F.round("u", 6))


def fine_cells(spark, nx: int = 60, ny: int = 48):
    return CartesianGrid.single_block((nx, ny), (0.0, 0.0), (0.5, 0.25)).cells(spark).select("i", "j")


def prolong_sql(source: str, nx: int, ny: int) -> str:
    """Bilinear values of ``source`` (i, j, u; nx by ny cells) on twice as many cells a side."""
    clamp = lambda c, n: f"CASE WHEN {c} < 0 THEN -1 - ({c}) WHEN {c} >= {n} THEN {2 * n - 1} - ({c}) ELSE {c} END"
    return f"""f AS (SELECT a.i, b.j, (a.i + 0.5) / 2.0 - 0.5 AS p, (b.j + 0.5) / 2.0 - 0.5 AS q FROM (SELECT unnest(range({2 * nx})) AS i) a CROSS JOIN (SELECT unnest(range({2 * ny})) AS j) b),
 d AS (SELECT i, j, {clamp("CAST(floor(p) AS BIGINT) + dx", nx)} AS ci, {clamp("CAST(floor(q) AS BIGINT) + dy", ny)} AS cj,
  (CASE WHEN dx = 0 THEN 1.0 - (p - floor(p)) ELSE p - floor(p) END) * (CASE WHEN dy = 0 THEN 1.0 - (q - floor(q)) ELSE q - floor(q) END) AS w
  FROM f CROSS JOIN (VALUES (0, 0), (0, 1), (1, 0), (1, 1)) v(dx, dy)),
 fine AS (SELECT d.i, d.j, sum(s.u * d.w) AS u FROM d JOIN {source} s ON s.i = d.ci AND s.j = d.cj GROUP BY d.i, d.j)"""


@query(f"{BASE}, {prolong_sql('g', 30, 24)} SELECT i, j, round(u, 9) AS u FROM fine")
def prolong_bilinear(spark, sf_dir):
    return rel.prolong(field(spark, sf_dir).select("i", "j", "u"), fine_cells(spark), "u", 2, (30, 24)).withColumn("u", F.round("u", 9))


@query(f"{BASE}, {prolong_sql('g', 30, 24)} SELECT i // 2 AS i, j // 2 AS j, round(sum(u) / 4.0, 9) AS u FROM fine GROUP BY 1, 2")
def prolong_restrict_roundtrip(spark, sf_dir):
    fine = rel.prolong(field(spark, sf_dir).select("i", "j", "u"), fine_cells(spark), "u", 2, (30, 24))
    return rel.restrict(fine, "u", 2).withColumn("u", F.round("u", 9))


@query(f"{BASE}, {prolong_sql('g', 30, 24)}, part AS (SELECT i, j, u + 1.0 AS u FROM fine WHERE i >= 20 AND i < 40 AND j >= 10 AND j < 30), m AS (SELECT i // 2 AS i, j // 2 AS j, sum(u) / 4.0 AS v FROM part GROUP BY 1, 2) SELECT g.i, g.j, round(coalesce(m.v, g.u), 9) AS u FROM g LEFT JOIN m ON m.i = g.i AND m.j = g.j")
def restrict_covered(spark, sf_dir):
    coarse = field(spark, sf_dir).select("i", "j", "u")
    wanted = fine_cells(spark).where("i >= 20 and i < 40 and j >= 10 and j < 30")
    part = rel.prolong(coarse, wanted, "u", 2, (30, 24)).withColumn("u", F.col("u") + 1.0)
    return rel.restricted_onto(coarse, part, "u", 2).withColumn("u", F.round("u", 9))


@query(f"{BASE}, {prolong_sql('g', 30, 24)} SELECT i, j, round(CASE WHEN i < 30 AND j < 20 THEN 7.0 * i - j ELSE u END, 9) AS u FROM fine WHERE i >= 20 AND i < 40 AND j >= 10 AND j < 30")
def regrid_migrate(spark, sf_dir):
    coarse = field(spark, sf_dir).select("i", "j", "u")
    wanted = fine_cells(spark).where("i >= 20 and i < 40 and j >= 10 and j < 30")
    old = fine_cells(spark).where("i < 30 and j < 20").withColumn("u", F.lit(7.0) * F.col("i") - F.col("j"))
    return rel.migrate(old, rel.prolong(coarse, wanted, "u", 2, (30, 24)), wanted, "u").select("i", "j", F.round("u", 9).alias("u"))


@query(f"{BASE} SELECT p.i AS pi, p.j AS pj, round(CASE WHEN p.i >= 20 AND p.i < 40 AND p.j >= 10 AND p.j < 30 THEN p.i + 100.0 * p.j ELSE g.u END, 6) AS u, CAST(CASE WHEN p.i >= 20 AND p.i < 40 AND p.j >= 10 AND p.j < 30 THEN 1 ELSE 0 END AS INTEGER) AS level FROM (SELECT a.i, b.j FROM (SELECT unnest(range(60)) AS i) a CROSS JOIN (SELECT unnest(range(48)) AS j) b) p JOIN g ON g.i = p.i // 2 AND g.j = p.j // 2")
def finest_wins(spark, sf_dir):
    coarse = field(spark, sf_dir).select(F.lit(0).alias("level"), "i", "j", "u")
    fine = fine_cells(spark).where("i >= 20 and i < 40 and j >= 10 and j < 30").select(F.lit(1).alias("level"), "i", "j", (F.col("i") + F.lit(100.0) * F.col("j")).alias("u"))
    return rel.finest_wins(coarse.union(fine), (2,), "u").select("pi", "pj", F.round("u", 6).alias("u"), "level")


AMR = AmrGrid(GRID, (2,), ((CellBox((20, 10), (40, 30)), CellBox((40, 10), (48, 30))),))


@query(f"{BASE} SELECT CAST(0 AS INTEGER) AS level, i, j, block_id AS owner FROM g UNION ALL SELECT 1, f.i, f.j, CASE WHEN f.i >= 20 AND f.i < 40 AND f.j >= 10 AND f.j < 30 THEN 9 WHEN f.i >= 40 AND f.i < 48 AND f.j >= 10 AND f.j < 30 THEN 10 END FROM (SELECT a.i, b.j FROM (SELECT unnest(range(60)) AS i) a CROSS JOIN (SELECT unnest(range(48)) AS j) b) f")
def owner_lookup(spark, sf_dir):
    cells = GRID.cells(spark).select(F.lit(0).alias("level"), "i", "j").union(fine_cells(spark).select(F.lit(1), "i", "j"))
    return rel.owners(cells, AMR.patch_table(spark))


@query("""SELECT CAST(0 AS INTEGER) AS level, b AS block_id, 10.0 * (b % 3) AS x0, 10.0 * (b % 3) + 10.0 AS x1, 4.0 * (b // 3) AS y0, 4.0 * (b // 3) + 4.0 AS y1 FROM (SELECT unnest(range(9)) AS b)
  UNION ALL SELECT 1, 9, 10.0, 20.0, 2.5, 7.5 UNION ALL SELECT 1, 10, 20.0, 24.0, 2.5, 7.5""")
def patch_outlines(spark, sf_dir):
    return rel.patch_outlines(AMR.cells(spark))


# --- counter-based randomness


def mixing(source: str, steps: list[str]) -> str:
    """CTEs m0, m1, ... that run each step; SPLIT is one splitmix of column k."""
    out, last, n = [], source, 0
    for step in steps:
        parts = [step] if step != "SPLIT" else [
            f"CAST((CAST(k AS UHUGEINT) + {rng.GAMMA}) % 18446744073709551616 AS UBIGINT)",
            f"CAST((CAST(xor(k, k >> 30) AS UHUGEINT) * {rng.MULTIPLIER_A}) % 18446744073709551616 AS UBIGINT)",
            f"CAST((CAST(xor(k, k >> 27) AS UHUGEINT) * {rng.MULTIPLIER_B}) % 18446744073709551616 AS UBIGINT)",
            "xor(k, k >> 31)",
        ]
        for p in parts:
            body = p if p.startswith("SELECT") else f"SELECT * REPLACE ({p} AS k)"
            out.append(f"{source}_m{n} AS (SELECT * FROM ({body} FROM {last}))")
            last, n = f"{source}_m{n}", n + 1
    return ", ".join(out), last


def unit_sql(k: str) -> str:
    return f"(CAST(({k} >> 11) + 1 AS DOUBLE) * {2.0**-53!r})"


def normal_sql(source: str) -> tuple[str, str]:
    ctes, last = mixing(source, ["SPLIT", "SELECT *, k AS k_first", f"xor(k, CAST({rng.SECOND} AS UBIGINT))", "SPLIT"])
    return ctes, last


def start(seed: int, *parts: int) -> int:
    return int(rng.mix_key(seed, parts))


KEYED = f"c AS (SELECT c_custkey, xor(CAST({start(SEED, 3)} AS UBIGINT), CAST(c_custkey AS UBIGINT)) AS k FROM customer)"
_U, _U_LAST = mixing("c", ["SPLIT"])
_N, _N_LAST = mixing("c", ["SPLIT", "SPLIT", "SELECT *, k AS k_first", f"xor(k, CAST({rng.SECOND} AS UBIGINT))", "SPLIT"])


@query(f"WITH {KEYED}, {_U} SELECT c_custkey, {unit_sql('k')} AS u FROM {_U_LAST}")
def rng_uniform(spark, sf_dir):
    rows = rng.with_key(table(spark, sf_dir, "customer").select("c_custkey"), "k", SEED, [3, F.col("c_custkey")])
    return rows.select("c_custkey", rng.unit_open_col(F.col("k")).alias("u"))


@query(f"WITH {KEYED}, {_N} SELECT c_custkey, round(sqrt(-2.0 * ln({unit_sql('k_first')})) * cos({2 * math.pi!r} * {unit_sql('k')}), 9) AS z FROM {_N_LAST}")
def rng_normal(spark, sf_dir):
    rows = rng.with_key(table(spark, sf_dir, "customer").select("c_custkey"), "k", SEED, [3, F.col("c_custkey")])
    return rng.with_normal(rows, "z", "k").select("c_custkey", F.round("z", 9).alias("z"))


CIR = {"k": 1.0, "theta": 1.0, "sigma": 0.1, "mu": 0.05}


def cir(spark, sf_dir, steps=2, dt=0.01):
    at = F.col("c_custkey")
    rows = table(spark, sf_dir, "customer").select("c_custkey", F.floor(at / 500).alias("block_id"), F.pmod(at, F.lit(500)).cast("long").alias("cell"), (F.lit(1.0) + F.abs("c_acctbal") / F.lit(10000.0)).alias("nu"), F.lit(100.0).alias("mid"))
    t = 0.0
    for _ in range(steps):
        plus = F.greatest(F.col("nu"), F.lit(0.0))
        rows = paths.step_paths(rows, {"nu": F.lit(CIR["k"]) * (F.lit(CIR["theta"]) - plus), "mid": F.lit(CIR["mu"])}, {wiener(0): {"nu": F.lit(CIR["sigma"]) * F.sqrt(plus)}, wiener(1): {"mid": F.sqrt(plus)}}, {}, t, dt, SEED, lambda d: d.withColumn("nu", F.greatest("nu", F.lit(0.0))))
        t += dt
    return rows


def draw_sql(source: str, t: float, stream: int, normal: bool) -> tuple[str, str]:
    """CTEs that leave in ``source``-derived rows (with block_id, cell) the column z or p of a draw."""
    steps = [f"SELECT *, CAST({start(SEED, rng.time_bits(t), stream)} AS UBIGINT) AS k", "xor(k, CAST(block_id AS UBIGINT))", "SPLIT", "xor(k, CAST(cell AS UBIGINT))", "SPLIT"]
    if normal:
        steps += ["SPLIT", "SELECT *, k AS k_first", f"xor(k, CAST({rng.SECOND} AS UBIGINT))", "SPLIT"]
    ctes, last = mixing(source, steps)
    value = f"sqrt(-2.0 * ln({unit_sql('k_first')})) * cos({2 * math.pi!r} * {unit_sql('k')})" if normal else unit_sql("k")
    drop = "k, k_first" if normal else "k"
    return f"{ctes}, {source}_z AS MATERIALIZED (SELECT * EXCLUDE ({drop}), {value} AS z FROM {last})", f"{source}_z"


def cir_sql(tail: str, steps: int = 2, dt: float = 0.01) -> str:
    text = "WITH p0 AS (SELECT c_custkey, c_custkey // 500 AS block_id, c_custkey % 500 AS cell, 1.0 + abs(c_acctbal) / 10000.0 AS nu, CAST(100.0 AS DOUBLE) AS mid FROM customer)"
    t = 0.0
    for n in range(steps):
        first, a = draw_sql(f"p{n}", t, rng.stream_tag(rng.WIENER, 0), True)
        text += f", {first}, q{n} AS (SELECT * EXCLUDE (z), z AS z0 FROM {a})"
        second, b = draw_sql(f"q{n}", t, rng.stream_tag(rng.WIENER, 1), True)
        r = math.sqrt(dt)
        text += f", {second}, p{n + 1} AS MATERIALIZED (SELECT c_custkey, block_id, cell, greatest(nu + {dt} * (1.0 * (1.0 - greatest(nu, 0.0))) + {r!r} * (0.1 * sqrt(greatest(nu, 0.0))) * z0, 0.0) AS nu, mid + {dt} * 0.05 + {r!r} * sqrt(greatest(nu, 0.0)) * z AS mid FROM {b})"
        t += dt
    return f"{text} {tail.format(last=f'p{steps}')}"


@query(cir_sql("SELECT c_custkey, round(nu, 9) AS nu, round(mid, 8) AS mid FROM {last}"))
def cir_paths(spark, sf_dir):
    return cir(spark, sf_dir).select("c_custkey", F.round("nu", 9).alias("nu"), F.round("mid", 8).alias("mid"))


@query(cir_sql('SELECT count(nu) AS "count", round(avg(nu), 7) AS mean, round(greatest(var_pop(nu), 0.0), 7) AS variance, round(min(nu), 7) AS "min", round(max(nu), 7) AS "max", round(sqrt(var_pop(nu)), 7) AS std FROM {last}'))
def mc_stats(spark, sf_dir):
    s = stats.ensemble_stats(cir(spark, sf_dir), F.col("nu"))
    return s.select("count", *[F.round(c, 7).alias(c) for c in ("mean", "variance", "min", "max", "std")])


def jump_sql(steps: int = 2, dt: float = 0.5) -> str:
    text = 'WITH p0 AS (SELECT o_orderkey, o_orderkey // 1000 AS block_id, o_orderkey % 1000 AS cell, o_totalprice / 500000.0 AS lam, CAST(0.0 AS DOUBLE) AS "n", CAST(0.0 AS DOUBLE) AS jsum FROM orders)'
    t = 0.0
    for n in range(steps):
        ctes, last = draw_sql(f"p{n}", t, rng.stream_tag(rng.JUMP, 0), False)
        text += f", {ctes}, p{n + 1} AS MATERIALIZED (SELECT o_orderkey, block_id, cell, lam, CASE WHEN lam > 0 AND z < 1.0 - exp(-lam * {dt}) THEN n + 1.0 ELSE n END AS n, CASE WHEN lam > 0 AND z < 1.0 - exp(-lam * {dt}) THEN jsum + 2.0 ELSE jsum END AS jsum FROM {last})"
        t += dt
    return f"{text} SELECT o_orderkey, n, jsum FROM p{steps}"


@query(jump_sql())
def jump_counts(spark, sf_dir):
    at = F.col("o_orderkey")
    rows = table(spark, sf_dir, "orders").select("o_orderkey", F.floor(at / 1000).alias("block_id"), F.pmod(at, F.lit(1000)).cast("long").alias("cell"), (F.col("o_totalprice") / F.lit(500000.0)).alias("lam"), F.lit(0.0).alias("n"), F.lit(0.0).alias("jsum"))
    t = 0.0
    for _ in range(2):
        rows = paths.step_paths(rows, {}, {jump(0): {"n": F.lit(1.0), "jsum": F.lit(2.0)}}, {jump(0): F.col("lam")}, t, 0.5, SEED)
        t += 0.5
    return rows.select("o_orderkey", "n", "jsum")


# --- grains and the phase field

def units_sql(rows: str) -> tuple[str, list[str]]:
    """CTEs of the mixed keys (s_suppkey, k) of three numbers a row of ``rows`` (s_suppkey), and their names."""
    first, last = mixing("s", ["SPLIT"])
    out = [f"s AS (SELECT s_suppkey, xor(CAST({start(SEED)} AS UBIGINT), CAST(s_suppkey AS UBIGINT)) AS k FROM ({rows}) r)", first]
    names = []
    for n in range(3):
        ctes, name = mixing(f"s{n}", ["SPLIT"])
        out += [f"s{n} AS (SELECT s_suppkey, xor(k, CAST({n} AS UBIGINT)) AS k FROM {last})", ctes]
        names.append(name)
    return ", ".join(out), names


def grain_sql() -> str:
    ctes, names = units_sql("SELECT s_suppkey FROM supplier")
    return f"{ctes}, grains AS (SELECT a.s_suppkey AS grain_id, {unit_sql('a.k')} * 30.0 AS cx, {unit_sql('b.k')} * 12.0 AS cy, 2.0 AS radius, {unit_sql('c.k')} * {math.pi / 2!r} AS orientation FROM {names[0]} a JOIN {names[1]} b USING (s_suppkey) JOIN {names[2]} c USING (s_suppkey))"


def seed_sql(extent: tuple[float, float], radius: float) -> str:
    ctes, names = units_sql("SELECT unnest(range((SELECT count(*) FROM nation))) AS s_suppkey")
    margin = 2 * radius
    place = lambda k, size: f"{margin!r} + {unit_sql(k)} * {size - 2 * margin!r}"
    return f"WITH {ctes} SELECT a.s_suppkey AS grain_id, {place('a.k', extent[0])} AS cx, {place('b.k', extent[1])} AS cy, CAST({radius!r} AS DOUBLE) AS radius, {unit_sql('c.k')} * {math.pi / 2!r} AS orientation FROM {names[0]} a JOIN {names[1]} b USING (s_suppkey) JOIN {names[2]} c USING (s_suppkey)"


def grains(spark, sf_dir):
    rows = table(spark, sf_dir, "supplier").select(F.col("s_suppkey").cast("long").alias("grain_id"))
    for n in range(3):
        rows = rng.with_key(rows, f"k{n}", SEED, [F.col("grain_id"), n])
    unit = lambda n: rng.unit_open_col(F.col(f"k{n}"))
    return rows.select("grain_id", (unit(0) * F.lit(30.0)).alias("cx"), (unit(1) * F.lit(12.0)).alias("cy"), F.lit(2.0).alias("radius"), (unit(2) * F.lit(math.pi / 2)).alias("orientation"))


def phase_sql() -> str:
    far = "(g.x - n.cx) * (g.x - n.cx) + (g.y - n.cy) * (g.y - n.cy)"
    return f"""{BASE}, {grain_sql()}, far AS (SELECT g.i, g.j, g.u, n.grain_id, n.orientation, {far} AS d, -tanh((sqrt(pow(g.x - n.cx, 2) + pow(g.y - n.cy, 2)) - n.radius) / {math.sqrt(2)!r}) AS profile FROM g CROSS JOIN grains n),
 phase AS (SELECT i, j, greatest(-1.0, max(profile)) AS phi, first(orientation ORDER BY d, grain_id) AS theta0, first(grain_id ORDER BY d, grain_id) AS grain FROM far GROUP BY i, j)"""


@query(f"{phase_sql()} SELECT avg(CASE WHEN phi > 0 THEN 1.0 ELSE 0.0 END) AS solid, round(max(CASE WHEN phi > 0 THEN sqrt(pow(x - 15.0, 2) + pow(y - 6.0, 2)) ELSE 0.0 END), 9) AS radius FROM phase JOIN g USING (i, j)")
def solid_reach(spark, sf_dir):
    cells = rel.grain_profile(GRID.cells(spark).select("i", "j", "x", "y"), grains(spark, sf_dir))
    return cells.agg(stats.solid_fraction("phi").alias("solid"), F.round(stats.arm_length("phi", (15.0, 6.0), [0.0], math.pi + 1.0), 9).alias("radius"))


@query(f"{phase_sql()} SELECT i, j, round(phi, 9) AS phi, round(theta0, 9) AS theta0, grain FROM phase")
def voronoi_grains(spark, sf_dir):
    out = rel.grain_profile(GRID.cells(spark).select("i", "j", "x", "y"), grains(spark, sf_dir))
    return out.select("i", "j", F.round("phi", 9).alias("phi"), F.round("theta0", 9).alias("theta0"), "grain")


def corner_sql(source: str) -> str:
    """SQL for all eight neighbours of phi (pc, mc, cp, cm, pp, pm, mp, mm) with mirrored faces."""
    return f"""nb1 AS (SELECT *, coalesce(lag(phi) OVER (PARTITION BY j ORDER BY i), phi) AS mc, coalesce(lead(phi) OVER (PARTITION BY j ORDER BY i), phi) AS pc,
  coalesce(lag(phi) OVER (PARTITION BY i ORDER BY j), phi) AS cm, coalesce(lead(phi) OVER (PARTITION BY i ORDER BY j), phi) AS cp,
  coalesce(lag(u) OVER (PARTITION BY j ORDER BY i), u) AS xm, coalesce(lead(u) OVER (PARTITION BY j ORDER BY i), u) AS xp,
  coalesce(lag(u) OVER (PARTITION BY i ORDER BY j), u) AS ym, coalesce(lead(u) OVER (PARTITION BY i ORDER BY j), u) AS yp FROM {source}),
 nb AS (SELECT *, coalesce(lag(mc) OVER (PARTITION BY i ORDER BY j), mc) AS mm, coalesce(lead(mc) OVER (PARTITION BY i ORDER BY j), mc) AS mp,
  coalesce(lag(pc) OVER (PARTITION BY i ORDER BY j), pc) AS pm, coalesce(lead(pc) OVER (PARTITION BY i ORDER BY j), pc) AS pp FROM nb1)"""


def modelc_sql(dt: float | None, oriented: bool = False) -> str:
    m = models.ModelC()
    a, e, d = m.shape.a, m.shape.e, m.shape.d
    grads = {"R": ("pc - phi", "0.25 * (pp - pm + cp - cm)"), "L": ("phi - mc", "0.25 * (cp - cm + mp - mm)"), "T": ("0.25 * (pp - mp + pc - mc)", "cp - phi"), "B": ("0.25 * (pc - mc + pm - mm)", "phi - cm"), "C": ("0.5 * (pc - mc)", "0.5 * (cp - cm)")}
    gx = ", ".join(f"{x} AS x{n}, {y} AS y{n}" for n, (x, y) in grads.items())
    turn = ", ".join(f"cos(theta0) * x{n} + sin(theta0) * y{n} AS tp{n}, cos(theta0) * y{n} - sin(theta0) * x{n} AS tq{n}" if oriented else f"x{n} AS tp{n}, y{n} AS tq{n}" for n in grads)
    size = lambda n: f"pow(tp{n} * tp{n} + tq{n} * tq{n}, 2)"
    aa = ", ".join(f"CASE WHEN {size(n)} > 1e-8 THEN {a!r} * (1.0 + {e!r} * (pow(tp{n}, 4) + pow(tq{n}, 4)) / {size(n)}) ELSE {a!r} END AS v{n}, CASE WHEN {size(n)} > 1e-8 THEN -{d!r} * tp{n} * tq{n} * (tp{n} * tp{n} - tq{n} * tq{n}) / {size(n)} ELSE 0.0 END AS w{n}" for n in grads)
    flux = "(vR * (vR * xR - wR * yR) - vL * (vL * xL - wL * yL) + vT * (vT * yT + wT * xT) - vB * (vB * yB + wB * xB)) / 0.5"
    rhs = f"(({flux}) - (phi * phi * phi - phi) - {m.coupling!r} * u * pow(1.0 - phi * phi, 2)) / (vC * vC)"
    out = "round(dphi, 7) AS dphi, round(du, 7) AS du" if dt is None else f"round(phi + {dt} * dphi, 7) AS phi, round(u + {dt} * du, 7) AS u"
    return f"{phase_sql()}, st AS (SELECT i, j, phi, -0.7 AS u, theta0 FROM phase), {corner_sql('st')}, gr AS (SELECT *, {gx} FROM nb), tu AS (SELECT *, {turn} FROM gr), an AS (SELECT *, {aa} FROM tu), r AS (SELECT *, {rhs} AS dphi FROM an), q AS (SELECT *, {m.diffusivity!r} * {LAP} + 0.5 * dphi AS du FROM r) SELECT i, j, {out} FROM q"


def phase(spark, sf_dir):
    cells = GRID.cells(spark).select("block_id", "cell", "i", "j", "x", "y")
    return rel.grain_profile(cells, grains(spark, sf_dir)).select("block_id", "cell", "i", "j", "phi", F.lit(-0.7).alias("u"), "theta0")


def modelc_tendencies(spark, sf_dir, angle=None):
    m = models.ModelC()
    wide = stencils.with_neighbors(stencils.with_corners(phase(spark, sf_dir), GRID, "phi"), GRID, "u")
    p, a = F.col("phi"), m.shape.center_column("phi", angle)
    well = F.lit(1.0) - p * p
    wide = wide.withColumn("dphi", (m.shape.divergence_column("phi", GRID.spacing, angle) - (p * p * p - p) - F.lit(m.coupling) * F.col("u") * (well * well)) / (a * a))
    wide = wide.withColumn("du", F.lit(m.diffusivity) * stencils.laplacian_column(GRID, "u") + F.lit(0.5) * F.col("dphi"))
    return wide.select("i", "j", F.round("dphi", 7).alias("dphi"), F.round("du", 7).alias("du"))


@query(modelc_sql(None))
def modelc_rhs(spark, sf_dir):
    return modelc_tendencies(spark, sf_dir)


@query(modelc_sql(None, True))
def modelc_oriented_rhs(spark, sf_dir):
    return modelc_tendencies(spark, sf_dir, F.col("theta0"))


def modelc_one_step(spark, sf_dir, model, names):
    blocks = executor.to_blocks(phase(spark, sf_dir), names)
    state = executor.advance(blocks, GRID, model, integrators.EulerMaruyama(SEED), 0.0, 0.005, 1)
    return executor.to_cells(state, GRID, ["phi", "u"]).select("i", "j", F.round("phi", 7).alias("phi"), F.round("u", 7).alias("u"))


@query(modelc_sql(0.005))
def modelc_step(spark, sf_dir):
    return modelc_one_step(spark, sf_dir, models.ModelC(), ["phi", "u"])


@query(modelc_sql(0.005, True))
def modelc_oriented_step(spark, sf_dir):
    return modelc_one_step(spark, sf_dir, models.ModelC(oriented=True), ["phi", "u", "theta0"])


# --- market making

MM = models.MarketMaker(q_min=-2, q_max=2)
NU = CartesianGrid((25,), (25,), (0.001,), (0.08,))
VALUES = """WITH n AS (SELECT c_nationkey AS i, round(avg(c_acctbal) / 100000.0, 6) AS v FROM customer GROUP BY 1),
 v AS (SELECT CAST(a.i AS BIGINT) AS i, CAST(b.q AS BIGINT) AS q, 0.001 + (a.i + 0.5) * 0.08 AS nu, coalesce(n.v, 0.0) * (1.0 + 0.1 * b.q * b.q) AS u
  FROM (SELECT unnest(range(25)) AS i) a CROSS JOIN (SELECT unnest(range(-2, 3)) AS q) b LEFT JOIN n ON n.i = a.i)"""


def values(spark, sf_dir):
    avg = table(spark, sf_dir, "customer").groupBy(F.col("c_nationkey").cast("long").alias("i")).agg(F.round(F.avg("c_acctbal") / F.lit(100000.0), 6).alias("v"))
    cells = NU.cells(spark).select("block_id", "cell", "i").join(avg, "i", "left").withColumn("v", F.coalesce("v", F.lit(0.0)))
    return cells.withColumns({MM.name(q): F.col("v") * F.lit(1.0 + 0.1 * q * q) for q in range(-2, 3)})


def hjb_sql(dt: float) -> str:
    return f"""{VALUES}, w AS (SELECT *, lag(u) OVER (PARTITION BY i ORDER BY q) AS dn, lead(u) OVER (PARTITION BY i ORDER BY q) AS up,
  coalesce(lag(u) OVER a, 2.0 * u - lead(u) OVER a) AS m, coalesce(lead(u) OVER a, 2.0 * u - lag(u) OVER a) AS p FROM v WINDOW a AS (PARTITION BY q ORDER BY i)),
 r AS (SELECT *, 0.5 * 0.1 * 0.1 * nu * ((p + m - 2 * u) / (0.08 * 0.08)) + (1.0 - nu) * (CASE WHEN 1.0 - nu > 0 THEN (p - u) / 0.08 ELSE (u - m) / 0.08 END) + 0.01 * q - 0.1 * 0.1 * 0.1 * nu * q * q
  + CASE WHEN q > -2 THEN 2.0 * (q * 0.004 + exp(-2.0 * (0.01 * (1 - 2 * q) + 0.004 - dn + u)) / 2.0) ELSE 2.0 * q * 0.004 END
  + CASE WHEN q < 2 THEN 1.0 * (-q * 0.004 + exp(-2.0 * (0.01 * (1 + 2 * q) + 0.004 - up + u)) / 2.0) ELSE -1.0 * q * 0.004 END AS du FROM w)
SELECT i, q, round(u + {dt} * du, 9) AS u FROM r"""


@query(hjb_sql(0.01))
def hjb_step(spark, sf_dir):
    names = [MM.name(q) for q in range(-2, 3)]
    state = executor.advance(executor.to_blocks(values(spark, sf_dir), names), NU, MM, integrators.ForwardEuler(), 0.0, 0.01, 1)
    cells = executor.to_cells(state, NU, names)
    rows = F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.col(MM.name(q)).alias("u")) for q in range(-2, 3)])).alias("r")
    return cells.select("i", rows).select("i", "r.q", F.round("r.u", 9).alias("u"))


@query(f"""{VALUES}, w AS (SELECT *, lag(u) OVER (PARTITION BY i ORDER BY q) AS dn, lead(u) OVER (PARTITION BY i ORDER BY q) AS up FROM v)
SELECT i, q, CASE WHEN up IS NULL THEN NULL ELSE round(greatest(0.5 + 0.004 + 0.01 * (1 + 2 * q) - up + u, 0.0001), 9) END AS bid,
 CASE WHEN dn IS NULL THEN NULL ELSE round(greatest(0.5 + 0.004 + 0.01 * (1 - 2 * q) - dn + u, 0.0001), 9) END AS ask,
 CASE WHEN dn IS NULL THEN 0.0 ELSE round(2.0 * exp(-2.0 * greatest(0.5 + 0.004 + 0.01 * (1 - 2 * q) - dn + u, 0.0001)), 9) END AS sells FROM w""")
def optimal_quotes(spark, sf_dir):
    rows = F.explode(F.array(*[F.struct(F.lit(q).cast("long").alias("q"), F.col(MM.name(q)).alias("u")) for q in range(-2, 3)])).alias("r")
    long = values(spark, sf_dir).select("i", rows).select("i", "r.q", "r.u")
    over = Window.partitionBy("i").orderBy("q")
    long = long.withColumns({"up": F.lead("u").over(over), "dn": F.lag("u").over(over)})
    bid = quotes.depth(MM.buy, MM.alpha, F.col("q"), 1, F.col("u"), F.col("up"), MM.min_spread)
    ask = quotes.depth(MM.sell, MM.alpha, F.col("q"), -1, F.col("u"), F.col("dn"), MM.min_spread)
    sells = quotes.fill_rate(MM.sell.rate, MM.sell.decay, ask)
    finite = lambda c: F.when(c != F.lit(float("inf")), F.round(c, 9))
    return long.select("i", "q", finite(bid).alias("bid"), finite(ask).alias("ask"), F.round(sells, 9).alias("sells"))


# --- state


@query(f"{BASE}, s AS (SELECT block_id, cell, x, y, 1000.0 * y + x AS theta0 FROM g) SELECT s.block_id, s.cell, s.x, s.y, s.theta0, round(g.u * 2.0, 6) AS u FROM s JOIN g USING (block_id, cell)")
def static_snapshot_join(spark, sf_dir):
    cells = field(spark, sf_dir)
    static = cells.select("block_id", "cell", "x", "y", (F.lit(1000.0) * F.col("y") + F.col("x")).alias("theta0"))
    snap = cells.select("block_id", "cell", F.round(F.col("u") * 2.0, 6).alias("u"))
    return static.join(snap, ["block_id", "cell"])


@query(f"{BASE} SELECT i, j, round(greatest(u - 50.0, 0.0), 6) AS v FROM g")
def project_clamp(spark, sf_dir):
    cells = engine(spark, sf_dir, models.ClampedDecay(rate=500.0), integrators.ForwardEuler(), 1, 0.1, {"v": F.col("u")})
    return cells.select("i", "j", F.round("v", 6).alias("v"))


def cubic_sql(steps: int, dt: float) -> str:
    text = BASE + ", s0 AS (SELECT i, j, u / 1000.0 AS u FROM g)"
    for n in range(steps):
        text += f", s{n + 1} AS (SELECT i, j, u - {dt} * (u * u * u) AS u FROM s{n})"
    return f"{text} SELECT i, j, round(u, 9) AS u FROM s{steps}"


@query(cubic_sql(5, 0.02))
def cubic_decay(spark, sf_dir):
    cells = engine(spark, sf_dir, models.CubicDecay(), integrators.ForwardEuler(), 5, 0.02, {"u": F.col("u") / F.lit(1000.0)})
    return cells.select("i", "j", F.round("u", 9).alias("u"))


@query(f"{BASE} SELECT i, j, round(0.75 * u + 0.25 * (u * u), 4) AS u FROM g")
def time_blend(spark, sf_dir):
    cells = field(spark, sf_dir)
    return rel.time_blend(cells, cells.withColumn("u", F.col("u") * F.col("u")), "u", 0.25, ["i", "j"]).withColumn("u", F.round("u", 4))


@query(f"{BASE} SELECT i, j, u FROM g WHERE i % 3 = 0 AND j % 3 = 0")
def downsample(spark, sf_dir):
    from lattica.sources.snapshots import downsampled

    return downsampled(field(spark, sf_dir), 30, 10).select("i", "j", "u")


@query("""SELECT CAST(date_trunc('hour', ts) AS TIMESTAMP) AS start, event_type, count(*) AS n, round(sum(value), 4) AS total FROM events GROUP BY 1, 2""")
def event_windows(spark, sf_dir):
    from lattica.streaming.observers import binned_events

    return binned_events(table(spark, sf_dir, "events")).withColumn("total", F.round("total", 4))


# --- what SQL cannot express


@query()
def cluster_boxes(spark, sf_dir):
    """Boxes around the flags of a coarse grid."""
    return cluster_table(flags(spark, sf_dir).withColumn("level", F.lit(0)), ClusterParams(0.7, 2)).select("lo", "hi", "cells")


def bump(cx: float, cy: float):
    import numpy as np

    return lambda x, y: np.exp(-((x - cx) ** 2 + (y - cy) ** 2) / 0.4)


def study(row: dict):
    policy = amr.Regrid(amr.GradientTagger("u", 0.05), 4, 2, ClusterParams(0.7, 2))
    sim = amr.AmrSimulation(amr.uniform((16, 16), (8, 8), 0.5), models.Heat(0.7), amr.ForwardEuler(), policy)
    sim.state.fill({"u": bump(2.0 + row["study"] % 5, 4.0)})
    return sim


@query()
def amr_regrid(spark, sf_dir):
    """An adaptive run for each nation, in parallel."""
    studies = table(spark, sf_dir, "nation").select(F.col("n_nationkey").cast("long").alias("study"))
    return amr.run_hierarchies(studies, study, 20, lambda sim, row: 0.2 * 0.25**2 / 0.7, ["u"])


def subcycled(row: dict):
    sim = study(row)
    sim.integrator = amr.Subcycling()
    return sim


@query()
def subcycled_heat(spark, sf_dir):
    studies = table(spark, sf_dir, "region").select(F.col("r_regionkey").cast("long").alias("study"))
    return amr.run_hierarchies(studies, subcycled, 5, lambda sim, row: 0.2 * 0.5**2 / 0.7, ["u"])


@query()
def modelc_100_steps(spark, sf_dir):
    model = models.ModelC(noise=0.01)
    blocks = executor.to_blocks(phase(spark, sf_dir), ["phi", "u"])
    state = executor.advance(blocks, GRID, model, integrators.EulerMaruyama(SEED), 0.0, 0.01, 100)
    return executor.to_cells(state, GRID, ["phi", "u"])


@query(seed_sql((30.0, 12.0), 1.0))
def seed_placement(spark, sf_dir):
    return random_seeds(spark, table(spark, sf_dir, "nation").count(), (30.0, 12.0), 1.0, SEED, 1.0)


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    return heat_step(spark, sf_dir)


def queries() -> dict[str, Query]:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLE)


__all__ = ["flagship", "oracle_sql", "queries"]
