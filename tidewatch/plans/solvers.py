"""Queries of metric paths, sparse solvers and eigenvalues on the raster of the readings."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import graph, paths, solve
from tidewatch.plans.grids import ground
from tidewatch.operators.grid import cut
from tidewatch.registry import query
from tidewatch.sources.tables import TERRAIN, table

R6 = lambda c: F.round(c, 6).alias(c)

#: Gradients, metric tensors and the length of each step of the raster, and the shortest distance by number of steps.
METRIC = """slope AS (SELECT *, COALESCE((lead(z) OVER q_ - lag(z) OVER q_) / 2, lead(z) OVER q_ - z, z - lag(z) OVER q_, 0) AS gx, COALESCE((lead(z) OVER r_ - lag(z) OVER r_) / 2, lead(z) OVER r_ - z, z - lag(z) OVER r_, 0) AS gy
  FROM terrain WINDOW q_ AS (PARTITION BY r ORDER BY q), r_ AS (PARTITION BY q ORDER BY r)),
steep AS (SELECT *, sqrt(gx * gx + gy * gy) AS g FROM slope),
cost AS (SELECT *, (2 * (1 + g) + 0.5::DOUBLE / (1 + g)) / 2 - 1 AS more FROM steep),
metric AS (SELECT cell, r, q, h, w, CASE WHEN g < 2.220446049250313e-16 THEN 1.0 ELSE 1 + more * (gx / g) * (gx / g) END AS m11, CASE WHEN g < 2.220446049250313e-16 THEN 0.0 ELSE more * (gx / g) * (gy / g) END AS m12, CASE WHEN g < 2.220446049250313e-16 THEN 1.0 ELSE 1 + more * (gy / g) * (gy / g) END AS m22 FROM cost)"""
FIELD = f"""{METRIC},
step AS (SELECT a.cell AS src, b.cell AS dst, sqrt(m11 * (b.q - a.q) * (b.q - a.q) + 2 * m12 * (b.q - a.q) * (b.r - a.r) + m22 * (b.r - a.r) * (b.r - a.r)) AS s FROM metric a JOIN terrain b ON abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1 AND a.cell <> b.cell),
hops(k, cell, far) AS (SELECT 0, cell, 0.0::DOUBLE FROM terrain WHERE cell % 97 = 3 UNION ALL SELECT k + 1, dst, MIN(far + s) FROM hops JOIN step ON src = cell WHERE k < (SELECT 3 * MAX(w) FROM terrain) GROUP BY k, dst),
field AS (SELECT cell, MIN(far) AS distance FROM hops GROUP BY cell),
back AS (SELECT dst AS cell, arg_min(src, {{'d': round(f.distance + s, 9), 'c': src}}) AS previous FROM step JOIN field f ON f.cell = src GROUP BY dst)"""


def metric(spark, sf_dir):
    return paths.slope_metric(ground(spark, sf_dir), "z")


def field(spark, sf_dir, tile: int = 128):
    m = metric(spark, sf_dir)
    return paths.distance_field(m, m.where("cell % 97 = 3").select("r", "q"), tile=tile)


@query("metric_distances", f"WITH RECURSIVE {TERRAIN}, {FIELD} SELECT field.cell, round(distance, 6) AS distance, CASE WHEN distance > 0 THEN previous END AS previous FROM field JOIN back USING (cell)")
def metric_distances(spark, sf_dir):
    return field(spark, sf_dir).select("cell", R6("distance"), "previous")


@query("metric_paths", f"""WITH RECURSIVE {TERRAIN}, {FIELD}, path(target, cell, behind) AS (SELECT cell, cell, 0 FROM field WHERE cell % 13 = 5 UNION ALL SELECT target, previous, behind + 1 FROM path JOIN back USING (cell) WHERE cell % 97 <> 3),
 n AS (SELECT target, COUNT(*) AS n_cells FROM path GROUP BY 1) SELECT target, CAST(n_cells - 1 - behind AS BIGINT) AS step, path.cell, n_cells, round(distance, 6) AS distance FROM path JOIN n USING (target) JOIN field ON field.cell = target""")  # fmt: skip
def metric_paths(spark, sf_dir):
    tree = field(spark, sf_dir)
    return paths.path_cells(tree, tree.where("cell % 13 = 5")).select("target", "step", "cell", "n_cells", R6("distance"))


@query("metric_pairs", f"""WITH {TERRAIN}, {METRIC}, p AS (SELECT a.cell AS a, b.cell AS b, sqrt(a.m11 * (b.q - a.q) * (b.q - a.q) + 2 * a.m12 * (b.q - a.q) * (b.r - a.r) + a.m22 * (b.r - a.r) * (b.r - a.r)) AS x, sqrt(b.m11 * (b.q - a.q) * (b.q - a.q) + 2 * b.m12 * (b.q - a.q) * (b.r - a.r) + b.m22 * (b.r - a.r) * (b.r - a.r)) AS y
 FROM metric a JOIN metric b ON a.cell < b.cell) SELECT a, b, round((x + y) / 2, 6) AS distance FROM p WHERE LEAST(x, y) <= 4""")  # fmt: skip
def metric_pairs(spark, sf_dir):
    return paths.metric_pairs(metric(spark, sf_dir), "cell", "q", "r", 4.0).select("a", "b", R6("distance"))


def vector(df, value: str = "z"):
    return df.select(F.col("cell").cast("long").alias("i"), F.col(value).alias("x"))


@query("poisson_solution", f"""WITH RECURSIVE {TERRAIN}, near AS (SELECT a.cell AS i, b.cell AS j FROM terrain a JOIN terrain b ON abs(a.r - b.r) + abs(a.q - b.q) = 1),
 sweep(k, i, x) AS (SELECT 0, cell, 0.0::DOUBLE FROM terrain UNION ALL SELECT k + 1, t.cell, (t.z / 100 + SUM(s.x)) / 4 FROM sweep s JOIN near ON near.j = s.i JOIN terrain t ON t.cell = near.i WHERE k < 4000 GROUP BY k, t.cell, t.z)
 SELECT i, round(x, 4) AS x, true AS converged FROM sweep WHERE k = 4000""")  # fmt: skip
def poisson_solution(spark, sf_dir):
    """The five-point Poisson equation with zero borders, by conjugate gradients with the raster's sine transforms."""
    g = cut(ground(spark, sf_dir).withColumn("load", F.col("z") / 100))
    size = g.agg(F.max("h"), F.max("w")).first()
    nearly = solve.sine_inverse(*size) if size[0] else None
    done = solve.conjugate_gradients(solve.shifted(graph.laplacian(g, boundary="dirichlet"), 0.0, -1.0), vector(g, "load"), precondition=nearly)
    return done.x.select("i", F.round("x", 4).alias("x"), F.lit(done.converged and done.residual < 1e-9).alias("converged"))


@query("implicit_diffusion", f"""WITH RECURSIVE {TERRAIN}, near AS (SELECT a.cell AS i, b.cell AS j FROM terrain a JOIN terrain b ON abs(a.r - b.r) + abs(a.q - b.q) = 1), deg AS (SELECT i, COUNT(*) AS n FROM near GROUP BY 1),
 sweep(k, i, x) AS (SELECT 0, cell, z FROM terrain UNION ALL SELECT k + 1, t.cell, (t.z + 0.25::DOUBLE * (t.cell % 5) + 0.25::DOUBLE * SUM(s.x)) / (1 + 0.25::DOUBLE * n) FROM sweep s JOIN near ON near.j = s.i JOIN terrain t ON t.cell = near.i JOIN deg ON deg.i = t.cell WHERE k < 120 GROUP BY k, t.cell, t.z, n)
 SELECT i, round(x, 6) AS x FROM sweep WHERE k = 120""")  # fmt: skip
def implicit_diffusion(spark, sf_dir):
    g = ground(spark, sf_dir)
    return solve.implicit_step(g, vector(g), vector(g.withColumn("f", (F.col("cell") % 5).cast("double")), "f"), 0.25).x.select("i", R6("x"))


@query("dominant_eigenvalue", """WITH RECURSIVE c AS (SELECT user_id, event_type, COUNT(*)::DOUBLE AS n FROM events GROUP BY ALL), types AS (SELECT event_type, ROW_NUMBER() OVER (ORDER BY event_type) AS i FROM (SELECT DISTINCT event_type FROM events)),
 m AS (SELECT s.i, t.i AS j, SUM(a.n * b.n) AS a FROM c a JOIN c b USING (user_id) JOIN types s ON s.event_type = a.event_type JOIN types t ON t.event_type = b.event_type GROUP BY ALL),
 it(k, i, x, value) AS (SELECT 0, i, 1.0::DOUBLE, 0.0::DOUBLE FROM types UNION ALL SELECT k + 1, i, y / sqrt(SUM(y * y) OVER ()), SUM(x * y) OVER () / SUM(x * x) OVER () FROM (SELECT k, m.i, SUM(a * x) AS y, MAX(CASE WHEN m.i = m.j THEN x END) AS x FROM it JOIN m ON m.j = it.i WHERE k < 60 GROUP BY k, m.i))
 SELECT i, round(abs(x), 6) AS x, round(value, 4) AS value FROM it WHERE k = 60""")  # fmt: skip
def dominant_eigenvalue(spark, sf_dir):
    """How strongly kinds of events go together: the leading eigenvector of the users' counts by kind."""
    e = table(spark, sf_dir, "events")
    rank = e.select("event_type").distinct().groupBy().agg(F.sort_array(F.collect_list("event_type")).alias("kinds"))  # one row of kinds
    counts = e.groupBy("user_id", "event_type").agg(F.count("*").cast("double").alias("n")).crossJoin(F.broadcast(rank))
    counts = counts.select("user_id", F.array_position("kinds", F.col("event_type")).alias("i"), "n")
    pairs = counts.alias("a").join(counts.alias("b"), "user_id").groupBy(F.col("a.i").alias("i"), F.col("b.i").alias("j")).agg(F.sum(F.col("a.n") * F.col("b.n")).alias("a"))
    found = solve.dominant_eigenvalue(pairs, tol=1e-8)
    return found.vector.select("i", F.round(F.abs("x"), 6).alias("x"), F.round(F.lit(found.value), 4).alias("value"))
