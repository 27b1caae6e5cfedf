"""Queries of drivers, kernels, adaptive cells and reports on an inference."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.functions.mathx import clip, d
from tidewatch.operators import bayes, decide, fields, grid, series
from tidewatch.plans.grids import cells, ground
from tidewatch.plans.inference import GAIN, POST, RISK, post
from tidewatch.plans.surfaces import NORMAL
from tidewatch.registry import query
from tidewatch.sources.tables import GRID, TERRAIN, table

R6 = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)


def r6(x: str) -> str:
    return f"round({x} + 1e-8::DOUBLE, 6)"


FIELD = TERRAIN + ", field AS (SELECT r, q, h, w, z / 100 + (cell % 7) / 10.0::DOUBLE AS s, 0.5::DOUBLE + (cell % 5) / 10.0::DOUBLE AS v, z / 100 AS a, (cell % 10) / 10.0::DOUBLE AS u, cell % 4 AS k FROM terrain)"


def field(spark, sf_dir):
    c = F.col("cell")
    return ground(spark, sf_dir).select("r", "q", "h", "w", (F.col("z") / 100 + c % 7 / 10.0).alias("s"), (d(0.5) + c % 5 / 10.0).alias("v"), (F.col("z") / 100).alias("a"), (c % 10 / 10.0).alias("u"), (c % 4).alias("k"))


def separable_sql(source: str, values: list[str], weight: str, reach: int, name: str) -> str:
    """Relations ``name`` (r, q, h, w, values): rows, then columns of ``source`` weighted by o.k, with mirrored borders."""
    mirror = lambda x, n: f"CASE WHEN ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) < {n} THEN ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) END"
    sums = ", ".join(f"SUM(b.{v} * {weight}) AS {v}" for v in values)
    return f"""{name}_o AS (SELECT UNNEST(range(-{reach}, {reach + 1})) AS k), {name}_1 AS (SELECT a.r, a.q, a.h, a.w, {sums} FROM {source} a CROSS JOIN {name}_o o JOIN {source} b ON b.q = a.q AND b.r = {mirror('a.r + o.k', 'a.h')} GROUP BY ALL),
 {name} AS (SELECT a.r, a.q, a.h, a.w, {sums} FROM {name}_1 a CROSS JOIN {name}_o o JOIN {name}_1 b ON b.r = a.r AND b.q = {mirror('a.q + o.k', 'a.w')} GROUP BY ALL)"""


def gauss_sql(source: str, values: list[str], sigma: float, name: str) -> str:
    reach = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1))
    return separable_sql(source, values, f"exp(-0.5::DOUBLE * power(o.k / {sigma}::DOUBLE, 2)) / {total}::DOUBLE", reach, name)


CORR = "GREATEST(LEAST(GREATEST({c} / (sqrt(({v} + 1e-9::DOUBLE) * (ss + 1e-9::DOUBLE)) + 1e-9::DOUBLE), -1), 1), 0)"


@query("driver_contributions", f"""WITH {FIELD}, {separable_sql('field', ['s', 'a', 'u'], '(1 / 15.0::DOUBLE)', 7, 'fm')},
 mom AS (SELECT r, q, f.h, f.w, power(f.s - m.s, 2) AS ss, power(f.a - m.a, 2) AS aa, power(f.u - m.u, 2) AS uu, (f.a - m.a) * (f.s - m.s) AS sa, (f.u - m.u) * (f.s - m.s) AS su FROM field f JOIN fm m USING (r, q)),
 {separable_sql('mom', ['ss', 'aa', 'uu', 'sa', 'su'], '(1 / 15.0::DOUBLE)', 7, 'mm')}, lk AS (SELECT r, q, h, w, ln(1.0::DOUBLE + k) AS k FROM field), {gauss_sql('lk', ['k'], 5.0, 'dens')},
 parts AS (SELECT r, q, mm.h, mm.w, {CORR.format(c='sa', v='aa')} AS x1, {CORR.format(c='su', v='uu')} AS x2, LEAST(GREATEST((1 - f.v / ((SELECT MAX(v) FROM field) + 1e-9::DOUBLE)) * dens.k / ((SELECT MAX(k) FROM dens) + 1e-9::DOUBLE), 0), 1) AS x3 FROM mm JOIN field f USING (r, q) JOIN dens USING (r, q)),
 {gauss_sql('parts', ['x1', 'x2', 'x3'], 5.0, 'soft')}
 SELECT r, q, {r6('x1 / (x1 + x2 + x3 + 1e-9::DOUBLE)')} AS rainfall, {r6('x2 / (x1 + x2 + x3 + 1e-9::DOUBLE)')} AS terrain, {r6('x3 / (x1 + x2 + x3 + 1e-9::DOUBLE)')} AS observation FROM soft""")  # fmt: skip
def driver_contributions(spark, sf_dir):
    return fields.driver_contributions(field(spark, sf_dir), "s", "v", "a", "u", "k").select("r", "q", R6("rainfall"), R6("terrain"), R6("observation"))


@query("smooth_confidence", f"""WITH {FIELD}, snr AS (SELECT r, q, h, w, abs(s) / sqrt(v + 1e-9::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * ln(1.0::DOUBLE + k) / ((SELECT MAX(ln(1.0::DOUBLE + k)) FROM field) + 1e-9::DOUBLE)) AS c FROM field), {gauss_sql('snr', ['c'], 2.5, 'soft')}
 SELECT r, q, {r6('LEAST(GREATEST(c, 0), 10)')} AS confidence FROM soft""")  # fmt: skip
def smooth_confidence(spark, sf_dir):
    f = field(spark, sf_dir)
    ready = f.crossJoin(F.broadcast(f.agg(F.max(F.log1p("k")).alias("most"))))  # one row
    raw = ready.withColumn("confidence", decide.signal_confidence(F.col("s"), F.col("v"), F.log1p("k") / (F.col("most") + 1e-9)))
    soft = grid.blurs(raw, ["confidence"], 2.5)
    return soft.select("r", "q", clip(F.col("confidence"), 0, 10).alias("confidence")).select("r", "q", R6("confidence"))


@query("rolling_deviation", f"WITH {GRID} SELECT CAST(t AS BIGINT) AS t, cell, {r6('CASE WHEN COUNT(v) OVER g = 3 THEN STDDEV_SAMP(v) OVER g END')} AS deviation FROM grid WINDOW g AS (PARTITION BY cell ORDER BY t ROWS BETWEEN 2 PRECEDING AND CURRENT ROW)")
def rolling_deviation(spark, sf_dir):
    return series.rolling_deviation(cells(spark, sf_dir), "v", "cell", "t", 3).select(F.col("t").cast("long").alias("t"), "cell", R6("deviation"))


KERNEL = "sqrt((1.0::DOUBLE + a.cell % 3) * (1.0::DOUBLE + b.cell % 3)) * sqrt((0.5::DOUBLE + a.cell % 4 / 2.0::DOUBLE) * (0.5::DOUBLE + b.cell % 4 / 2.0::DOUBLE)) / sqrt((power(0.5::DOUBLE + a.cell % 4 / 2.0::DOUBLE, 2) + power(0.5::DOUBLE + b.cell % 4 / 2.0::DOUBLE, 2)) / 2)"


@query("nonstationary_kernel", f"WITH {TERRAIN}, p AS (SELECT a.cell, b.cell AS other, {KERNEL} AS f, sqrt((power(a.r - b.r, 2) + power(a.q - b.q, 2)) / ((power(0.5::DOUBLE + a.cell % 4 / 2.0::DOUBLE, 2) + power(0.5::DOUBLE + b.cell % 4 / 2.0::DOUBLE, 2)) / 2)) AS x FROM terrain a JOIN terrain b ON abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1 AND a.cell <> b.cell) SELECT cell, other, {r6('f * (1 + sqrt(5.0::DOUBLE) * x + 5 / 3.0::DOUBLE * x * x) * exp(-sqrt(5.0::DOUBLE) * x)')} AS matern, {r6('f * exp(-0.5::DOUBLE * x * x)')} AS se FROM p")
def nonstationary_kernel(spark, sf_dir):
    g = ground(spark, sf_dir)
    pairs = grid.neighbors(g, "cell").withColumnRenamed("n", "other").join(g.select("r", "q", "cell"), ["r", "q"])
    var, length = (lambda c: d(1) + F.col(c) % 3), (lambda c: d(0.5) + F.col(c) % 4 / 2.0)
    k = lambda base: fields.nonstationary_kernel(var("cell"), length("cell"), var("other"), length("other"), (F.col("di") * F.col("di") + F.col("dj") * F.col("dj")).cast("double"), base)
    return pairs.select("cell", "other", k("matern").alias("matern"), k("se").alias("se")).select("cell", "other", R6("matern"), R6("se"))


TREE = """pts AS (SELECT event_id, value, 10 * a * a AS x, 10 * b * b AS y FROM (SELECT event_id, value, (event_id * 7 % 1000) / 1000.0::DOUBLE AS a, (user_id * 13 % 997) / 997.0::DOUBLE AS b FROM events)),
 c AS (SELECT *, CAST(floor(x / 10 * 32) AS BIGINT) AS fx, CAST(floor(y / 10 * 32) AS BIGINT) AS fy FROM pts WHERE x >= 0 AND x < 10 AND y >= 0 AND y < 10), lv AS (SELECT UNNEST([2, 3, 4, 5]) AS l),
 s AS (SELECT l, fx // (1 << (5 - l)) AS ix, fy // (1 << (5 - l)) AS iy, COUNT(*) AS n, AVG(value) AS m, STDDEV_POP(value) AS sd FROM c, lv GROUP BY ALL), dn AS (SELECT * FROM s WHERE l < 5 AND n / 100.0::DOUBLE * power(4, l) > 60),
 dv AS (SELECT a.l, a.ix, a.iy FROM dn a JOIN dn b ON b.l <= a.l AND b.ix = a.ix // (1 << (a.l - b.l)) AND b.iy = a.iy // (1 << (a.l - b.l)) GROUP BY ALL HAVING COUNT(*) = a.l - 1),
 lf AS (SELECT 2 AS l, x.range AS ix, y.range AS iy FROM range(4) x, range(4) y UNION ALL SELECT l + 1, ix * 2 + i.range, iy * 2 + j.range FROM dv, range(2) i, range(2) j),
 leaves AS (SELECT lf.l AS level, lf.ix, lf.iy, COALESCE(n, 0) AS n, m, sd FROM (SELECT * FROM lf ANTI JOIN dv USING (l, ix, iy)) lf LEFT JOIN s USING (l, ix, iy))"""
AREA = (0.0, 0.0, 10.0, 10.0)


def scattered(spark, sf_dir):
    a, b = F.col("event_id") * 7 % 1000 / 1000.0, F.col("user_id") * 13 % 997 / 997.0
    return table(spark, sf_dir, "events").select("event_id", "value", (d(10) * a * a).alias("x"), (d(10) * b * b).alias("y"))


@query("adaptive_cells", f"WITH {TREE} SELECT level, ix, iy, n, round(m, 4) AS value, round(CASE WHEN n > 1 THEN sd / sqrt(n) END, 3) AS uncertainty FROM leaves")
def adaptive_cells(spark, sf_dir):
    tree = fields.adaptive_cells(scattered(spark, sf_dir), "x", "y", "value", AREA, 2, 5, 60.0)
    return tree.select("level", "ix", "iy", "n", F.round("value", 4).alias("value"), F.round("uncertainty", 3).alias("uncertainty"))


@query("leaf_at", f"WITH {TREE} SELECT event_id, level, leaves.ix, leaves.iy FROM c JOIN leaves ON leaves.ix = fx // (1 << (5 - level)) AND leaves.iy = fy // (1 << (5 - level))")
def leaf_at(spark, sf_dir):
    p = scattered(spark, sf_dir)
    tree = fields.adaptive_cells(p, "x", "y", "value", AREA, 2, 5, 60.0)
    return fields.leaf_at(p, tree, "x", "y", AREA, 2, 5).select("event_id", "level", "ix", "iy")


CHECKS = POST + f""", {NORMAL}, x AS (SELECT post.t, post.cell, r, q, k, m1, v0, v1, sqrt(v1) AS sd, {GAIN} AS g, {RISK} AS risk FROM post JOIN n ON n.t = post.t AND n.cell = post.cell),
 o AS (SELECT STDDEV_POP(sd) / (AVG(sd) + 1e-9::DOUBLE) AS cv, AVG((risk = 'HIGH')::INT) AS high, COALESCE(AVG(g) FILTER (WHERE k > 0), 0) AS impact, AVG((sd >= 0.9::DOUBLE * (SELECT quantile_cont(sd, 0.9) FROM x))::INT) AS unsure, COUNT(*) FILTER (WHERE k > 0) AS seen, AVG((v0 - v1) / (v0 + 1e-9::DOUBLE)) FILTER (WHERE k > 0) AS less, AVG((m1 < 0)::INT) AS negative, COUNT(DISTINCT round(m1, 3)) AS kinds, COUNT(m1) AS n FROM x),
 st AS (SELECT COUNT(*) AS steps, STDDEV_POP(m) / (AVG(m) + 1e-9::DOUBLE) AS varied FROM (SELECT t, AVG(m1) AS m FROM x GROUP BY 1)), z AS (SELECT r, q, AVG(m1) AS z FROM x GROUP BY 1, 2),
 ro AS (SELECT COUNT(*) AS wins, AVG(v) / ((SELECT VAR_POP(z) FROM z) + 1e-9::DOUBLE) AS rough FROM (SELECT VAR_POP(b.z) AS v FROM z a JOIN z b ON abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1 GROUP BY a.r, a.q HAVING COUNT(*) = 9)),
 e AS (SELECT * FROM o, st, ro),
 checks AS (SELECT 'uncertainty_heterogeneity' AS name, 2.0::DOUBLE AS weight, cv AS metric, CASE WHEN cv >= 0.1 THEN 'PASS' WHEN cv >= 0.05 THEN 'WARN' ELSE 'FAIL' END AS status FROM e
 UNION ALL SELECT 'spatial_structure', 1.0::DOUBLE, CASE WHEN wins < 10 THEN 0 ELSE rough END, CASE WHEN wins < 10 THEN 'SKIP' WHEN rough >= 0.05 THEN 'PASS' ELSE 'WARN' END FROM e
 UNION ALL SELECT 'decision_distribution', 1.5::DOUBLE, high, CASE WHEN high <= 0.8 THEN 'PASS' WHEN high <= 0.88 THEN 'WARN' ELSE 'FAIL' END FROM e
 UNION ALL SELECT 'observation_impact', 2.0::DOUBLE, impact, CASE WHEN impact >= 0.01 THEN 'PASS' WHEN impact >= 0.001 THEN 'WARN' ELSE 'FAIL' END FROM e
 UNION ALL SELECT 'no_decision_exists', 1.5::DOUBLE, unsure, CASE WHEN unsure >= 0.05 THEN 'PASS' ELSE 'WARN' END FROM e
 UNION ALL SELECT 'variance_reduction', 1.5::DOUBLE, CASE WHEN seen < 10 THEN 0 ELSE less END, CASE WHEN seen < 10 THEN 'SKIP' WHEN less >= 0.05 THEN 'PASS' WHEN less > 0 THEN 'WARN' ELSE 'FAIL' END FROM e
 UNION ALL SELECT 'temporal_variation', 1.0::DOUBLE, CASE WHEN steps < 3 THEN 0 ELSE varied END, CASE WHEN steps < 3 THEN 'SKIP' WHEN varied >= 0.1 THEN 'PASS' ELSE 'WARN' END FROM e
 UNION ALL SELECT 'physical_constraints', 1.0::DOUBLE, CASE WHEN negative > 0.01 THEN negative WHEN kinds < 10 THEN kinds / n ELSE 1.0::DOUBLE END, CASE WHEN negative > 0.01 OR kinds < 10 THEN 'FAIL' ELSE 'PASS' END FROM e)"""


def checks(spark, sf_dir):
    p = post(spark, sf_dir)
    p = p.withColumns({"u": F.sqrt("v1"), "gain": bayes.information_gain(F.col("m0"), F.col("v0"), F.col("m1"), F.col("v1"))})
    p = decide.risk_rules(p, "m1", "u")
    return fields.scientific_checks(grid.cut(p.select("t", "cell", "r", "q", "k", "m1", "v1", "v0", "gain", "risk")), "m1", "v1", "v0", "k", "gain", "risk", "cell", "t")


@query("scientific_checks", f"WITH {CHECKS} SELECT name, status, round(metric + 1e-7::DOUBLE, 5) AS metric, weight FROM checks")
def scientific_checks(spark, sf_dir):
    return checks(spark, sf_dir).select("name", "status", F.round(F.col("metric") + 1e-7, 5).alias("metric"), "weight")


@query("scientific_report", f"WITH {CHECKS}, s AS (SELECT COUNT(*) FILTER (WHERE status = 'PASS') AS n_pass, COUNT(*) FILTER (WHERE status = 'WARN') AS n_warn, COUNT(*) FILTER (WHERE status = 'FAIL') AS n_fail, SUM(weight * CASE status WHEN 'PASS' THEN 100 WHEN 'WARN' THEN 60 ELSE 0 END) / SUM(weight) AS integrity FROM checks) SELECT n_pass, n_warn, n_fail, {r6('integrity')} AS integrity, CASE WHEN n_fail > 0 THEN 'FAIL' WHEN n_warn > 2 THEN 'WARN' ELSE 'PASS' END AS status, n_fail = 0 AS is_valid FROM s")
def scientific_report(spark, sf_dir):
    return fields.scientific_report(checks(spark, sf_dir)).select("n_pass", "n_warn", "n_fail", R6("integrity"), "status", "is_valid")


@query("event_report", f"""WITH {POST}, x AS (SELECT *, m1 - LAG(m1) OVER (PARTITION BY cell ORDER BY t) AS dm FROM post), st AS (SELECT t, round(AVG(m1), 9) AS m, round(AVG(k), 9) AS k, AVG(abs(dm)) AS j FROM x GROUP BY 1),
 pk AS (SELECT ARG_MIN(t, (-m, t)) AS a, ARG_MIN(t, (-k, t)) AS b, MAX(k) AS top, MAX(j) > 0.5::DOUBLE AS jumps FROM st), o AS (SELECT AVG((dm < 0)::INT) FILTER (WHERE dm IS NOT NULL) > 0.9 AS persists, AVG((k > 0 AND v1 < 0.05::DOUBLE)::INT) AS overconfident, AVG((k > 0 AND v1 > 0.08::DOUBLE)::INT) AS underconfident FROM x),
 co AS (SELECT CORR(m, u) AS c FROM (SELECT cell, AVG(m1) AS m, AVG(up) AS u FROM post GROUP BY 1))
 SELECT CASE WHEN top > 0 THEN (b - a) * 1440.0::DOUBLE END AS lead_minutes, jumps, persists, {r6('overconfident')} AS overconfident, {r6('underconfident')} AS underconfident, {r6('c')} AS coherence, c < 0.1 AS incoherent FROM pk, o, co""")  # fmt: skip
def event_report(spark, sf_dir):
    p = grid.cut(post(spark, sf_dir).select("t", "cell", "m1", "v1", "k", "up"))
    out = fields.event_report(p, "m1", "v1", "k", "up", "cell", "t", 1440.0, 0.5, 0.05, 0.08)
    return out.select("lead_minutes", "jumps", "persists", R6("overconfident"), R6("underconfident"), R6("coherence"), "incoherent")
