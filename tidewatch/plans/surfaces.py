"""Queries of surfaces, filters, quality reports, dataset checks, boxes and small helpers."""

from __future__ import annotations

import math

from pyspark.sql import functions as F

from tidewatch.functions import geometry, logic, text
from tidewatch.functions.mathx import d
from tidewatch.operators import bayes, bins, calibrate, catalog, decide, grid, learning, match, quality, series
from tidewatch.plans.grids import KALMAN, NODES, cells, ground, hydro, nodes
from tidewatch.plans.inference import FEATURES, GAIN, HIER, PEAK, POST, RISK, features, hierarchy, long_t, peak, post
from tidewatch.plans.knowledge import CATALOG, datasets
from tidewatch.plans.streams import scratch
from tidewatch.registry import query
from tidewatch.sources import readers, writers
from tidewatch.sources.tables import GRID, REPORTS, TERRAIN, reports, table

R6 = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)


def r6(x: str) -> str:
    return f"round({x} + 1e-8::DOUBLE, 6)"


#: Reports with places off the globe and near zero, old and future times, and kinds.
ODD = REPORTS + """, odd AS (SELECT event_id, ward, 'kind ' || (user_id % 23) AS kind, CASE WHEN event_id % 31 = 0 THEN 95.0::DOUBLE ELSE round(lat, 3) END AS lat, CASE WHEN event_id % 37 = 0 THEN 0.05::DOUBLE ELSE lon END AS lon,
 CASE WHEN event_id % 41 = 0 THEN ts - INTERVAL 10950 DAY ELSE ts END AS ts, CASE WHEN event_id % 3 = 0 THEN 'street flood' ELSE 'noise' END AS note FROM reports)"""


def odd_reports(spark, sf_dir):
    rows = reports(spark, sf_dir)
    when = lambda k, a, b: F.when(F.col("event_id") % k == 0, a).otherwise(b)
    return rows.select("event_id", "ward", F.concat(F.lit("kind "), (F.col("user_id") % 23).cast("string")).alias("kind"), when(31, d(95), F.round("lat", 3)).alias("lat"), when(37, d(0.05), F.col("lon")).alias("lon"), when(41, F.expr("ts - interval 10950 days"), F.col("ts")).alias("ts"), when(3, F.lit("street flood"), F.lit("noise")).alias("note"))


NOW = "2024-01-25 00:00:00"


@query("quality_report", f"""WITH {ODD}, n AS (SELECT COUNT(*)::DOUBLE AS n, COUNT(ts)::DOUBLE AS nt FROM odd),
 acc AS (SELECT GREATEST(100 - LEAST(200 * COUNT(*) FILTER (abs(lat) > 90 OR abs(lon) > 180) / MAX(n), 30) - LEAST(200 * COUNT(*) FILTER (abs(lat) < 0.1 OR abs(lon) < 0.1) / MAX(n), 20) - LEAST(300 * COUNT(*) FILTER (ts > TIMESTAMP '{NOW}') / MAX(nt), 25) - LEAST(200 * COUNT(*) FILTER (ts < TIMESTAMP '2000-01-01') / MAX(nt), 15), 0) AS accuracy FROM odd, n),
 k AS (SELECT COUNT(*) AS kinds, MAX(c) AS top FROM (SELECT kind, COUNT(*) AS c FROM odd GROUP BY 1)), dec AS (SELECT STDDEV_SAMP(length(string_split(CAST(lat AS VARCHAR), '.')[2])) AS s FROM odd),
 con AS (SELECT 100 - CASE WHEN kinds > 50 THEN 15 WHEN kinds > 20 THEN 5 ELSE 0 END - CASE WHEN top / n > 0.95 THEN 10 ELSE 0 END - CASE WHEN COALESCE(s, 0) > 2 THEN 10 ELSE 0 END AS consistency FROM k, n, dec),
 tim AS (SELECT 100 - CASE WHEN TIMESTAMP '{NOW}' - MAX(ts) >= INTERVAL 366 DAY THEN 30 ELSE 0 END - CASE WHEN MAX(ts) - MIN(ts) < INTERVAL 7 DAY THEN 20 WHEN MAX(ts) - MIN(ts) < INTERVAL 30 DAY THEN 10 ELSE 0 END AS timeliness FROM odd),
 uni AS (SELECT 100 - CASE WHEN r > 0.2 THEN 30 WHEN r > 0.1 THEN 15 WHEN r > 0.05 THEN 5 ELSE 0 END AS uniqueness FROM (SELECT 1 - COUNT(DISTINCT (ward, kind)) / COUNT(*)::DOUBLE AS r FROM odd)),
 val AS (SELECT 100 - CASE WHEN COUNT(*) < 10 THEN 40 WHEN COUNT(*) < 50 THEN 20 WHEN COUNT(*) < 100 THEN 10 ELSE 0 END - CASE WHEN AVG((note = 'street flood')::INT) < 0.1 THEN 15 ELSE 0 END AS validity FROM odd),
 com AS (SELECT 100 - SUM(CASE WHEN x > 30 THEN 30 WHEN x > 10 THEN 15 WHEN x > 5 THEN 5 ELSE 0 END) AS completeness FROM (SELECT UNNEST([100 * AVG((ts IS NULL)::INT), 100 * AVG((lat IS NULL)::INT), 100 * AVG((lon IS NULL)::INT)]) AS x FROM odd)),
 w AS (SELECT *, (2 * completeness + 2 * accuracy + 1.5::DOUBLE * consistency + timeliness + uniqueness + 1.5::DOUBLE * validity) / 9.0::DOUBLE AS quality FROM acc, con, tim, uni, val, com)
 SELECT {r6('completeness')} AS completeness, {r6('accuracy')} AS accuracy, {r6('consistency')} AS consistency, {r6('timeliness')} AS timeliness, {r6('uniqueness')} AS uniqueness, {r6('validity')} AS validity, {r6('quality')} AS quality, CASE WHEN quality >= 90 THEN 'A' WHEN quality >= 80 THEN 'B' WHEN quality >= 70 THEN 'C' WHEN quality >= 60 THEN 'D' ELSE 'F' END AS grade FROM w""")  # fmt: skip
def quality_report(spark, sf_dir):
    rows = odd_reports(spark, sf_dir)
    parts = [quality.completeness(rows, ["ts", "lat", "lon"]), quality.accuracy(rows, "lat", "lon", "ts", NOW), quality.consistency(rows, "kind", "lat"), quality.timeliness(rows, "ts", NOW), quality.uniqueness_score(rows, ["ward", "kind"]), quality.validity(rows, F.size(text.flood_keywords(F.col("note"))) > 0)]
    one = parts[0]
    for p in parts[1:]:
        one = one.crossJoin(p)  # one row each
    out = quality.quality_score(one)
    return out.select(*[R6(c) for c in out.columns if c != "grade"], "grade")


FILTERED = f"k(t, cell, m, p) AS (SELECT t, cell, {KALMAN.format(m='v / 100', p='1.0::DOUBLE')} FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, {KALMAN.format(m='k.m', p='k.p')} FROM k JOIN grid g ON g.cell = k.cell AND g.t = k.t + 1)"


def filtered(spark, sf_dir):
    g = cells(spark, sf_dir).select("t", "cell", (F.col("v") / 100).alias("m"), F.lit(1.0).alias("p"), F.col("c").cast("double").alias("c"))
    return series.kalman(g, "m", "p", "c", "cell", "t").join(g, ["cell", "t"])


@query("kalman_smooth", f"WITH RECURSIVE {GRID}, {FILTERED}, e AS (SELECT MAX(t) AS n FROM grid), s(t, cell, m, p) AS (SELECT k.t, k.cell, k.m, k.p FROM k, e WHERE k.t = e.n UNION ALL SELECT k.t, k.cell, k.m + k.p / (k.p + 0.1::DOUBLE) * (s.m - k.m), k.p + power(k.p / (k.p + 0.1::DOUBLE), 2) * (s.p - k.p - 0.1::DOUBLE) FROM s JOIN k ON k.cell = s.cell AND k.t = s.t - 1) SELECT t, cell, {r6('m')} AS mean, {r6('p')} AS var FROM s")
def kalman_smooth(spark, sf_dir):
    return series.smooth(filtered(spark, sf_dir), "mean", "var", "cell", "t").select(F.col("t").cast("long").alias("t"), "cell", R6("mean"), R6("var"))


@query("kalman_loglik", f"WITH RECURSIVE {GRID}, {FILTERED}, i AS (SELECT g.cell, g.c - COALESCE(LAG(k.m) OVER w, g.v / 100) AS e, COALESCE(LAG(k.p) OVER w, 1.0::DOUBLE) + 0.3::DOUBLE AS s, g.c FROM k JOIN grid g ON g.cell = k.cell AND g.t = k.t WINDOW w AS (PARTITION BY g.cell ORDER BY g.t)) SELECT cell, {r6('SUM(CASE WHEN c > 0 THEN -0.5::DOUBLE * (ln(2 * pi()) + ln(s) + e * e / s) ELSE 0.0::DOUBLE END)')} AS loglik FROM i GROUP BY 1")
def kalman_loglik(spark, sf_dir):
    return series.innovation_loglik(filtered(spark, sf_dir), "m", "p", "c", "cell", "t").select("cell", R6("loglik"))


@query("agg_extremes", f"""WITH {HIER}, h AS (SELECT n_nationkey AS g, v, s, n, md5(c_custkey::VARCHAR || ':' || n) AS h FROM ch, range(1, 101) AS d(n)), u AS (SELECT g, n, v, s, (('0x' || substr(h, 1, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS a, (('0x' || substr(h, 9, 8))::BIGINT + 0.5::DOUBLE) / 4294967296 AS b FROM h),
 x AS (SELECT g, n, v + s * sqrt(-2 * ln(a)) * cos(2 * pi() * b) AS x FROM u), e AS (SELECT g, n, MAX(x) AS hi, MIN(x) AS lo, MEDIAN(x) AS mid FROM x GROUP BY 1, 2), w AS (SELECT g, STDDEV_POP(hi) AS a, STDDEV_POP(lo) AS b, STDDEV_POP(mid) AS c FROM e GROUP BY 1)
 SELECT n_nationkey, COUNT(*) AS n, round(MAX(v), 4) AS max_value, round(MIN(v), 4) AS min_value, round(MEDIAN(v), 4) AS median_value, round(MAX(a), 4) AS max_sigma, round(MAX(b), 4) AS min_sigma, round(MAX(c), 4) AS median_sigma FROM ch JOIN w ON g = n_nationkey GROUP BY 1""")  # fmt: skip
def agg_extremes(spark, sf_dir):
    out = calibrate.extremes_uncertain(hierarchy(spark, sf_dir), "c_custkey", "v", "s", ["n_nationkey"], draws=100)
    return out.select("n_nationkey", "n", *[F.round(c, 4).alias(c) for c in out.columns if c not in ("n_nationkey", "n")])


def mixture_fit(spark, sf_dir):
    """Two normal distributions fitted to order totals, with the criterion that chooses their number; no SQL form."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    fits = [calibrate.fit_mixture(o, "x", k) for k in (1, 2)]
    rows = [(k + 1, i, w, m, v, f["bic"]) for k, f in enumerate(fits) for i, (w, m, v) in enumerate(zip(f["weights"], f["means"], f["variances"]))]
    return spark.createDataFrame(rows, "k int, component int, weight double, mean double, variance double, bic double")


query("mixture_fit")(mixture_fit)

SUPPLIES = "cat2 AS (SELECT *, quality / 100 AS complete, (id % 5) * 25.0::DOUBLE AS metres, d0 + INTERVAL (id % 30) HOUR AS checked, CASE WHEN id % 4 = 0 THEN 'EPSG:32610' ELSE 'EPSG:4326' END AS crs, kind = 'dem' AS fixed, (id % 3)::DOUBLE AS x0, 0.0::DOUBLE AS y0, (id % 3) + 1.5::DOUBLE AS x1, 1.0::DOUBLE AS y1 FROM cat)"


def supplies(spark, sf_dir):
    i = F.col("id")
    return datasets(spark, sf_dir).withColumns({"complete": F.col("quality") / 100, "metres": (i % 5) * 25.0, "checked": F.timestamp_seconds(F.unix_timestamp("d0") + i % 30 * 3600), "crs": F.when(i % 4 == 0, "EPSG:32610").otherwise("EPSG:4326"), "fixed": F.col("kind") == "dem", "x0": (i % 3).cast("double"), "y0": d(0), "x1": i % 3 + d(1.5), "y1": d(1)})


@query("data_sufficiency", f"WITH {CATALOG}, {SUPPLIES} SELECT id, CASE WHEN kind = 'dem' THEN CASE WHEN metres <= 30 THEN 'PASS' ELSE 'WARN' END WHEN (CASE WHEN complete > 0 THEN complete * 100 ELSE 10 END) >= 100 THEN 'PASS' WHEN (CASE WHEN complete > 0 THEN complete * 100 ELSE 10 END) >= 10 THEN 'WARN' ELSE 'FAIL' END AS status FROM cat2")
def data_sufficiency(spark, sf_dir):
    return supplies(spark, sf_dir).select("id", catalog.sufficiency(F.col("kind"), F.col("complete"), F.col("metres")).alias("status"))


@query("validation_freshness", f"WITH {CATALOG}, {SUPPLIES} SELECT city, COUNT(*) FILTER (checked < TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR) AS n_stale, CASE WHEN COUNT(*) FILTER (checked < TIMESTAMP '2024-01-15' - INTERVAL 24 HOUR) = 0 THEN 'PASS' ELSE 'WARN' END AS status FROM cat2 GROUP BY 1")
def validation_freshness(spark, sf_dir):
    return catalog.freshness(supplies(spark, sf_dir), "checked", "2024-01-15 00:00:00", ["city"])


@query("cross_consistency", f"""WITH {CATALOG}, {SUPPLIES}, f AS (SELECT *, FIRST_VALUE(x0) OVER w AS fx0, FIRST_VALUE(x1) OVER w AS fx1 FROM cat2 WINDOW w AS (PARTITION BY city ORDER BY id)), g AS (SELECT city, COUNT(*) AS n, COUNT(DISTINCT crs) AS n_crs, COUNT(*) FILTER (NOT fixed) AS nt, MAX(d0) FILTER (NOT fixed) AS a, MIN(d1) FILTER (NOT fixed) AS b, BOOL_OR(x0 > fx1 OR x1 < fx0) AS apart FROM f GROUP BY 1)
 SELECT city, n, n_crs, CASE WHEN n < 2 THEN 'PASS' WHEN (nt >= 2 AND a >= b) OR apart THEN 'FAIL' WHEN n_crs > 1 OR (nt >= 2 AND b - a < INTERVAL 7 DAY) THEN 'WARN' ELSE 'PASS' END AS status FROM g""")  # fmt: skip
def cross_consistency(spark, sf_dir):
    return catalog.cross_consistency(supplies(spark, sf_dir), ["city"], "d0", "d1", "crs", ["x0", "y0", "x1", "y1"], "fixed", "id")


def blurred_sql(source: str, value: str, sigma: float, name: str) -> str:
    """Relations ``name`` (r, q, v): both passes of a mirrored Gaussian over ``source`` (r, q, h, w, value)."""
    reach = int(4 * sigma + 0.5)
    total = sum(math.exp(-0.5 * (k / sigma) ** 2) for k in range(-reach, reach + 1))
    weights = f"exp(-0.5::DOUBLE * power(o.k / {sigma}::DOUBLE, 2)) / {total}::DOUBLE"
    mirror = lambda x, n: f"CASE WHEN ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) < {n} THEN ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) ELSE 2 * {n} - 1 - ((({x}) % (2 * {n})) + 2 * {n}) % (2 * {n}) END"
    return f"""{name}_o AS (SELECT UNNEST(range(-{reach}, {reach + 1})) AS k), {name}_1 AS (SELECT a.r, a.q, a.h, a.w, SUM(b.{value} * {weights}) AS v FROM {source} a CROSS JOIN {name}_o o JOIN {source} b ON b.q = a.q AND b.r = {mirror('a.r + o.k', 'a.h')} GROUP BY ALL),
 {name} AS (SELECT a.r, a.q, SUM(b.v * {weights}) AS v FROM {name}_1 a CROSS JOIN {name}_o o JOIN {name}_1 b ON b.r = a.r AND b.q = {mirror('a.q + o.k', 'a.w')} GROUP BY ALL)"""


@query("sparse_smoothing", f"WITH {TERRAIN}, {blurred_sql('terrain', 'z', 1.9, 'soft')} SELECT r, q, {r6('0.7::DOUBLE * soft.v + 0.3::DOUBLE * z')} AS smoothed FROM terrain JOIN soft USING (r, q)")
def sparse_smoothing(spark, sf_dir):
    return grid.sparse_smoothing(ground(spark, sf_dir), "z", 0.45).select("r", "q", R6("smoothed"))


@query("multi_resolution", f"""WITH {TERRAIN}, half AS (SELECT r // 2 AS r, q // 2 AS q, (h + 1) // 2 AS h, (w + 1) // 2 AS w, z FROM terrain WHERE r % 2 = 0 AND q % 2 = 0 AND h > 10 AND w > 10), {blurred_sql('half', 'z', 1.0, 'soft')},
 p AS (SELECT r, q, z, r * ((h + 1) // 2 - 1) / (2.0::DOUBLE * ((h + 1) // 2) - 1) AS y, q * ((w + 1) // 2 - 1) / (2.0::DOUBLE * ((w + 1) // 2) - 1) AS x FROM terrain),
 b AS (SELECT p.r, p.q, SUM(v * (1 - abs(y - soft.r)) * (1 - abs(x - soft.q))) AS up FROM p JOIN soft ON abs(y - soft.r) < 1 AND abs(x - soft.q) < 1 GROUP BY 1, 2)
 SELECT p.r, p.q, {r6('CASE WHEN up IS NULL THEN z ELSE (z + up) / 2 END')} AS blended FROM p LEFT JOIN b ON b.r = p.r AND b.q = p.q""")  # fmt: skip
def multi_resolution(spark, sf_dir):
    return grid.multi_resolution(ground(spark, sf_dir), "z").select("r", "q", R6("blended"))


@query("bilinear", f"WITH {TERRAIN}, p AS (SELECT cell, (cell * 7 % 50) / 10.0::DOUBLE AS y, (cell * 3 % 40) / 10.0::DOUBLE AS x FROM terrain), b AS (SELECT p.cell, y, x, SUM((1 - abs(y - t.r)) * (1 - abs(x - t.q))) AS s, SUM(z * (1 - abs(y - t.r)) * (1 - abs(x - t.q))) AS z FROM p LEFT JOIN terrain t ON abs(y - t.r) < 1 AND abs(x - t.q) < 1 GROUP BY 1, 2, 3) SELECT cell, {r6('CASE WHEN s > 0.999999999 THEN z END')} AS interpolated FROM b")
def bilinear(spark, sf_dir):
    g = ground(spark, sf_dir)
    points = g.select("cell", (F.col("cell") * 7 % 50 / 10.0).alias("y"), (F.col("cell") * 3 % 40 / 10.0).alias("x"))
    return grid.bilinear(points, g, "y", "x", "z").select("cell", R6("interpolated"))


@query("structural_uncertainty", f"WITH {TERRAIN}, s AS (SELECT AVG(z) AS m, STDDEV_POP(z) AS s FROM terrain), e AS (SELECT *, (r < 2 OR r >= h - 2)::INT AS a, (q < 2 OR q >= w - 2)::INT AS b, abs(z - m) / (s + 1e-9::DOUBLE) AS zz FROM terrain, s) SELECT r, q, {r6('0.3::DOUBLE * (a + b + 0.5::DOUBLE * a * b) + CASE WHEN zz > 2 THEN 0.3::DOUBLE * (zz - 2) ELSE 0.0::DOUBLE END')} AS structural FROM e")
def structural_uncertainty(spark, sf_dir):
    return grid.structural_uncertainty(ground(spark, sf_dir), "z").select("r", "q", R6("structural"))


@query("spatial_structure", f"WITH {TERRAIN}, l AS (SELECT a.r, a.q, VAR_POP(b.z) AS v FROM terrain a JOIN terrain b ON abs(a.r - b.r) <= 1 AND abs(a.q - b.q) <= 1 WHERE a.r BETWEEN 1 AND a.h - 2 AND a.q BETWEEN 1 AND a.w - 2 GROUP BY 1, 2), s AS (SELECT COUNT(*) AS n, AVG(v) / ((SELECT VAR_POP(z) FROM terrain) + 1e-9::DOUBLE) AS x FROM l) SELECT n AS n_windows, {r6('x')} AS roughness, CASE WHEN n < 10 THEN 'SKIP' WHEN x >= 0.05 THEN 'PASS' ELSE 'WARN' END AS status FROM s")
def spatial_structure(spark, sf_dir):
    return grid.spatial_structure(ground(spark, sf_dir), "z").select("n_windows", R6("roughness"), "status")


NORMAL = "n AS (SELECT t, cell, m1 / ((SELECT MAX(m1) FROM post) + 1e-9::DOUBLE) AS sn, sqrt(v1) AS u, (sqrt(v1) - (SELECT MIN(sqrt(v1)) FROM post)) / ((SELECT MAX(sqrt(v1)) - MIN(sqrt(v1)) FROM post) + 1e-9::DOUBLE) AS un FROM post)"


@query("decision_share", f"WITH {POST}, {NORMAL}, x AS (SELECT COUNT(*) AS n, AVG(({RISK} = 'HIGH')::INT) AS s FROM n) SELECT n, {r6('s')} AS high_share, CASE WHEN s <= 0.8 THEN 'PASS' WHEN s <= 0.88 THEN 'WARN' ELSE 'FAIL' END AS status FROM x")
def decision_share(spark, sf_dir):
    risks = decide.risk_rules(post(spark, sf_dir).withColumn("u", F.sqrt("v1")), "m1", "u")
    return decide.decision_share(risks, "risk").select("n", R6("high_share"), "status")


@query("inference", f"WITH {POST}, {NORMAL} SELECT post.t, post.cell, {r6('m1')} AS mean, {r6('v1')} AS var, {r6('GREATEST(m1 - 1.96::DOUBLE * sqrt(v1), 0)')} AS ci_lower, {r6('m1 + 1.96::DOUBLE * sqrt(v1)')} AS ci_upper, round({GAIN} + 1e-7::DOUBLE, 5) AS gain_nats, {RISK} AS risk FROM post JOIN n ON n.t = post.t AND n.cell = post.cell")
def inference(spark, sf_dir):
    """Prior, likelihood, posterior, intervals, gain and risk as one call over the grid."""
    out = bayes.inferred(features(spark, sf_dir), "ri", "ra", "up", "k")
    out = decide.risk_rules(out.withColumn("u", F.sqrt("var")), "mean", "u")
    return out.select(long_t(), "cell", R6("mean"), R6("var"), R6("ci_lower"), R6("ci_upper"), F.round(F.col("gain_nats") + 1e-7, 5).alias("gain_nats"), "risk")


@query("signal_confidence", f"WITH {PEAK}, o AS (SELECT *, ln(1 + k) / ((SELECT MAX(ln(1 + k)) FROM n) + 1e-9::DOUBLE) AS ow FROM n) SELECT cell, {r6('LEAST(GREATEST(abs(m1) / sqrt(v1 + 1e-9::DOUBLE) * (0.5::DOUBLE + 0.5::DOUBLE * ow), 0), 10)')} AS confidence FROM o")
def signal_confidence(spark, sf_dir):
    p = peak(spark, sf_dir)
    ready = p.crossJoin(F.broadcast(p.agg(F.max(F.log1p("k")).alias("most"))))
    c = decide.signal_confidence(F.col("m1"), F.col("v1"), F.log1p("k") / (F.col("most") + 1e-9))
    return ready.select("cell", F.least(F.greatest(c, d(0)), d(10)).alias("confidence")).select("cell", R6("confidence"))


@query("distance_to_network", f"WITH {TERRAIN}, {NODES} SELECT a.node, {r6('MIN(sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)))')} AS distance FROM nodes a, nodes b WHERE b.node % 41 = 5 GROUP BY 1")
def distance_to_network(spark, sf_dir):
    n = nodes(spark, sf_dir)
    return match.nearest_neighbors(n, "node", "x", "y", 1, 1.0, among=n.where("node % 41 = 5")).select(F.col("src").alias("node"), R6("distance"))


BOXES = "boxes AS (SELECT s_suppkey AS id, (s_suppkey % 17)::DOUBLE AS x0, (s_suppkey % 13)::DOUBLE AS y0, (s_suppkey % 17) + 1.5::DOUBLE AS x1, (s_suppkey % 13) + (s_suppkey % 3) AS y1 FROM supplier), asked AS (SELECT n_nationkey AS a, n_nationkey * 0.7::DOUBLE AS x0, n_nationkey * 0.5::DOUBLE AS y0, n_nationkey * 0.7::DOUBLE + n_nationkey % 2 AS x1, n_nationkey * 0.5::DOUBLE + n_nationkey % 2 AS y1 FROM nation)"


@query("box_join", f"WITH {BOXES} SELECT a, id FROM boxes b JOIN asked q ON b.x0 <= q.x1 AND b.x1 >= q.x0 AND b.y0 <= q.y1 AND b.y1 >= q.y0")
def box_join(spark, sf_dir):
    s, n = F.col("s_suppkey"), F.col("n_nationkey")
    boxes = table(spark, sf_dir, "supplier").select(s.alias("id"), (s % 17).cast("double").alias("x0"), (s % 13).cast("double").alias("y0"), (s % 17 + d(1.5)).alias("x1"), (s % 13 + s % 3).cast("double").alias("y1"))
    asked = table(spark, sf_dir, "nation").select(n.alias("a"), (n * d(0.7)).alias("x0"), (n * d(0.5)).alias("y0"), (n * d(0.7) + n % 2).alias("x1"), (n * d(0.5) + n % 2).alias("y1"))
    return match.box_join(boxes, asked, "id", "a", 2.0)


@query("event_windows", """WITH e AS (SELECT date_trunc('hour', MIN(ts)) AS a, MAX(ts) AS b FROM events), w AS (SELECT UNNEST(range(a, b + INTERVAL 1 MICROSECOND, INTERVAL 45 MINUTE)) AS window_start FROM e)
 SELECT window_start, window_start + INTERVAL 45 MINUTE AS window_end, COUNT(event_id) AS n FROM w LEFT JOIN events ON ts >= window_start AND ts < window_start + INTERVAL 45 MINUTE GROUP BY 1""")  # fmt: skip
def event_windows(spark, sf_dir):
    return bins.windows_of(table(spark, sf_dir, "events"), "ts", 45)


@query("tiles", """WITH b AS (SELECT c_nationkey, MIN(c_acctbal) / 400 AS x0, MAX(c_acctbal) / 400 AS x1, c_nationkey % 9 * 4 - 20.5::DOUBLE AS y0, c_nationkey % 9 * 4 - 18.5::DOUBLE AS y1 FROM customer GROUP BY 1), r AS (SELECT x0, x1, UNNEST(range(CAST(floor(y0) AS BIGINT), CAST(floor(y1) AS BIGINT) + 1)) AS lat FROM b)
 SELECT DISTINCT CAST(lat AS INTEGER) AS lat, CAST(UNNEST(range(CAST(floor(x0) AS BIGINT), CAST(floor(x1) AS BIGINT) + 1)) AS INTEGER) AS lon FROM r""")  # fmt: skip
def tiles(spark, sf_dir):
    """Tiles that cover one box for each nation's customers."""
    boxes = table(spark, sf_dir, "customer").groupBy("c_nationkey").agg((F.min("c_acctbal") / 400).alias("x0"), (F.max("c_acctbal") / 400).alias("x1"))
    low = F.col("c_nationkey") % 9 * 4
    return readers.tiles(boxes.withColumns({"y0": low - 20.5, "y1": low - 18.5}), "x0", "y0", "x1", "y1")


@query("fuzzy_more", "SELECT s_suppkey, round(LEAST(1.0::DOUBLE, (s_suppkey % 10) / 10.0::DOUBLE + (s_suppkey % 7) / 7.0::DOUBLE), 6) AS either, round(1 - (s_suppkey % 10) / 10.0::DOUBLE, 6) AS negated, round(LEAST(GREATEST(0.3::DOUBLE * (s_suppkey % 10) / 2, 0.01::DOUBLE), 0.95::DOUBLE), 6) AS reporting, round((ln(GREATEST(power((s_suppkey % 7) / 7.0::DOUBLE, 2), 1e-6::DOUBLE)) + power(s_suppkey % 5 - 2, 2) / GREATEST(power((s_suppkey % 7) / 7.0::DOUBLE, 2), 1e-6::DOUBLE)) / 2, 4) AS nll, round(GREATEST(sqrt(power((s_suppkey % 7) / 7.0::DOUBLE, 2) + 0.25::DOUBLE), 0.001::DOUBLE), 6) AS sigma, round(LEAST(GREATEST(s_suppkey % 20 - 7.5::DOUBLE, -5), 5), 6) AS residual FROM supplier")
def fuzzy_more(spark, sf_dir):
    k = F.col("s_suppkey")
    a, b = k % 10 / 10.0, k % 7 / 7.0
    made = {"either": logic.lukasiewicz_or(a, b), "negated": logic.negate(a), "reporting": bayes.reporting_probability(k % 10 / 2.0), "nll": learning.gaussian_nll(d(2), (k % 5).cast("double"), b), "sigma": learning.combined_sigma(b, d(0.5)), "residual": learning.structural_residual((k % 20).cast("double"), d(7.5))}
    return table(spark, sf_dir, "supplier").select("s_suppkey", *[F.round(c, 4 if n == "nll" else 6).alias(n) for n, c in made.items()])


@query("standardized", f"SELECT o_orderkey, {r6('(o_totalprice - (SELECT AVG(o_totalprice) FROM orders)) / (SELECT STDDEV_POP(o_totalprice) FROM orders)')} AS z FROM orders")
def standardized(spark, sf_dir):
    return learning.standardized(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", "z").select("o_orderkey", R6("z"))


@query("boxes_overlap", f"WITH {BOXES} SELECT id, x0 <= 8 AND x1 >= 4 AND y0 <= 6 AND y1 >= 2 AS meets, x0 BETWEEN 4 AND 8 AND y0 BETWEEN 2 AND 6 AS inside FROM boxes")
def boxes_overlap(spark, sf_dir):
    s = F.col("s_suppkey")
    corners = [(s % 17).cast("double"), (s % 13).cast("double"), s % 17 + d(1.5), (s % 13 + s % 3).cast("double")]
    return table(spark, sf_dir, "supplier").select(s.alias("id"), geometry.boxes_overlap(corners, [d(4), d(2), d(8), d(6)]).alias("meets"), geometry.in_box(corners[0], corners[1], (4.0, 2.0, 8.0, 6.0)).alias("inside"))


@query("geojson_boxes", "SELECT n_nationkey, n_nationkey * 1.5::DOUBLE AS west, -2.25::DOUBLE AS south, n_nationkey * 1.5::DOUBLE + 2 AS east, n_regionkey + 0.5::DOUBLE AS north FROM nation")
def geojson_boxes(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_nationkey") * d(1.5)).alias("x0"), d(-2.25).alias("y0"), (F.col("n_nationkey") * d(1.5) + 2).alias("x1"), (F.col("n_regionkey") + d(0.5)).alias("y1"))
    back = writers.geojson_features(n, ["n_nationkey"])
    return readers.geojson_box(back.withColumn("n_nationkey", F.get_json_object("value", "$.properties.n_nationkey").cast("int")), "value").select("n_nationkey", "west", "south", "east", "north")


@query("read_gauges", "SELECT user_id AS station, COUNT(*) AS n, round(SUM(value), 3) AS total, MIN(date_trunc('second', ts)) AS first_ts FROM events GROUP BY 1")
def read_gauges(spark, sf_dir):
    """Readings written as CSV under other names and read back by content."""
    e = table(spark, sf_dir, "events")
    to = f"{scratch(spark)}/gauges.csv"
    writers.write_summaries(e.select(F.date_format("ts", "yyyy-MM-dd HH:mm:ss").alias("obs_time"), F.col("user_id").alias("station"), F.col("value").alias("precip_mm")), to)
    g = readers.read_gauges(spark, [to])
    return g.groupBy(F.col("station").cast("long").alias("station")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 3).alias("total"), F.min("ts").alias("first_ts"))


@query("file_digests")
def file_digests(spark, sf_dir):
    """Digest of a table's file; the SQL side does not know the folder, so a test compares it with hashlib."""
    return writers.file_digests(spark, f"{sf_dir}/nation.parquet").agg(F.count("*").alias("n_files"), F.min("length").alias("length"), F.min("sha256").alias("sha256"))


@query("field_partitions", f"WITH {FEATURES} SELECT t, COUNT(*) AS n, round(SUM(ri), 4) AS rain FROM f WHERE t = 3 GROUP BY 1")
def field_partitions(spark, sf_dir):
    """A long table of fields written by step and read back, one step's folder only."""
    to = f"{scratch(spark)}/fields"
    writers.write_fields(features(spark, sf_dir).select(F.col("t").cast("long").alias("t"), "cell", "ri"), to, by="t")
    back = spark.read.parquet(to).where("t = 3")
    return back.groupBy(F.col("t").cast("long").alias("t")).agg(F.count("*").alias("n"), F.round(F.sum("ri"), 4).alias("rain"))
