"""Queries over the space-time grid: series, rasters, graphs."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.operators import graph, grid, series
from tidewatch.registry import query
from tidewatch.sources.tables import GRID, TERRAIN, table

R6 = lambda c: F.round(F.col(c), 6).alias(c)
#: Sums of few decimals often end in a five; this moves them off the rounding boundary in both engines.
N6 = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)
D8 = "(VALUES (0, -1, 0), (1, -1, 1), (2, 0, 1), (3, 1, 1), (4, 1, 0), (5, 1, -1), (6, 0, -1), (7, -1, -1)) AS o(code, di, dj)"


def cells(spark, sf_dir):
    return grid.dense(table(spark, sf_dir, "events"))


def ground(spark, sf_dir):
    return grid.terrain(table(spark, sf_dir, "events"))


@query("report_grid", f"WITH {GRID} SELECT t, r, q, c AS n, round(v, 6) AS rain FROM grid")
def report_grid(spark, sf_dir):
    return cells(spark, sf_dir).select("t", F.col("r").cast("long").alias("r"), "q", F.col("c").alias("n"), F.round("v", 6).alias("rain")).withColumn("t", F.col("t").cast("long"))


@query("daily_rain", "SELECT CAST(ts AS DATE) AS day, round(SUM(value), 4) AS rain, COUNT(*) AS n FROM events GROUP BY 1")
def daily_rain(spark, sf_dir):
    return table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day")).agg(F.round(F.sum("value"), 4).alias("rain"), F.count("*").alias("n"))


@query("rain_cumsum", f"WITH {GRID} SELECT t, cell, round(SUM(v) OVER (PARTITION BY cell ORDER BY t), 4) AS total FROM grid")
def rain_cumsum(spark, sf_dir):
    return series.running_sum(cells(spark, sf_dir), "v", "cell", "t", "total").select(F.col("t").cast("long").alias("t"), "cell", F.round("total", 4).alias("total"))


@query("first_steps", f"WITH {GRID} SELECT t, cell, round(v, 6) AS v FROM grid WHERE t < 10 AND cell < 5")
def first_steps(spark, sf_dir):
    return cells(spark, sf_dir).where("t < 10 and cell < 5").select(F.col("t").cast("long").alias("t"), "cell", R6("v"))


@query("window_accum3", f"WITH {GRID} SELECT t, cell, round(v + COALESCE(LAG(v) OVER w, 0) + COALESCE(LAG(v, 2) OVER w, 0), 4) AS accum FROM grid WINDOW w AS (PARTITION BY cell ORDER BY t)")
def window_accum3(spark, sf_dir):
    return series.trailing_sum(cells(spark, sf_dir), "v", "cell", "t", 3, "accum").select(F.col("t").cast("long").alias("t"), "cell", F.round("accum", 4).alias("accum"))


@query("ewma_stress", f"WITH RECURSIVE {GRID}, m(t, cell, m) AS (SELECT t, cell, v FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, 0.35::DOUBLE * m.m + 0.65::DOUBLE * g.v FROM m JOIN grid g ON g.cell = m.cell AND g.t = m.t + 1) SELECT t, cell, round(m + 1e-8::DOUBLE, 6) AS m FROM m")
def ewma_stress(spark, sf_dir):
    return series.ewma(cells(spark, sf_dir), "v", "cell", "t", 0.35).select(F.col("t").cast("long").alias("t"), "cell", N6("m"))


@query("ewma_variance", f"WITH RECURSIVE {GRID}, m(t, cell, v) AS (SELECT t, cell, v / 100 FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, 0.1225::DOUBLE * m.v + 0.4225::DOUBLE * g.v / 100 FROM m JOIN grid g ON g.cell = m.cell AND g.t = m.t + 1) SELECT t, cell, round(GREATEST(v, 1e-4::DOUBLE) + 1e-8::DOUBLE, 6) AS v FROM m")
def ewma_variance(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("s", F.col("v") / 100)
    return series.ewma_variance(g, "s", "cell", "t", 0.35).select(F.col("t").cast("long").alias("t"), "cell", N6("v"))


@query("hysteresis", f"WITH RECURSIVE {GRID}, m(t, cell, y, up) AS (SELECT t, cell, v, FALSE FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, m.y + CASE WHEN g.v > m.y THEN 0.8::DOUBLE ELSE 0.4::DOUBLE END * (g.v - m.y), g.v > m.y FROM m JOIN grid g ON g.cell = m.cell AND g.t = m.t + 1) SELECT t, cell, round(y + 1e-8::DOUBLE, 6) AS y, up AS rising FROM m")
def hysteresis(spark, sf_dir):
    return series.hysteresis(cells(spark, sf_dir), "v", "cell", "t").select(F.col("t").cast("long").alias("t"), "cell", N6("y"), "rising")


KALMAN = "CASE WHEN c > 0 THEN {m} + ({p} + 0.1::DOUBLE) / ({p} + 0.3::DOUBLE) * (c - {m}) ELSE {m} END, CASE WHEN c > 0 THEN (1 - ({p} + 0.1::DOUBLE) / ({p} + 0.3::DOUBLE)) * ({p} + 0.1::DOUBLE) ELSE {p} + 0.1::DOUBLE END"


@query("kalman_scalar", f"WITH RECURSIVE {GRID}, k(t, cell, m, p) AS (SELECT t, cell, {KALMAN.format(m='v / 100', p='1.0::DOUBLE')} FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, {KALMAN.format(m='k.m', p='k.p')} FROM k JOIN grid g ON g.cell = k.cell AND g.t = k.t + 1) SELECT t, cell, round(m + 1e-8::DOUBLE, 6) AS mean, round(p + 1e-8::DOUBLE, 6) AS var FROM k")
def kalman_scalar(spark, sf_dir):
    g = cells(spark, sf_dir).select("t", "cell", (F.col("v") / 100).alias("m"), F.lit(1.0).alias("p"), F.col("c").cast("double").alias("c"))
    return series.kalman(g, "m", "p", "c", "cell", "t").select(F.col("t").cast("long").alias("t"), "cell", N6("mean"), N6("var"))


@query("ou_dynamics", f"WITH RECURSIVE {GRID}, k(t, cell, m, p) AS (SELECT t, cell, v / 100, 0.5::DOUBLE FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, k.m + 0.3::DOUBLE * (0.5::DOUBLE * g.v / 50 - k.m) + 0.3::DOUBLE * g.v / 100, k.p * exp(-0.6::DOUBLE) + 0.01::DOUBLE / 0.6::DOUBLE * (1 - exp(-0.6::DOUBLE)) + 0.15::DOUBLE FROM k JOIN grid g ON g.cell = k.cell AND g.t = k.t + 1) SELECT t, cell, round(m + 1e-8::DOUBLE, 6) AS mean, round(p + 1e-8::DOUBLE, 6) AS var FROM k")
def ou_dynamics(spark, sf_dir):
    g = cells(spark, sf_dir).select("t", "cell", (F.col("v") / 100).alias("m"), F.lit(0.5).alias("p"), (F.col("v") / 50).alias("rain"))
    return series.ornstein_uhlenbeck(g, "m", "p", "rain", "cell", "t").select(F.col("t").cast("long").alias("t"), "cell", N6("mean"), N6("var"))


@query("persistence", f"WITH RECURSIVE {GRID}, m(t, cell, r) AS (SELECT t, cell, v FROM grid WHERE t = 0 UNION ALL SELECT g.t, g.cell, (1 - (g.cell % 5) / 10.0::DOUBLE) * g.v + (g.cell % 5) / 10.0::DOUBLE * m.r FROM m JOIN grid g ON g.cell = m.cell AND g.t = m.t + 1) SELECT t, cell, round(r + 1e-8::DOUBLE, 6) AS r FROM m")
def persistence(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("p", F.col("cell") % 5 / 10.0)
    return series.persistence(g, "v", "p", "cell", "t").select(F.col("t").cast("long").alias("t"), "cell", N6("r"))


KERNEL = series.delay_kernel(24 * 60, mean_hours=30.0, sd_hours=20.0)


@query("delay_convolution", f"WITH {GRID}, k AS (SELECT * FROM (VALUES {', '.join(f'({i}, {x!r}::DOUBLE)' for i, x in enumerate(KERNEL))}) AS k(lag, w)) SELECT a.t, a.cell, round(SUM(k.w * b.v), 6) AS aligned FROM grid a JOIN k ON TRUE JOIN grid b ON b.cell = a.cell AND b.t = a.t - k.lag GROUP BY 1, 2")
def delay_convolution(spark, sf_dir):
    return series.convolve(cells(spark, sf_dir), "v", "cell", "t", KERNEL, "aligned").select(F.col("t").cast("long").alias("t"), "cell", R6("aligned"))


@query("variable_lag", f"WITH {GRID} SELECT a.t, a.cell, round(COALESCE(b.v, f.v), 6) AS lagged FROM grid a LEFT JOIN grid b ON b.cell = a.cell AND b.t = a.t - a.cell % 4 JOIN grid f ON f.cell = a.cell AND f.t = 0")
def variable_lag(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("k", (F.col("cell") % 4).cast("int"))
    return series.lag_by(g, "v", "k", "cell", "t", "lagged").select(F.col("t").cast("long").alias("t"), "cell", R6("lagged"))


@query("peak_times", f"WITH {GRID} SELECT cell, t AS peak_t, round(v, 6) AS peak_value FROM grid QUALIFY ROW_NUMBER() OVER (PARTITION BY cell ORDER BY v DESC, t) = 1")
def peak_times(spark, sf_dir):
    return series.peak_times(cells(spark, sf_dir), "v", "cell", "t").select("cell", F.col("peak_t").cast("long").alias("peak_t"), R6("peak_value"))


@query("peak_slice", f"WITH {GRID} SELECT t AS peak_t, round(AVG(v), 6) AS peak_mean FROM grid GROUP BY t ORDER BY AVG(v) DESC, t LIMIT 1")
def peak_slice(spark, sf_dir):
    return series.peak_slice(cells(spark, sf_dir), "v", "t").select(F.col("peak_t").cast("long").alias("peak_t"), R6("peak_mean"))


@query("asymmetry", f"WITH {GRID}, d AS (SELECT cell, v - LAG(v) OVER (PARTITION BY cell ORDER BY t) AS d FROM grid) SELECT cell, round(COALESCE(AVG(d) FILTER (WHERE d > 0), 0), 6) AS mean_rise, round(COALESCE(AVG(-d) FILTER (WHERE d < 0), 0), 6) AS mean_fall FROM d GROUP BY 1")
def asymmetry(spark, sf_dir):
    return series.asymmetry(cells(spark, sf_dir), "v", "cell", "t").select("cell", R6("mean_rise"), R6("mean_fall"))


@query("lead_lag_corr", f"WITH {GRID}, l AS (SELECT UNNEST(range(0, 6)) AS k) SELECT CAST(k AS INT) AS lag, round(CORR(a.c, b.v), 6) AS corr FROM l JOIN grid a ON TRUE JOIN grid b ON b.cell = a.cell AND b.t = a.t - k GROUP BY 1")
def lead_lag_corr(spark, sf_dir):
    return series.lag_correlations(cells(spark, sf_dir), "v", "c", "cell", "t", 5).select("lag", R6("corr"))


@query("autocorr", f"WITH {GRID}, l AS (SELECT UNNEST(range(0, 11)) AS k) SELECT CAST(k AS INT) AS lag, round(CORR(a.v, b.v), 6) AS corr FROM l JOIN grid a ON TRUE JOIN grid b ON b.cell = a.cell AND b.t = a.t - k GROUP BY 1")
def autocorr(spark, sf_dir):
    return series.lag_correlations(cells(spark, sf_dir), "v", "v", "cell", "t", 10).select("lag", R6("corr"))


@query("lag1_decay", f"WITH {GRID}, p AS (SELECT a.cell, CORR(a.v, b.v) AS rho, COUNT(*) AS n FROM grid a JOIN grid b ON b.cell = a.cell AND b.t = a.t - 1 GROUP BY 1) SELECT COUNT(*) AS n_cells, round(AVG(rho), 6) AS mean_rho, round(LEAST(GREATEST(1 - AVG(rho), 0.05::DOUBLE), 0.95::DOUBLE), 6) AS decay FROM p WHERE rho IS NOT NULL AND NOT isnan(rho)")
def lag1_decay(spark, sf_dir):
    return series.lag1_decay(cells(spark, sf_dir), "v", "cell", "t").select("n_cells", R6("mean_rho"), R6("decay"))


@query("sliding_windows", f"WITH {GRID} SELECT a.cell, a.t AS start_t, COUNT(*) FILTER (WHERE b.c > 0) AS n_valid, round(AVG(CASE WHEN b.c > 0 THEN b.v END), 6) AS window_mean FROM grid a JOIN grid b ON b.cell = a.cell AND b.t BETWEEN a.t AND a.t + 6 WHERE a.t + 7 <= (SELECT MAX(t) FROM grid) GROUP BY 1, 2 HAVING COUNT(*) FILTER (WHERE b.c > 0) >= 3.5")
def sliding_windows(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("x", F.when(F.col("c") > 0, F.col("v")))
    return series.sliding_windows(g, "x", "cell", "t").select("cell", F.col("start_t").cast("long").alias("start_t"), "n_valid", R6("window_mean"))


@query("temporal_split", f"WITH {GRID} SELECT CASE WHEN t < floor((SELECT MAX(t) + 1 FROM grid) * 0.7::DOUBLE) THEN 'train' ELSE 'validation' END AS part, COUNT(*) AS n, round(AVG(v), 6) AS mean_v FROM grid GROUP BY 1")
def temporal_split(spark, sf_dir):
    return series.chronological_split(cells(spark, sf_dir), "t", 0.3).groupBy("part").agg(F.count("*").alias("n"), F.round(F.avg("v"), 6).alias("mean_v"))


@query("slope", f"WITH {TERRAIN} SELECT a.r, a.q, round(degrees(atan(sqrt(power((d.z - u.z) / 2, 2) + power((e.z - w.z) / 2, 2)))), 6) AS slope FROM terrain a JOIN terrain u ON u.r = (a.r + a.h - 1) % a.h AND u.q = a.q JOIN terrain d ON d.r = (a.r + 1) % a.h AND d.q = a.q JOIN terrain w ON w.r = a.r AND w.q = (a.q + a.w - 1) % a.w JOIN terrain e ON e.r = a.r AND e.q = (a.q + 1) % a.w")
def slope(spark, sf_dir):
    return grid.slope_degrees(ground(spark, sf_dir)).select("r", "q", R6("slope"))


AROUND8 = f"n AS (SELECT a.r, a.q, b.z FROM terrain a, {D8}, terrain b WHERE b.r = (a.r + di + a.h) % a.h AND b.q = (a.q + dj + a.w) % a.w)"
AROUND9 = "o AS (SELECT i.i AS di, j.i AS dj FROM (VALUES (-1), (0), (1)) i(i), (VALUES (-1), (0), (1)) j(i))"


@query("fill_sinks", f"WITH {TERRAIN}, {AROUND8}, m AS (SELECT r, q, MIN(z) AS low FROM n GROUP BY 1, 2) SELECT r, q, round(low, 6) AS least, round(CASE WHEN low > z THEN z + LEAST(low - z, 0.5::DOUBLE) ELSE z END, 6) AS filled FROM terrain JOIN m USING (r, q)")
def fill_sinks(spark, sf_dir):
    return grid.fill_sinks(ground(spark, sf_dir)).select("r", "q", R6("least"), R6("filled"))


@query("mean_filter3", f"WITH {TERRAIN}, {AROUND9} SELECT a.r, a.q, round(AVG(b.z), 6) AS smooth FROM terrain a, o JOIN terrain b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY 1, 2")
def mean_filter3(spark, sf_dir):
    return grid.mean_filter(ground(spark, sf_dir)).select("r", "q", R6("smooth"))


@query("spike_mad", f"""WITH {TERRAIN}, {AROUND9}, m AS (SELECT a.r, a.q, a.h, a.w, a.z, MEDIAN(b.z) AS med FROM terrain a, o JOIN terrain b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY ALL),
 x AS (SELECT a.r, a.q, a.z, a.med, MEDIAN(abs(b.z - b.med)) AS mad FROM m a, o JOIN m b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY ALL) SELECT r, q, round(med, 6) AS med, round(mad, 6) AS mad, abs(z - med) / (mad * 1.4826::DOUBLE + 1e-6::DOUBLE) > 6 AS spike FROM x""")  # fmt: skip
def spike_mad(spark, sf_dir):
    return grid.spikes(ground(spark, sf_dir)).select("r", "q", R6("med"), R6("mad"), "spike")


FLOW = f"""d AS (SELECT a.r, a.q, o.code, a.z - b.z AS fall FROM terrain a, {D8}, terrain b WHERE b.r = a.r + di AND b.q = a.q + dj AND a.z > b.z AND a.r BETWEEN 1 AND a.h - 2 AND a.q BETWEEN 1 AND a.w - 2),
flow AS (SELECT r, q, code FROM d QUALIFY ROW_NUMBER() OVER (PARTITION BY r, q ORDER BY fall DESC, code) = 1)"""
REACH = f"""edges AS (SELECT f.r * (SELECT MAX(w) FROM terrain) + f.q AS src, (f.r + di) * (SELECT MAX(w) FROM terrain) + f.q + dj AS dst FROM flow f JOIN {D8} ON o.code = f.code),
up(root, cell) AS (SELECT cell, cell FROM terrain UNION ALL SELECT up.root, e.dst FROM up JOIN edges e ON e.src = up.cell), acc AS (SELECT cell, COUNT(*) AS n FROM up GROUP BY 1)"""


@query("d8_direction", f"WITH {TERRAIN}, {FLOW} SELECT terrain.r, terrain.q, CAST(COALESCE(code, -1) AS INT) AS code FROM terrain LEFT JOIN flow USING (r, q)")
def d8_direction(spark, sf_dir):
    return grid.flow_direction(ground(spark, sf_dir)).select("r", "q", "code")


@query("flow_accum", f"WITH RECURSIVE {TERRAIN}, {FLOW}, {REACH} SELECT cell, n AS accumulation FROM acc")
def flow_accum(spark, sf_dir):
    return grid.flow_accumulation(grid.flow_direction(ground(spark, sf_dir)))


@query("upstream_index", f"WITH RECURSIVE {TERRAIN}, {FLOW}, {REACH} SELECT cell, round((n - (SELECT MIN(n) FROM acc)) / ((SELECT MAX(n) FROM acc) - (SELECT MIN(n) FROM acc) + 1e-6::DOUBLE), 6) AS contribution, CASE WHEN cell % 9 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS contribution_confidence FROM acc")
def upstream_index(spark, sf_dir):
    acc = grid.flow_accumulation(grid.flow_direction(ground(spark, sf_dir)))
    return grid.upstream_index(acc, F.col("cell") % 9 == 0).select("cell", R6("contribution"), "contribution_confidence")


#: The raster with its sinks filled and smoothed in place of the raw one, with the marks of spikes and flat places.
PROCESSED = f"""{TERRAIN.replace('terrain AS', 'raw AS')}, n AS (SELECT a.r, a.q, b.z FROM raw a, {D8}, raw b WHERE b.r = (a.r + di + a.h) % a.h AND b.q = (a.q + dj + a.w) % a.w), low AS (SELECT r, q, MIN(z) AS low FROM n GROUP BY 1, 2),
filled AS (SELECT raw.* REPLACE (CASE WHEN low > z THEN z + LEAST(low - z, 0.5::DOUBLE) ELSE z END AS z) FROM raw JOIN low USING (r, q)), {AROUND9},
terrain AS (SELECT a.cell, a.r, a.q, a.h, a.w, AVG(b.z) AS z FROM filled a, o JOIN filled b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY ALL),
md AS (SELECT a.cell, a.r, a.q, a.h, a.w, a.z, MEDIAN(b.z) AS med FROM terrain a, o JOIN terrain b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY ALL),
sk AS (SELECT a.cell, abs(a.z - a.med) / (MEDIAN(abs(b.z - b.med)) * 1.4826::DOUBLE + 1e-6::DOUBLE) > 6 AS spike FROM md a, o JOIN md b ON b.r = GREATEST(LEAST(a.r + di, a.h - 1), 0) AND b.q = GREATEST(LEAST(a.q + dj, a.w - 1), 0) GROUP BY a.cell, a.z, a.med),
sl AS (SELECT a.cell, degrees(atan(sqrt(power((d.z - u.z) / 2, 2) + power((e.z - w.z) / 2, 2)))) < 0.1 AS flat FROM terrain a JOIN terrain u ON u.r = (a.r + a.h - 1) % a.h AND u.q = a.q JOIN terrain d ON d.r = (a.r + 1) % a.h AND d.q = a.q JOIN terrain w ON w.r = a.r AND w.q = (a.q + a.w - 1) % a.w JOIN terrain e ON e.r = a.r AND e.q = (a.q + 1) % a.w)"""


@query("terrain_chain", f"""WITH RECURSIVE {PROCESSED}, {FLOW}, {REACH}
 SELECT t.cell, round(t.z, 6) AS processed, CAST(COALESCE(code, -1) AS INT) AS code, acc.n AS accumulation, spike OR flat AS artifact, round((acc.n - (SELECT MIN(n) FROM acc)) / ((SELECT MAX(n) FROM acc) - (SELECT MIN(n) FROM acc) + 1e-6::DOUBLE), 6) AS contribution, CASE WHEN spike OR flat THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END AS contribution_confidence
 FROM terrain t LEFT JOIN flow USING (r, q) JOIN acc ON acc.cell = t.cell JOIN sk ON sk.cell = t.cell JOIN sl ON sl.cell = t.cell""")  # fmt: skip
def terrain_chain(spark, sf_dir):
    """Elevations to upstream shares in one call."""
    out = grid.terrain_chain(ground(spark, sf_dir))
    return out.select("cell", R6("processed"), "code", "accumulation", "artifact", R6("contribution"), "contribution_confidence")


@query("pyramid_coarsen", f"WITH {GRID} SELECT t, r // 2 AS r, q // 2 AS q, round(SUM(v / (1 + c)) / SUM(1.0::DOUBLE / (1 + c)), 6) AS value, round(1 / SUM(1.0::DOUBLE / (1 + c)), 6) AS variance, COUNT(*) AS n_cells FROM grid GROUP BY 1, 2, 3")
def pyramid_coarsen(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("s", F.lit(1.0) + F.col("c"))
    return grid.coarsen(g, "v", "s", ("t",)).select(F.col("t").cast("long").alias("t"), "r", "q", R6("value"), R6("variance"), "n_cells")


@query("strided_means", f"WITH {GRID} SELECT round(AVG(v), 6) AS level0, round(AVG(v) FILTER (WHERE r % 2 = 0 AND q % 2 = 0), 6) AS level1, round(AVG(v) FILTER (WHERE r % 4 = 0 AND q % 4 = 0), 6) AS level2 FROM grid")
def strided_means(spark, sf_dir):
    return grid.strided_means(cells(spark, sf_dir), "v").select(R6("level0"), R6("level1"), R6("level2"))


@query("roughness", f"""WITH {GRID}, g AS (SELECT t, CASE WHEN u.v IS NULL AND d.v IS NULL THEN 0 WHEN u.v IS NULL THEN d.v - a.v WHEN d.v IS NULL THEN a.v - u.v ELSE (d.v - u.v) / 2 END AS gy, CASE WHEN l.v IS NULL AND e.v IS NULL THEN 0 WHEN l.v IS NULL THEN e.v - a.v WHEN e.v IS NULL THEN a.v - l.v ELSE (e.v - l.v) / 2 END AS gx
 FROM grid a LEFT JOIN grid u ON u.t = a.t AND u.r = a.r - 1 AND u.q = a.q LEFT JOIN grid d ON d.t = a.t AND d.r = a.r + 1 AND d.q = a.q LEFT JOIN grid l ON l.t = a.t AND l.r = a.r AND l.q = a.q - 1 LEFT JOIN grid e ON e.t = a.t AND e.r = a.r AND e.q = a.q + 1) SELECT t, round(AVG(sqrt(gx * gx + gy * gy)), 6) AS roughness FROM g GROUP BY 1""".replace("SELECT t, CASE", "SELECT a.t, CASE"))  # fmt: skip
def roughness(spark, sf_dir):
    return grid.roughness(cells(spark, sf_dir), "v", ("t",)).select(F.col("t").cast("long").alias("t"), R6("roughness"))


@query("local_spread", f"WITH {GRID} SELECT a.t, a.r, a.q, COUNT(*) AS n_around, round(AVG(b.v), 6) AS mean_around, round(STDDEV_POP(b.v), 6) AS std_around FROM grid a JOIN grid b ON b.t = a.t AND b.r BETWEEN a.r - 1 AND a.r + 1 AND b.q BETWEEN a.q - 1 AND a.q + 1 WHERE a.t < 5 GROUP BY 1, 2, 3")
def local_spread(spark, sf_dir):
    g = cells(spark, sf_dir).where("t < 5").withColumn("h", F.col("w"))
    out = grid.local_spread(g, "v", ("t",))
    return out.select(F.col("t").cast("long").alias("t"), F.col("r").cast("long").alias("r"), "q", "n_around", R6("mean_around"), R6("std_around"))


@query("raster_sample", f"WITH {TERRAIN}, p AS (SELECT event_id, value / 20 AS x, (event_id % 13) * 0.7::DOUBLE AS y FROM events) SELECT event_id, round(z, 6) AS sampled FROM p LEFT JOIN terrain ON terrain.r = CAST(round_even(y, 0) AS BIGINT) AND terrain.q = CAST(round_even(x, 0) AS BIGINT)")
def raster_sample(spark, sf_dir):
    p = table(spark, sf_dir, "events").select("event_id", (F.col("value") / 20).alias("x"), (F.col("event_id") % 13 * 0.7).alias("y"))
    return grid.sample_at(p, ground(spark, sf_dir), "x", "y", "z", 1.0).select("event_id", R6("sampled"))


@query("cell_boxes", f"WITH {TERRAIN} SELECT cell, round(-122.42::DOUBLE + q * 0.01::DOUBLE, 6) AS x0, round(47.74::DOUBLE - r * 0.02::DOUBLE - 0.02::DOUBLE, 6) AS y0, round(-122.42::DOUBLE + q * 0.01::DOUBLE + 0.01::DOUBLE, 6) AS x1, round(47.74::DOUBLE - r * 0.02::DOUBLE, 6) AS y1 FROM terrain")
def cell_boxes(spark, sf_dir):
    return grid.cell_boxes(ground(spark, sf_dir), -122.42, 47.74, 0.01, 0.02).select("cell", R6("x0"), R6("y0"), R6("x1"), R6("y1"))


@query("mosaic", f"WITH {GRID} SELECT r, q, round(v, 6) AS v, t FROM grid WHERE v > 400 QUALIFY ROW_NUMBER() OVER (PARTITION BY r, q ORDER BY t) = 1")
def mosaic(spark, sf_dir):
    g = cells(spark, sf_dir).withColumn("v", F.when(F.col("v") > 400, F.col("v")))
    return grid.mosaic(g, "t", "v").select(F.col("r").cast("long").alias("r"), "q", R6("v"), F.col("t").cast("long").alias("t"))


NODES = f"""nodes AS (SELECT cell AS node, q::DOUBLE AS x, r::DOUBLE AS y, z, (cell % 7)::DOUBLE AS flow FROM terrain), hydro AS (SELECT a.node AS src, b.node AS dst, exp(-(a.z - b.z) / 10) * sqrt((a.flow + 1) / (b.flow + 1)) AS weight FROM nodes a, {D8}, nodes b WHERE b.y = a.y + di AND b.x = a.x + dj AND a.z > b.z)"""


def nodes(spark, sf_dir):
    return ground(spark, sf_dir).select(F.col("cell").alias("node"), F.col("q").cast("double").alias("x"), F.col("r").cast("double").alias("y"), "z", (F.col("cell") % 7).cast("double").alias("flow"))


def hydro(spark, sf_dir):
    return graph.downhill_edges(ground(spark, sf_dir).withColumn("flow", (F.col("cell") % 7).cast("double")), "z", "flow")


@query("hydro_edges", f"WITH {TERRAIN}, {NODES} SELECT src, dst, round(weight, 6) AS weight FROM hydro")
def hydro_edges(spark, sf_dir):
    return hydro(spark, sf_dir).select("src", "dst", R6("weight"))


@query("edge_dedup", f"WITH {TERRAIN}, {NODES}, p AS (SELECT *, 0 AS p FROM hydro UNION ALL SELECT dst, src, weight, 1 FROM hydro UNION ALL SELECT node, node, 1.0::DOUBLE, 2 FROM nodes), o AS (SELECT src, dst, weight FROM p QUALIFY ROW_NUMBER() OVER (PARTITION BY src, dst ORDER BY p) = 1) SELECT src, dst, round(weight / ((SELECT MAX(weight) FROM o) + 1e-8::DOUBLE), 6) AS weight FROM o")
def edge_dedup(spark, sf_dir):
    return graph.undirected(hydro(spark, sf_dir), ground(spark, sf_dir)).select("src", "dst", R6("weight"))


@query("edge_weights", f"WITH {TERRAIN}, {NODES}, w AS (SELECT src, dst, LEAST(GREATEST((0.4::DOUBLE * exp(-sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2))) + 0.15::DOUBLE * sqrt((a.flow + 1) / (b.flow + 1)) + 0.15::DOUBLE / (1 + exp(-(a.z - b.z)))) / 0.7::DOUBLE, 0.01::DOUBLE), 1.0::DOUBLE) AS w FROM hydro JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst) SELECT src, dst, round(w / (SELECT MAX(w) FROM w), 6) AS weight FROM w")
def edge_weights(spark, sf_dir):
    return graph.edge_weights(hydro(spark, sf_dir), nodes(spark, sf_dir)).select("src", "dst", R6("weight"))


@query("attention_softmax", f"WITH {TERRAIN}, {NODES} SELECT src, dst, round(exp(weight / 0.5::DOUBLE) / SUM(exp(weight / 0.5::DOUBLE)) OVER (PARTITION BY src), 6) AS attention FROM hydro")
def attention_softmax(spark, sf_dir):
    return graph.attention(hydro(spark, sf_dir), "weight", 0.5).select("src", "dst", R6("attention"))


@query("sym_norm", f"WITH {TERRAIN}, {NODES}, g AS (SELECT src AS node, 1 / sqrt(SUM(weight)) AS d FROM hydro GROUP BY 1) SELECT src, dst, round(weight * a.d * COALESCE(b.d, 0), 6) AS weight FROM hydro JOIN g a ON a.node = src LEFT JOIN g b ON b.node = dst")
def sym_norm(spark, sf_dir):
    return graph.symmetric(hydro(spark, sf_dir)).select("src", "dst", R6("weight"))


@query("smoothness", f"WITH {TERRAIN}, {NODES} SELECT round(AVG(weight * power(a.z - b.z, 2)), 4) AS smoothness, COUNT(*) AS n_edges FROM hydro JOIN nodes a ON a.node = src JOIN nodes b ON b.node = dst")
def smoothness(spark, sf_dir):
    return graph.smoothness(hydro(spark, sf_dir), nodes(spark, sf_dir), "z").select(F.round("smoothness", 4).alias("smoothness"), "n_edges")


@query("gated_message", f"WITH {TERRAIN}, {NODES} SELECT dst AS node, round(SUM(a.z / (1 + exp(-weight))), 4) AS message FROM hydro JOIN nodes a ON a.node = src GROUP BY 1")
def gated_message(spark, sf_dir):
    return graph.gated_sum(hydro(spark, sf_dir), nodes(spark, sf_dir), "z").select("node", F.round("message", 4).alias("message"))


@query("knn_edges", f"WITH {TERRAIN}, {NODES} SELECT a.node AS src, b.node AS dst, round(1 / (sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)) + 1), 6) AS weight FROM nodes a JOIN nodes b ON a.node <> b.node QUALIFY ROW_NUMBER() OVER (PARTITION BY a.node ORDER BY sqrt(power(a.x - b.x, 2) + power(a.y - b.y, 2)), b.node) <= 8")
def knn_edges(spark, sf_dir):
    from tidewatch.operators.match import nearest_neighbors

    return nearest_neighbors(nodes(spark, sf_dir), "node", "x", "y", 8, 2.0).select("src", "dst", F.round(1 / (F.col("distance") + 1), 6).alias("weight"))


@query("shortest_paths", f"""WITH RECURSIVE {TERRAIN}, {NODES}, e AS (SELECT src, dst, round(weight, 3) + 0.5::DOUBLE AS w FROM hydro), p(node, d) AS (SELECT node, 0.0::DOUBLE FROM nodes WHERE node IN (3, 17) UNION SELECT e.dst, round(p.d + e.w, 9) FROM p JOIN e ON e.src = p.node)
 SELECT node, round(MIN(d), 6) AS distance FROM p GROUP BY 1""")  # fmt: skip
def shortest_paths(spark, sf_dir):
    e = hydro(spark, sf_dir).select("src", "dst", (F.round("weight", 3) + 0.5).alias("weight"))
    out = graph.distances(e, nodes(spark, sf_dir).where("node in (3, 17)").select("node"))
    return out.select("node", R6("distance"))


@query("laplacian_matvec", f"WITH {TERRAIN}, {NODES} SELECT a.node AS i, round(SUM(b.z - a.z), 4) AS x FROM nodes a JOIN nodes b ON abs(a.x - b.x) + abs(a.y - b.y) = 1 GROUP BY 1")
def laplacian_matvec(spark, sf_dir):
    g = ground(spark, sf_dir)
    out = graph.matvec(graph.laplacian(g), g.select(F.col("cell").alias("i"), F.col("z").alias("x")))
    return out.select("i", F.round("x", 4).alias("x"))
