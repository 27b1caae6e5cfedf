"""The tables that the registered queries read, and their canonical shapes."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.mathx import d

#: The box of the synthetic coordinates (west, south, east, north).
BOX = (-122.42, 47.50, -122.24, 47.74)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table with its zone-less times read as UTC, in which the engine's sessions work."""
    if spark.conf.get("spark.sql.session.timeZone") != "UTC":
        spark.conf.set("spark.sql.session.timeZone", "UTC")
    df = spark.read.parquet(f"{sf_dir}/{name}.parquet")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def readings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Gauge readings: hourly times, coarse values and missing ones, so that every quality rule has cases."""
    e = table(spark, sf_dir, "events")
    value = F.when(F.col("event_id") % 17 == 0, F.lit(None)).when(F.col("event_id") % 101 == 0, -F.col("value")).otherwise(F.floor(F.col("value") / 50) * 50.0)
    return e.select("event_id", F.date_trunc("hour", "ts").alias("ts"), F.col("user_id").alias("station"), value.alias("value"))


READINGS = "readings AS (SELECT event_id, date_trunc('hour', ts) AS ts, user_id AS station, CASE WHEN event_id % 17 = 0 THEN NULL WHEN event_id % 101 = 0 THEN -value ELSE floor(value / 50) * 50.0::DOUBLE END AS value FROM events)"


def reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Citizen reports: error events with places on a lattice, some missing."""
    e = table(spark, sf_dir, "events").where("event_type = 'error'")
    west, south, east, north = BOX
    lat = F.when(F.col("event_id") % 23 == 0, F.lit(None)).otherwise(d(south) + d(north - south) * (F.col("user_id") % 7 + F.col("event_id") % 3 * 0.001) / 8)
    lon = d(west) + d(east - west) * (F.col("user_id") % 5) / 6
    when = F.when(F.col("event_id") % 29 == 0, F.lit(None)).otherwise(F.col("ts"))
    return e.select("event_id", "user_id", when.alias("ts"), lat.alias("lat"), lon.alias("lon"), (F.col("user_id") % 11).alias("ward"))


REPORTS = "reports AS (SELECT event_id, user_id, CASE WHEN event_id % 29 = 0 THEN NULL ELSE ts END AS ts, CASE WHEN event_id % 23 = 0 THEN NULL ELSE 47.50::DOUBLE + (47.74::DOUBLE - 47.50::DOUBLE) * (user_id % 7 + event_id % 3 * 0.001::DOUBLE) / 8 END AS lat, -122.42::DOUBLE + (-122.24::DOUBLE - -122.42::DOUBLE) * (user_id % 5) / 6 AS lon, user_id % 11 AS ward FROM events WHERE event_type = 'error')"

#: The dense grid of ``operators.grid.dense`` in SQL.
GRID = """ends AS (SELECT MIN(ts)::DATE AS d0, MAX(ts)::DATE AS d1, MAX(user_id) AS u FROM events),
cells AS (SELECT UNNEST(range(0, u + 1)) AS cell, CAST(ceil(sqrt(u + 1)) AS BIGINT) AS w FROM ends),
days AS (SELECT UNNEST(range(0, date_diff('day', d0, d1) + 1)) AS t FROM ends),
sums AS (SELECT date_diff('day', d0, ts::DATE) AS t, user_id AS cell, SUM(value) AS v, COUNT(*) FILTER (WHERE event_type = 'error') AS c FROM events, ends GROUP BY ALL),
grid AS (SELECT days.t, cells.cell, cells.cell // cells.w AS r, cells.cell % cells.w AS q, w, COALESCE(sums.v, 0.0::DOUBLE) AS v, COALESCE(sums.c, 0) AS c
  FROM days CROSS JOIN cells LEFT JOIN sums ON sums.t = days.t AND sums.cell = cells.cell)"""

#: The raster of ``operators.grid.terrain`` in SQL.
TERRAIN = """tz AS (SELECT user_id AS cell, AVG(value) AS z FROM events GROUP BY 1),
te AS (SELECT CAST(ceil(sqrt(MAX(cell) + 1)) AS BIGINT) AS w, AVG(z) AS m FROM tz),
tf AS (SELECT UNNEST(range(0, w * w)) AS cell, w, m FROM te),
terrain AS (SELECT tf.cell, tf.cell // tf.w AS r, tf.cell % tf.w AS q, tf.w AS h, tf.w AS w, round(COALESCE(tz.z, tf.m), 4) AS z FROM tf LEFT JOIN tz ON tz.cell = tf.cell)"""
