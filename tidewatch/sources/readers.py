"""Readers of gauge and report files, and synthetic data from ranges."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import DataFrame, SparkSession, functions as F

from tidewatch.functions.mathx import d
from tidewatch.operators.clean import find_time_column, find_value_column, normalized_units, require_rows


def read_table(spark: SparkSession, path: str) -> DataFrame:
    """CSV, JSON array or JSON lines by suffix and first character; other suffixes are rejected.

    Spark reads the first character, so the path may be in any store that Spark reaches.
    """
    kind = path.rsplit(".", 1)[-1].lower()
    if kind == "csv":
        return require_rows(spark.read.csv(path, header=True))
    if kind in ("json", "ndjson", "jsonl"):
        first = spark.read.text(path).select(F.substring(F.ltrim("value"), 1, 1).alias("c")).where("c <> ''").first()
        return require_rows(spark.read.json(path, multiLine=bool(first and first["c"] == "[")))
    if kind == "parquet":
        return require_rows(spark.read.parquet(path))
    raise ValueError(f"no reader for .{kind} files")


def read_gauges(spark: SparkSession, paths: list[str], unit: str | None = None) -> DataFrame:
    """All files by column name, with ``ts`` and ``value`` from whatever columns hold them."""
    if not paths:
        raise ValueError("no files")
    df = reduce(lambda a, b: a.unionByName(b, allowMissingColumns=True), [read_table(spark, p) for p in paths])
    time, value = find_time_column(df), find_value_column(df)
    return df.withColumn("ts", F.try_to_timestamp(F.col(time).cast("string"))).withColumn("value", normalized_units(F.col(value), unit))


def read_cube(df: DataFrame, threshold: float = 50.0) -> DataFrame:
    """Radar scans as rows (time, latitude, longitude, rain_rate): reliability, missing scans, gaps in time.

    Scans are one row each when gaps are sought; the pixels never share a window.
    """
    scans = df.groupBy("time").agg(F.bool_and(F.col("rain_rate").isNull()).alias("missing_scan"))
    from pyspark.sql import Window

    w = Window.partitionBy(F.lit(0)).orderBy("time")  # one row a scan
    step = scans.withColumn("step", F.unix_micros("time") - F.unix_micros(F.lag("time").over(w)))
    typical = step.agg(F.median("step").alias("typical"))
    flagged = step.crossJoin(F.broadcast(typical)).withColumn("temporal_gap", F.coalesce(F.col("step") > 1.5 * F.col("typical"), F.lit(False))).select("time", "missing_scan", "temporal_gap")
    rate = F.col("rain_rate")
    return df.join(flagged, "time").withColumn("reliability", F.when(F.col("missing_scan"), d(0)).when(rate > 4 * threshold, d(0.5)).otherwise(d(0.9)))


def tiles(boxes: DataFrame, west: str, south: str, east: str, north: str) -> DataFrame:
    """One-degree tiles (lat, lon of their south-west corners) that cover boxes, each once; boxes with nulls have none."""
    at = lambda c: F.floor(c).cast("int")
    span = lambda a, b: F.explode(F.sequence(at(a), at(b)))
    whole = boxes.where((F.col(west) <= F.col(east)) & (F.col(south) <= F.col(north)))
    return whole.select(west, east, span(south, north).alias("lat")).select("lat", span(west, east).alias("lon")).distinct()


def geojson_box(df: DataFrame, column: str) -> DataFrame:
    """Bounding box of each GeoJSON text, whatever its nesting: all numbers pairs inside "coordinates"."""
    pairs = F.regexp_extract_all(column, F.lit(r"\[\s*(-?\d+(?:\.\d+)?)\s*,\s*-?\d+(?:\.\d+)?"), 1), F.regexp_extract_all(column, F.lit(r"\[\s*-?\d+(?:\.\d+)?\s*,\s*(-?\d+(?:\.\d+)?)"), 1)
    x, y = (F.transform(p, lambda v: v.cast("double")) for p in pairs)
    return df.withColumns({"west": F.array_min(x), "south": F.array_min(y), "east": F.array_max(x), "north": F.array_max(y)})


def synthetic_reports(spark: SparkSession, n: int, seed: int, west: float, south: float, east: float, north: float, days: int = 30) -> DataFrame:
    """Seeded random reports in a box; equal seeds give equal rows for an equal number of partitions."""
    return spark.range(n).select(F.col("id").alias("report_id"), (d(west) + F.rand(seed) * (east - west)).alias("lon"), (d(south) + F.rand(seed + 1) * (north - south)).alias("lat"), F.timestamp_seconds(F.lit(1_704_067_200) + F.floor(F.rand(seed + 2) * days * 86_400)).alias("ts"))


def synthetic_terrain(spark: SparkSession, height: int, width: int) -> DataFrame:
    """An analytic raster (r, q, z): a tilted plane with hills."""
    cells = spark.range(height * width).select(F.floor(F.col("id") / width).alias("r"), (F.col("id") % width).alias("q"))
    return cells.withColumn("z", d(100) - F.col("r") * 0.5 + F.sin(F.col("q") / 3.0) * 4 + F.cos(F.col("r") / 5.0) * 3)
