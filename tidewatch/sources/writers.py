"""Sinks: GeoJSON lines, summaries, long field tables, reports, provenance."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def geojson_features(df: DataFrame, properties: list[str]) -> DataFrame:
    """One GeoJSON feature a row as ``value``, from box corners x0, y0, x1, y1."""
    pt = lambda x, y: F.array(F.col(x), F.col(y))
    ring = F.array(pt("x0", "y0"), pt("x1", "y0"), pt("x1", "y1"), pt("x0", "y1"), pt("x0", "y0"))
    feature = F.struct(F.lit("Feature").alias("type"), F.struct(F.lit("Polygon").alias("type"), F.array(ring).alias("coordinates")).alias("geometry"), F.struct(*properties).alias("properties"))
    return df.select(F.to_json(feature).alias("value"))


def write_geojson(df: DataFrame, path: str, properties: list[str]) -> None:
    """GeoJSON lines, written by the tasks that hold the rows."""
    geojson_features(df, properties).write.mode("overwrite").text(path)


def write_summaries(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").option("header", True).csv(path)


def write_fields(df: DataFrame, path: str, by: str | None = None) -> None:
    """A long table of fields; ``by`` partitions the folders so that readers prune them."""
    writer = df.write.mode("overwrite")
    (writer.partitionBy(by) if by else writer).parquet(path)


def write_report(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def file_digests(spark, path: str) -> DataFrame:
    """(path, length, sha256) of files, hashed where they are read."""
    return spark.read.format("binaryFile").load(path).select("path", "length", F.sha2("content", 256).alias("sha256"))
