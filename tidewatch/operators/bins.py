"""Counts in time bins, in batch and on streams alike."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F


def floor_time(column: str, minutes: int):
    """Start of the bin; a null time stays null and so stays a group, which ``window`` would drop."""
    return F.timestamp_seconds(F.floor(F.unix_seconds(column) / (minutes * 60)) * (minutes * 60))


def time_bins(df: DataFrame, area: str, time: str, confidence: str, minutes: int, bias: DataFrame | None = None) -> DataFrame:
    """(area, bin, n, mean_confidence[, bias]); rows without a time or area are kept as their own groups.

    ``bias`` (area, bias) has one row for each area; areas without one have bias 1.
    """
    out = df.groupBy(area, floor_time(time, minutes).alias("bin")).agg(F.count("*").alias("n"), F.avg(confidence).alias("mean_confidence"))
    if bias is not None:
        out = out.join(bias.select(area, "bias"), area, "left").withColumn("bias", F.coalesce("bias", F.lit(1.0)))
    return out


def event_windows(spark, start: str, end: str, minutes: int) -> DataFrame:
    """Tumbling windows (window_start, window_end) from start on, while they begin before the end."""
    step = f"interval {minutes} minutes"
    all_ = spark.range(1).select(F.explode(F.sequence(F.to_timestamp(F.lit(start)), F.to_timestamp(F.lit(end)), F.expr(step))).alias("window_start"))
    return all_.where(F.col("window_start") < F.to_timestamp(F.lit(end))).withColumn("window_end", F.col("window_start") + F.expr(step))


def windows_of(df: DataFrame, time: str, minutes: int, unit: str = "hour") -> DataFrame:
    """(window_start, window_end, n): tumbling windows from the first time, cut to ``unit``, to the last, with the rows
    of each; windows without rows have 0. An empty table has none."""
    step = minutes * 60_000_000
    ends = df.agg(F.unix_micros(F.date_trunc(unit, F.min(time))).alias("_a"), F.unix_micros(F.max(time)).alias("_b"))  # one row
    slots = ends.where("_a is not null").select(F.explode(F.sequence(F.lit(0).cast("long"), F.floor((F.col("_b") - F.col("_a")) / step))).alias("_i"), "_a")
    held = df.where(F.col(time).isNotNull()).crossJoin(F.broadcast(ends)).groupBy(F.floor((F.unix_micros(time) - F.col("_a")) / step).alias("_i")).agg(F.count("*").alias("n"))
    begin = F.col("_a") + F.col("_i") * step
    return slots.join(held, "_i", "left").select(F.timestamp_micros(begin).alias("window_start"), F.timestamp_micros(begin + step).alias("window_end"), F.coalesce("n", F.lit(0)).alias("n"))
