"""Streaming counts and recursions. Batch and stream share their column logic; late rows differ: batch keeps them, a
watermark drops them."""

from __future__ import annotations

from collections.abc import Iterator

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, functions as F
from pyspark.sql.streaming.state import GroupState, GroupStateTimeout


def stream_table(spark: SparkSession, path: str, files_per_batch: int = 1000) -> DataFrame:
    """Parquet files as a stream; times without a zone are read as UTC. A single file is named by a pattern."""
    schema = spark.read.parquet(path).schema
    df = spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_batch).parquet(f"{path}*")
    return df.withColumns({c: F.col(c).cast("timestamp") for c, kind in df.dtypes if kind == "timestamp_ntz"})


def windowed_counts(df: DataFrame, time: str, area: str, minutes: int, late: str = "1 day") -> DataFrame:
    """Counts in tumbling windows of event time; state is dropped once the watermark has passed."""
    w = F.window(time, f"{minutes} minutes")
    return df.withWatermark(time, late).groupBy(area, w).agg(F.count("*").alias("n"), F.sum("value").alias("total")).select(area, F.col("window.start").alias("bin"), "n", "total")


def running_ewma(df: DataFrame, key: str, time: str, value: str, decay: float) -> DataFrame:
    """Exponential memory of each key across micro-batches: one number of state a key, updated in time order."""

    def step(k: tuple, frames: Iterator[pd.DataFrame], state: GroupState) -> Iterator[pd.DataFrame]:
        rows = pd.concat(list(frames)).sort_values(time)
        m = state.get[0] if state.exists else None
        out = []
        for x in rows[value]:
            m = float(x) if m is None else decay * m + (1 - decay) * float(x)
            out.append(m)
        state.update((m,))
        yield pd.DataFrame({key: k[0], time: rows[time].to_numpy(), "m": out})

    kinds = dict(df.dtypes)
    return df.groupBy(key).applyInPandasWithState(step, f"{key} {kinds[key]}, {time} timestamp, m double", "m double", "append", GroupStateTimeout.NoTimeout)


def drained(df: DataFrame, out: str, checkpoint: str, mode: str) -> None:
    """Runs a stream over all that is there now and stops. Complete results are rewritten, others appended."""

    def save(batch: DataFrame, _: int) -> None:
        batch.write.mode("overwrite" if mode == "complete" else "append").parquet(out)

    df.writeStream.outputMode(mode).option("checkpointLocation", checkpoint).trigger(availableNow=True).foreachBatch(save).start().awaitTermination()
