"""Streaming queries, drained over the table that is there."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import functions as F

from tidewatch.registry import query
from tidewatch.sources.tables import table
from tidewatch.streaming import jobs


def scratch(spark) -> str:
    """A folder that driver and executors share: below spark.checkpoint.dir where that is set."""
    base = spark.conf.get("spark.checkpoint.dir", None)
    if not base:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        base = "file://" + tempfile.mkdtemp(prefix="tidewatch-")
    return f"{base.rstrip('/')}/stream-{uuid.uuid4().hex}"


@query("stream_bins", "SELECT user_id, CAST(floor(epoch(ts) / 21600) AS BIGINT) * 21600 AS bin_s, COUNT(*) AS n, round(SUM(value), 4) AS total FROM events GROUP BY 1, 2")
def stream_bins(spark, sf_dir):
    table(spark, sf_dir, "events")
    to = scratch(spark)
    jobs.drained(jobs.windowed_counts(jobs.stream_table(spark, f"{sf_dir}/events.parquet"), "ts", "user_id", 360), f"{to}/out", f"{to}/state", "complete")
    return spark.read.parquet(f"{to}/out").select("user_id", F.unix_seconds("bin").alias("bin_s"), "n", F.round("total", 4).alias("total"))


@query("stream_ewma", "WITH RECURSIVE o AS (SELECT user_id, value, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY ts) AS i FROM events), m(user_id, i, m) AS (SELECT user_id, i, value FROM o WHERE i = 1 UNION ALL SELECT o.user_id, o.i, 0.7::DOUBLE * m.m + 0.3::DOUBLE * o.value FROM m JOIN o ON o.user_id = m.user_id AND o.i = m.i + 1) SELECT user_id, COUNT(*) AS n, round(SUM(m), 3) AS total FROM m GROUP BY 1")
def stream_ewma(spark, sf_dir):
    table(spark, sf_dir, "events")
    to = scratch(spark)
    events = jobs.stream_table(spark, f"{sf_dir}/events.parquet").select("user_id", "ts", "value")
    jobs.drained(jobs.running_ewma(events, "user_id", "ts", "value", 0.7), f"{to}/out", f"{to}/state", "append")
    return spark.read.parquet(f"{to}/out").groupBy("user_id").agg(F.count("*").alias("n"), F.round(F.sum("m"), 3).alias("total"))
