"""Queries over reports that come in pages from a service, and over inputs that are made when they are missing or old."""

from __future__ import annotations

from datetime import datetime

from pyspark.sql import functions as F

from tidewatch.operators.grid import cut
from tidewatch.registry import query
from tidewatch.sources import remote
from tidewatch.sources.tables import REPORTS, readings, reports, table

SINCE, UNTIL = datetime(2024, 1, 5), datetime(2024, 1, 20, 12)
SOURCES = ("north", "east", "west")
OWN = "own AS (SELECT *, CASE CAST(user_id % 3 AS INTEGER) WHEN 0 THEN 'north' WHEN 1 THEN 'east' ELSE 'west' END AS source, CASE WHEN event_id % 2 = 0 THEN 'flood' ELSE 'drain' END AS kind FROM reports)"


def service(spark, sf_dir, times: int = 0, refused: tuple[str, ...] = ()):
    """The reports of a table, offered in pages by three sources; those of ``east`` lack half of their places."""
    own = F.when(F.col("user_id") % 3 == 0, "north").when(F.col("user_id") % 3 == 1, "east").otherwise("west")
    lat = F.when((own == "east") & (F.col("event_id") % 4 < 2), F.lit(None)).otherwise(F.col("lat"))
    kind = F.when(F.col("event_id") % 2 == 0, "flood").otherwise("drain")
    kept = cut(reports(spark, sf_dir).select(F.col("event_id").cast("string").alias("k"), "ts", kind.alias("kind"), lat.alias("lat"), "lon", own.alias("source")))
    folder = kept.inputFiles()[0].rsplit("/", 1)[0]
    columns = {"unique_key": "k", "created": "ts", "complaint_type": "kind", "latitude": "lat", "longitude": "lon"}
    return remote.Failing(remote.TablePages(folder, columns, "source"), times, refused)


FAST = remote.Retry(tries=4, first_s=0.01, longest_s=0.05)


@query("paged_reports", f"""WITH {REPORTS}, {OWN} SELECT source, kind AS complaint_type, COUNT(*) AS n, COUNT(lat) FILTER (WHERE source <> 'east' OR event_id % 4 >= 2) AS n_placed, CAST(MIN(event_id) AS BIGINT) AS first_key, 3 AS attempts
 FROM own WHERE ts >= TIMESTAMP '{SINCE}' AND ts < TIMESTAMP '{UNTIL}' AND source IN ('north', 'east') GROUP BY ALL""")  # fmt: skip
def paged_reports(spark, sf_dir):
    """Pages of two sources, each of which fails twice; time and source go with the requests."""
    asked = (F.col("created") >= F.lit(SINCE)) & (F.col("created") < F.lit(UNTIL)) & F.col("source").isin("north", "east")
    chosen = remote.read_paged(spark, service(spark, sf_dir, times=2), list(SOURCES), asked, rows=500, retry=FAST)
    return remote.once(chosen).groupBy("source", "complaint_type").agg(F.count("*").alias("n"), F.count("latitude").alias("n_placed"), F.min(F.col("unique_key").cast("long")).alias("first_key"), F.max("attempts").alias("attempts"))


@query("source_fall_through", f"""WITH {REPORTS}, {OWN} SELECT event_id, ts, kind AS complaint_type, lat AS latitude, lon AS longitude, source, 'north,east,west' AS tried FROM own WHERE source = 'west'""")
def source_fall_through(spark, sf_dir):
    """The first source refuses, the second lacks places, the third is good."""
    chosen, tried = remote.fall_through(spark, service(spark, sf_dir, refused=("north",)), list(SOURCES), least=90.0, rows=2000, retry=FAST)
    return chosen.select(F.col("unique_key").cast("long").alias("event_id"), F.col("created").alias("ts"), "complaint_type", "latitude", "longitude", "source", F.lit(",".join(n for n, *_ in tried)).alias("tried"))


@query("source_scores", f"""WITH {REPORTS}, {OWN}, p AS (SELECT *, CASE WHEN source = 'east' AND event_id % 4 < 2 THEN NULL ELSE lat END AS y FROM own)
 SELECT source, CASE WHEN source = 'north' THEN 0 ELSE COUNT(*) END AS n_rows, source = 'north' AS failed, CASE WHEN source = 'north' THEN 0.0::DOUBLE ELSE round((AVG((ts IS NOT NULL)::INT) + 1 + AVG((y IS NOT NULL AND lon IS NOT NULL)::INT)) * 100 / 3, 6) END AS score FROM p GROUP BY 1""")  # fmt: skip
def source_scores(spark, sf_dir):
    """All sources side by side; a source that refuses leaves its error and not the query's."""
    pages = remote.read_paged(spark, service(spark, sf_dir, refused=("north",)), list(SOURCES), rows=1000, retry=FAST, skip_failures=True)
    return remote.source_scores(pages).select("source", "n_rows", (F.col("failed_pages") > 0).alias("failed"), F.round("score", 6).alias("score"))


@query("ensured_readings", """WITH r AS (SELECT date_trunc('day', ts) AS day, user_id % 10 AS station, value FROM events WHERE event_id % 17 <> 0) SELECT day, station, COUNT(*) AS n, round(SUM(value), 4) AS total, true AS made_first, false AS made_again, true AS made_when_old FROM r GROUP BY ALL""")
def ensured_readings(spark, sf_dir):
    """A derived table is made when it is missing, found when it is there, and made anew when it is too old."""
    daily = lambda: table(spark, sf_dir, "events").where("event_id % 17 <> 0").groupBy(F.date_trunc("day", "ts").alias("day"), (F.col("user_id") % 10).alias("station")).agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))
    folder = cut(readings(spark, sf_dir).limit(0)).select("station")
    path = folder.inputFiles()[0].rsplit("/", 1)[0] + "-ensured"
    first = remote.ensured(spark, path, daily, required=("total",))[1]
    again = remote.ensured(spark, path, daily, oldest_s=86_400, required=("total",))[1]
    out, old = remote.ensured(spark, path, daily, oldest_s=-1.0, required=("total",))
    return out.withColumns({"made_first": F.lit(first), "made_again": F.lit(again), "made_when_old": F.lit(old)})
