"""Queries over readings and reports: cleaning, matching, quality."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import geometry, text
from tidewatch.functions.mathx import haversine
from tidewatch.operators import clean, match, quality
from tidewatch.registry import query
from tidewatch.sources.tables import READINGS, REPORTS, readings, reports, table

R6 = lambda c: F.round(F.col(c), 6).alias(c)


@query("station_hourly", f"""WITH {READINGS} SELECT station, ts, COUNT(*) AS n, COUNT(value) AS n_values, round(AVG(value), 6) AS mean_value, round(MAX(value), 6) AS max_value,
 CAST(COUNT(*) FILTER (WHERE value < 0) AS BIGINT) AS n_negative FROM readings GROUP BY 1, 2""")  # fmt: skip
def station_hourly(spark, sf_dir):
    return readings(spark, sf_dir).groupBy("station", "ts").agg(F.count("*").alias("n"), F.count("value").alias("n_values"), F.round(F.avg("value"), 6).alias("mean_value"), F.round(F.max("value"), 6).alias("max_value"), F.count_if(F.col("value") < 0).alias("n_negative"))


@query("qc_flags", f"""WITH {READINGS}, f AS (SELECT *, LAST_VALUE(value IGNORE NULLS) OVER (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW) AS fv FROM readings),
 g AS (SELECT *, COUNT(fv) OVER w5 AS n5, MAX(fv) OVER w5 AS hi, MIN(fv) OVER w5 AS lo, COUNT(*) OVER (PARTITION BY station, ts) AS same FROM f WINDOW w5 AS (PARTITION BY station ORDER BY ts, event_id ROWS BETWEEN 4 PRECEDING AND CURRENT ROW))
 SELECT event_id, CASE WHEN value > 200 THEN 'extreme_value' WHEN value < 0 THEN 'negative_value' WHEN n5 = 5 AND hi = lo THEN 'constant_sequence' WHEN same > 1 THEN 'duplicate_timestamp' WHEN value IS NULL THEN 'missing_value' ELSE 'ok' END AS qc_flag,
 value IS NULL AS missing_flag, CASE WHEN value >= 0 AND value <= 200 THEN 0.2::DOUBLE END AS uncertainty FROM g""")  # fmt: skip
def qc_flags(spark, sf_dir):
    return clean.qc_flags(readings(spark, sf_dir)).select("event_id", "qc_flag", "missing_flag", "uncertainty")


@query("qc_split", f"""WITH {READINGS} SELECT CASE WHEN value < 0 THEN 'negative' WHEN value > 200 THEN 'extreme' ELSE 'clean' END AS qc, COUNT(*) AS n, round(SUM(value), 4) AS total FROM readings GROUP BY 1""")
def qc_split(spark, sf_dir):
    return clean.basic_qc(readings(spark, sf_dir), "value").groupBy("qc").agg(F.count("*").alias("n"), F.round(F.sum("value"), 4).alias("total"))


@query("qc_summary", f"""WITH {READINGS} SELECT value IS NULL AS missing_flag, COUNT(*) AS n FROM readings GROUP BY 1""")
def qc_summary(spark, sf_dir):
    return quality.flag_summary(readings(spark, sf_dir).withColumn("missing_flag", F.col("value").isNull()), "missing_flag")


@query("value_stats", f"""WITH {READINGS} SELECT station, round(MIN(value), 6) AS v_min, round(MAX(value), 6) AS v_max, round(AVG(value), 6) AS v_mean, round(MEDIAN(value), 6) AS v_median, round(STDDEV_SAMP(value), 6) AS v_std,
 round(AVG(CASE WHEN value = 0 THEN 1.0::DOUBLE WHEN value IS NOT NULL THEN 0.0::DOUBLE END), 6) AS zero_share, COUNT(*) FILTER (WHERE value <> 0) AS n_nonzero, COUNT(*) FILTER (WHERE value IS NULL) AS n_missing FROM readings GROUP BY station""")  # fmt: skip
def value_stats(spark, sf_dir):
    out = quality.value_stats(readings(spark, sf_dir), "value", ["station"])
    return out.select("station", *[R6(c) for c in ("v_min", "v_max", "v_mean", "v_median", "v_std", "zero_share")], "n_nonzero", "n_missing")


@query("temporal_resolution_mode", f"""WITH {READINGS}, s AS (SELECT station, epoch(ts) - epoch(LAG(ts) OVER (PARTITION BY station ORDER BY ts, event_id)) AS g FROM readings), c AS (SELECT station, CAST(round(g) AS BIGINT) AS step_s, COUNT(*) AS n FROM s WHERE g IS NOT NULL GROUP BY 1, 2)
 SELECT station, step_s, n FROM c QUALIFY ROW_NUMBER() OVER (PARTITION BY station ORDER BY n DESC, step_s) = 1""")  # fmt: skip
def temporal_resolution_mode(spark, sf_dir):
    return quality.temporal_resolution(readings(spark, sf_dir), ["station"], "ts", "event_id")


@query("temporal_gaps", """WITH s AS (SELECT user_id, (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS g FROM events)
 SELECT user_id, COUNT(*) FILTER (WHERE g > 21600) AS n_gaps, round(MAX(g), 3) AS max_gap_s, round(AVG(CASE WHEN g > 21600 THEN 1.0::DOUBLE WHEN g IS NOT NULL THEN 0.0::DOUBLE END), 6) AS gap_share FROM s GROUP BY 1""")  # fmt: skip
def temporal_gaps(spark, sf_dir):
    out = quality.temporal_gaps(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id", 6)
    return out.select("user_id", "n_gaps", F.round("max_gap_s", 3).alias("max_gap_s"), R6("gap_share"))


@query("time_gap_flags", """WITH s AS (SELECT event_id, user_id, (epoch_us(ts) - epoch_us(LAG(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id))) / 1e6::DOUBLE AS g FROM events), m AS (SELECT user_id, MEDIAN(g) AS m FROM s GROUP BY 1)
 SELECT event_id, COALESCE(g > 1.5::DOUBLE * m, FALSE) AS gap_flag FROM s JOIN m USING (user_id)""")  # fmt: skip
def time_gap_flags(spark, sf_dir):
    return quality.time_gap_flags(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id").select("event_id", "gap_flag")


@query("stuck_runs", """WITH b AS (SELECT event_id, user_id, floor(value / 100) AS v FROM events), s AS (SELECT *, ROW_NUMBER() OVER (PARTITION BY user_id ORDER BY event_id) - ROW_NUMBER() OVER (PARTITION BY user_id, v ORDER BY event_id) AS island FROM b)
 SELECT user_id, CAST(v AS BIGINT) AS run_value, COUNT(*) AS run_length, MIN(event_id) AS run_event_id FROM s GROUP BY user_id, v, island HAVING COUNT(*) >= 3""")  # fmt: skip
def stuck_runs(spark, sf_dir):
    e = table(spark, sf_dir, "events").select("event_id", "user_id", F.floor(F.col("value") / 100).alias("v"))
    return quality.stuck_runs(e, ["user_id"], "v", ["event_id"], 3)


@query("station_coverage", """WITH h AS (SELECT (MAX(epoch_us(ts)) - MIN(epoch_us(ts))) / 3.6e9::DOUBLE AS hours FROM events) SELECT user_id, COUNT(*) AS n, round(LEAST(1.0::DOUBLE, COUNT(*) / GREATEST(MAX(hours), 1.0::DOUBLE)), 6) AS coverage,
 LEAST(1.0::DOUBLE, COUNT(*) / GREATEST(MAX(hours), 1.0::DOUBLE)) < 0.5 AS sparse FROM events, h GROUP BY 1""")  # fmt: skip
def station_coverage(spark, sf_dir):
    return quality.station_coverage(table(spark, sf_dir, "events"), "user_id", "ts").select("user_id", "n", R6("coverage"), "sparse")


@query("spatial_coverage", f"""WITH {REPORTS} SELECT COUNT(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL) AS n_valid, COUNT(*) FILTER (WHERE lat IS NULL OR lon IS NULL) AS n_missing, COUNT(*) FILTER (WHERE abs(lat) < 1 OR abs(lon) < 1) AS n_suspicious,
 COUNT(*) FILTER (WHERE lat IS NOT NULL AND lon IS NOT NULL AND NOT (lon BETWEEN -122.42 AND -122.3 AND lat BETWEEN 47.5 AND 47.6)) AS n_outside, round(MIN(lat), 6) AS lat_min, round(MAX(lat), 6) AS lat_max, round(MIN(lon), 6) AS lon_min, round(MAX(lon), 6) AS lon_max, COUNT(DISTINCT ward) AS n_wards FROM reports""")  # fmt: skip
def spatial_coverage(spark, sf_dir):
    out = quality.spatial_coverage(reports(spark, sf_dir), "lat", "lon", (-122.42, 47.5, -122.3, 47.6), "ward")
    return out.select("n_valid", "n_missing", "n_suspicious", "n_outside", *[R6(c) for c in ("lat_min", "lat_max", "lon_min", "lon_max")], "n_wards")


@query("report_flags", f"""WITH {REPORTS}, p AS (SELECT *, LAG(ts) OVER w AS pt, LAG(lat) OVER w AS py, LAG(lon) OVER w AS px FROM reports WINDOW w AS (PARTITION BY user_id ORDER BY ts NULLS LAST, event_id)),
 f AS (SELECT *, COALESCE(epoch_us(ts) - epoch_us(pt) <= 86400000000 AND abs(lat - py) * 111000 <= 75 AND abs(lon - px) * 111000 <= 75, FALSE) AS near FROM p)
 SELECT event_id, CASE WHEN near THEN 'near_duplicate' WHEN lat IS NULL OR lon IS NULL THEN 'ambiguous_location' WHEN ts IS NULL THEN 'missing_timestamp' ELSE 'ok' END AS flag,
 round((CASE WHEN ts IS NULL THEN 0.3::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN lat IS NULL OR lon IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN near THEN 0.2::DOUBLE ELSE 1.0::DOUBLE END), 6) AS confidence FROM f""")  # fmt: skip
def report_flags(spark, sf_dir):
    return clean.flag_reports(reports(spark, sf_dir), "event_id", "user_id", minutes=24 * 60).select("event_id", "flag", R6("confidence"))


@query("near_pairs", f"""WITH {REPORTS} SELECT a.event_id AS a, b.event_id AS b, round(abs(epoch_us(a.ts) - epoch_us(b.ts)) / 1e6::DOUBLE, 3) AS seconds,
 round(2 * 6371000.0::DOUBLE * atan2(sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)), sqrt(1 - (power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))), 3) AS metres
 FROM reports a JOIN reports b ON a.event_id < b.event_id AND abs(epoch_us(a.ts) - epoch_us(b.ts)) <= 21600000000 WHERE 2 * 6371000.0::DOUBLE * asin(LEAST(1.0::DOUBLE, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100""")  # fmt: skip
def near_pairs(spark, sf_dir):
    out = match.nearby_pairs(reports(spark, sf_dir), "event_id", "ts", "lat", "lon", 6, 100)
    return out.select("a", "b", F.round("seconds", 3).alias("seconds"), F.round("metres", 3).alias("metres"))


@query("near_groups", f"""WITH RECURSIVE {REPORTS}, v AS (SELECT * FROM reports WHERE ts IS NOT NULL AND lat IS NOT NULL AND lon IS NOT NULL),
 pairs AS (SELECT a.event_id AS a, b.event_id AS b, a.ts AS ta FROM v a JOIN v b ON (a.ts, a.event_id) < (b.ts, b.event_id) AND epoch_us(b.ts) - epoch_us(a.ts) <= 21600000000
  WHERE 2 * 6371000.0::DOUBLE * asin(LEAST(1.0::DOUBLE, sqrt(power(sin(radians(b.lat - a.lat) / 2), 2) + cos(radians(a.lat)) * cos(radians(b.lat)) * power(sin(radians(b.lon - a.lon) / 2), 2)))) <= 100),
 it(n, k, s) AS (SELECT 0, event_id, 'free' FROM v UNION ALL
  SELECT n + 1, k, CASE WHEN s <> 'free' THEN s WHEN bool_or(u = 'anchor') THEN 'taken' WHEN bool_or(u = 'free') THEN 'free' ELSE 'anchor' END
  FROM (SELECT i.n, i.k, i.s, e.s AS u FROM it i LEFT JOIN pairs p ON p.b = i.k LEFT JOIN it e ON e.k = p.a) WHERE n < 80 GROUP BY n, k, s),
 done AS (SELECT k, s FROM it WHERE n = 80),
 members AS (SELECT b AS k, arg_min(a, (ta, a)) AS anchor FROM pairs JOIN done x ON x.k = a AND x.s = 'anchor' JOIN done y ON y.k = b AND y.s = 'taken' GROUP BY b)
 SELECT k, anchor FROM members UNION SELECT anchor, anchor FROM members""")  # fmt: skip
def near_groups(spark, sf_dir):
    return match.first_come_groups(reports(spark, sf_dir), "event_id", "ts", "lat", "lon", 6, 100)


@query("text_digest_groups", r"""WITH t AS (SELECT doc_id, array_to_string(list_sort(list_filter(string_split(regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '[!?]{2,}', '!', 'g'), '\.{2,}', '.', 'g'), '\s+', ' ', 'g'), ' '), lambda x: length(x) > 3)), ' ') AS s FROM documents),
 h AS (SELECT doc_id, CASE WHEN s = '' THEN '' ELSE substr(md5(s), 1, 12) END AS digest FROM t), g AS (SELECT digest, COUNT(*) AS n, MIN(doc_id) AS anchor FROM h WHERE digest <> '' GROUP BY 1 HAVING COUNT(*) > 1)
 SELECT doc_id, digest, n, anchor, doc_id = anchor AS is_representative FROM h JOIN g USING (digest)""")  # fmt: skip
def text_digest_groups(spark, sf_dir):
    return match.digest_groups(table(spark, sf_dir, "documents").select("doc_id", "text"), text.text_digest(F.col("text")), "doc_id")


@query("normalize_description", r"""SELECT conv_id, turn, md5(regexp_replace(regexp_replace(regexp_replace(trim(lower(text)), '[!?]{2,}', '!', 'g'), '\.{2,}', '.', 'g'), '\s+', ' ', 'g')) AS digest FROM conversations""")
def normalize_description(spark, sf_dir):
    return table(spark, sf_dir, "conversations").select("conv_id", "turn", F.md5(text.normalize_description(F.col("text")).cast("binary")).alias("digest"))


ADDRESSES = "concat(s_name, ' N. Main ST Apt ', cast(s_suppkey as string), '  @ 5th AVE. Hwy 7 fl Flr. Ne ne.')"


@query("normalize_address", """SELECT s_suppkey, lower(replace(s_name, '#', '')) || ' north main street apartment ' || s_suppkey || '  5th avenue hwy 7 fl floor northeast ne.' AS address FROM supplier""")
def normalize_address(spark, sf_dir):
    return table(spark, sf_dir, "supplier").select("s_suppkey", text.normalize_address(F.expr(ADDRESSES)).alias("address"))


CALLS = "concat('FLOODED ', if(n_regionkey % 2 = 0, 'basement after the storm, water damage', 'street, drain backed up'), if(n_nationkey % 3 = 0, ', standing water', ', ponding'), ' in ', n_name)"


@query("flood_keywords", """SELECT n_nationkey, CASE WHEN n_regionkey % 2 = 1 THEN 'backed up,drain,' ELSE '' END || 'flood,flooded' || CASE WHEN n_nationkey % 3 = 0 THEN ',standing water' ELSE ',ponding' END || CASE WHEN n_regionkey % 2 = 0 THEN ',water damage' ELSE '' END AS keywords FROM nation""")
def flood_keywords(spark, sf_dir):
    return table(spark, sf_dir, "nation").select("n_nationkey", F.array_join(text.flood_keywords(F.expr(CALLS)), ",").alias("keywords"))


@query("plain_text", """SELECT doc_id, md5(strip_accents(text)) AS digest FROM documents""")
def plain_text(spark, sf_dir):
    return table(spark, sf_dir, "documents").select("doc_id", F.md5(text.without_accents(F.col("text")).cast("binary")).alias("digest"))


@query("temporal_features", f"""WITH {REPORTS} SELECT event_id, CAST(hour(ts) AS INT) AS hour, CAST(isodow(ts) - 1 AS INT) AS day_of_week, CAST(month(ts) AS INT) AS month, CAST(year(ts) AS INT) AS year, ts IS NULL AS missing_time FROM reports""")
def temporal_features(spark, sf_dir):
    return clean.temporal_features(reports(spark, sf_dir)).select("event_id", "hour", "day_of_week", "month", "year", "missing_time")


@query("coordinate_validity", f"""WITH {REPORTS} SELECT event_id, COALESCE(abs(lat) > 0.1 AND abs(lat) <= 90 AND abs(lon) > 0.1 AND abs(lon) <= 180, FALSE) AS coord_valid, lat IS NOT NULL AND lon IS NOT NULL AND NOT COALESCE(abs(lat) > 0.1 AND abs(lat) <= 90 AND abs(lon) > 0.1 AND abs(lon) <= 180, FALSE) AS coord_suspicious FROM reports""")
def coordinate_validity(spark, sf_dir):
    return clean.coordinate_validity(reports(spark, sf_dir)).select("event_id", "coord_valid", "coord_suspicious")


@query("roi_filter", f"""WITH {REPORTS} SELECT event_id FROM reports WHERE lon BETWEEN -122.42 AND -122.33 AND lat BETWEEN 47.5 AND 47.62""")
def roi_filter(spark, sf_dir):
    return reports(spark, sf_dir).where(geometry.in_box(F.col("lon"), F.col("lat"), (-122.42, 47.5, -122.33, 47.62))).select("event_id")


@query("roi_leakage", f"""WITH {REPORTS} SELECT COUNT(*) AS n_before, COUNT(*) FILTER (WHERE lon BETWEEN -122.42 AND -122.33 AND lat BETWEEN 47.5 AND 47.62) AS n_after, COUNT(*) FILTER (WHERE lat IS NOT NULL AND NOT (lon BETWEEN -122.42 AND -122.33 AND lat BETWEEN 47.5 AND 47.62)) AS n_outside FROM reports""")
def roi_leakage(spark, sf_dir):
    inside = geometry.in_box(F.col("lon"), F.col("lat"), (-122.42, 47.5, -122.33, 47.62))
    return reports(spark, sf_dir).agg(F.count("*").alias("n_before"), F.count_if(inside).alias("n_after"), F.count_if(F.col("lat").isNotNull() & ~inside).alias("n_outside"))


@query("delay_windows", f"""WITH {REPORTS}, p AS (SELECT ln(4.0::DOUBLE / sqrt(2.25::DOUBLE + 4.0::DOUBLE)) AS mu, sqrt(ln(1 + 2.25::DOUBLE / 4.0::DOUBLE)) AS s)
 SELECT event_id, epoch_us(ts) - CAST(round(LEAST(exp(mu + 1.645::DOUBLE * s), 48.0::DOUBLE) * 3600000000.0::DOUBLE) AS BIGINT) AS start_us, epoch_us(ts) - CAST(round(exp(mu - 1.645::DOUBLE * s) * 3600000000.0::DOUBLE) AS BIGINT) AS end_us FROM reports, p""")  # fmt: skip
def delay_windows(spark, sf_dir):
    return clean.delay_windows(reports(spark, sf_dir)).select("event_id", F.unix_micros("window_start").alias("start_us"), F.unix_micros("window_end").alias("end_us"))


@query("delay_estimated", f"""WITH {REPORTS}, d AS (SELECT event_id, ts, ts - to_microseconds(CAST((event_id % 400) * 540000000 AS BIGINT)) AS happened FROM reports), g AS (SELECT (epoch_us(ts) - epoch_us(happened)) / 3600000000.0::DOUBLE AS h FROM d), s AS (SELECT AVG(h) AS m, ln(VAR_SAMP(h) / power(AVG(h), 2) + 1) AS v FROM g WHERE h > 0 AND h <= 48),
 p AS (SELECT ln(m) - v / 2 AS mu, sqrt(v) AS s FROM s)
 SELECT event_id, CASE WHEN ts IS NOT NULL THEN round(LEAST(exp(mu + 1.645::DOUBLE * s), 48.0::DOUBLE), 5) END AS delay_p95, CASE WHEN ts IS NOT NULL THEN round(exp(mu), 5) END AS delay_p50, CASE WHEN ts IS NOT NULL THEN round(exp(mu - 1.645::DOUBLE * s), 5) END AS delay_p05, round(epoch_us(ts) / 3600000000.0::DOUBLE - LEAST(exp(mu + 1.645::DOUBLE * s), 48.0::DOUBLE), 3) AS start_h FROM d, p""")  # fmt: skip
def delay_estimated(spark, sf_dir):
    """Windows of when reported events happened, from the delays of those whose time is known."""
    r = reports(spark, sf_dir)
    known = r.withColumn("happened", F.timestamp_micros(F.unix_micros("ts") - F.col("event_id") % 400 * 540_000_000))
    out = clean.delay_windows(known, "happened")
    return out.select("event_id", *[F.round(F.when(F.col("ts").isNotNull(), F.col(c)), 5).alias(c) for c in ("delay_p95", "delay_p50", "delay_p05")], F.round(F.unix_micros("window_start") / 3.6e9, 3).alias("start_h"))


@query("report_bins", f"""WITH {REPORTS} SELECT ward, CAST(floor(epoch(ts) / 3600) AS BIGINT) * 3600 AS bin_s, COUNT(*) AS n, round(AVG(CASE WHEN lat IS NULL THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END), 6) AS mean_confidence FROM reports GROUP BY 1, 2""")
def report_bins(spark, sf_dir):
    from tidewatch.operators.bins import time_bins

    out = time_bins(reports(spark, sf_dir).withColumn("confidence", F.when(F.col("lat").isNull(), 0.5).otherwise(1.0)), "ward", "ts", "confidence", 60)
    return out.select("ward", F.unix_seconds("bin").alias("bin_s"), "n", R6("mean_confidence"))


@query("station_pivot", """SELECT CAST(ts AS DATE) AS day, round(SUM(value) FILTER (WHERE user_id % 3 = 0), 4) AS rainfall_0, round(SUM(value) FILTER (WHERE user_id % 3 = 1), 4) AS rainfall_1, round(SUM(value) FILTER (WHERE user_id % 3 = 2), 4) AS rainfall_2 FROM events GROUP BY 1""")
def station_pivot(spark, sf_dir):
    """Three groups of gauges side by side."""
    e = table(spark, sf_dir, "events").groupBy(F.to_date("ts").alias("day"), (F.col("user_id") % 3).alias("station")).agg(F.round(F.sum("value"), 4).alias("value"))
    return match.station_table(e, "day", "station", "value", [0, 1, 2])


@query("asof_nearest", """WITH l AS (SELECT event_id, user_id, ts FROM events WHERE event_type = 'error'), r AS (SELECT event_id, user_id, ts, CASE WHEN event_id % 7 = 0 THEN NULL ELSE value END AS value FROM events WHERE event_type = 'view'),
 m AS (SELECT l.event_id, r.value, r.event_id AS o, abs(epoch_us(l.ts) - epoch_us(r.ts)) AS gap FROM l JOIN r ON l.user_id = r.user_id AND abs(epoch_us(l.ts) - epoch_us(r.ts)) <= 7200000000 QUALIFY ROW_NUMBER() OVER (PARTITION BY l.event_id ORDER BY abs(epoch_us(l.ts) - epoch_us(r.ts)), r.event_id) = 1)
 SELECT l.event_id, round(m.value, 6) AS matched_value, round(m.gap / 1e6::DOUBLE, 3) AS gap_s, m.o AS matched_row, CASE WHEN m.o IS NULL THEN 'no_match' WHEN m.value IS NULL THEN 'missing' ELSE 'aligned' END AS status FROM l LEFT JOIN m USING (event_id)""")  # fmt: skip
def asof_nearest(spark, sf_dir):
    e = table(spark, sf_dir, "events")
    left = e.where("event_type = 'error'").select("event_id", "user_id", "ts")
    right = e.where("event_type = 'view'").select("event_id", "user_id", "ts", F.when(F.col("event_id") % 7 != 0, F.col("value")).alias("value"))
    out = match.asof_nearest(left, right, ["user_id"], "ts", "value", "event_id", 7200)
    return out.select("event_id", R6("matched_value"), F.round("gap_s", 3).alias("gap_s"), "matched_row", "status")


@query("ward_centroid_lookup", f"""WITH {REPORTS}, w AS (SELECT n_nationkey * 2 AS ward, 47.5::DOUBLE + n_nationkey / 100.0::DOUBLE AS y, -122.4::DOUBLE + n_regionkey / 100.0::DOUBLE AS x FROM nation)
 SELECT event_id, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 'point' WHEN y IS NOT NULL THEN 'ward_centroid' ELSE 'unknown' END AS precision, CASE WHEN lat IS NOT NULL AND lon IS NOT NULL THEN 75.0::DOUBLE WHEN y IS NOT NULL THEN 300.0::DOUBLE END AS radius_m, round(COALESCE(lat, y), 6) AS geo_lat FROM reports LEFT JOIN w USING (ward)""")  # fmt: skip
def ward_centroid_lookup(spark, sf_dir):
    wards = table(spark, sf_dir, "nation").select((F.col("n_nationkey") * 2).alias("ward"), (F.lit(47.5) + F.col("n_nationkey") / 100).alias("centroid_lat"), (F.lit(-122.4) + F.col("n_regionkey") / 100).alias("centroid_lon"))
    return match.ward_lookup(reports(spark, sf_dir), wards, "ward", "lat", "lon").select("event_id", "precision", "radius_m", R6("geo_lat"))


@query("geocode_wards", """WITH p AS (SELECT n_name AS name, CASE WHEN n_nationkey = 3 THEN 0.2::DOUBLE ELSE 0.4::DOUBLE END AS c FROM nation), a AS (SELECT s_suppkey, 'Near ' || n_name || ' square' AS address FROM supplier JOIN nation ON s_nationkey = n_nationkey)
 SELECT s_suppkey, (SELECT name FROM p WHERE contains(lower(address), lower(name)) AND c >= 0.3 ORDER BY c DESC, length(name), name DESC LIMIT 1) AS place FROM a""")  # fmt: skip
def geocode_wards(spark, sf_dir):
    nation = table(spark, sf_dir, "nation")
    places = nation.select(F.col("n_name").alias("name"), F.col("n_nationkey").cast("double").alias("place_lat"), F.col("n_regionkey").cast("double").alias("place_lon"), F.when(F.col("n_nationkey") == 3, 0.2).otherwise(0.4).alias("place_confidence"))
    rows = table(spark, sf_dir, "supplier").join(F.broadcast(nation.select("n_nationkey", "n_name")), F.col("s_nationkey") == F.col("n_nationkey")).select("s_suppkey", F.concat(F.lit("Near "), "n_name", F.lit(" square")).alias("address"))
    return match.geocode(rows, places, "address").select("s_suppkey", "place")


@query("bias_hours", f"""WITH {REPORTS}, s AS (SELECT UNNEST(range(0, 24)) AS h), c AS (SELECT hour(ts) AS h, COUNT(*) AS n FROM reports WHERE ts IS NOT NULL GROUP BY 1), f AS (SELECT CAST(s.h AS INT) AS bucket, COALESCE(n, 0) AS n FROM s LEFT JOIN c USING (h))
 SELECT bucket, n, round(power(n - (SELECT SUM(n) FROM f) / 24.0::DOUBLE, 2) / ((SELECT SUM(n) FROM f) / 24.0::DOUBLE), 6) AS chi2_part FROM f""")  # fmt: skip
def bias_hours(spark, sf_dir):
    return quality.histogram_bias(reports(spark, sf_dir), F.hour("ts"), 24).select("bucket", "n", R6("chi2_part"))


@query("bias_temporal", f"""WITH {REPORTS} SELECT round(AVG(CASE WHEN hour(ts) BETWEEN 9 AND 17 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS office_share, round(AVG(CASE WHEN isodow(ts) <= 5 THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END), 6) AS weekday_share FROM reports WHERE ts IS NOT NULL""")
def bias_temporal(spark, sf_dir):
    return quality.temporal_bias(reports(spark, sf_dir), "ts").select(R6("office_share"), R6("weekday_share"))


@query("bias_volume", f"""WITH {REPORTS}, d AS (SELECT CAST(ts AS DATE) AS day, COUNT(*) AS n FROM reports WHERE ts IS NOT NULL GROUP BY 1), m AS (SELECT AVG(n) AS m, STDDEV_SAMP(n) AS s FROM d)
 SELECT round(MAX(m), 6) AS day_mean, round(MAX(s), 6) AS day_std, MAX(n) AS day_max, MIN(n) AS day_min, round(MAX(s) / MAX(m), 6) AS day_cv, COUNT(*) FILTER (WHERE abs(n - m) > 3 * s) AS n_unusual FROM d, m""")  # fmt: skip
def bias_volume(spark, sf_dir):
    out = quality.volume_patterns(reports(spark, sf_dir).where("ts is not null"), "ts")
    return out.select(R6("day_mean"), R6("day_std"), "day_max", "day_min", R6("day_cv"), "n_unusual")


@query("bias_top_share", f"""WITH {REPORTS}, c AS (SELECT ward, COUNT(*) AS n FROM reports GROUP BY 1), t AS (SELECT n FROM c ORDER BY n DESC, ward LIMIT 3) SELECT round(MAX(n) / (SELECT SUM(n)::DOUBLE FROM c), 6) AS top1_share, round(SUM(n) / (SELECT SUM(n)::DOUBLE FROM c), 6) AS top_share FROM t""")
def bias_top_share(spark, sf_dir):
    return quality.top_shares(reports(spark, sf_dir), "ward").select(R6("top1_share"), R6("top_share"))


@query("quality_completeness", f"""WITH {REPORTS}, s AS (SELECT 100 * AVG((ts IS NULL)::INT) AS a, 100 * AVG((lat IS NULL)::INT) AS b, 100 * AVG((lon IS NULL)::INT) AS c FROM reports)
 SELECT GREATEST(100.0::DOUBLE - (SELECT SUM(CASE WHEN x > 30 THEN 30.0::DOUBLE WHEN x > 10 THEN 15.0::DOUBLE WHEN x > 5 THEN 5.0::DOUBLE ELSE 0.0::DOUBLE END) FROM (SELECT UNNEST([a, b, c]) AS x)), 0.0::DOUBLE) AS completeness FROM s""")  # fmt: skip
def quality_completeness(spark, sf_dir):
    return quality.completeness(reports(spark, sf_dir), ["ts", "lat", "lon"])


@query("quality_uniqueness", f"""WITH {REPORTS} SELECT CAST(COUNT(*) AS BIGINT) AS n_rows, COUNT(*) - COUNT(DISTINCT (ward, CAST(ts AS DATE))) AS n_repeats, round((COUNT(*) - COUNT(DISTINCT (ward, CAST(ts AS DATE)))) / COUNT(*)::DOUBLE, 6) AS repeat_share FROM reports WHERE ts IS NOT NULL""")
def quality_uniqueness(spark, sf_dir):
    rows = reports(spark, sf_dir).where("ts is not null").select("ward", F.to_date("ts").alias("day"))
    return quality.uniqueness(rows, ["ward", "day"]).select("n_rows", "n_repeats", R6("repeat_share"))


@query("quality_score", """SELECT n_nationkey, round((2.0::DOUBLE * (100 - n_nationkey) + 2.0::DOUBLE * (100 - 2 * n_regionkey) + 1.5::DOUBLE * 90 + 80 + 1.0::DOUBLE * (100 - n_nationkey * 2) + 1.5::DOUBLE * 70) / 9.0::DOUBLE, 6) AS quality,
 CASE WHEN (2.0::DOUBLE * (100 - n_nationkey) + 2.0::DOUBLE * (100 - 2 * n_regionkey) + 1.5::DOUBLE * 90 + 80 + 1.0::DOUBLE * (100 - n_nationkey * 2) + 1.5::DOUBLE * 70) / 9.0::DOUBLE >= 90 THEN 'A' WHEN (2.0::DOUBLE * (100 - n_nationkey) + 2.0::DOUBLE * (100 - 2 * n_regionkey) + 1.5::DOUBLE * 90 + 80 + 1.0::DOUBLE * (100 - n_nationkey * 2) + 1.5::DOUBLE * 70) / 9.0::DOUBLE >= 80 THEN 'B' ELSE 'C' END AS grade FROM nation""")  # fmt: skip
def quality_score(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (100.0 - F.col("n_nationkey")).alias("completeness"), (100.0 - 2 * F.col("n_regionkey")).alias("accuracy"), F.lit(90.0).alias("consistency"), F.lit(80.0).alias("timeliness"), (100.0 - 2 * F.col("n_nationkey")).alias("uniqueness"), F.lit(70.0).alias("validity"))
    return quality.quality_score(n).select("n_nationkey", R6("quality"), "grade")


@query("outliers", """WITH q AS (SELECT quantile_cont(o_totalprice, 0.25) AS q1, quantile_cont(o_totalprice, 0.75) AS q3, AVG(o_totalprice) AS m, STDDEV_POP(o_totalprice) AS s FROM orders), f AS (SELECT o_orderkey, o_totalprice < q1 - 0.3::DOUBLE * (q3 - q1) OR o_totalprice > q3 + 0.3::DOUBLE * (q3 - q1) AS i, abs(o_totalprice - m) / s > 1.6 AS z FROM orders, q)
 SELECT o_orderkey, i AS outlier_iqr, z AS outlier_z, round(i::INT * 0.33::DOUBLE + z::INT * 0.33::DOUBLE, 6) AS outlier_score, i AND z AS outlier_both FROM f WHERE i OR z""")  # fmt: skip
def outliers(spark, sf_dir):
    out = quality.outliers(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", 0.3, 1.6)
    return out.where("outlier_iqr or outlier_z").select("o_orderkey", "outlier_iqr", "outlier_z", R6("outlier_score"), "outlier_both")


@query("monotonic_times", """WITH s AS (SELECT user_id, ts, LAG(ts) OVER (PARTITION BY user_id ORDER BY event_id) AS p FROM events) SELECT user_id, COALESCE(BOOL_AND(ts >= p), TRUE) AS monotonic FROM s GROUP BY 1""")
def monotonic_times(spark, sf_dir):
    return clean.is_monotonic(table(spark, sf_dir, "events"), ["user_id"], "ts", "event_id")


@query("haversine_stations", f"""WITH {REPORTS}, p AS (SELECT event_id, lat, lon FROM reports WHERE lat IS NOT NULL) SELECT event_id, round(2 * 6371000.0::DOUBLE * asin(sqrt(power(sin(radians(lat - 47.6::DOUBLE) / 2), 2) + cos(radians(47.6::DOUBLE)) * cos(radians(lat)) * power(sin(radians(lon - -122.33::DOUBLE) / 2), 2))), 3) AS metres FROM p""")
def haversine_stations(spark, sf_dir):
    return reports(spark, sf_dir).where("lat is not null").select("event_id", F.round(haversine(F.lit(47.6), F.lit(-122.33), F.col("lat"), F.col("lon")), 3).alias("metres"))


