"""Cleaning and flagging of sensor readings and citizen reports."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d, lognormal_params

#: Accepted column names, in order.
TIME_NAMES = ("timestamp", "time", "datetime", "obs_time")
VALUE_NAMES = ("rainfall", "rainfall_mm", "rain", "precip", "precip_mm")
EXTREME_MM = 200.0


def find_column(df: DataFrame, names: tuple[str, ...]) -> str | None:
    """The first of ``names`` that the table has, whatever its case."""
    have = {c.lower(): c for c in df.columns}
    return next((have[n] for n in names if n in have), None)


def find_time_column(df: DataFrame) -> str:
    """A column of an accepted name, else the one whose values parse most often; one pass over all columns."""
    named = find_column(df, TIME_NAMES)
    if named:
        return named
    bad = df.agg(*[F.count_if(F.try_to_timestamp(F.col(f"`{c}`").cast("string")).isNull()).alias(c) for c in df.columns]).first()
    return min(df.columns, key=lambda c: (bad[c], df.columns.index(c)))


def find_value_column(df: DataFrame) -> str:
    named = find_column(df, VALUE_NAMES)
    if named:
        return named
    numeric = [c for c, t in df.dtypes if t.startswith(("int", "bigint", "double", "float", "decimal", "smallint", "tinyint"))]
    if len(numeric) != 1:
        raise ValueError("no column of a known value name, and not exactly one numeric column")
    return numeric[0]


def normalized_units(value: Column, unit: str | None = None) -> Column:
    """Numbers in millimetres; what is no number becomes null."""
    number = value.try_cast("double")
    return number * 10 if unit == "cm" else number


def qc_flags(df: DataFrame, time: str = "ts", value: str = "value", station: str = "station", row: str = "event_id") -> DataFrame:
    """``df`` with ``qc_flag``, ``missing_flag`` and ``uncertainty``.

    Priority: extreme, negative, constant sequence, duplicate time, missing value, missing time, ok. Sequences and
    duplicates are those of a station, so no window spans the table.
    """
    w = Window.partitionBy(station).orderBy(F.col(time).asc_nulls_last(), row)
    ready = df.withColumn("_v", F.last(value, ignorenulls=True).over(w.rowsBetween(Window.unboundedPreceding, 0)))
    five = w.rowsBetween(-4, 0)
    constant = (F.count("_v").over(five) == 5) & (F.max("_v").over(five) == F.min("_v").over(five))
    twice = F.col(time).isNotNull() & (F.count("*").over(Window.partitionBy(station, time)) > 1)
    v, t = F.col(value), F.col(time)
    flag = (
        F.when(v > EXTREME_MM, "extreme_value").when(v < 0, "negative_value").when(constant, "constant_sequence").when(twice, "duplicate_timestamp")
        .when(v.isNull(), "missing_value").when(t.isNull(), "missing_timestamp").otherwise("ok")
    )
    bad = v.isNull() | (v < 0) | (v > EXTREME_MM)
    return ready.withColumn("qc_flag", flag).withColumn("missing_flag", t.isNull() | v.isNull()).withColumn("uncertainty", F.when(~bad, d(0.2))).drop("_v")


def basic_qc(df: DataFrame, value: str) -> DataFrame:
    """``df`` with ``qc`` = negative, extreme or clean; split it with a filter each, which reaches the scan."""
    return df.withColumn("qc", F.when(F.col(value) < 0, "negative").when(F.col(value) > EXTREME_MM, "extreme").otherwise("clean"))


def flag_reports(df: DataFrame, key: str, city: str, time: str = "ts", lat: str = "lat", lon: str = "lon", minutes: int = 60, metres: float = 75.0) -> DataFrame:
    """Reports with ``flag`` and ``confidence``: near-duplicates of the city's previous report in time and place,
    ambiguous locations and missing times, multiplied into the confidence."""
    w = Window.partitionBy(city).orderBy(F.col(time).asc_nulls_last(), key)
    near = (
        (F.col(time).cast("double") - F.lag(time).over(w).cast("double") <= minutes * 60)
        & (F.abs(F.col(lat) - F.lag(lat).over(w)) * 111_000 <= metres)
        & (F.abs(F.col(lon) - F.lag(lon).over(w)) * 111_000 <= metres)
    )
    near, lost, late = F.coalesce(near, F.lit(False)), F.col(lat).isNull() | F.col(lon).isNull(), F.col(time).isNull()
    part = lambda c, x: F.when(c, d(x)).otherwise(d(1))
    flagged = df.withColumn("_near", near)
    return (
        flagged.withColumn("flag", F.when(F.col("_near"), "near_duplicate").when(lost, "ambiguous_location").when(late, "missing_timestamp").otherwise("ok"))
        .withColumn("confidence", part(late, 0.3) * part(lost, 0.5) * part(F.col("_near"), 0.2))
        .drop("_near")
    )


def standard_columns(df: DataFrame, aliases: dict[str, str]) -> DataFrame:
    """Adds each standard column from the first alias that exists where the standard one is absent; originals stay."""
    new: dict[str, Column] = {}
    for alias, name in aliases.items():
        if name not in df.columns and name not in new and alias in df.columns:
            new[name] = F.col(alias)
    return df.withColumns(new)


def temporal_features(df: DataFrame, time: str = "ts") -> DataFrame:
    """Hour, day of week (Monday 0), month, year and whether the time is missing."""
    t = F.col(time)
    return df.withColumns({"hour": F.hour(t), "day_of_week": F.weekday(t), "month": F.month(t), "year": F.year(t), "missing_time": t.isNull()})


def coordinate_validity(df: DataFrame, lat: str = "lat", lon: str = "lon") -> DataFrame:
    """``coord_valid``, ``coord_suspicious`` (present but not valid) and ``coord_uncertainty_m``."""
    size_ok = (F.abs(lat) > 0.1) & (F.abs(lat) <= 90) & (F.abs(lon) > 0.1) & (F.abs(lon) <= 180)
    there = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    ok = F.coalesce(there & size_ok, F.lit(False))
    return df.withColumns({"coord_valid": ok, "coord_suspicious": there & ~ok, "coord_uncertainty_m": F.when(ok, d(10)).otherwise(d(float("inf")))})


def delay_windows(df: DataFrame, event: str | None = None, reported: str = "ts", mean_hours: float = 2.0, sd_hours: float = 1.5, cap_hours: float = 48.0) -> DataFrame:
    """``window_start`` and ``window_end`` of when a reported event happened, from a log-normal reporting delay.

    With an event time and at least ten delays in (0, cap] hours the delay is estimated, else the prior is used.
    """
    mu, sigma = lognormal_params(mean_hours, sd_hours)
    if event is None:
        moments = df.sparkSession.range(1).select(d(mu).alias("mu"), d(sigma).alias("sigma"))
    else:
        delay = (F.col(reported).cast("double") - F.col(event).cast("double")) / 3600
        good = df.select(delay.alias("h")).where((F.col("h") > 0) & (F.col("h") <= cap_hours))
        m = good.agg(F.count("*").alias("n"), F.avg("h").alias("m"), F.var_samp("h").alias("v"))
        spread = F.log(F.col("v") / (F.col("m") * F.col("m")) + 1)
        enough = F.col("n") >= 10
        moments = m.select(F.when(enough, F.log("m") - spread / 2).otherwise(d(mu)).alias("mu"), F.when(enough, F.sqrt(spread)).otherwise(d(sigma)).alias("sigma"))
    level = lambda z: F.exp(F.col("mu") + d(z) * F.col("sigma"))
    hours = moments.select(level(-1.645).alias("delay_p05"), level(0.0).alias("delay_p50"), F.least(level(1.645), d(cap_hours)).alias("delay_p95"))
    out = df.crossJoin(F.broadcast(hours))
    back = lambda c: F.timestamp_micros(F.unix_micros(reported) - F.round(F.col(c) * 3_600_000_000).cast("long"))
    return out.withColumn("window_start", back("delay_p95")).withColumn("window_end", back("delay_p05"))


def where_all(df: DataFrame, **equal) -> DataFrame:
    """Conjunction of the equality filters that are not None."""
    tests = [F.col(c) == v for c, v in equal.items() if v is not None]
    return df.where(reduce(lambda a, b: a & b, tests)) if tests else df


def require_columns(df: DataFrame, columns: list[str]) -> DataFrame:
    missing = [c for c in columns if c not in df.columns]
    if missing:
        raise ValueError(f"missing columns: {', '.join(missing)}")
    return df


def require_rows(df: DataFrame) -> DataFrame:
    if df.isEmpty():
        raise ValueError("the table is empty")
    return df


def is_monotonic(df: DataFrame, by: list[str], time: str, row: str) -> DataFrame:
    """For each group whether its times never fall in row order."""
    w = Window.partitionBy(*by).orderBy(row)
    return df.withColumn("_step", F.col(time).cast("double") - F.lag(time).over(w).cast("double")).groupBy(*by).agg((F.coalesce(F.min("_step"), d(0)) >= 0).alias("monotonic"))
