"""Data quality: coverage, gaps, stuck gauges, bias, scores, outliers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d
from tidewatch.operators.scalars import with_quantiles, with_scalars


def value_stats(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    v = F.col(value)
    return df.groupBy(*by).agg(
        F.min(v).alias("v_min"), F.max(v).alias("v_max"), F.avg(v).alias("v_mean"), F.median(v).alias("v_median"), F.stddev_samp(v).alias("v_std"),
        F.avg((v == 0).cast("double")).alias("zero_share"), F.count_if(v != 0).alias("n_nonzero"), F.count_if(v.isNull()).alias("n_missing"),
    )


def steps(df: DataFrame, by: list[str], time: str, row: str) -> DataFrame:
    """``df`` with ``gap_s``: seconds since the group's previous time."""
    w = Window.partitionBy(*by).orderBy(time, row)
    return df.withColumn("gap_s", (F.unix_micros(time) - F.unix_micros(F.lag(time).over(w))) / 1e6)


def temporal_resolution(df: DataFrame, by: list[str], time: str, row: str) -> DataFrame:
    """The most frequent step of each group, the least of equals; by counts, so that a group's steps are combined early."""
    counted = steps(df, by, time, row).where("gap_s is not null").groupBy(*by, F.round("gap_s").cast("long").alias("step_s")).agg(F.count("*").alias("n"))
    return counted.groupBy(*by).agg(F.max(F.struct("n", (-F.col("step_s")).alias("m"))).alias("b")).select(*by, (-F.col("b.m")).alias("step_s"), F.col("b.n").alias("n"))


def temporal_gaps(df: DataFrame, by: list[str], time: str, row: str, hours: float) -> DataFrame:
    late = F.col("gap_s") > hours * 3600
    return steps(df, by, time, row).groupBy(*by).agg(F.count_if(late).alias("n_gaps"), F.max("gap_s").alias("max_gap_s"), F.avg(F.when(F.col("gap_s").isNotNull(), late.cast("double"))).alias("gap_share"))


def time_gap_flags(df: DataFrame, by: list[str], time: str, row: str) -> DataFrame:
    """``gap_flag``: steps of more than 1.5 times the group's median step; false for the first row."""
    stepped = steps(df, by, time, row)
    typical = stepped.groupBy(*by).agg(F.median("gap_s").alias("typical_s"))
    return stepped.join(typical, by).withColumn("gap_flag", F.coalesce(F.col("gap_s") > 1.5 * F.col("typical_s"), F.lit(False)))


def stuck_runs(df: DataFrame, by: list[str], value: str, order: list[str], least: int) -> DataFrame:
    """Runs of at least ``least`` equal non-null values in a row: gaps and islands by running sums of changes."""
    w = Window.partitionBy(*by).orderBy(*order)
    changed = df.withColumn("_new", F.coalesce((F.col(value) != F.lag(value).over(w)) | F.lag(value).over(w).isNull() | F.col(value).isNull(), F.lit(True)).cast("int"))
    island = changed.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    runs = island.where(F.col(value).isNotNull()).groupBy(*by, "_island").agg(F.count("*").alias("run_length"), F.first(value).alias("run_value"), F.min(F.struct(*order)).alias("_at"))
    return runs.where(F.col("run_length") >= least).select(*by, "run_value", "run_length", *[F.col(f"_at.{o}").alias(f"run_{o}") for o in order])


def station_coverage(df: DataFrame, station: str, time: str) -> DataFrame:
    """Rows of each station beside the hours of the whole range, at most 1; ``sparse`` below one half."""
    span = df.agg(((F.max(F.unix_micros(time)) - F.min(F.unix_micros(time))) / 3.6e9).alias("hours"))
    share = F.least(d(1), F.col("n") / F.greatest(F.col("hours"), d(1)))
    return df.groupBy(station).agg(F.count("*").alias("n")).crossJoin(F.broadcast(span)).select(station, "n", share.alias("coverage"), (share < 0.5).alias("sparse"))


def spatial_coverage(df: DataFrame, lat: str, lon: str, box: tuple[float, float, float, float], ward: str) -> DataFrame:
    west, south, east, north = box
    there = F.col(lat).isNotNull() & F.col(lon).isNotNull()
    inside = F.col(lon).between(west, east) & F.col(lat).between(south, north)
    return df.agg(
        F.count_if(there).alias("n_valid"), F.count_if(~there).alias("n_missing"), F.count_if((F.abs(lat) < 1) | (F.abs(lon) < 1)).alias("n_suspicious"),
        F.count_if(there & ~inside).alias("n_outside"), F.min(lat).alias("lat_min"), F.max(lat).alias("lat_max"), F.min(lon).alias("lon_min"), F.max(lon).alias("lon_max"), F.countDistinct(ward).alias("n_wards"),
    )


def histogram_bias(df: DataFrame, bucket: Column, buckets: int) -> DataFrame:
    """Counts of each of the buckets 0 .. n - 1, zeros included, with the chi-square part against an even spread."""
    spine = df.sparkSession.range(buckets).select(F.col("id").cast("int").alias("bucket"))
    counts = df.where(bucket.isNotNull()).groupBy(bucket.cast("int").alias("bucket")).agg(F.count("*").alias("n"))
    filled = spine.join(F.broadcast(counts), "bucket", "left").select("bucket", F.coalesce("n", F.lit(0)).alias("n"))
    expected = F.sum("n").over(Window.partitionBy()) / buckets  # a dozen rows
    return filled.withColumn("chi2_part", F.when(expected > 0, F.pow(F.col("n") - expected, 2) / expected).otherwise(d(0)))


def temporal_bias(df: DataFrame, time: str) -> DataFrame:
    """Share of office hours (9 to 17 inclusive) and of Monday to Friday, beside what an even spread would give."""
    t = F.col(time)
    office, week = F.avg(F.hour(t).between(9, 17).cast("double")), F.avg((F.weekday(t) < 5).cast("double"))
    return df.where(t.isNotNull()).agg(office.alias("office_share"), week.alias("weekday_share"), (office - d(8 / 24)).alias("office_excess"), (week - d(5 / 7)).alias("weekday_excess"))


def volume_patterns(df: DataFrame, time: str) -> DataFrame:
    """Daily counts: mean, deviation, extremes, variation, and days beyond three deviations."""
    days = df.groupBy(F.to_date(time).alias("day")).agg(F.count("*").alias("n"))
    daily = with_scalars(days, m=F.avg("n"), s=F.stddev_samp("n"))
    return daily.agg(F.first("m").alias("day_mean"), F.first("s").alias("day_std"), F.max("n").alias("day_max"), F.min("n").alias("day_min"), (F.first("s") / F.first("m")).alias("day_cv"), F.count_if(F.abs(F.col("n") - F.col("m")) > 3 * F.col("s")).alias("n_unusual"))


def top_shares(df: DataFrame, ward: str, k: int = 3) -> DataFrame:
    """Share of the busiest ward and of the ``k`` busiest; only ``k`` rows are sorted out."""
    counts = df.groupBy(ward).agg(F.count("*").alias("n"))
    total = counts.agg(F.sum("n").alias("total"))
    top = counts.orderBy(F.desc("n"), ward).limit(k)
    return top.crossJoin(F.broadcast(total)).agg((F.max("n") / F.first("total")).alias("top1_share"), (F.sum("n") / F.first("total")).alias("top_share"))


def tiers(x: Column, steps_: list[tuple[float, float]]) -> Column:
    """The penalty of the first step that ``x`` exceeds, else 0."""
    out = None
    for limit, penalty in steps_:
        out = F.when(x > limit, d(penalty)) if out is None else out.when(x > limit, d(penalty))
    return out.otherwise(d(0))


def completeness(df: DataFrame, columns: list[str]) -> DataFrame:
    """100 less the penalties of missing shares: over 30 percent 30, over 10 percent 15, over 5 percent 5."""
    shares = df.agg(*[F.avg(F.col(c).isNull().cast("double")).alias(c) for c in columns])
    penalty = sum((tiers(F.col(c) * 100, [(30, 30), (10, 15), (5, 5)]) for c in columns), d(0))
    return shares.select(F.greatest(d(100) - penalty, d(0)).alias("completeness"))


def uniqueness(df: DataFrame, columns: list[str]) -> DataFrame:
    """Share of rows that repeat an earlier one: groups are counted, not listed."""
    groups = df.groupBy(*columns).agg(F.count("*").alias("n"))
    return groups.agg(F.sum("n").alias("n_rows"), F.sum(F.col("n") - 1).alias("n_repeats")).select("n_rows", "n_repeats", (F.col("n_repeats") / F.col("n_rows")).alias("repeat_share"))


#: Weights of the six quality dimensions and the grades' limits.
WEIGHTS = {"completeness": 2.0, "accuracy": 2.0, "consistency": 1.5, "timeliness": 1.0, "uniqueness": 1.0, "validity": 1.5}
GRADES = (("A", 90), ("B", 80), ("C", 70), ("D", 60))


def quality_score(scores: DataFrame) -> DataFrame:
    """Weighted mean of the six dimension columns, with its grade."""
    total = sum((F.col(c) * w for c, w in WEIGHTS.items()), d(0)) / sum(WEIGHTS.values())
    grade = F.when(total >= GRADES[0][1], GRADES[0][0])
    for name, limit in GRADES[1:]:
        grade = grade.when(total >= limit, name)
    return scores.withColumn("quality", total).withColumn("grade", grade.otherwise("F"))


def outliers(df: DataFrame, value: str, iqr: float = 1.5, z: float = 3.0) -> DataFrame:
    """``outlier_iqr``, ``outlier_z``, ``outlier_score`` (0.33 each) and ``outlier_both``; global quartiles and moments."""
    v = F.col(value)
    ready = with_scalars(with_quantiles(df, value, q1=0.25, q3=0.75), m=F.avg(value), s=F.stddev_pop(value))
    spread = F.col("q3") - F.col("q1")
    by_iqr = (v < F.col("q1") - iqr * spread) | (v > F.col("q3") + iqr * spread)
    by_z = F.when(F.col("s") > 0, F.abs(v - F.col("m")) / F.col("s") > z).otherwise(F.lit(False))
    ready = ready.withColumn("outlier_iqr", F.coalesce(by_iqr, F.lit(False))).withColumn("outlier_z", F.coalesce(by_z, F.lit(False))).drop("q1", "q3", "m", "s")
    score = F.col("outlier_iqr").cast("double") * 0.33 + F.col("outlier_z").cast("double") * 0.33
    return ready.withColumn("outlier_score", score).withColumn("outlier_both", F.col("outlier_iqr") & F.col("outlier_z"))


def flag_summary(df: DataFrame, flag: str) -> DataFrame:
    return df.groupBy(flag).agg(F.count("*").alias("n"))


def accuracy(df: DataFrame, lat: str, lon: str, time: str, now: str) -> DataFrame:
    """100 less the penalties of places off the globe or near zero, and of times after ``now`` or before 2000."""
    y, x, at = F.col(lat), F.col(lon), F.to_timestamp(F.lit(now))
    share = lambda c: F.avg(F.coalesce(c, F.lit(False)).cast("double")) * 100
    known = lambda c: F.coalesce(F.avg(c.cast("double")), d(0)) * 100  # noqa: E731  missing times are left out
    one = df.agg(share((F.abs(y) > 90) | (F.abs(x) > 180)).alias("a"), share((F.abs(y) < 0.1) | (F.abs(x) < 0.1)).alias("b"), known(F.col(time) > at).alias("c"), known(F.col(time) < F.lit("2000-01-01").cast("timestamp")).alias("e"))
    lost = F.least(F.col("a") * 2, d(30)) + F.least(F.col("b") * 2, d(20)) + F.least(F.col("c") * 3, d(25)) + F.least(F.col("e") * 2, d(15))
    return one.select(F.greatest(d(100) - F.coalesce(lost, d(0)), d(0)).alias("accuracy"))


def consistency(df: DataFrame, kind: str, lat: str) -> DataFrame:
    """100 less the penalties of many kinds, of one kind over 95 percent, and of uneven decimals in the latitudes."""
    kinds = df.where(F.col(kind).isNotNull()).groupBy(kind).agg(F.count("*").alias("n")).agg(F.count("*").alias("kinds"), F.max("n").alias("top"))
    decimals = F.length(F.element_at(F.split(F.col(lat).cast("string"), "[.]"), -1))
    rest = df.agg(F.count("*").alias("n"), F.when(F.count(lat) > 10, F.stddev_samp(decimals)).alias("spread"))
    one = kinds.crossJoin(rest)
    lost = tiers(F.col("kinds"), [(50, 15), (20, 5)]) + tiers(F.col("top") / F.col("n") * 100, [(95, 10)]) + tiers(F.coalesce("spread", d(0)), [(2, 10)])
    return one.select(F.greatest(d(100) - lost, d(0)).alias("consistency"))


def timeliness(df: DataFrame, time: str, now: str) -> DataFrame:
    """100 less the penalties of a last row long ago and of a short span, in whole days; without times there is none."""
    days = lambda a, b: F.floor((F.unix_micros(b) - F.unix_micros(a)) / 86_400_000_000)
    one = df.agg(F.min(time).alias("a"), F.max(time).alias("b"))
    lost = tiers(days(F.col("b"), F.to_timestamp(F.lit(now))), [(365, 30), (90, 15), (30, 5)]) + F.when(days(F.col("a"), F.col("b")) < 7, d(20)).when(days(F.col("a"), F.col("b")) < 30, d(10)).otherwise(d(0))
    return one.select(F.when(F.col("a").isNull(), d(100)).otherwise(F.greatest(d(100) - lost, d(0))).alias("timeliness"))


def uniqueness_score(df: DataFrame, columns: list[str]) -> DataFrame:
    """100 less the penalty of repeated rows: over 20 percent 30, over 10 percent 15, over 5 percent 5."""
    share = F.coalesce(F.col("repeat_share"), d(0)) * 100
    return uniqueness(df, columns).select(F.greatest(d(100) - tiers(share, [(20, 30), (10, 15), (5, 5)]), d(0)).alias("uniqueness"))


def validity(df: DataFrame, flooded: Column) -> DataFrame:
    """100 less the penalties of few rows and of less than a tenth that tell of flooding."""
    one = df.agg(F.count("*").alias("n"), F.avg(flooded.cast("double")).alias("share"))
    few = F.when(F.col("n") < 10, d(40)).when(F.col("n") < 50, d(20)).when(F.col("n") < 100, d(10)).otherwise(d(0))
    return one.select(F.greatest(d(100) - few - F.when(F.col("share") < 0.1, d(15)).otherwise(d(0)), d(0)).alias("validity"))
