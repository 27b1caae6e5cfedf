"""Dataset catalog, integrity checks and the run gate, over small tables of metadata."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d

#: Required dataset types by run mode, and thresholds (pass, warn).
REQUIRED = {"full": ("dem", "rainfall", "complaints"), "degraded": ("dem", "rainfall"), "minimal": ("dem",)}
TEMPORAL, SPATIAL, QUALITY = (0.9, 0.7), (0.8, 0.5), (70.0, 50.0)
MULTIPLIERS = {"missing_radar": 1.3, "missing_complaints": 1.2, "low_quality_rainfall": 1.25, "low_quality_dem": 1.4, "limited_temporal_coverage": 1.15, "limited_spatial_coverage": 1.2}


def overlap_fraction(start: Column, end: Column, target_start: Column, target_end: Column) -> Column:
    """Overlapping seconds over the target's seconds, 0 without overlap."""
    s = lambda c: F.unix_micros(c) / 1e6
    return F.greatest(F.least(s(end), s(target_end)) - F.greatest(s(start), s(target_start)), d(0)) / F.greatest(s(target_end) - s(target_start), d(1e-9))


def covers(start: Column, end: Column, target_start: Column, target_end: Column, static: Column) -> Column:
    return F.when(static, F.lit(True)).otherwise(F.coalesce((start <= target_start) & (end >= target_end), F.lit(False)))


def box_overlap_area(a: list[Column], b: list[Column]) -> Column:
    """Share of box b (west, south, east, north) that box a covers."""
    w = F.greatest(F.least(a[2], b[2]) - F.greatest(a[0], b[0]), d(0))
    h = F.greatest(F.least(a[3], b[3]) - F.greatest(a[1], b[1]), d(0))
    return w * h / F.greatest((b[2] - b[0]) * (b[3] - b[1]), d(1e-12))


def graded(x: Column, limits: tuple[float, float]) -> Column:
    return F.when(x >= limits[0], "PASS").when(x >= limits[1], "WARN").otherwise("FAIL")


def best_dataset(catalog: DataFrame, kind: str, rank: Column, quality: str, recency: str, key: str) -> DataFrame:
    """The best row of each kind by status rank, quality, recency and then key."""
    w = Window.partitionBy(kind).orderBy(F.desc(rank), F.desc(quality), F.desc(recency), key)
    return catalog.withColumn("_r", F.row_number().over(w)).where("_r = 1").drop("_r")


def missing_required(catalog: DataFrame, kind: str, mode: str) -> DataFrame:
    need = catalog.sparkSession.createDataFrame([(k,) for k in REQUIRED[mode]], f"{kind} string")
    return need.join(catalog.select(kind).distinct(), kind, "left_anti")


def source_score(quality: Column, n: Column, covered: Column, points: Column) -> Column:
    return d(0.4) * quality + F.least(n / 1000, d(30)) + d(20) * covered + F.when(points, d(10)).otherwise(d(0))


def worst(checks: DataFrame, status: str, by: list[str]) -> DataFrame:
    """Worst status of each group: FAIL over WARN over PASS."""
    rank = F.max(F.when(F.col(status) == "FAIL", 2).when(F.col(status) == "WARN", 1).otherwise(0))
    return checks.groupBy(*by).agg(F.element_at(F.array(F.lit("PASS"), F.lit("WARN"), F.lit("FAIL")), rank + 1).alias("overall"))


def gate(runs: DataFrame, strict: bool = False) -> DataFrame:
    """FULL, DEGRADED or ABORT from the flags has_dem, has_rainfall, has_complaints and n_fail."""
    full = F.col("has_dem") & F.col("has_rainfall") & F.col("has_complaints")
    low = F.col("has_dem") & F.col("has_rainfall")
    rule = F.when(full & (F.col("n_fail") == 0), "FULL")
    rule = rule if strict else rule.when(low, "DEGRADED")
    return runs.withColumn("gate", rule.otherwise("ABORT"))


def uncertainty_factor(flags: dict[str, Column], gate: Column | None = None) -> Column:
    """Product of the multipliers of the flags that hold, rounded half to even to two decimals; 1 for a full run.

    Unknown names of low quality count 1.15, other unknown ones 1.1.
    """
    out = d(1)
    for name, holds in flags.items():
        out = out * F.when(holds, d(MULTIPLIERS.get(name, 1.15 if name.startswith("low_quality") else 1.1))).otherwise(d(1))
    out = F.bround(out, 2)
    return out if gate is None else F.when(gate == "FULL", d(1)).otherwise(out)


def latest(records: DataFrame, key: str, version: str) -> DataFrame:
    """Upsert: the newest record of each key, combined before the shuffle."""
    rest = [c for c in records.columns if c not in (key, version)]
    return records.groupBy(key).agg(F.max(F.struct(version, *rest)).alias("b")).select(key, F.col(f"b.{version}").alias(version), *[F.col(f"b.{c}").alias(c) for c in rest])


def integrity_score(checks: DataFrame, status: str, weight: str, by: list[str]) -> DataFrame:
    """Weighted score: PASS 100, WARN 60, else 0; skipped checks count in the denominator."""
    points = F.when(F.col(status) == "PASS", d(100)).when(F.col(status) == "WARN", d(60)).otherwise(d(0))
    return checks.groupBy(*by).agg((F.sum(points * F.col(weight)) / F.sum(weight)).alias("integrity"))


#: Records (completeness times 100) for PASS and WARN, metres of a raster, hours of a validation.
RECORDS, RESOLUTION, FRESH_HOURS = (100.0, 10.0), 30.0, 24


def sufficiency(kind: Column, completeness: Column, resolution: Column) -> Column:
    """Whether a dataset has enough data: rasters by resolution, others by completeness; none has no row to grade."""
    raster = F.when(resolution <= RESOLUTION, "PASS").otherwise("WARN")
    return F.when(kind == "dem", raster).otherwise(graded(F.when(completeness > 0, completeness * 100).otherwise(d(RECORDS[1])), RECORDS))


def freshness(catalog: DataFrame, validated: str, now: str, by: list[str]) -> DataFrame:
    """Datasets of each group validated more than 24 hours before ``now``; PASS without any, else WARN."""
    old = F.col(validated) < F.to_timestamp(F.lit(now)) - F.expr(f"interval {FRESH_HOURS} hours")
    return catalog.groupBy(*by).agg(F.count_if(old).alias("n_stale")).withColumn("status", F.when(F.col("n_stale") == 0, "PASS").otherwise("WARN"))


def cross_consistency(datasets: DataFrame, by: list[str], start: str, end: str, crs: str, box: list[str], static: str, rank: str) -> DataFrame:
    """Whether each group's datasets can be used together: FAIL without a common time or place, WARN for several
    reference systems or a common time under seven days, else PASS. Places are held against the first dataset by ``rank``."""
    w = Window.partitionBy(*by).orderBy(rank)
    first = [F.first(c).over(w.rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)) for c in box]
    apart = ~((F.col(box[0]) <= first[2]) & (F.col(box[2]) >= first[0]) & (F.col(box[1]) <= first[3]) & (F.col(box[3]) >= first[1]))
    rows = datasets.withColumn("_apart", apart)
    moving = ~F.col(static)
    one = rows.groupBy(*by).agg(F.count("*").alias("n"), F.count_distinct(crs).alias("n_crs"), F.count_if(moving).alias("n_time"), F.max(F.when(moving, F.col(start))).alias("a"), F.min(F.when(moving, F.col(end))).alias("b"), F.bool_or("_apart").alias("apart"))
    timed = (F.col("n_time") >= 2) & F.col("a").isNotNull() & F.col("b").isNotNull()
    short = (F.unix_micros("b") - F.unix_micros("a")) < 7 * 86_400_000_000
    rule = F.when(F.col("n") < 2, "PASS").when((timed & (F.col("a") >= F.col("b"))) | F.col("apart"), "FAIL").when((F.col("n_crs") > 1) | (timed & short), "WARN").otherwise("PASS")
    return one.select(*by, "n", "n_crs", rule.alias("status"))
