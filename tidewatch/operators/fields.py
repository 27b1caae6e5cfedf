"""Fields over rasters and scattered points: drivers, confidence, kernels, adaptive cells, and reports on an inference."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.mathx import clip, d
from tidewatch.operators import catalog, grid
from tidewatch.operators.scalars import with_quantiles, with_scalars


def driver_contributions(df: DataFrame, stress: str, variance: str, rain: str, upstream: str, count: str, sigma: float = 5.0, window: int = 15, by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., r, q, rainfall, terrain, observation): shares of what drives the stress, which add up to 1 where any does.

    Rain and upstream count by their local correlation with the stress (windows of ``window`` cells, negative ones as
    0), reports by their blurred density times what is left of the variance; all three are blurred by ``sigma``. The
    maxima are over the whole of each raster. Full rasters with r, q, h, w; null values count as 0.
    """
    keys = [*by, "r", "q"]
    cells = df.select(*by, F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"), "h", "w", *[F.coalesce(F.col(c).cast("double"), d(0)).alias(n) for n, c in {"_s": stress, "_v": variance, "_a": rain, "_u": upstream, "_k": count}.items()])
    cells = cells.withColumn("_k", F.log1p("_k"))
    centred = cells.join(grid.box_mean(cells, ["_s", "_a", "_u"], window, by).select(*keys, *[F.col(c).alias(f"{c}m") for c in ("_s", "_a", "_u")]), keys)
    s, a, u = (F.col(c) - F.col(f"{c}m") for c in ("_s", "_a", "_u"))
    moments = grid.box_mean(centred.select(*keys, "h", "w", (s * s).alias("ss"), (a * a).alias("aa"), (u * u).alias("uu"), (a * s).alias("as"), (u * s).alias("us")), ["ss", "aa", "uu", "as", "us"], window, by)
    local = lambda cov, v: F.greatest(clip(F.col(cov) / (F.sqrt((F.col(v) + 1e-9) * (F.col("ss") + 1e-9)) + 1e-9), -1, 1), d(0))
    dense = grid.blurs(cells.select(*keys, "h", "w", "_k"), ["_k"], 5.0, by).select(*keys, F.col("_k").alias("_d"))
    seen = cells.select(*keys, "_v").join(dense, keys)
    tops = seen.groupBy(*by).agg(F.max("_v").alias("_vt"), F.max("_d").alias("_dt"))
    seen = seen.join(tops, list(by)) if by else seen.crossJoin(F.broadcast(tops))  # one row
    left = clip((d(1) - F.col("_v") / (F.col("_vt") + 1e-9)) * F.col("_d") / (F.col("_dt") + 1e-9), 0, 1)
    parts = moments.select(*keys, "h", "w", local("as", "aa").alias("rainfall"), local("us", "uu").alias("terrain")).join(seen.select(*keys, left.alias("observation")), keys)
    names = ["rainfall", "terrain", "observation"]
    soft = grid.blurs(parts, names, sigma, by)
    total = F.col(names[0]) + F.col(names[1]) + F.col(names[2]) + 1e-9
    return soft.select(*keys, *[(F.col(c) / total).alias(c) for c in names])


def nonstationary_kernel(variance_a: Column, length_a: Column, variance_b: Column, length_b: Column, squared: Column, base: str = "matern") -> Column:
    """Covariance of two places with their own variances and length scales, from their squared distance.

    The mean of the squared lengths scales the distance; ``base`` is a Matern kernel of 5/2 or, as ``se``, the squared
    exponential. Two lengths of zero count as distance 0 and give null.
    """
    mean = (length_a * length_a + length_b * length_b) / 2
    q = F.when(mean > 1e-10, F.sqrt(squared / mean)).otherwise(d(0))
    k = F.exp(q * q * -0.5) if base == "se" else (d(1) + q * math.sqrt(5) + q * q * (5 / 3)) * F.exp(q * -math.sqrt(5))
    return F.sqrt(variance_a * variance_b) * F.sqrt(length_a * length_b) / F.when(mean > 0, F.sqrt(mean)) * k


def adaptive_cells(points: DataFrame, x: str, y: str, value: str, box: tuple[float, float, float, float], least: int = 2, most: int = 6, limit: float = 0.1) -> DataFrame:
    """(level, ix, iy, n, value, uncertainty): the leaves of a quadtree over ``box``, the empty ones too.

    A cell from level ``least`` on is divided while it holds more than ``limit`` points a unit of area, up to level
    ``most``. Leaves are half-open; points off the box or without a place are in none. ``value`` is the mean, the
    uncertainty the population deviation over the root of n, null for a single point. Points are summed by finest cell
    once; all else is counts of cells, 4 ** most at most.
    """
    width, height = box[2] - box[0], box[3] - box[1]
    finest = _at(points, x, y, box, most).groupBy("ix", "iy").agg(F.count("*").alias("n"), F.count(value).alias("nv"), F.sum(value).alias("s"), F.sum(F.col(value) * F.col(value)).alias("ss"))
    level = F.explode(F.sequence(F.lit(least), F.lit(most)))
    at = grid.cut(finest).withColumn("level", level)
    up = lambda c: F.shiftright(F.col(c), 1)
    coarse = lambda c: F.floor(F.col(c) / F.pow(d(2), F.lit(most) - F.col("level"))).cast("long")
    sums = grid.cut(at.groupBy("level", coarse("ix").alias("ix"), coarse("iy").alias("iy")).agg(F.sum("n").alias("n"), F.sum("nv").alias("nv"), F.sum("s").alias("s"), F.sum("ss").alias("ss")))
    crowded = sums.where((F.col("n") / (width * height) * F.pow(d(4), F.col("level")) > limit) & (F.col("level") < most)).select("level", "ix", "iy")
    divided = open_ = crowded.where(F.col("level") == least)
    for k in range(least + 1, most):
        parents = open_.select(F.col("ix").alias("px"), F.col("iy").alias("py"))
        open_ = crowded.where(F.col("level") == k).join(parents, (up("ix") == F.col("px")) & (up("iy") == F.col("py")), "left_semi")
        divided = divided.unionByName(open_)
    divided = grid.cut(divided)
    side = F.sequence(F.lit(0).cast("long"), F.lit(2**least - 1).cast("long"))
    base = points.sparkSession.range(1).select(F.lit(least).alias("level"), F.explode(side).alias("ix")).select("level", "ix", F.explode(side).alias("iy"))
    children = divided.select((F.col("level") + 1).alias("level"), F.explode(F.array(F.col("ix") * 2, F.col("ix") * 2 + 1)).alias("ix"), "iy").select("level", "ix", F.explode(F.array(F.col("iy") * 2, F.col("iy") * 2 + 1)).alias("iy"))
    leaves = base.unionByName(children).join(divided, ["level", "ix", "iy"], "left_anti").join(sums, ["level", "ix", "iy"], "left")
    mean = F.col("s") / F.col("nv")
    sd = F.sqrt(F.greatest(F.col("ss") / F.col("nv") - mean * mean, d(0)))
    return leaves.select("level", "ix", "iy", F.coalesce("n", F.lit(0)).alias("n"), mean.alias("value"), F.when(F.col("nv") > 1, sd / F.sqrt("nv")).alias("uncertainty"))


def _at(points: DataFrame, x: str, y: str, box: tuple[float, float, float, float], level: int) -> DataFrame:
    """``points`` inside the half-open box, with the column ix and row iy of their cell at ``level``."""
    inside = (F.col(x) >= box[0]) & (F.col(x) < box[2]) & (F.col(y) >= box[1]) & (F.col(y) < box[3])
    place = lambda c, a, b: F.floor((F.col(c) - a) / (b - a) * 2**level).cast("long")
    return points.where(inside).withColumns({"ix": place(x, box[0], box[2]), "iy": place(y, box[1], box[3])})


def leaf_at(points: DataFrame, leaves: DataFrame, x: str, y: str, box: tuple[float, float, float, float], least: int = 2, most: int = 6) -> DataFrame:
    """``points`` inside the box with the level, place and value of their leaf: an equi-join on the cell of each level."""
    asked = _at(points, x, y, box, most).withColumn("level", F.explode(F.sequence(F.lit(least), F.lit(most))))
    coarse = lambda c: F.floor(F.col(c) / F.pow(d(2), F.lit(most) - F.col("level"))).cast("long")
    asked = asked.withColumns({"ix": coarse("ix"), "iy": coarse("iy")})
    return asked.join(leaves.select("level", "ix", "iy", F.col("value").alias("leaf_value")), ["level", "ix", "iy"])


#: The weight of each check in the integrity of an inference.
WEIGHTS = {
    "uncertainty_heterogeneity": 2.0,
    "observation_impact": 2.0,
    "decision_distribution": 1.5,
    "no_decision_exists": 1.5,
    "spatial_structure": 1.0,
    "variance_reduction": 1.5,
    "temporal_variation": 1.0,
    "physical_constraints": 1.0,
}


def scientific_checks(df: DataFrame, mean: str, var: str, prior_var: str, count: str, gain: str, risk: str, cell: str, t: str) -> DataFrame:
    """(name, status, metric, weight): the eight checks of an inference over a grid (columns r, q beside the named ones).

    Each metric is an aggregate of one row; only steps, cells and quantile ranges are ever grouped.
    """
    rows = with_quantiles(df.withColumn("_sd", F.sqrt(var)), "_sd", _q90=0.9)
    seen = F.col(count) > 0
    share = lambda c: F.avg(c.cast("double"))
    drop = (F.col(prior_var) - F.col(var)) / (F.col(prior_var) + 1e-9)
    one = rows.agg((F.stddev_pop("_sd") / (F.avg("_sd") + 1e-9)).alias("cv"), share(F.lower(risk).contains("high")).alias("high"), F.coalesce(F.avg(F.when(seen, F.col(gain))), d(0)).alias("impact"), share(F.col("_sd") >= F.col("_q90") * 0.9).alias("unsure"), F.count_if(seen).alias("n_seen"), F.avg(F.when(seen, drop)).alias("less"), share(F.col(mean) < 0).alias("negative"), F.count(mean).alias("n"))
    steps = df.groupBy(t).agg(F.avg(mean).alias("m")).agg(F.count("*").alias("n_steps"), (F.stddev_pop("m") / (F.avg("m") + 1e-9)).alias("varied"))
    raster = with_scalars(df.groupBy(cell, "r", "q").agg(F.avg(mean).alias("z")), h=F.max("r") + 1, w=F.max("q") + 1)
    rough = grid.spatial_structure(raster, "z").select("roughness", F.col("status").alias("rough"))
    kinds = df.select(F.round(mean, 3)).distinct().agg(F.count("*").alias("kinds"))
    all_ = one.crossJoin(steps).crossJoin(rough).crossJoin(kinds)  # one row each
    cv, high, impact, less = F.col("cv"), F.col("high"), F.col("impact"), F.col("less")
    checks = {
        "uncertainty_heterogeneity": (cv, F.when(cv >= 0.1, "PASS").when(cv >= 0.05, "WARN").otherwise("FAIL")),
        "spatial_structure": (F.when(F.col("rough") == "SKIP", d(0)).otherwise(F.col("roughness")), F.col("rough")),
        "decision_distribution": (high, F.when(high <= 0.8, "PASS").when(high <= 0.8 * 1.1, "WARN").otherwise("FAIL")),
        "observation_impact": (impact, F.when(impact >= 0.01, "PASS").when(impact >= 0.001, "WARN").otherwise("FAIL")),
        "no_decision_exists": (F.col("unsure"), F.when(F.col("unsure") >= 0.05, "PASS").otherwise("WARN")),
        "variance_reduction": (F.when(F.col("n_seen") < 10, d(0)).otherwise(less), F.when(F.col("n_seen") < 10, "SKIP").when(less >= 0.05, "PASS").when(less > 0, "WARN").otherwise("FAIL")),
        "temporal_variation": (F.when(F.col("n_steps") < 3, d(0)).otherwise(F.col("varied")), F.when(F.col("n_steps") < 3, "SKIP").when(F.col("varied") >= 0.1, "PASS").otherwise("WARN")),
        "physical_constraints": (F.when(F.col("negative") > 0.01, F.col("negative")).when(F.col("kinds") < 10, F.col("kinds") / F.col("n")).otherwise(d(1)), F.when((F.col("negative") > 0.01) | (F.col("kinds") < 10), "FAIL").otherwise("PASS")),
    }
    rows = F.array(*[F.struct(F.lit(k).alias("name"), s.alias("status"), m.cast("double").alias("metric"), d(WEIGHTS[k]).alias("weight")) for k, (m, s) in checks.items()])
    return all_.select(F.inline(rows))


def scientific_report(checks: DataFrame) -> DataFrame:
    """One row: passed, warned and failed checks, weighted integrity, status (WARN from three warnings), and whether the run is valid."""
    n = lambda s: F.count_if(F.col("status") == s)
    one = checks.agg(n("PASS").alias("n_pass"), n("WARN").alias("n_warn"), n("FAIL").alias("n_fail")).crossJoin(catalog.integrity_score(checks, "status", "weight", []))
    return one.withColumns({"status": F.when(F.col("n_fail") > 0, "FAIL").when(F.col("n_warn") > 2, "WARN").otherwise("PASS"), "is_valid": F.col("n_fail") == 0})


def event_report(df: DataFrame, mean: str, var: str, count: str, upstream: str, cell: str, t: str, step_minutes: float, jump: float = 3.0, sure: float = 0.1, unsure: float = 0.5) -> DataFrame:
    """One row on an event: minutes from the peak of mean stress to that of mean reports (null without reports), whether
    any step's mean change exceeds ``jump``, whether over 0.9 of all steps fall, whether mean stress correlates less than
    0.1 with upstream, and the shares of reported rows with variance below ``sure`` and above ``unsure``."""
    from tidewatch.operators.series import differences

    moved = differences(df, mean, cell, t, "_d")
    steps = moved.groupBy(t).agg(F.round(F.avg(mean), 9).alias("m"), F.round(F.avg(count), 9).alias("k"), F.avg(F.abs("_d")).alias("j"))
    first = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col(t)).alias("m")))
    peaks = steps.agg(first("m").alias("a"), first("k").alias("b"), F.coalesce(F.max("j") > jump, F.lit(False)).alias("jumps"))
    lead = F.when(F.col("b.v") > 0, (F.col("a.m") - F.col("b.m")) * d(step_minutes))
    seen = F.col(count) > 0
    one = moved.agg(F.coalesce(F.avg((F.col("_d") < 0).cast("double")) > 0.9, F.lit(False)).alias("persists"), F.avg((seen & (F.col(var) < sure)).cast("double")).alias("overconfident"), F.avg((seen & (F.col(var) > unsure)).cast("double")).alias("underconfident"))
    like = df.groupBy(cell).agg(F.avg(mean).alias("m"), F.avg(upstream).alias("u")).agg(F.corr("m", "u").alias("coherence"))
    return peaks.select(lead.alias("lead_minutes"), "jumps").crossJoin(one).crossJoin(like).withColumn("incoherent", F.coalesce(F.col("coherence") < 0.1, F.lit(False)))
