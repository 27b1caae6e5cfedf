"""Decisions: risk rules, relative decisions, contracts, utilities, baselines."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import clip, d, normal_cdf
from tidewatch.operators.scalars import with_quantiles, with_scalars


def risk_rules(df: DataFrame, stress: str, uncertainty: str, reliable: Column | None = None, high: float = 0.7, medium: float = 0.4, low: float = 0.2) -> DataFrame:
    """``risk`` by ordered rules on normalised stress and uncertainty; later rules win, so the CASE runs backwards."""
    ready = with_scalars(df, s_max=F.max(stress), u_min=F.min(uncertainty), u_max=F.max(uncertainty))
    u = F.col(uncertainty)
    sn, un = F.col(stress) / (F.col("s_max") + 1e-9), (u - F.col("u_min")) / (F.col("u_max") - F.col("u_min") + 1e-9)
    sure = un < 0.9
    rule = F.when(~(reliable if reliable is not None else F.lit(True)), "NO_DECISION")
    rule = rule.when((sn >= medium) & (sn < high) & (u > 0.6) & sure, "NO_DECISION").when((sn < low) & sure, "LOW").when((sn >= medium) & (sn < high) & (u <= 0.6) & sure, "MEDIUM")
    rule = rule.when((sn >= high) & (un > 0.3) & sure, "NO_DECISION").when((sn >= high) & (un <= 0.3) & sure, "HIGH")
    return ready.withColumn("risk", rule.otherwise("NO_DECISION")).drop("s_max", "u_min", "u_max")


def interval_risk(df: DataFrame, lower: str, upper: str) -> DataFrame:
    """``risk`` and ``risk_confidence`` from credible intervals over the greatest upper end."""
    ready = with_scalars(df, top=F.max(upper))
    lo, hi = F.col(lower) / (F.col("top") + 1e-9), F.col(upper) / (F.col("top") + 1e-9)
    width = hi - lo
    rule = F.when(width > 0.5, "NO_DECISION").when(lo >= 0.7, "HIGH").when(hi <= 0.2, "LOW").when((lo >= 0.2) & (hi <= 0.7), "MEDIUM").otherwise("NO_DECISION")
    out = ready.withColumn("risk", rule).withColumn("risk_confidence", F.when(F.col("risk") != "NO_DECISION", d(1) - width).otherwise(d(0)))
    return out.drop("top")


def percentile_ranks(df: DataFrame, z: str, by: list[str]) -> DataFrame:
    """Share of the group's values that are not greater, in percent: counts by value, then running sums over values."""
    counts = df.groupBy(*by, F.col(z).alias("_z")).agg(F.count("*").alias("_n"))
    w = Window.partitionBy(*by).orderBy("_z")
    ranks = counts.select(*by, "_z", (F.sum("_n").over(w.rowsBetween(Window.unboundedPreceding, 0)) / F.sum("_n").over(Window.partitionBy(*by)) * 100).alias("percentile_rank"))
    a, b = df.alias("a"), ranks.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in by] + [F.col(f"a.{z}").eqNullSafe(F.col("b._z"))]
    return a.join(b, same).select(*[F.col(f"a.{c}").alias(c) for c in df.columns], "percentile_rank")


def exceedance(z: Column, sigma: Column, threshold: Column) -> Column:
    return d(1) - normal_cdf((threshold - z) / (sigma + 1e-10))


def confidence(sigma: Column) -> Column:
    return clip(F.exp(d(-2) * sigma), 0, 1)


def relative_decision(p: Column, e: Column, c: Column, strict_precedence: bool = False, conservative: bool = False) -> Column:
    """Decision from percentile rank, exceedance probability and confidence. An exceedance over 0.3 acts even without
    confidence, unless ``strict_precedence``."""
    ok = c >= 0.3
    act = (ok & (((p >= 75) & (p < 90)) | (e > 0.3))) if strict_precedence else ((ok & (p >= 75) & (p < 90)) | (e > 0.3))
    rule = F.when((c >= 0.3) & (c < 0.5), "no_decision") if conservative else F.when(F.lit(False), "no_decision")
    return rule.when(ok & (p >= 90) & (e > 0.5), "urgent").when(act, "action").when(ok & (p >= 50) & (p < 75), "monitor").when(~ok, "no_decision").otherwise("no_action")


def contract_state(c: Column, sigma: Column) -> Column:
    return F.when(sigma > 1, "REFUSED").when(c >= 0.7, "CONFIDENT").when(c >= 0.3, "UNCERTAIN").otherwise("REFUSED")


def contracts(df: DataFrame, decision: str, c: str, sigma: str) -> DataFrame:
    """``state`` and ``contract_decision``, which is null where refused."""
    out = df.withColumn("state", contract_state(F.col(c), F.col(sigma)))
    return out.withColumn("contract_decision", F.when(F.col("state") != "REFUSED", F.col(decision)))


def contract_summary(df: DataFrame) -> DataFrame:
    counts = df.groupBy("state").agg(F.count("*").alias("n"), F.count_if(F.col("contract_decision").isin("action", "urgent")).alias("n_acting"))
    return counts.withColumn("share", F.col("n") / F.sum("n").over(Window.partitionBy()))  # three rows


def broken_contracts(df: DataFrame) -> DataFrame:
    """Rows that break an invariant: a refused one has no decision, the others have one, confidence lies in 0 .. 1."""
    refused = F.col("state") == "REFUSED"
    good = (refused & F.col("contract_decision").isNull()) | (~refused & F.col("contract_decision").isNotNull())
    return df.agg(F.count_if(~good).alias("n_broken"), F.count("*").alias("n"))


def city_reference(df: DataFrame, z: str) -> DataFrame:
    q = with_quantiles(df, z, q10=0.1, q25=0.25, q50=0.5, q75=0.75, q90=0.9, q95=0.95, q99=0.99)
    names = ["q10", "q25", "q50", "q75", "q90", "q95", "q99"]
    return q.agg(*[F.first(n).alias(n) for n in names], F.min(z).alias("z_min"), F.max(z).alias("z_max"), F.stddev_pop(z).alias("z_std"))


def threshold_baseline(rain: Column) -> dict[str, Column]:
    """Stress of the heaviest rain alone, and its class at 5, 15 and 30: low, medium, high or extreme, numbered from 0."""
    return {"stress": clip(rain / 30, 0, 2), "level": F.when(rain >= 30, 3).when(rain >= 15, 2).when(rain >= 5, 1).otherwise(0)}


def physics_baseline(rain: Column, slope: Column, upstream: Column) -> dict[str, Column]:
    """Stress of the heaviest rain, raised by the slope (tangent, up to a factor of 3) and by upstream over its maximum.

    ``slope`` is the gradient's magnitude, ``upstream`` the contribution over the greatest one.
    """
    steep = clip(d(1) + slope / d(1 + 1e-6), 1, 3)
    s = rain / 30 * (d(1) + d(0.5) * (steep - 1) + d(0.3) * upstream)
    return {"stress": s, "level": F.when(s >= 1, 3).when(s >= 0.5, 2).when(s >= 0.25, 1).otherwise(0)}


def linear_baseline(rain: Column, trailing: Column, upstream: Column, count: Column) -> Column:
    return d(0.3) * rain + d(0.2) * trailing + d(0.3) * upstream + d(0.2) * count


def action_class(stress: Column, sigma: Column) -> Column:
    """Action from stress and deviation, each over its greatest; what lies between the bands stays undecided."""
    rule = F.when(sigma > 0.6, "UNDECIDED").when(stress >= 0.7, F.when(sigma <= 0.3, "DEPLOY_PUMPS").otherwise("UNDECIDED"))
    return rule.when(stress >= 0.4, "MONITOR").when(stress < 0.2, "NO_ACTION").otherwise("UNDECIDED")


def expected_loss(stress: Column, sigma: Column, cost: float = 10_000.0) -> Column:
    """Loss expected without acting: stress over its greatest as the chance of a flood, and a penalty for deviation."""
    return clip(stress, 0, 1) * d(cost) + sigma * d(100)


def signal_confidence(mean: Column, var: Column, weight: Column) -> Column:
    """Signal over noise, weighted by how much was observed (0 to 1); to be smoothed and clipped at 10."""
    return F.abs(mean) / F.sqrt(var + 1e-9) * (d(0.5) + d(0.5) * weight)


def best_action(outcomes: DataFrame, action: str, utility: Column) -> DataFrame:
    """Expected utility of each action over the samples, and the best one, the first of equals by name."""
    means = outcomes.groupBy(action).agg(F.avg(utility).alias("expected_utility"))
    top = means.agg(F.min_by(action, F.struct(-F.round("expected_utility", 9), action)).alias("_best"))
    return means.crossJoin(F.broadcast(top)).select(action, "expected_utility", (F.col(action) == F.col("_best")).alias("is_best"))


def perfect_information(outcomes: DataFrame, sample: str, action: str, utility: Column) -> DataFrame:
    """Value of perfect information: mean of the best utilities less the best of the mean utilities, at least 0."""
    best = outcomes.groupBy(sample).agg(F.max(utility).alias("u")).agg(F.avg("u").alias("informed"))
    mean = outcomes.groupBy(action).agg(F.avg(utility).alias("u")).agg(F.max("u").alias("uninformed"))
    return best.crossJoin(F.broadcast(mean)).select("informed", "uninformed", F.greatest(F.col("informed") - F.col("uninformed"), d(0)).alias("evpi"))


def decision_share(df: DataFrame, risk: str, most: float = 0.8) -> DataFrame:
    """Share of HIGH among all decisions: PASS up to ``most``, WARN up to a tenth above it, else FAIL."""
    one = df.agg(F.count("*").alias("n"), F.avg(F.contains(F.lower(risk), F.lit("high")).cast("double")).alias("high_share"))
    return one.withColumn("status", F.when(F.col("high_share") <= most, "PASS").when(F.col("high_share") <= most * 1.1, "WARN").otherwise("FAIL"))
