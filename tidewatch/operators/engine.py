"""The whole inference over a space-time grid as one call, each stage with a switch."""

from __future__ import annotations

from dataclasses import dataclass, fields

from pyspark.sql import DataFrame, functions as F

from tidewatch.functions.mathx import clip, d
from tidewatch.operators import bayes, grid, mixtures, series
from tidewatch.operators.grid import cut
from tidewatch.operators.scalars import with_scalars

EPSILON = 2.220446049250313e-16


@dataclass(frozen=True)
class Stages:
    """Which stages run, and the limits of the variance."""

    prior: bool = True
    state_space: bool = True
    dynamics: bool = True
    mixture: bool = True
    decomposition: bool = True
    smoothing: bool = True
    multi_resolution: bool = True
    evidence: bool = True
    least_variance: float = 0.01
    most_variance: float = 10.0

    def used(self) -> list[str]:
        """Names of the stages that run."""
        return [f.name for f in fields(self) if getattr(self, f.name) is True]


def composed(df: DataFrame, rain: str, upstream: str, count: str, cell: str = "cell", t: str = "t", stages: Stages = Stages()) -> DataFrame:
    """``df`` (a full grid with r, q, h, w) with mean, var, epistemic, aleatoric, gain, reducible, cvar, utility, ci_lower and
    ci_upper of each cell and step.

    The order is fixed: prior (rain scaled by the share of upstream), scalar filter along time, mean reversion towards
    the rain, a shift by the two groups of positive counts (from 51 of them on), the split into reducible and other
    variance, the blur that the mean upstream share widens, the blend with the half resolution, risk measures, evidence,
    intervals. A stage that is off passes its input on; without a prior it is 0 with variance 0.5, without the split both
    parts are half the variance. Stages of a cell's series are scans by blocks, stages of a step's raster windows along its
    lines, and global numbers one-row aggregates. What several stages read is stored once.
    """
    known = {"_x": F.coalesce(F.col(rain).cast("double"), d(0)), "_u": F.coalesce(F.col(upstream).cast("double"), d(0)), "_k": F.coalesce(F.col(count).cast("double"), d(0))}
    whole = df.select(*[c.alias(n) for n, c in known.items()]).agg(F.var_pop("_x") + 0.1, F.max("_u"), F.avg("_u"), F.max("_k")).first()
    gv, um, us, km = (F.lit(x).cast("double") for x in whole)
    x, u, k = known.values()
    share = u / (um + EPSILON)
    v0 = gv * (share * 0.5 + 1) if stages.prior else d(0.5)
    own = df.withColumns({"_m": x * (share + 0.5) * 0.5 if stages.prior else d(0), "_v": v0})

    if stages.state_space or stages.dynamics:
        own = cut(own)
        state = own.select(cell, t, F.col("_m").alias("mean"), F.col("_v").alias("var"), x.alias("_x"), k.alias("_k"))
        if stages.state_space:
            state = series.kalman(state.withColumnsRenamed({"mean": "_m", "var": "_v"}), "_m", "_v", "_k", cell, t, keep=("_x",))
        if stages.dynamics:
            state = cut(state) if stages.state_space else state
            state = series.ornstein_uhlenbeck(state.withColumnsRenamed({"mean": "_m", "var": "_v"}), "_m", "_v", "_x", cell, t)
        fresh = state.select(cell, t, F.col("mean").alias("_m"), F.col("var").alias("_v"))
        own = own.drop("_m", "_v").join(fresh, [cell, t])
    own = cut(own)
    own = own.withColumns({"_u": u, "_k": k, "_v0": v0})
    seen = F.col("_k") > 0
    if stages.mixture:
        positive = own.where(seen).select("_k")
        found = mixtures.fit_mixture(positive, ["_k"], 2) if positive.count() > 50 else None
        if found is not None:
            shift = 0.1 * float(found.means.max() - found.means.min())
            own = own.withColumns({"_m": F.when(seen, F.col("_m") + d(shift)).otherwise(F.col("_m")), "_v": F.when(seen, F.col("_v") * 1.2).otherwise(F.col("_v"))})
    if stages.decomposition:
        own = bayes.epistemic_split(own, "_v0", "_v", "_k", cell, t)
    else:
        own = own.withColumns({"epistemic": F.col("_v") * 0.5, "aleatoric": F.col("_v") * 0.5, "gain": d(0)})
    if stages.smoothing or stages.multi_resolution:
        own = cut(own)
    if stages.smoothing:
        if whole[2] is not None:
            own = grid.sparse_smoothing(own, "_m", whole[2] / (whole[1] + EPSILON), (t,)).withColumn("_m", F.col("smoothed")).drop("smoothed")
            own = cut(own)
    if stages.multi_resolution:
        own = cut(grid.multi_resolution(own, "_m", (t,)).withColumn("_m", F.col("blended")).drop("blended"))
    own = own.withColumn("var", clip(F.col("epistemic") + F.col("aleatoric"), stages.least_variance, stages.most_variance)).withColumnRenamed("_m", "mean")
    own = own.withColumns({"reducible": F.col("epistemic") / (F.col("epistemic") + F.col("aleatoric") + EPSILON), "cvar": bayes.cvar_normal_2326(F.col("mean"), F.col("var")), "utility": bayes.expected_utility(F.col("mean"), F.col("var"))})
    if stages.evidence:
        own = with_scalars(own, _peak=F.max("mean"))
        own = own.withColumn("var", bayes.linear_evidence(F.col("mean"), F.col("var"), F.col("_k"), F.col("_u"), F.col("_peak"), km)["var_after"])
    half = d(1.96) * F.sqrt("var")
    out = own.withColumns({"ci_lower": F.col("mean") - half, "ci_upper": F.col("mean") + half})
    return out.select(*df.columns, "mean", "var", "epistemic", "aleatoric", "gain", "reducible", "cvar", "utility", "ci_lower", "ci_upper")


def composed_summary(out: DataFrame, t: str = "t") -> DataFrame:
    """One row: coverage (share of known means), the spread of the deviations over their mean, whether it reaches 0.2, and
    the mean roughness of the steps' rasters."""
    s = F.sqrt("var")
    whole = out.agg(F.avg(F.col("mean").isNotNull().cast("double")).alias("coverage"), (F.stddev_pop(s) / (F.avg(s) + EPSILON)).alias("uncertainty_cv"))
    rough = grid.roughness(out, "mean", (t,)).agg(F.avg("roughness").alias("roughness"))
    return whole.crossJoin(rough).withColumn("spread_enough", F.col("uncertainty_cv") >= 0.2)
