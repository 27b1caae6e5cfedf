"""Inference of latent stress: priors, likelihoods, posteriors, as columns over a grid table."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import clip, d, log_factorial, log_gamma, softplus
from tidewatch.operators.grid import cut
from tidewatch.operators.scalars import quantiles, with_scalars


def latent_base(rain: Column, trailing: Column, upstream: Column, intercept: float = 0.0, weights: tuple[float, float, float] = (1.0, 0.4, 0.8)) -> Column:
    return d(intercept) + d(weights[0]) * rain + d(weights[1]) * trailing + d(weights[2]) * upstream


def latent_variance(valid_share: Column, noise: float = 0.5, inflation: float = 2.0, floor: float = 1e-4) -> Column:
    return F.greatest(d(noise**2) * (d(1) + d(inflation) * (d(1) - valid_share)), d(floor))


def reporting_rate(stress: Column, spatial: Column | None = None, temporal: Column | None = None, base: float = 0.3) -> Column:
    """Expected reports: clipped reporting probability times the softplus of the stress."""
    return reporting_probability(spatial, temporal, base) * (softplus(stress) + d(1e-6))


def reporting_probability(spatial: Column | None = None, temporal: Column | None = None, base: float = 0.3) -> Column:
    return clip(d(base) * (spatial if spatial is not None else d(1)) * (temporal if temporal is not None else d(1)), 0.01, 0.95)


def poisson_loglik(k: Column, rate: Column) -> Column:
    """Log-likelihood of counts; null counts stay null."""
    return k * F.log(F.greatest(rate, d(1e-12))) - rate - log_factorial(k)


def negative_binomial_loglik(k: Column, stress: Column, dispersion: float = 1.5, base: float = 0.1, slope: float = 0.5) -> Column:
    r, mu = 1 / dispersion, d(base) * F.exp(d(slope) * stress)
    return log_gamma(k + d(r)) - log_gamma(d(r)) - log_factorial(k) + d(r) * F.log(d(r) / (d(r) + mu)) + k * F.log(mu / (d(r) + mu))


def fuse_precision(mean: Column, var: Column, likelihood: Column, rate: Column) -> dict[str, Column]:
    """Precision fusion of a latent mean with observed rates; ``no_decision`` where little is known."""
    p0 = d(1) / F.greatest(var, d(1e-6))
    p1 = F.when(likelihood > 0, F.least(likelihood, d(1)) * 2).otherwise(d(0))
    total = F.greatest(p0 + p1, d(1e-9))
    return {"mean": (p0 * mean + p1 * rate) / total, "var": d(1) / total, "no_decision": p0 + p1 < 0.03}


def heteroscedastic_prior(rain: Column, trailing: Column, upstream: Column, weights: tuple[float, float, float] = (1.0, 0.5, 0.3)) -> dict[str, Column]:
    m = F.greatest(d(weights[0]) * F.coalesce(rain, d(0)) + d(weights[1]) * F.coalesce(trailing, d(0)) + d(weights[2]) * F.coalesce(upstream, d(0)), d(0))
    v = clip(d(0.001) + d(0.1) * (m + 1) + F.when(rain.isNull(), d(2)).otherwise(d(0)), 0.001, 10)
    return {"prior_mean": m, "prior_var": v}


def posterior(mean: Column, var: Column, count: Column) -> dict[str, Column]:
    """Precision addition where there are reports, credible interval, information gain in nats, and its mask."""
    pl = clip(F.when(count > 0, d(1) + F.log1p(count)).otherwise(d(0)) / d(0.09 + 1e-9), 0, 100)
    ml = clip(F.log1p(count / 0.1), 0, 5)
    p0 = d(1) / var
    total = p0 + pl
    m = F.when(count > 0, (p0 * mean + pl * ml) / total).otherwise(mean)
    v = clip(F.when(count > 0, d(1) / total).otherwise(var), 0.001, 20)
    return {"post_mean": m, "post_var": v}


def intervals(mean: Column, var: Column) -> dict[str, Column]:
    return {"ci_lower": F.greatest(mean - d(1.96) * F.sqrt(var), d(0)), "ci_upper": mean + d(1.96) * F.sqrt(var), "no_decision": F.sqrt(var) > 2}


def information_gain(m0: Column, v0: Column, m1: Column, v1: Column) -> Column:
    """Kullback-Leibler divergence of posterior from prior, in nats, within 0 and 100."""
    ratio = v1 / (v0 + 1e-9)
    return clip((ratio + F.pow(m1 - m0, 2) / (v0 + 1e-9) - 1 - F.log(ratio + 1e-9)) / 2, 0, 100)


def epistemic_split(df: DataFrame, prior_var: str, post_var: str, count: str, cell: str, t: str) -> DataFrame:
    """Epistemic part shrinking with the observations so far, aleatoric part, and half the log ratio of variances."""
    seen = F.sum((F.col(count) > 0).cast("long")).over(Window.partitionBy(cell).orderBy(t).rowsBetween(Window.unboundedPreceding, 0))
    factor = d(1) / (d(1) + d(0.2) * seen)
    return df.withColumns({"epistemic": d(0.6) * F.col(post_var) * factor, "aleatoric": d(0.4) * F.col(post_var) + d(0.05), "gain": F.log(F.greatest(F.col(prior_var) / F.col(post_var), d(1))) / 2})


def linear_evidence(mean: Column, var: Column, count: Column, upstream: Column, peak: Column, most: Column) -> dict[str, Column]:
    """Belief 0.4 / 0.3 / 0.3 of stress, reports and upstream; the variance shrinks with the belief."""
    belief = d(0.4) * mean / (peak + 1e-9) + d(0.3) * count / (most + 1e-9) + d(0.3) * upstream
    return {"belief": belief, "var_after": var * (d(1) - d(0.3) * clip(belief, 0, 1))}


def cvar_normal_2326(mean: Column, var: Column) -> Column:
    return mean + d(2.326) * F.sqrt(var)


def expected_utility(mean: Column, var: Column, gamma: float = 2.0) -> Column:
    return F.greatest(mean - d(gamma / 2) * var / (mean + 1e-9), d(0))


def observation_age(df: DataFrame, count: str, cell: str, t: str) -> DataFrame:
    """``age``: steps since the cell's last report; ``age_uncertainty`` = min(0.3 ln(1 + age), 1), 1 before any report."""
    w = Window.partitionBy(cell).orderBy(t).rowsBetween(Window.unboundedPreceding, 0)
    age = F.col(t) - F.last(F.when(F.col(count) > 0, F.col(t)), ignorenulls=True).over(w)
    return df.withColumn("age", age).withColumn("age_uncertainty", F.coalesce(F.least(d(0.3) * F.log1p("age"), d(1)), d(1)))


def stability(df: DataFrame, mean: str, var: str, cell: str, t: str) -> DataFrame:
    """Limits on steepness, growth and spread: the 95 percent quantile of the spatial gradient below 10, that of the
    ratio of steps below 2 (0.5 with one step), and sqrt(vmax / vmin) below 1000. ``df`` has rows r and columns q."""

    def gradient(w):
        before, after = F.lag(mean).over(w), F.lead(mean).over(w)
        return F.when(before.isNull() & after.isNull(), d(0)).when(before.isNull(), after - F.col(mean)).when(after.isNull(), F.col(mean) - before).otherwise((after - before) / 2)

    gy, gx = gradient(Window.partitionBy(t, "q").orderBy("r")), gradient(Window.partitionBy(t, "r").orderBy("q"))
    step = cut(df.select(F.hypot(gy, gx).alias("steep"), F.abs(F.col(mean) / (F.lag(mean).over(Window.partitionBy(cell).orderBy(t)) + 1e-9)).alias("ratio"), F.col(var).alias("var")))
    out = step.agg(F.sqrt(F.max("var") / (F.min("var") + 1e-9)).alias("condition"))
    out = out.crossJoin(quantiles(step, "steep", lipschitz=0.95)).crossJoin(quantiles(step, "ratio", spectral_radius=0.95)).withColumn("spectral_radius", F.coalesce("spectral_radius", d(0.5)))
    return out.withColumn("stable", (F.col("lipschitz") < 10) & (F.col("spectral_radius") < 2) & (F.col("condition") < 1000))


def ridge_gram(df: DataFrame, features: list[str], target: str) -> DataFrame:
    """Sums of products for ridge regression, one row for any number of rows: solve them on the driver with ``solve_ridge``."""
    pairs = [(i, j) for i in range(len(features)) for j in range(i, len(features))]
    return df.agg(*[F.sum(F.col(features[i]) * F.col(features[j])).alias(f"x{i}x{j}") for i, j in pairs], *[F.sum(F.col(f) * F.col(target)).alias(f"x{i}y") for i, f in enumerate(features)], F.sum(F.col(target) * F.col(target)).alias("yy"), F.count("*").alias("n"))


def solve_ridge(gram: DataFrame, k: int, penalty: float = 1.0, floor: float = 0.01) -> list[float]:
    """Weights from the sums, each at least ``floor``; a k x k system from one row."""
    import numpy as np

    row = gram.first()
    a = np.array([[row[f"x{min(i, j)}x{max(i, j)}"] for j in range(k)] for i in range(k)], float) + penalty * np.eye(k)
    return np.maximum(np.linalg.solve(a, [row[f"x{i}y"] for i in range(k)]), floor).tolist()


def fit_metrics(df: DataFrame, observed: str, fitted: str, sigma: float, k: int) -> DataFrame:
    """Gaussian log-likelihood, AIC, BIC and R squared within 0 and 1."""
    e = F.col(observed) - F.col(fitted)
    ready = with_scalars(df, mean_y=F.avg(observed))
    s = ready.agg(F.count("*").alias("n"), F.sum(e * e).alias("ss"), F.sum(F.pow(F.col(observed) - F.col("mean_y"), 2)).alias("tot"))
    logl = -F.col("n") / 2 * F.log(d(2 * 3.141592653589793 * sigma**2)) - F.col("ss") / d(2 * sigma**2)
    return s.select("n", logl.alias("loglik"), (d(2 * k) - 2 * logl).alias("aic"), (d(k) * F.log(F.col("n").cast("double")) - 2 * logl).alias("bic"), clip(d(1) - F.col("ss") / F.greatest("tot", d(1e-12)), 0, 1).alias("r2"))


def mixture_update(components: Column, observed: Column, variance: float) -> Column:
    """One Kalman update of each component (weight, mean, var) of a mixture, weights times likelihood, renormalised."""
    moved = F.transform(components, lambda c: F.struct((c["weight"] * F.exp(-F.pow(observed - c["mean"], 2) / (2 * (c["var"] + variance))) / F.sqrt(c["var"] + variance)).alias("weight"), (c["mean"] + c["var"] / (c["var"] + variance) * (observed - c["mean"])).alias("mean"), (c["var"] * d(variance) / (c["var"] + variance)).alias("var")))
    total = F.aggregate(moved, d(0), lambda a, c: a + c["weight"])
    return F.transform(moved, lambda c: F.struct((c["weight"] / total).alias("weight"), c["mean"].alias("mean"), c["var"].alias("var")))


#: Rows of a sorted range, and places of a block of ranks.
RANGE_ROWS, BLOCK_RANKS = 1_000_000, 1 << 16


def highest_density(df: DataFrame, value: str, by: list[str], level: float) -> DataFrame:
    """Narrowest interval that holds ceil(level n) further samples of each group; the first of equals.

    Only the first of equal samples can begin it. The distinct values are sorted into ranges, their ranks are running
    sums inside the ranges and over the ranges' totals, and the value at the other end is sought in blocks of ranks, so
    no task holds a group. Nulls are the last samples, and groups without a name are left out.
    """
    named = df.where(" and ".join(f"`{c}` is not null" for c in by))
    counts = cut(named.groupBy(*by, F.col(value).alias("x")).agg(F.count("*").alias("n")))
    x = F.col("x").asc_nulls_last()
    dealt = cut(counts.repartitionByRange(counts.count() // RANGE_ROWS + 1, *by, x).withColumn("part", F.spark_partition_id()))
    ranges = Window.partitionBy(*by).orderBy("part").rowsBetween(Window.unboundedPreceding, -1)  # one row a range
    sums = dealt.groupBy(*by, "part").agg(F.sum("n").alias("rows"))
    sums = sums.select(*by, "part", F.coalesce(F.sum("rows").over(ranges), F.lit(0)).alias("base"), F.sum("rows").over(Window.partitionBy(*by)).alias("total"))
    inside = Window.partitionBy(*by, "part").orderBy(x).rowsBetween(Window.unboundedPreceding, -1)
    placed = dealt.withColumn("i", F.coalesce(F.sum("n").over(inside), F.lit(0))).join(sums, [*by, "part"])
    placed = cut(placed.select(*by, "x", "n", (F.col("i") + F.col("base")).alias("i"), "total"))
    block = lambda c: F.floor(c / BLOCK_RANKS)
    runs = placed.withColumn("block", F.explode(F.sequence(block(F.col("i")), block(F.col("i") + F.col("n") - 1))))
    runs = runs.select(*by, "block", F.greatest("i", F.col("block") * BLOCK_RANKS).alias("at"), F.struct("x").alias("run"), F.lit(None).cast("long").alias("i"), F.lit(None).cast(df.schema[value].dataType).alias("x"))
    at = F.col("i") + F.ceil(F.col("total") * d(level)).cast("long")
    asked = placed.withColumn("at", at).where("at < total").select(*by, block(F.col("at")).alias("block"), "at", F.lit(None).cast(runs.schema["run"].dataType).alias("run"), "i", "x")
    line = Window.partitionBy(*by, "block").orderBy("at", F.col("run").isNull()).rowsBetween(Window.unboundedPreceding, 0)
    pairs = runs.unionByName(asked).withColumn("hi", F.last("run", ignorenulls=True).over(line)["x"]).where("run is null").withColumn("width", F.col("hi") - F.col("x"))
    best = pairs.groupBy(*by).agg(F.min(F.struct(F.col("width").isNull().alias("last"), "width", "i", "x", "hi")).alias("b"))
    return best.select(*by, F.col("b.x").alias("hdi_low"), F.col("b.hi").alias("hdi_high"))


def inferred(df: DataFrame, rain: str, trailing: str, upstream: str, count: str) -> DataFrame:
    """``df`` with the whole inference of its rows: prior, posterior ``mean`` and ``var``, credible interval, ``gain_nats``.

    All steps are columns of the same row, so the composition is one stage without a shuffle.
    """
    out = df.withColumns(heteroscedastic_prior(F.col(rain), F.col(trailing), F.col(upstream)))
    out = out.withColumns(posterior(F.col("prior_mean"), F.col("prior_var"), F.col(count))).withColumnsRenamed({"post_mean": "mean", "post_var": "var"})
    out = out.withColumns(intervals(F.col("mean"), F.col("var")))
    return out.withColumn("gain_nats", information_gain(F.col("prior_mean"), F.col("prior_var"), F.col("mean"), F.col("var")))
