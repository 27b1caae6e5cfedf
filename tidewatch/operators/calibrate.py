"""Scaling, calibration between cities, shift detection, risk measures, aggregation with uncertainty."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import box_cox, clip, d, normal_ppf, yeo_johnson
from tidewatch.operators.grid import cut
from tidewatch.operators.scalars import quantiles, ranked, with_quantiles, with_scalars

#: Calibration knots, quantile levels and the levels they map to.
KNOTS = ((0.0, 0.0), (0.25, 0.25), (0.5, 0.5), (0.75, 0.75), (0.9, 1.0), (0.95, 1.5), (0.99, 2.0), (1.0, 2.5))


def latent_scale(df: DataFrame, value: str) -> DataFrame:
    """One row: median and median deviation (at least 1e-6)."""
    med = quantiles(df, value, median=0.5)
    dev = df.crossJoin(F.broadcast(med)).select(F.abs(F.col(value) - F.col("median")).alias("_d"), "median")
    return med.crossJoin(F.broadcast(quantiles(dev, "_d", mad=0.5))).select("median", F.greatest("mad", d(1e-6)).alias("mad"))


def latent(df: DataFrame, value: str, scale: DataFrame, name: str = "z") -> DataFrame:
    return df.crossJoin(F.broadcast(scale)).withColumn(name, (F.col(value) - F.col("median")) / F.col("mad")).drop("median", "mad")


def unlatent(df: DataFrame, z: str, scale: DataFrame, name: str) -> DataFrame:
    return df.crossJoin(F.broadcast(scale)).withColumn(name, F.col(z) * F.col("mad") + F.col("median")).drop("median", "mad")


def calibrate_quantile(df: DataFrame, z: str) -> DataFrame:
    """``calibrated``: linear interpolation between the knots at the table's own quantiles, clamped at the ends."""
    names = {f"k{i}": p for i, (p, _) in enumerate(KNOTS)}
    ready = with_quantiles(df, z, **names)
    x, out = F.col(z), d(KNOTS[-1][1])
    for i in range(len(KNOTS) - 2, -1, -1):
        lo, hi = F.col(f"k{i}"), F.col(f"k{i + 1}")
        y0, y1 = KNOTS[i][1], KNOTS[i + 1][1]
        out = F.when(x <= hi, F.when(hi > lo, d(y0) + (x - lo) / (hi - lo) * d(y1 - y0)).otherwise(d(y1))).otherwise(out)
    out = F.when(x <= F.col("k0"), d(KNOTS[0][1])).otherwise(out)
    return ready.withColumn("calibrated", out).drop(*names)


def calibrate_linear(df: DataFrame, z: str) -> DataFrame:
    ready = with_scalars(df, lo=F.min(z), hi=F.max(z))
    return ready.withColumn("calibrated", clip((F.col(z) - F.col("lo")) * (d(2) / (F.col("hi") - F.col("lo") + 1e-6)), 0, 2.5)).drop("lo", "hi")


def isotonic_ranks(df: DataFrame, z: str, top: float = 2.0) -> DataFrame:
    """Isotonic fit to targets evenly spaced from 0 to ``top``: equal values share the mean of their ranks' targets."""
    share = (F.col("before") + (F.col("n") - 1) / 2) / F.greatest(F.col("n_all") - 1, F.lit(1))
    ranks = ranked(df, z).select(F.col("v").alias("_z"), (share * top).alias("calibrated"))
    return df.join(ranks, df[z] == ranks["_z"]).drop("_z")


def histogram(df: DataFrame, value: str, ends: DataFrame, bins: int = 50) -> DataFrame:
    """(bin, n) over equal bins between ``lo`` and ``hi`` of a one-row table; the last bin is closed, others drop out."""
    ready = df.crossJoin(F.broadcast(ends)).where(F.col(value).between(F.col("lo"), F.col("hi")))
    b = F.least(F.floor((F.col(value) - F.col("lo")) / (F.col("hi") - F.col("lo")) * bins), F.lit(bins - 1)).cast("int")
    return ready.groupBy(b.alias("bin")).agg(F.count("*").alias("n"))


def shift_kl(reference: DataFrame, new: DataFrame, value: str, bins: int = 50) -> DataFrame:
    """Sum of density times log ratio over the reference's bins, without bin widths, within 0 and 100."""
    ends = reference.agg(F.min(value).alias("lo"), F.max(value).alias("hi"))
    spine = reference.sparkSession.range(bins).select(F.col("id").cast("int").alias("bin"))

    def density(df: DataFrame, name: str) -> DataFrame:
        h = histogram(df, value, ends, bins)
        total = h.agg(F.sum("n").alias("_t")).crossJoin(ends).withColumn("_w", (F.col("hi") - F.col("lo")) / bins)
        full = spine.join(F.broadcast(h), "bin", "left").crossJoin(F.broadcast(total))
        return full.select("bin", (F.coalesce("n", F.lit(0)) / (F.col("_t") * F.col("_w")) + d(1e-10)).alias(name))

    both = density(new, "p").join(density(reference, "q"), "bin")
    return both.agg(clip(F.sum(F.col("p") * F.log(F.col("p") / F.col("q"))), 0, 100).alias("kl"))


def shift_wasserstein(reference: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """First Wasserstein distance: area between the two distribution functions, from counts by value.

    All rows count, none are sampled. Values are counted before they are ordered, and sorted into ranges of about equal
    size whose totals are accumulated first, so that no task holds all values.
    """
    own = lambda df, a: df.select(F.col(value).cast("double").alias("v"), F.lit(a).alias("a"), F.lit(1 - a).alias("b"))
    counts = own(reference, 1).unionByName(own(new, 0)).where("v is not null").groupBy("v").agg(F.sum("a").alias("a"), F.sum("b").alias("b"))
    dealt = cut(counts.repartitionByRange("v").withColumn("k", F.spark_partition_id()))
    sums = dealt.groupBy("k").agg(F.sum("a").alias("sa"), F.sum("b").alias("sb"), F.min("v").alias("first_v"))
    order = Window.orderBy("k")  # one row a range
    before, all_ = order.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    sums = sums.select("k", F.coalesce(F.sum("sa").over(before), F.lit(0)).alias("ba"), F.coalesce(F.sum("sb").over(before), F.lit(0)).alias("bb"), F.lead("first_v").over(order).alias("next_v"), F.sum("sa").over(all_).alias("na"), F.sum("sb").over(all_).alias("nb"))
    w = Window.partitionBy("k").orderBy("v")
    run = w.rowsBetween(Window.unboundedPreceding, 0)
    inside = dealt.join(F.broadcast(sums), "k").select(((F.sum("a").over(run) + F.col("ba")) / F.col("na") - (F.sum("b").over(run) + F.col("bb")) / F.col("nb")).alias("gap"), (F.coalesce(F.lead("v").over(w), F.col("next_v")) - F.col("v")).alias("width"))
    return inside.agg(F.sum(F.abs("gap") * F.coalesce("width", d(0))).alias("wasserstein"))


def shift_tail(reference: DataFrame, new: DataFrame, value: str) -> DataFrame:
    """Greatest relative change of the 5 and 95 percent quantiles."""
    a, b = quantiles(reference, value, a05=0.05, a95=0.95), quantiles(new, value, b05=0.05, b95=0.95)
    change = lambda x, y: F.abs(F.col(y) - F.col(x)) / (F.abs(x) + 1e-6)
    return a.crossJoin(b).select(F.greatest(change("a95", "b95"), change("a05", "b05")).alias("tail"))


def shift_score(kl: Column, wasserstein: Column, tail: Column) -> Column:
    return clip(d(0.3) * (d(1) - F.exp(-kl / 2)) + d(0.4) * F.tanh(wasserstein / 2) + d(0.3) * F.tanh(tail), 0, 1)


def inflated_sigma(z: Column, spread: Column, shift: Column) -> dict[str, Column]:
    """Total sigma from its three parts, and the inflation over the first, within 1 and 5."""
    b, dl, s = d(0.1) + d(0.1) * F.abs(z), d(0.1) + d(0.2) * spread, d(0.5) + d(0.1) * F.abs(z)
    total = F.greatest(F.sqrt(b * b + dl * dl + shift * s * s), d(0.05))
    return {"sigma": total, "inflation": clip(total / b, 1, 5), "no_decision": total > 0.5}


def robust_scale(df: DataFrame, value: str) -> DataFrame:
    ready = with_quantiles(df, value, q1=0.25, q2=0.5, q3=0.75)
    iqr = F.col("q3") - F.col("q1")
    return ready.withColumn("scaled", (F.col(value) - F.col("q2")) / F.when(iqr < 1e-10, d(1)).otherwise(iqr)).drop("q1", "q2", "q3")


def rank_scale(df: DataFrame, value: str, low: float = 0.0, high: float = 1.0) -> DataFrame:
    """Rank among the distinct values, scaled to the target range; all equal values go to ``low``."""
    share = F.when(F.col("n_values") > 1, F.col("dense") / (F.col("n_values") - 1)).otherwise(d(0))
    table = ranked(df, value).select(F.col("v").alias("_v"), (d(low) + share * d(high - low)).alias("scaled"))
    return df.join(table, df[value] == table["_v"]).drop("_v")


def normal_scores(df: DataFrame, value: str, by: list[str]) -> DataFrame:
    """Normal quantile of each value's mid-rank in its group."""
    w = Window.partitionBy(*by).orderBy(value)
    n = F.count("*").over(Window.partitionBy(*by))
    low, ties = F.rank().over(w), F.count("*").over(Window.partitionBy(*by, value))
    return df.withColumn("_p", (low + (ties - 1) / 2 - 0.5) / n).withColumn("score", normal_ppf(F.col("_p"))).drop("_p")


def power_likelihood(df: DataFrame, value: str, lams: list[float], kind: str = "yeo_johnson") -> DataFrame:
    """Profile log-likelihood of each power on a grid, in one pass: the best is the maximum-likelihood lambda."""
    move = yeo_johnson if kind == "yeo_johnson" else box_cox
    x = F.col(value)
    jac = F.sum(F.signum(x) * F.log1p(F.abs(x))) if kind == "yeo_johnson" else F.sum(F.log(x))
    one = df.agg(F.count(value).alias("n"), jac.alias("j"), *[F.var_pop(move(x, lam)).alias(f"v{i}") for i, lam in enumerate(lams)])
    made = F.array(*[F.struct(d(lam).alias("lambda"), (-F.col("n") / 2 * F.log(F.greatest(F.col(f"v{i}"), d(1e-300))) + d(lam - 1) * F.col("j")).alias("loglik")) for i, lam in enumerate(lams)])
    return one.select(F.explode(made).alias("z")).select("z.lambda", "z.loglik")


def cvar(df: DataFrame, loss: str, alpha: float) -> DataFrame:
    ready = with_quantiles(df, loss, var=alpha)
    return ready.where(F.col(loss) >= F.col("var")).agg(F.first("var").alias("value_at_risk"), F.avg(loss).alias("cvar"))


def risk_spectrum(df: DataFrame, loss: str, levels: list[float]) -> DataFrame:
    """CVaR at each level: one row of thresholds, then conditional means in one pass."""
    names = {f"p{i}": a for i, a in enumerate(levels)}
    ready = with_quantiles(df, loss, **names)
    one = ready.agg(*[F.avg(F.when(F.col(loss) >= F.col(n), F.col(loss))).alias(n) for n in names])
    return one.select(F.explode(F.array(*[F.struct(d(a).alias("alpha"), F.col(n).alias("cvar")) for n, a in names.items()])).alias("z")).select("z.alpha", "z.cvar")


def aggregate_uncertain(df: DataFrame, value: str, sigma: str, by: list[str]) -> DataFrame:
    """Sums, means and inverse-variance means with their standard deviations; groups of one have no sampling part."""
    v, s = F.col(value), F.col(sigma)
    w = d(1) / (s * s + 1e-12)
    n = F.count("*")
    sampling = F.coalesce(F.stddev_samp(v), d(0)) / F.sqrt(n)
    own = F.sqrt(F.sum(s * s)) / n
    return df.groupBy(*by).agg(
        n.alias("n"), F.sum(v).alias("sum_value"), F.sqrt(F.sum(s * s)).alias("sum_sigma"), F.avg(v).alias("mean_value"), F.sqrt(own * own + sampling * sampling).alias("mean_sigma"),
        (F.sum(w * v) / F.sum(w)).alias("ivw_mean"), (d(1) / F.sqrt(F.sum(w))).alias("ivw_sigma"), F.max(v).alias("max_value"), F.min(v).alias("min_value"), F.median(v).alias("median_value"),
    )


def disaggregate(parents: DataFrame, children: DataFrame, parent: str, value: str, weight: str | None) -> DataFrame:
    """Each parent's value dealt to its children in proportion to their weights, or evenly."""
    part = Window.partitionBy(parent)
    share = F.col(weight) / F.sum(weight).over(part) if weight else d(1) / F.count("*").over(part)
    return children.withColumn("_share", share).join(parents.select(parent, value), parent).withColumn("dealt", F.col(value) * F.col("_share")).drop("_share", value)


#: Shares on both sides of the middle, from narrow to wide.
AROUND = [0.5 * 2 ** (-j / 2) for j in range(16, 0, -1)]
#: Half the width of the window, in roots of a group's rows.
NEAR = 5.0
#: Draws of a task; a table of few bytes has many.
DRAWS = 4_000_000


def extremes_uncertain(df: DataFrame, key: str, value: str, sigma: str, by: list[str], draws: int = 1000) -> DataFrame:
    """Greatest, least and middle value of each group with the deviations of these under noise of each row's sigma.

    Every row is drawn ``draws`` times with a normal deviate that follows from its key and the draw, so reruns agree.
    All draws of a group have one distribution, so the first tells between which values the middle of the others is: five
    times the root of the rows on both sides. One pass takes extremes and counts what lies below; only values between
    are kept apart and ranked. Draws whose middle is elsewhere are computed plainly.
    """
    h = F.md5(F.concat_ws(":", F.col(key).cast("string"), F.col("draw").cast("string")).cast("binary"))
    u = lambda at: (F.conv(F.substring(h, at, 8), 16, 10).cast("double") + 0.5) / float(1 << 32)
    noise = F.sqrt(d(-2) * F.log(u(1))) * F.cos(d(2 * math.pi) * u(9))
    x = (F.col(value) + F.col(sigma) * noise).alias("x")
    own = df.groupBy(*by).agg(F.count("*").alias("n"), F.max(value).alias("max_value"), F.min(value).alias("min_value"), F.median(value).alias("median_value"))

    first = df.withColumn("draw", F.lit(1)).select(*by, x).groupBy(*by).agg(F.count("x").alias("rows"), F.percentile_approx("x", [0.5 - a for a in AROUND] + [0.5 + a for a in AROUND], 10000).alias("q"))
    low, high = F.when(F.col("rows") < 0, d(0)), F.when(F.col("rows") < 0, d(0))
    for j, a in enumerate(AROUND):
        enough = d(NEAR) <= d(a) * F.sqrt("rows")
        low, high = low.when(enough, F.get("q", F.lit(j))), high.when(enough, F.get("q", F.lit(len(AROUND) + j)))
    ends = first.select(*by, F.coalesce(low, d(-math.inf)).alias("low"), F.coalesce(high, d(math.inf)).alias("high"))

    dealt = df.join(ends, by).select(*by, key, value, sigma, "low", "high").repartition(df.count() * draws // DRAWS + 1, key)
    drawn = dealt.select(*by, key, value, sigma, "low", "high", F.explode(F.sequence(F.lit(1), F.lit(draws))).alias("draw")).select(*by, "draw", "low", "high", x)
    middle = F.when(F.col("x").between(F.col("low"), F.col("high")), F.col("x")).alias("m")
    seen = drawn.groupBy(*by, "draw", middle).agg(F.max("x").alias("hi"), F.min("x").alias("lo"), F.count_if(F.col("x") < F.col("low")).alias("below"), F.count("x").alias("rows"))
    each = Window.partitionBy(*by, "draw")
    place = F.sum(F.when(F.col("m").isNull(), F.col("below")).otherwise(F.col("rows"))).over(each.orderBy(F.col("m").asc_nulls_first()).rowsBetween(Window.unboundedPreceding, 0))
    ranks = seen.withColumns({"place": place, "all": F.sum("rows").over(each)})
    at = lambda rank: F.min(F.when(F.col("m").isNotNull() & (F.col("place") >= F.floor(rank)), F.col("m")))
    below = F.coalesce(F.max(F.when(F.col("m").isNull(), F.col("below"))), F.lit(0))
    found = ranks.groupBy(*by, "draw").agg(F.max("hi").alias("hi"), F.min("lo").alias("lo"), at((F.col("all") + 1) / 2).alias("a"), at(F.col("all") / 2 + 1).alias("b"), below.alias("below"), F.max("all").alias("all"))
    mid = F.when(F.col("below") < F.floor((F.col("all") + 1) / 2), (F.col("a") + F.col("b")) / 2)
    found = cut(found.select(*by, "draw", "hi", "lo", mid.alias("mid"), "all"))
    lost = found.where("mid is null and all > 0").select(*by, "draw")
    if not lost.isEmpty():
        plain = drawn.join(lost, [*by, "draw"]).groupBy(*by, "draw").agg(F.median("x").alias("plain"))
        found = found.join(plain, [*by, "draw"], "left").withColumn("mid", F.coalesce("mid", "plain"))
    spread = found.groupBy(*by).agg(F.stddev_pop("hi").alias("max_sigma"), F.stddev_pop("lo").alias("min_sigma"), F.stddev_pop("mid").alias("median_sigma"))
    return own.join(spread, by)


def fit_mixture(df: DataFrame, value: str, k: int = 2, rounds: int = 100, tolerance: float = 1e-6, floor: float = 1e-6) -> dict:
    """Mixture of ``k`` normal distributions by expectation and maximisation: weights, means, variances, loglik, bic.

    Each round is one aggregate over all rows; 3 k sums come back. It starts from even quantiles, and ends when the
    log-likelihood changes by less than ``tolerance`` of itself or after ``rounds``, which ``converged`` tells.
    """
    x = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    start = x.agg(F.count("*").alias("n"), F.var_pop("x").alias("v")).first()
    n = start["n"]
    if not n:
        return {"n": 0, "weights": [], "means": [], "variances": [], "loglik": None, "bic": None, "converged": True}
    q = quantiles(x, "x", **{f"q{i}": (i + 0.5) / k for i in range(k)}).first()
    w, m, v, last = [1 / k] * k, [q[f"q{i}"] for i in range(k)], [(start["v"] or 0.0) + floor] * k, None
    for _ in range(rounds):
        p = [d(math.log(max(w[i], 1e-300)) - 0.5 * math.log(2 * math.pi * v[i])) - F.pow(F.col("x") - d(m[i]), 2) / d(2 * v[i]) for i in range(k)]
        logs = x.select("x", F.array(*p).alias("p")).select("x", "p", F.array_max("p").alias("top"))
        logs = logs.withColumn("norm", F.col("top") + F.log(sum((F.exp(F.get("p", F.lit(i)) - F.col("top")) for i in range(k)), d(0))))
        r = [F.exp(F.get("p", F.lit(i)) - F.col("norm")) for i in range(k)]
        s = logs.agg(F.sum("norm").alias("l"), *[F.sum(r[i]).alias(f"n{i}") for i in range(k)], *[F.sum(r[i] * F.col("x")).alias(f"x{i}") for i in range(k)], *[F.sum(r[i] * F.pow(F.col("x") - d(m[i]), 2)).alias(f"s{i}") for i in range(k)]).first()
        share = [max(s[f"n{i}"], 1e-12) for i in range(k)]
        fresh = [s[f"x{i}"] / share[i] for i in range(k)]
        v = [max(s[f"s{i}"] / share[i] - (fresh[i] - m[i]) ** 2, 0.0) + floor for i in range(k)]
        w, m = [c / n for c in share], fresh
        if last is not None and abs(s["l"] - last) < tolerance * abs(last):
            return {"n": n, "weights": w, "means": m, "variances": v, "loglik": s["l"], "bic": (3 * k - 1) * math.log(n) - 2 * s["l"], "converged": True}
        last = s["l"]
    return {"n": n, "weights": w, "means": m, "variances": v, "loglik": s["l"], "bic": (3 * k - 1) * math.log(n) - 2 * s["l"], "converged": False}


def power_search(df: DataFrame, value: str, kind: str = "yeo_johnson", low: float = -2.0, high: float = 2.0, width: float = 1e-5, grid: int = 21) -> tuple[float, float]:
    """(lambda, log-likelihood) of the power transform of greatest likelihood between ``low`` and ``high``.

    Each pass tries ``grid`` powers at once and keeps the neighbours of the best, until they are ``width`` apart: the
    likelihood has one top. Box-Cox needs positive values. Without two different values lambda is 1.
    """
    rows = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    ends = rows.agg(F.min("x").alias("a"), F.max("x").alias("b")).first()
    if ends.a is None or ends.a == ends.b:
        return 1.0, math.nan
    if kind == "box_cox" and ends.a <= 0:
        raise ValueError("Box-Cox needs positive values")
    while True:
        step = (high - low) / (grid - 1)
        tried = power_likelihood(rows, "x", [low + i * step for i in range(grid)], kind).collect()
        best = max(tried, key=lambda r: (r.loglik, -abs(r["lambda"])))
        if 2 * step <= width:
            return best["lambda"], best.loglik
        low, high = max(low, best["lambda"] - step), min(high, best["lambda"] + step)


def transform_choice(df: DataFrame, value: str, quantile: bool = True) -> DataFrame:
    """(name, lambda, normality): how straight each transform of a column lies against normal scores, best first.

    Candidates: none, log and box-cox (positive values), sqrt (no negative ones), yeo-johnson, and quantile, whose scores
    are its values. All rise with the value, so they share their ranks: each distinct value's mid-rank gives its normal
    score once, and one pass gives each candidate's squared correlation with the scores (Shapiro and Francia). No
    task holds all values (see ``scalars.ranked``). An empty column gives no rows; one value gives nulls.
    """
    known = df.where(F.col(value).isNotNull()).select(F.col(value).cast("double").alias("x"))
    low = known.agg(F.min("x")).first()[0]
    spark = df.sparkSession
    kind = "name string, lambda double, normality double"
    if low is None:
        return spark.createDataFrame([], kind)
    x = F.col("v")
    made: dict[str, tuple[Column, float | None]] = {"none": (x, None)}
    if low > 0:
        lam = power_search(known, "x", "box_cox")[0]
        made |= {"log": (F.log(x), None), "box-cox": (box_cox(x, lam), lam)}
    if low >= 0:
        made["sqrt"] = (F.sqrt(x), None)
    lam = power_search(known, "x")[0]
    made["yeo-johnson"] = (yeo_johnson(x, lam), lam)
    if quantile:
        made["quantile"] = (F.col("s"), None)
    score = normal_ppf((F.col("before") + (F.col("n") + 1) / 2 - 0.375) / (F.col("n_all") + 0.25))
    names = list(made)
    rows = cut(ranked(known, "x").withColumn("s", score).select("n", "s", *[made[m][0].alias(f"f{i}") for i, m in enumerate(names)]))
    n, total = F.col("n"), F.sum("n")
    ready = rows.crossJoin(F.broadcast(rows.agg((F.sum(n * F.col("s")) / total).alias("_s"), *[(F.sum(n * F.col(f"f{i}")) / total).alias(f"_m{i}") for i in range(len(names))])))
    own = lambda i: F.col(f"f{i}") - F.col(f"_m{i}")
    t = F.col("s") - F.col("_s")
    sums = ready.agg(*[(F.try_divide(F.pow(F.sum(n * own(i) * t), 2), F.sum(n * own(i) * own(i)) * F.sum(n * t * t))).alias(f"w{i}") for i in range(len(names))]).first()
    out = [(m, made[m][1], sums[f"w{i}"]) for i, m in enumerate(names)]
    return spark.createDataFrame(sorted(out, key=lambda r: (-(r[2] or 0.0), names.index(r[0]))), kind)
