"""Operators along time: windows, recursions as folds, lags, correlations. Every window has a key."""

from __future__ import annotations

import math
from collections.abc import Callable

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d


def _w(cell: str, t: str):
    return Window.partitionBy(cell).orderBy(t)


def trailing_sum(df: DataFrame, value: str, cell: str, t: str, steps: int, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_w(cell, t).rowsBetween(1 - steps, 0)))


def running_sum(df: DataFrame, value: str, cell: str, t: str, name: str) -> DataFrame:
    return df.withColumn(name, F.sum(value).over(_w(cell, t).rowsBetween(Window.unboundedPreceding, 0)))


#: Steps of a series that are scanned together, and states that a fold copies at once.
BLOCK = 128


def fold(df: DataFrame, cell: str, t: str, fields: list[str], start, step, keep: list[str]) -> DataFrame:
    """A recursion along each cell's series that has no shorter form: (cell, t, keep...).

    ``start(first)`` and ``step(state, x)`` give structs with ``keep`` fields. A cell's series is one array, bounded by
    the number of time steps; the fold is a built-in higher-order function, so nothing leaves the JVM. States are
    gathered in blocks of ``BLOCK``, so a step copies a block and not the series. Recursions whose steps compose
    are scanned instead (``scan``).
    """
    series = df.groupBy(cell).agg(F.array_sort(F.collect_list(F.struct(t, *fields))).alias("s"))
    first = start(F.element_at("s", 1))

    def grow(acc: Column, x: Column) -> Column:
        fresh = step(F.element_at(acc["own"], -1), x)
        room = F.size(acc["own"]) < BLOCK
        return F.struct(
            F.when(room, acc["done"]).otherwise(F.concat(acc["done"], F.array(acc["own"]))).alias("done"),
            F.when(room, F.concat(acc["own"], F.array(fresh))).otherwise(F.array(fresh)).alias("own"),
        )

    zero = F.struct(F.slice(F.array(F.array(first)), 1, 0).alias("done"), F.array(first).alias("own"))
    states = F.aggregate(F.slice("s", 2, F.greatest(F.size("s") - 1, F.lit(0))), zero, grow, lambda acc: F.flatten(F.concat(acc["done"], F.array(acc["own"]))))
    out = series.select(cell, F.explode(F.arrays_zip(F.col("s").alias("x"), states.alias("m"))).alias("z"))
    return out.select(cell, F.col(f"z.x.{t}").alias(t), *[F.col(f"z.m.{k}").alias(k) for k in keep])


Maps = dict[str, Column]


def scan(df: DataFrame, cell: str, t: str, maps: Maps, compose: Callable[[Maps, Maps], Maps], apply: Callable[[Maps, Maps], Maps], before: Maps, keep: tuple[str, ...] = ()) -> DataFrame:
    """(cell, t, keep..., states) of a recursion whose steps compose, linear in the steps.

    ``maps`` are the numbers of each row's step; ``compose(later, earlier)`` gives those of both after each other, and
    ``apply(map, state)`` a state after a step. ``before`` is the state before a cell's first step, from its first row.
    ``t`` is a whole number.

    A cell's steps are cut into blocks of ``BLOCK`` consecutive times, one array each, so a long series is spread over
    tasks. The steps of a block are composed into one, those are folded along the cell, one row a block, and then each block
    runs from the state before it.
    """
    names, states = list(maps), list(before)
    own = F.struct(F.col(t), *[F.col(k) for k in keep], *[c.cast("double").alias(f"_{m}") for m, c in maps.items()], *[c.cast("double").alias(f"_s{k}") for k, c in before.items()])
    blocks = df.select(cell, F.floor(F.col(t) / BLOCK).alias("_b"), own.alias("_x")).groupBy(cell, "_b").agg(F.array_sort(F.collect_list("_x")).alias("_x"))
    numbers = lambda x: {m: x[f"_{m}"] for m in names}
    packed = lambda x: F.struct(*[x[m].alias(f"_{m}") for m in names])
    state = lambda x: F.struct(*[x[k].alias(k) for k in states])
    row, rest = F.element_at("_x", 1), F.slice("_x", 2, F.greatest(F.size("_x") - 1, F.lit(0)))
    total = F.aggregate(rest, packed(numbers(row)), lambda acc, x: packed(compose(numbers(x), numbers(acc))))
    totals = blocks.select(cell, "_b", total.alias("_map"), F.struct(*[row[f"_s{k}"].alias(k) for k in states]).alias("_s"))
    carried = fold(
        totals, cell, "_b", ["_map", "_s"],
        lambda x: F.struct(x["_s"].alias("s"), x["_map"].alias("map")),
        lambda acc, x: F.struct(state(apply(numbers(acc["map"]), {k: acc["s"][k] for k in states})).alias("s"), x["_map"].alias("map")),
        ["s"],
    )
    run = F.aggregate("_x", F.array("s"), lambda acc, x: F.concat(acc, F.array(state(apply(numbers(x), {k: F.element_at(acc, -1)[k] for k in states})))))
    done = blocks.join(carried, [cell, "_b"]).select(cell, F.explode(F.arrays_zip(F.col("_x").alias("x"), F.slice(run, 2, F.size("_x")).alias("s"))).alias("z"))
    return done.select(cell, *[F.col(f"z.x.{k}").alias(k) for k in (t, *keep)], *[F.col(f"z.s.{k}").alias(k) for k in states])


def affine(df: DataFrame, cell: str, t: str, steps: dict[str, tuple[Column, Column]], before: Maps, keep: tuple[str, ...] = ()) -> DataFrame:
    """A scan of states that go to a * state + b, for each state's (a, b)."""
    maps = {f"{k}{x}": c for k, (a, b) in steps.items() for x, c in (("a", a), ("b", b))}
    compose = lambda late, early: {m: late[f"{k}a"] * (early[m] if m.endswith("a") else early[f"{k}b"]) + (d(0) if m.endswith("a") else late[f"{k}b"]) for k in steps for m in (f"{k}a", f"{k}b")}
    return scan(df, cell, t, maps, compose, lambda x, s: {k: x[f"{k}a"] * s[k] + x[f"{k}b"] for k in steps}, before, keep)


def undone(a: Column, b: Column, start: Column) -> Column:
    """The state from which a first step a * state + b leads to ``start``; with a = 0 the step gives it anyway."""
    return F.when(a == 0, d(0)).otherwise((start - b) / F.when(a != 0, a))


def ewma(df: DataFrame, value: str, cell: str, t: str, decay: float) -> DataFrame:
    """m_t = decay m_{t-1} + (1 - decay) x_t, from m_0 = x_0."""
    return affine(df, cell, t, {"m": (d(decay), d(1 - decay) * F.col(value))}, {"m": F.col(value)})


def ewma_variance(df: DataFrame, variance: str, cell: str, t: str, decay: float, floor: float = 1e-4) -> DataFrame:
    """v_t = decay^2 v_{t-1} + (1 - decay)^2 x_t, from v_0 = x_0; floored after the recursion."""
    if decay == 0:  # then a first step would give (1 - decay)^2 x_0
        return df.select(cell, t, F.greatest(F.col(variance).cast("double"), d(floor)).alias("v"))
    a, b = d(decay**2), d((1 - decay) ** 2) * F.col(variance)
    return affine(df, cell, t, {"v": (a, b)}, {"v": undone(a, b, F.col(variance))}).withColumn("v", F.greatest("v", d(floor)))


def hysteresis(df: DataFrame, value: str, cell: str, t: str, rise: float = 0.8, decay: float = 0.4) -> DataFrame:
    """y_t = y_{t-1} + rate (x_t - y_{t-1}), faster up than down; ``rising`` tells which."""
    start = lambda x: F.struct(x[value].cast("double").alias("y"), F.lit(False).alias("rising"))

    def step(s, x):
        up = x[value] > s["y"]
        return F.struct((s["y"] + F.when(up, d(rise)).otherwise(d(decay)) * (x[value] - s["y"])).alias("y"), up.alias("rising"))

    return fold(df, cell, t, [value], start, step, ["y", "rising"])


def kalman(df: DataFrame, prior_mean: str, prior_var: str, observed: str, cell: str, t: str, q: float = 0.1, r: float = 0.2, keep: tuple[str, ...] = ()) -> DataFrame:
    """Scalar filter: every step predicts, positive observations update; the first step starts from its prior. Columns in
    ``keep`` stay beside the states.

    The variance goes to r (v + q) / (v + q + r) where there is an observation, else to v + q: fractions of linear
    terms compose as 2 x 2 matrices (scaled, since only ratios count). Given the variance, the mean's steps are affine.
    """
    seen = F.coalesce(F.col(observed) > 0, F.lit(False))
    maps = {"e": F.when(seen, d(r)).otherwise(d(1)), "f": F.when(seen, d(r * q)).otherwise(d(q)), "g": F.when(seen, d(1)).otherwise(d(0)), "h": F.when(seen, d(q + r)).otherwise(d(1))}

    def compose(late: Maps, early: Maps) -> Maps:
        out = {"e": late["e"] * early["e"] + late["f"] * early["g"], "f": late["e"] * early["f"] + late["f"] * early["h"], "g": late["g"] * early["e"] + late["h"] * early["g"], "h": late["g"] * early["f"] + late["h"] * early["h"]}
        size = F.greatest(*out.values())  # all are positive or zero
        return {m: c / size for m, c in out.items()}

    variance = scan(df, cell, t, maps, compose, lambda x, s: {"var": (x["e"] * s["var"] + x["f"]) / (x["g"] * s["var"] + x["h"])}, {"var": F.col(prior_var)}, (prior_mean, observed, *keep))
    gain = F.col("var") / d(r)  # of an updated variance
    a, b = F.when(seen, d(1) - gain).otherwise(d(1)), F.when(seen, gain * F.col(observed)).otherwise(d(0))
    return affine(variance, cell, t, {"mean": (a, b)}, {"mean": F.col(prior_mean)}, ("var", *keep)).select(cell, t, *keep, "mean", "var")


def ornstein_uhlenbeck(df: DataFrame, mean: str, var: str, rain: str, cell: str, t: str, theta: float = 0.3, sigma: float = 0.1, blend: float = 0.3) -> DataFrame:
    """Mean reversion to half the rain, blended with the step's prior; variance by its exact recursion."""
    keep = math.exp(-2 * theta)
    noise = sigma**2 / (2 * theta) * (1 - keep)
    m = d(1 - theta), d(0.5 * theta) * F.col(rain) + d(blend) * F.col(mean)
    v = d(keep), d(noise) + d(blend) * F.col(var)
    return affine(df, cell, t, {"mean": m, "var": v}, {"mean": undone(*m, F.col(mean)), "var": undone(*v, F.col(var))})


def persistence(df: DataFrame, value: str, share: str, cell: str, t: str) -> DataFrame:
    """r_t = (1 - p) x_t + p r_{t-1} with p of the cell, from r_0 = x_0."""
    return affine(df, cell, t, {"r": (F.col(share), (d(1) - F.col(share)) * F.col(value))}, {"r": F.col(value)})


def delay_kernel(step_minutes: float, mean_hours: float = 2.0, sd_hours: float = 1.5, cap_hours: float = 48.0) -> list[float]:
    """Log-normal reporting delays at each step up to ``cap_hours``, normalised."""
    mu, sigma = math.log(mean_hours**2 / math.sqrt(sd_hours**2 + mean_hours**2)), math.sqrt(math.log(1 + sd_hours**2 / mean_hours**2))
    out = []
    for k in range(int(cap_hours * 60 / step_minutes) + 1):
        h = k * step_minutes / 60
        out.append(math.exp(-((math.log(h + 1e-9) - mu) ** 2) / (2 * sigma**2)) / (h * sigma * math.sqrt(2 * math.pi) + 1e-9) if h <= cap_hours else 0.0)
    return [x / (sum(out) + 1e-9) for x in out]


def convolve(df: DataFrame, value: str, cell: str, t: str, kernel: list[float], name: str) -> DataFrame:
    """Causal convolution of each cell's series with a short kernel: one window and a dot product of its frame."""
    frame = F.collect_list(F.col(value).cast("double")).over(_w(cell, t).rowsBetween(1 - len(kernel), 0))
    weights = F.array(*[d(k) for k in kernel])
    dot = F.aggregate(F.zip_with(F.reverse(frame), F.slice(weights, 1, F.size(frame)), lambda x, k: x * k), d(0), lambda a, x: a + x)
    return df.withColumn(name, dot)


def lag_by(df: DataFrame, value: str, lag: str, cell: str, t: str, name: str) -> DataFrame:
    """The value ``lag`` rows before, where ``lag`` is the row's own; the cell's first value before the series begins.

    Rows are numbered in their cell and joined to the row that they ask for.
    """
    numbered = df.withColumn("_i", F.row_number().over(_w(cell, t)))
    given = numbered.select(F.col(cell).alias("_cell"), F.col("_i").alias("_j"), F.col(value).alias(name))
    asked = numbered.withColumn("_ask", F.greatest(F.col("_i") - F.col(lag), F.lit(1)))
    return asked.join(given, (F.col(cell) == F.col("_cell")) & (F.col("_ask") == F.col("_j"))).drop("_i", "_ask", "_cell", "_j")


def peak_times(df: DataFrame, value: str, cell: str, t: str) -> DataFrame:
    """Step and height of each cell's peak, the first of equals."""
    return df.groupBy(cell).agg(F.max(F.struct(F.col(value).alias("v"), (-F.col(t)).alias("m"))).alias("b")).select(cell, (-F.col("b.m")).alias("peak_t"), F.col("b.v").alias("peak_value"))


def peak_slice(df: DataFrame, value: str, t: str) -> DataFrame:
    """The step with the greatest mean over all cells, the first of equals."""
    means = df.groupBy(t).agg(F.avg(value).alias("m"))
    return means.agg(F.max(F.struct(F.round("m", 9).alias("m"), (-F.col(t)).alias("n"))).alias("b")).select((-F.col("b.n")).alias("peak_t"), F.col("b.m").alias("peak_mean"))


def differences(df: DataFrame, value: str, cell: str, t: str, name: str = "diff") -> DataFrame:
    return df.withColumn(name, F.col(value) - F.lag(value).over(_w(cell, t)))


def asymmetry(df: DataFrame, value: str, cell: str, t: str) -> DataFrame:
    """Mean rise beside mean fall of each cell."""
    return differences(df, value, cell, t).groupBy(cell).agg(F.coalesce(F.avg(F.when(F.col("diff") > 0, F.col("diff"))), d(0)).alias("mean_rise"), F.coalesce(F.avg(F.when(F.col("diff") < 0, -F.col("diff"))), d(0)).alias("mean_fall"))


def lag_correlations(df: DataFrame, cause: str, effect: str, cell: str, t: str, most: int) -> DataFrame:
    """Correlation of the effect with the cause 0 .. most steps before, over all cells; one pass of windows."""
    w = _w(cell, t)
    wide = df.select(F.col(effect).alias("y"), *[F.lag(cause, k).over(w).alias(f"x{k}") for k in range(most + 1)])
    one = wide.agg(*[F.corr("y", f"x{k}").alias(f"c{k}") for k in range(most + 1)])
    return one.select(F.explode(F.array(*[F.struct(F.lit(k).alias("lag"), F.col(f"c{k}").alias("corr")) for k in range(most + 1)])).alias("z")).select("z.lag", "z.corr")


def lag1_decay(df: DataFrame, value: str, cell: str, t: str, least_points: int = 5, least_cells: int = 10) -> DataFrame:
    """Memory decay 1 - mean lag-1 correlation over the cells, within 0.05 and 0.95; 0.3 with too few cells."""
    lagged = df.withColumn("_x", F.lag(value).over(_w(cell, t)))
    each = lagged.groupBy(cell).agg(F.corr(value, "_x").alias("rho"), F.count("*").alias("n")).where((F.col("n") >= least_points) & F.col("rho").isNotNull() & ~F.isnan("rho"))
    return each.agg(F.count("*").alias("n_cells"), F.avg("rho").alias("mean_rho")).withColumn("decay", F.when(F.col("n_cells") < least_cells, d(0.3)).otherwise(F.least(F.greatest(d(1) - F.col("mean_rho"), d(0.05)), d(0.95))))


def sliding_windows(df: DataFrame, value: str, cell: str, t: str, width: int = 7, horizon: int = 1, valid: float = 0.5) -> DataFrame:
    """Windows of ``width`` steps with the value ``horizon`` steps after: kept with enough non-null values and a target."""
    w = _w(cell, t)
    frame = w.rowsBetween(1 - width, 0)
    out = df.select(cell, (F.col(t) - width + 1).alias("start_t"), F.count("*").over(frame).alias("n"), F.count(value).over(frame).alias("n_valid"), F.avg(value).over(frame).alias("window_mean"), F.lead(value, horizon).over(w).alias("target"), F.lead(t, horizon).over(w).alias("target_t"))
    return out.where((F.col("n") == width) & F.col("target_t").isNotNull() & (F.col("n_valid") >= valid * width)).drop("n", "target_t")


def chronological_split(df: DataFrame, t: str, share: float) -> DataFrame:
    """``part`` = train before int(T (1 - share)), else validation; T is one row."""
    ends = df.agg((F.max(t) - F.min(t) + 1).alias("_n"), F.min(t).alias("_t0"))
    return df.crossJoin(F.broadcast(ends)).withColumn("part", F.when(F.col(t) - F.col("_t0") < F.floor(F.col("_n") * (1 - share)), "train").otherwise("validation")).drop("_n", "_t0")


def rolling_deviation(df: DataFrame, value: str, cell: str, t: str, steps: int, name: str = "deviation") -> DataFrame:
    """``name``: sample deviation of the last ``steps`` values, null before there are as many."""
    w = _w(cell, t).rowsBetween(1 - steps, 0)
    return df.withColumn(name, F.when(F.count(value).over(w) == steps, F.stddev_samp(value).over(w)))


def smooth(df: DataFrame, mean: str, var: str, cell: str, t: str, q: float = 0.1) -> DataFrame:
    """Backward pass of the scalar filter (Rauch, Tung and Striebel): the filtered states with what came after.

    Given the filter's variances its steps are affine, so it is a scan over the series in reverse. The last step keeps
    the filter's state.
    """
    gain = F.col(var) / (F.col(var) + d(q))
    m = gain, F.col(mean) - gain * F.col(mean)
    v = gain * gain, F.col(var) - gain * gain * (F.col(var) + d(q))
    back = df.withColumn("_s", -F.col(t))
    out = affine(back, cell, "_s", {"mean": m, "var": v}, {"mean": undone(*m, F.col(mean)), "var": undone(*v, F.col(var))})
    return out.select(cell, (-F.col("_s")).alias(t), "mean", "var")


def innovation_loglik(filtered: DataFrame, prior_mean: str, prior_var: str, observed: str, cell: str, t: str, q: float = 0.1, r: float = 0.2) -> DataFrame:
    """(cell, loglik): log-likelihood of each cell's positive observations under the filter's one-step forecasts.

    ``filtered`` holds the filter's ``mean`` and ``var`` beside the priors and observations.
    """
    w = _w(cell, t)
    m, p = F.coalesce(F.lag("mean").over(w), F.col(prior_mean)), F.coalesce(F.lag("var").over(w), F.col(prior_var)) + d(q)
    each = filtered.select(cell, (F.col(observed) - m).alias("e"), (p + d(r)).alias("s"), (F.col(observed) > 0).alias("seen"))
    part = (F.log(d(2 * math.pi)) + F.log("s") + F.col("e") * F.col("e") / F.col("s")) * -0.5
    return each.groupBy(cell).agg(F.sum(F.when(F.col("seen"), part).otherwise(d(0))).alias("loglik"))
