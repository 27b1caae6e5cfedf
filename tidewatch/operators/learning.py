"""Metrics, guards, targets and losses of residual models, as one-pass aggregates; the networks themselves plug in by ``score_batches``."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pandas as pd
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import clip, d
from tidewatch.operators.scalars import with_quantiles, with_scalars


def regression_metrics(df: DataFrame, predicted: str, target: str, by: list[str] | None = None) -> DataFrame:
    """RMSE, MAE, R squared, explained variance and correlation over the rows where both are numbers."""
    p, t = F.col(predicted), F.col(target)
    ok = df.where(p.isNotNull() & t.isNotNull() & ~F.isnan(p) & ~F.isnan(t))
    e = t - p
    n, sst = F.count("*"), F.var_pop(t) * F.count("*")
    return ok.groupBy(*(by or [])).agg(n.alias("n"), F.sqrt(F.avg(e * e)).alias("rmse"), F.avg(F.abs(e)).alias("mae"), (d(1) - F.sum(e * e) / F.greatest(sst, d(1e-300))).alias("r2"), (d(1) - F.var_pop(e) / F.greatest(F.var_pop(t), d(1e-300))).alias("explained"), F.corr(p, t).alias("corr"))


def coverage(df: DataFrame, predicted: str, target: str, sigma: str, z: float = 1.959964) -> DataFrame:
    inside = F.abs(F.col(target) - F.col(predicted)) <= d(z) * F.col(sigma)
    return df.agg(F.avg(inside.cast("double")).alias("coverage"), F.corr(F.abs(F.col(target) - F.col(predicted)), F.col(sigma)).alias("error_sigma_corr"))


def decision_stability(df: DataFrame, base: str, observed: str, residual: str, threshold: float) -> DataFrame:
    """Of the base model's wrong decisions the share that the residual mends; 1 where none was wrong."""
    hit = lambda x: x > threshold
    wrong = hit(F.col(base)) != hit(F.col(observed))
    mended = wrong & (hit(F.col(base) + F.col(residual)) == hit(F.col(observed)))
    n = F.count_if(wrong)
    return df.agg(n.alias("n_wrong"), F.count_if(mended).alias("n_mended"), F.when(n > 0, F.count_if(mended) / n).otherwise(d(1)).alias("stability"))


def ablation(df: DataFrame, base: str, residual: str, target: str) -> DataFrame:
    """Metrics of the base model, of both together, and of the residual alone; rows are stacked, read once."""
    runs = F.array(*[F.struct(F.lit(n).alias("run"), x.alias("p")) for n, x in (("base", F.col(base)), ("hybrid", F.col(base) + F.col(residual)), ("residual", F.col(residual)))])
    rows = df.select(F.col(target).alias("t"), F.explode(runs).alias("z")).select("t", "z.run", "z.p")
    return regression_metrics(rows, "p", "t", ["run"]).select("run", "rmse", "mae", "r2")


def zscore_check(df: DataFrame, value: str, mean_limit: float = 0.5, std_range: tuple[float, float] = (0.5, 2.0), most: float = 10.0) -> DataFrame:
    """Whether a column looks standardised."""
    m, s, top = F.avg(value), F.stddev_pop(value), F.max(F.abs(value))
    return df.agg(m.alias("mean"), s.alias("std"), top.alias("max_abs"), ((F.abs(m) <= mean_limit) & s.between(*std_range) & (top <= most)).alias("ok"))


def role_audit(df: DataFrame, physics: str, correction: str, decided: str, decided_with: str) -> DataFrame:
    """Share of decisions a correction changes (at most 0.1) and its size beside the physics (at most 0.5)."""
    changed, ratio = F.avg((F.col(decided) != F.col(decided_with)).cast("double")), F.avg(F.abs(correction)) / F.greatest(F.avg(F.abs(physics)), d(1e-12))
    return df.agg(changed.alias("changed_share"), ratio.alias("size_ratio"), ((changed <= 0.1) & (ratio <= 0.5)).alias("ok"))


def residual_targets(df: DataFrame, observed: str, base: str, low: float = 0.01, high: float = 0.99) -> DataFrame:
    """``residual``: observed less base, clipped to the table's own percentiles."""
    raw = df.withColumn("_r", F.col(observed) - F.col(base))
    return with_quantiles(raw, "_r", _lo=low, _hi=high).withColumn("residual", F.least(F.greatest("_r", "_lo"), F.col("_hi"))).drop("_r", "_lo", "_hi")


def standardized(df: DataFrame, value: str, name: str, floor: float = 1e-6) -> DataFrame:
    return with_scalars(df, _m=F.avg(value), _s=F.stddev_pop(value)).withColumn(name, (F.col(value) - F.col("_m")) / F.greatest("_s", d(floor))).drop("_m", "_s")


def structural_residual(observed_z: Column, physics_z: Column, most: float = 5.0) -> Column:
    return clip(observed_z - physics_z, -most, most)


def combined_sigma(bayes: Column, model: Column, floor: float = 1e-3) -> Column:
    return F.greatest(F.hypot(F.greatest(bayes, d(0)), F.greatest(model, d(0))), d(floor))


def integrate_residual(mean: Column, sigma: Column, residual: Column, residual_sigma: Column, refused: Column, most: float = 1.0, share: float = 0.7) -> dict[str, Column]:
    """Adds a clipped residual and blends sigmas; where the decision is refused the base stays and sigma grows by half."""
    total = F.sqrt(d(share) * sigma * sigma + d(1 - share) * residual_sigma * residual_sigma)
    return {"mean": F.when(refused, mean).otherwise(F.greatest(mean + clip(residual, -most, most), d(0))), "sigma": F.when(refused, F.greatest(total, sigma * 1.5)).otherwise(total)}


def gaussian_nll(predicted: Column, target: Column, sigma: Column) -> Column:
    v = F.greatest(sigma * sigma, d(1e-6))
    return (F.log(v) + F.pow(target - predicted, 2) / v) / 2


def composite_loss(df: DataFrame, predicted: str, target: str, sigma: str, smooth: float = 0.0, rank: float = 0.0) -> DataFrame:
    mse, nll = F.avg(F.pow(F.col(predicted) - F.col(target), 2)), F.avg(gaussian_nll(F.col(predicted), F.col(target), F.col(sigma)))
    return df.agg(mse.alias("mse"), nll.alias("nll"), (d(10) * mse + d(0.2) * nll + d(0.1 * smooth + 0.2 * rank)).alias("loss"))


#: Rows of a sorted range.
RANGE_ROWS = 1_000_000


def adjacent_rank_loss(df: DataFrame, key: str, predicted: str, target: str, by: list[str], margin: float = 0.1) -> DataFrame:
    """Hinge on neighbouring pairs in target order within each group: pairs grow with the rows, not their square.

    The rows are sorted into ranges of about equal size; a task adds up the pairs inside its range and gives the first and
    last prediction of each group there, by which the pairs over borders are added. So a large group is many tasks. Nulls
    come last.
    """
    rows = df.select(*by, F.col(target).alias("_t"), F.col(key).alias("_k"), F.col(predicted).cast("double").alias("_p"))
    order = [F.col(c).asc_nulls_last() for c in (*by, "_t", "_k", "_p")]
    dealt = rows.repartitionByRange(rows.count() // RANGE_ROWS + 1, *order).sortWithinPartitions(*order)
    names = [f"_{i}" for i in range(len(by))]

    def run(frames):
        part, held = TaskContext.get().partitionId(), None  # held: the open group's names, ends, sum and pairs
        for pdf in frames:
            if not len(pdf):
                continue
            own, p, known = pdf[names], pdf["_p"].to_numpy(float), pdf["_known"].to_numpy(bool)
            before = own.shift()
            starts = ((own != before) & ~(own.isna() & before.isna())).any(axis=1).to_numpy()
            starts[0] = True
            cuts, done = [*np.flatnonzero(starts), len(p)], []
            for a, b in zip(cuts, cuts[1:]):
                name = [None if x is None or x != x else x for x in own.iloc[a]]
                both = known[a + 1 : b] & known[a : b - 1]
                total, n = float(np.maximum(margin - (p[a + 1 : b] - p[a : b - 1])[both], 0).sum()), int(both.sum())
                if held is not None and held[0] == name:
                    if known[a] and held[4]:
                        total, n = total + max(margin - (p[a] - held[3]), 0.0), n + 1
                    held = [name, *held[1:3], p[b - 1], known[b - 1], held[5] + total, held[6] + n]
                else:
                    if held is not None:
                        done.append([*held[0], part, *held[1:]])
                    held = [name, p[a], known[a], p[b - 1], known[b - 1], total, n]
            if done:
                yield pd.DataFrame(done, columns=columns)
        if held is not None:
            yield pd.DataFrame([[*held[0], part, *held[1:]]], columns=columns)

    columns = [*names, "part", "lead", "lead_known", "tail", "tail_known", "total", "n"]
    kinds = ", ".join(f"{n} {df.schema[c].dataType.simpleString()}" for n, c in zip(names, by))
    ready = dealt.select(*[F.col(c).alias(n) for n, c in zip(names, by)], "_p", F.col("_p").isNotNull().alias("_known"))
    parts = ready.mapInPandas(run, f"{kinds}, part int, lead double, lead_known boolean, tail double, tail_known boolean, total double, n long")
    line = Window.partitionBy(*names).orderBy("part")  # one row a range
    border = F.when(F.col("lead_known") & F.lag("tail_known").over(line), F.greatest(d(margin) - (F.col("lead") - F.lag("tail").over(line)), d(0)))
    sums = parts.withColumn("border", border).groupBy(*names).agg((F.sum("total") + F.coalesce(F.sum("border"), d(0))).alias("total"), (F.sum("n") + F.count("border")).alias("n"))
    return sums.select(*[F.col(n).alias(c) for n, c in zip(names, by)], F.when(F.col("n") > 0, F.col("total") / F.col("n")).alias("rank_loss"))


def distance_uncertainty(df: DataFrame, features: list[str], scale: float = 0.1) -> DataFrame:
    """Softplus base plus a scaled diagonal Mahalanobis distance from the table's own mean."""
    ready = with_scalars(df, **{f"_m{i}": F.avg(f) for i, f in enumerate(features)}, **{f"_v{i}": F.var_pop(f) for i, f in enumerate(features)})
    total = sum((F.pow(F.col(f) - F.col(f"_m{i}"), 2) / (F.col(f"_v{i}") + 1e-6) for i, f in enumerate(features)), d(0))
    drop = [f"_{k}{i}" for i in range(len(features)) for k in "mv"]
    return ready.withColumn("uncertainty", d(scale) * F.sqrt(total / len(features))).drop(*drop)


def score_batches(df: DataFrame, model: Callable, columns: list[str], output: str) -> DataFrame:
    """Arrow batches through ``model(pandas frame) -> array``: the hook for an outside network. The model is pickled to
    the executors, so it must be of bounded size."""
    from pyspark.sql import types as T

    schema = T.StructType([*df.schema.fields, T.StructField(output, T.DoubleType())])

    def run(frames):
        for pdf in frames:
            pdf[output] = model(pdf[columns])
            yield pdf

    return df.mapInPandas(run, schema)
