"""Recursions over long series in blocks, filters of rasters, and the search of a power, against plain loops."""

import math

import numpy as np
import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import calibrate, grid, series

T, CELLS = 150, (3, 8)


@pytest.fixture(scope="module")
def data():
    rng = np.random.default_rng(4)
    return {c: pd.DataFrame({"cell": c, "t": np.arange(T if c == 3 else 5), "x": rng.normal(0, 2, T if c == 3 else 5), "p": rng.uniform(0, 1, T if c == 3 else 5), "c": rng.integers(-1, 3, T if c == 3 else 5).astype(float)}) for c in CELLS}


@pytest.fixture(scope="module")
def df(spark, data):
    return spark.createDataFrame(pd.concat(data.values())).repartition(5).cache()


def by_time(out, *names):
    rows = {}
    for r in out.collect():
        rows.setdefault(r.cell, {})[r.t] = tuple(r[n] for n in names)
    return {c: [rows[c][t] for t in sorted(rows[c])] for c in rows}


def same(got, want):
    assert set(got) == set(want)
    for c in want:
        assert len(got[c]) == len(want[c]) and np.allclose(np.array(got[c], float), np.array(want[c], float), rtol=1e-10, atol=1e-12)


@pytest.mark.parametrize("block", [4, 128])
def test_recursions(df, data, monkeypatch, block):
    monkeypatch.setattr(series, "BLOCK", block)
    want = {k: {} for k in ("ewma", "variance", "hysteresis", "persistence", "ou", "kalman", "smooth")}
    for c, rows in data.items():
        x, p, o = rows.x.tolist(), rows.p.tolist(), rows.c.tolist()
        m, v, y, up, r, ou, k = [x[0]], [x[0]], [x[0]], [False], [x[0]], [(x[0], p[0])], []
        keep = math.exp(-0.6)
        mean, var = x[0], p[0]
        for t in range(len(x)):
            if t:
                m.append(0.35 * m[-1] + 0.65 * x[t])
                v.append(0.35**2 * v[-1] + 0.65**2 * x[t])
                up.append(x[t] > y[-1])
                y.append(y[-1] + (0.8 if up[-1] else 0.4) * (x[t] - y[-1]))
                r.append((1 - p[t]) * x[t] + p[t] * r[-1])
                a, b = ou[-1]
                ou.append((a + 0.3 * (0.5 * o[t] - a) + 0.3 * x[t], b * keep + 0.01 / 0.6 * (1 - keep) + 0.3 * p[t]))
            var += 0.1
            if o[t] > 0:
                gain = var / (var + 0.2)
                mean, var = mean + gain * (o[t] - mean), (1 - gain) * var
            k.append((mean, var))
        s = [k[-1]]
        for a, b in k[-2::-1]:
            g = b / (b + 0.1)
            s.insert(0, (a + g * (s[0][0] - a), b + g * g * (s[0][1] - b - 0.1)))
        for name, rows_ in zip(want, ([(a,) for a in m], [(max(a, 1e-4),) for a in v], list(zip(y, up)), [(a,) for a in r], ou, k, s)):
            want[name][c] = rows_
    same(by_time(series.ewma(df, "x", "cell", "t", 0.35), "m"), want["ewma"])
    same(by_time(series.ewma_variance(df, "x", "cell", "t", 0.35), "v"), want["variance"])
    same(by_time(series.hysteresis(df, "x", "cell", "t"), "y", "rising"), want["hysteresis"])
    same(by_time(series.persistence(df, "x", "p", "cell", "t"), "r"), want["persistence"])
    same(by_time(series.ornstein_uhlenbeck(df, "x", "p", "c", "cell", "t"), "mean", "var"), want["ou"])
    filtered = series.kalman(df, "x", "p", "c", "cell", "t")
    same(by_time(filtered, "mean", "var"), want["kalman"])
    same(by_time(series.smooth(filtered, "mean", "var", "cell", "t"), "mean", "var"), want["smooth"])


def test_no_decay(df, data):
    plain = by_time(series.ewma(df, "x", "cell", "t", 0.0), "m")
    same(plain, {c: [(x,) for x in rows.x] for c, rows in data.items()})
    same(by_time(series.ewma_variance(df, "p", "cell", "t", 0.0), "v"), {c: [(max(x, 1e-4),) for x in rows.p] for c, rows in data.items()})


def test_delay_kernel_reaches_its_end():
    kernel = series.delay_kernel(15)
    assert len(kernel) == 48 * 4 + 1 and sum(kernel) == pytest.approx(1) and kernel[100] > 0


@pytest.mark.parametrize("h,w", [(3, 4), (9, 30), (1, 1)])
def test_filters(spark, h, w):
    rng = np.random.default_rng(h)
    z = rng.normal(0, 1, (h, w))
    df = spark.createDataFrame([(r, q, h, w, float(z[r, q])) for r in range(h) for q in range(w)], "r int, q int, h int, w int, z double")

    def plain(weights):
        k = len(weights) - 1
        full = np.array(weights[:0:-1] + weights)
        a = np.pad(z, ((k, k), (0, 0)), "symmetric")
        a = np.array([[full @ a[r : r + 2 * k + 1, q] for q in range(w)] for r in range(h)])
        b = np.pad(a, ((0, 0), (k, k)), "symmetric")
        return np.array([[full @ b[r, q : q + 2 * k + 1] for q in range(w)] for r in range(h)])

    half = [math.exp(-0.5 * (k / 1.5) ** 2) for k in range(7)]
    half = [x / (2 * sum(half) - 1) for x in half]
    for out, weights in ((grid.blurs(df, ["z"], 1.5), half), (grid.box_mean(df, ["z"], 5), [0.2] * 3)):
        got = {(r.r, r.q): r.z for r in out.collect()}
        assert len(got) == h * w and np.allclose([[got[r, q] for q in range(w)] for r in range(h)], plain(weights))


def test_filters_over_tile_borders(spark):
    """Rasters of several tiles, steps of different sizes and a null: one shuffle, the sums of plain loops, and four corners a point."""
    rng = np.random.default_rng(5)
    sizes = {0: (grid.TILE + 9, grid.TILE + 3), 1: (3, 2)}
    fields = {t: rng.normal(size=s) for t, s in sizes.items()}
    rows = [(t, r, q, *sizes[t], None if (t, r, q) == (0, 60, 60) else float(z[r, q])) for t, z in fields.items() for r in range(z.shape[0]) for q in range(z.shape[1])]
    df = spark.createDataFrame(rows, "t int, r long, q long, h int, w int, z double").repartition(3)
    weights = [0.3, 0.2, 0.1, 0.05]
    out = grid.separable(df.withColumnRenamed("z", "_a"), ["_a"], weights, ("t",)).withColumnRenamed("_a", "z")
    assert out._jdf.queryExecution().executedPlan().toString().count("Exchange hashpartitioning") == 1
    got = {(r.t, r.r, r.q): r.z for r in out.collect()}
    assert len(got) == len(rows)
    full = np.array(weights[:0:-1] + weights)
    for t, z in fields.items():
        a = np.pad(z, 3, "symmetric")
        a = np.array([np.convolve(a[:, j], full, "valid") for j in range(a.shape[1])]).T
        a = np.array([np.convolve(a[i], full, "valid") for i in range(a.shape[0])])
        for (s, r, q), v in got.items():
            if s == t:
                lost = t == 0 and abs(r - 60) <= 3 and abs(q - 60) <= 3
                assert v is None if lost else v == pytest.approx(a[r, q], abs=1e-12)
    raster = spark.createDataFrame([(r, q, float(10 * r + q)) for r in range(3) for q in range(3) if (r, q) != (1, 2)], "r long, q long, z double")
    points = spark.createDataFrame([(0, 0.5, 0.5), (1, 0.5, 1.0), (2, 0.5, 1.5), (3, 2.0, 2.0), (4, 2.0, 2.5), (5, None, 0.0), (6, 0.0, 1.25)], "i int, y double, x double")
    assert {r.i: r.interpolated for r in grid.bilinear(points, raster, "y", "x", "z").collect()} == {0: 5.5, 1: 6.0, 2: None, 3: 22.0, 4: None, 5: None, 6: 1.25}


def test_power_search_and_choice(spark):
    rng = np.random.default_rng(1)
    x = np.exp(rng.normal(1, 0.5, 400))
    df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "x double")

    def loglik(lam):
        y = (x**lam - 1) / lam if lam else np.log(x)
        return -len(x) / 2 * math.log(y.var()) + (lam - 1) * np.log(x).sum()

    lam, best = calibrate.power_search(df, "x", "box_cox")
    grid_ = np.arange(-0.5, 0.5, 1e-4)
    want = grid_[np.argmax([loglik(v) for v in grid_])]
    assert abs(lam - want) <= 2e-4 and best == pytest.approx(loglik(lam))
    choice = calibrate.transform_choice(df, "x", quantile=False).collect()
    assert choice[0]["name"] in ("log", "box-cox", "yeo-johnson") and choice[-1]["name"] == "none" and choice[0].normality > 0.98
    assert calibrate.transform_choice(df, "x").first()["name"] == "quantile"
    assert calibrate.power_search(df.where("x < 0"), "x")[0] == 1.0 and calibrate.transform_choice(df.limit(0), "x").count() == 0
    same_ = spark.createDataFrame([(2.0,)] * 3, "x double")
    assert {r.normality for r in calibrate.transform_choice(same_, "x").collect()} == {None}
    with pytest.raises(ValueError):
        calibrate.power_search(df.withColumn("x", -F.col("x")), "x", "box_cox")
