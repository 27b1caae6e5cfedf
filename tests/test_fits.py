"""Rank loss over all pairs, bootstrap, mixtures, weighted regressions, experts and local processes against plain versions."""

import hashlib
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import bootstrap, mixtures, ranking


def plain_rank_loss(p, t, margin):
    sign = np.sign(t[:, None] - t[None])
    return np.maximum(0, margin - sign * (p[:, None] - p[None])).mean()


@pytest.mark.parametrize("kind", ["plain", "ties", "one target", "one prediction"])
def test_rank_hinge(spark, kind):
    rng = np.random.default_rng(3)
    n = 240
    p, t = rng.normal(0, 1, n), rng.normal(0, 1, n)
    if kind == "ties":  # a third of the rows share a target, and another third a prediction
        t[::3], p[1::3] = 0.25, 0.5
        t, p = t.round(1), p.round(1)
    if kind == "one target":
        t[:] = 2.0
    if kind == "one prediction":
        p[:] = 1.0
    g = np.where(np.arange(n) % 5 == 0, 1, 0)
    rows = [(int(a), float(b), float(c)) for a, b, c in zip(g, p, t)]
    df = spark.createDataFrame([*rows, (7, 1.0, 1.0), (8, None, 1.0), (None, 0.0, 1.0), (None, 1.0, 0.0)], "g int, p double, t double")
    for blocks in (1, 7):
        got = {r.g: (r.n, r.rank_loss) for r in ranking.rank_hinge(df, "p", "t", ["g"], 0.1, blocks=blocks).collect()}
        assert set(got) == {0, 1, 7, None}
        for k in (0, 1):
            assert got[k] == ((g == k).sum(), pytest.approx(plain_rank_loss(p[g == k], t[g == k], 0.1), rel=1e-12))
        assert got[7] == (1, pytest.approx(0.1)) and got[None] == (2, pytest.approx((0.1 + 0.1 + 2 * 1.1) / 4))
    whole = ranking.rank_hinge(df.where("g < 2"), "p", "t", [], 0.1, blocks=5).first()
    assert whole.n == n and whole.rank_loss == pytest.approx(plain_rank_loss(p, t, 0.1), rel=1e-12)
    assert ranking.rank_hinge(df.limit(0), "p", "t", ["g"]).count() == 0


def test_bootstrap(spark):
    rng = np.random.default_rng(1)
    x = rng.normal(0, 1, (60, 2))
    y = x @ [1.0, -2.0] + rng.normal(0, 0.3, 60)
    df = spark.createDataFrame([(i, float(a), float(b), float(c)) for i, ((a, b), c) in enumerate(zip(x, y))], "id long, a double, b double, y double")
    gram = bootstrap.bootstrap_gram(df, ["a", "b"], "y", F.col("id"), 30)
    got = {r.replicate: r for r in gram.collect()}
    assert sorted(got) == list(range(30))
    fits = []
    for rep in range(30):
        u = [int(hashlib.md5(f"{i}:{rep // 4}".encode()).hexdigest()[8 * (rep % 4) :][:8], 16) / 2**32 for i in range(60)]
        w = np.array([sum(v >= c for c in bootstrap.POISSON) for v in u])
        assert got[rep].n == w.sum() and got[rep].x0x1 == pytest.approx((w * x[:, 0] * x[:, 1]).sum()) and got[rep].x1y == pytest.approx((w * x[:, 1] * y).sum())
        fits.append(np.linalg.solve(x.T @ (w[:, None] * x) + np.eye(2), x.T @ (w * y)))
    ends, weights = bootstrap.bootstrap_intervals(gram, 2)
    assert weights == pytest.approx(np.array(fits))
    want = np.percentile(fits, [2.5, 97.5], axis=0).T
    assert np.array(ends) == pytest.approx(want) and want[0, 0] < 1.0 < want[0, 1] + 0.2
    assert bootstrap.bootstrap_intervals(gram.limit(0), 2)[0] == []
    share = bootstrap.replicate_weights(spark.range(4000), F.col("id"), 8).groupBy("replicate").agg(F.sum("weight").alias("n")).collect()
    assert len(share) == 8 and all(abs(r.n - 4000) < 4 * math.sqrt(4000) for r in share)


def clusters(spark, n=300):
    rng = np.random.default_rng(5)
    x = np.vstack([rng.multivariate_normal([0, 0], [[1, 0.6], [0.6, 1]], n), rng.multivariate_normal([6, -3], [[0.5, 0], [0, 2]], n // 2)])
    return x, spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(x)] + [(-1, None, 1.0)], "id long, a double, b double").repartition(3)


def plain_mixture(x, seeds, covariance, rounds, floor=1e-6):
    k, d = seeds.shape
    w, m = np.full(k, 1 / k), seeds.astype(float)
    shape = (lambda c: np.diag(np.diag(c)) + floor * np.eye(d)) if covariance == "diag" else (lambda c: c + floor * np.eye(d))
    c = np.array([shape(np.cov(x.T, bias=True))] * k)
    for _ in range(rounds):
        density = np.array([w[j] * np.exp(-0.5 * np.einsum("ni,ij,nj->n", x - m[j], np.linalg.inv(c[j]), x - m[j])) / math.sqrt((2 * math.pi) ** d * np.linalg.det(c[j])) for j in range(k)]).T
        loglik = np.log(density.sum(1)).sum()
        r = density / density.sum(1, keepdims=True)
        w, m = r.mean(0), (r.T @ x) / r.sum(0)[:, None]
        c = np.array([shape(((x - m[j]).T * r[:, j]) @ (x - m[j]) / r[:, j].sum()) for j in range(k)])
    return w, m, c, loglik


@pytest.mark.parametrize("covariance", ["full", "diag"])
def test_mixture(spark, covariance):
    x, df = clusters(spark)
    seeds = np.array([[1.0, 1.0], [4.0, -1.0]])
    own = mixtures.fit_mixture(df, ["a", "b"], 2, covariance, seeds=seeds, most=8, tol=0.0)
    w, m, c, loglik = plain_mixture(x, seeds, covariance, 8)
    assert (own.n, own.rounds, own.converged) == (len(x), 8, False) and own.loglik == pytest.approx(loglik, rel=1e-10)
    assert own.weights == pytest.approx(w) and own.means == pytest.approx(m) and own.covariances == pytest.approx(c, abs=1e-9)
    assert own.bic == pytest.approx((1 + 4 + (6 if covariance == "full" else 4)) * math.log(len(x)) - 2 * loglik)


def test_mixture_seeds_choice_and_shares(spark):
    x, df = clusters(spark)
    best, each = mixtures.best_mixture(df, ["a", "b"], [1, 2], most=40, tol=1e-4)
    assert best.converged and len(best.weights) == 2 and each[2] < each[1]
    assert sorted(best.weights) == pytest.approx([1 / 3, 2 / 3], abs=0.05)
    rows = mixtures.responsibilities(df, ["a", "b"], best).collect()
    assert len(rows) == len(x) + 1 and next(r for r in rows if r.id == -1).component is None
    big = int(best.weights.argmax())
    assert sum((r.component == big) == (r.id < 300) for r in rows if r.id >= 0) > 0.97 * len(x)
    one = mixtures.fit_mixture(spark.createDataFrame([(1.0,)] * 5, "v double"), ["v"], 3)
    assert len(one.weights) == 1 and one.means.ravel() == pytest.approx([1.0])
    assert mixtures.fit_mixture(df.limit(0), ["a", "b"], 2).n == 0
    with pytest.raises(ValueError):
        mixtures.fit_mixture(df, ["a"], 2, "round")


def test_noise_model(spark):
    rng = np.random.default_rng(7)
    x = rng.uniform(-1, 1, (400, 2))
    y = 1 + x @ [2.0, -1.0] + rng.normal(0, 1, 400) * np.exp(0.5 * (x[:, 0] - 1))
    df = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(x, y)], "a double, b double, y double").repartition(3)
    z, w = np.c_[np.ones(400), x], np.ones(400)
    for _ in range(3):
        mean = np.linalg.solve(z.T @ (w[:, None] * z), z.T @ (w * y))
        spread = np.linalg.solve(z.T @ z, z.T @ np.log((y - z @ mean) ** 2 + 1e-6))
        w = 1 / (np.exp(z @ spread) + 1e-6)
        w = w / w.mean()
    own = mixtures.fit_noise_model(df, ["a", "b"], "y")
    assert own.mean == pytest.approx(mean, rel=1e-8) and own.log_variance == pytest.approx(spread, rel=1e-8) and own.n == 400
    assert own.predict(x)[1] == pytest.approx(np.exp(z @ spread)) and mixtures.fit_noise_model(df.limit(0), ["a", "b"], "y").n == 0


def test_experts(spark):
    rng = np.random.default_rng(9)
    x = rng.uniform(-2, 2, (500, 1))
    y = np.where(x[:, 0] > 0.3, 3 * x[:, 0] - 1, -2 * x[:, 0]) + rng.normal(0, 0.1, 500)
    df = spark.createDataFrame([(float(a), float(b)) for (a,), b in zip(x, y)], "a double, y double").repartition(3)
    one = mixtures.fit_experts(df, ["a"], "y", 2, most=1)
    z, var = np.c_[np.ones(500), x], y.var() + 1e-8
    start = y.mean() + y.std() * np.array([-2 / 3, 2 / 3])
    r = np.exp(-0.5 * (y[:, None] - start) ** 2 / var)
    r /= r.sum(1, keepdims=True)
    want = [np.linalg.solve(z.T @ (r[:, [j]] * z) + 1e-8 * np.eye(2), z.T @ (r[:, j] * y)) for j in (0, 1)]
    gate = np.linalg.solve(0.25 * z.T @ z + 500e-8 * np.eye(2), z.T @ (r[:, 0] - 0.5))
    assert one.weights == pytest.approx(np.array(want), rel=1e-8) and one.gate[0] == pytest.approx(gate, rel=1e-8) and not one.converged
    own = mixtures.fit_experts(df, ["a"], "y", 2, most=30, tol=1e-4)
    mean, var = own.predict(x)
    assert np.abs(mean - y).mean() < 0.2 and sorted(own.weights[:, 1]) == pytest.approx([-2, 3], abs=0.1) and (var > 0).all()
    assert mixtures.fit_experts(df.limit(0), ["a"], "y").rounds == 0


def test_local_process(spark):
    rng = np.random.default_rng(2)
    o, at = rng.uniform(0, 3, (25, 2)), rng.uniform(0, 3, (6, 2))
    v = np.sin(o[:, 0]) + o[:, 1]
    seen = spark.createDataFrame([(float(a), float(b), float(c)) for (a, b), c in zip(o, v)] + [(1.0, 1.0, None)], "x double, y double, v double")
    asked = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(at)] + [(9, None, 1.0)], "id int, x double, y double")
    kernel = lambda a, b: 1.5 * np.exp(-0.5 * ((a[:, None] - b[None]) ** 2).sum(2) / 0.49)

    def plain(near):
        k = kernel(o[near], o[near]) + 0.1 * np.eye(len(near))
        c = kernel(at[[i]], o[near])[0]
        return c @ np.linalg.solve(k, v[near]), 1.5 - c @ np.linalg.solve(k, c)

    for k in (25, 5):
        got = {r.id: r for r in mixtures.local_process(asked, seen, "id", "x", "y", "v", k, 0.7, 1.5, 0.7, 0.1).collect()}
        assert set(got) == set(range(6))
        for i in range(6):
            near = np.argsort(((o - at[i]) ** 2).sum(1), kind="stable")[:k]
            mean, var = plain(near)
            assert (got[i].mean, got[i].epistemic, got[i].aleatoric, got[i].n_near) == (pytest.approx(mean), pytest.approx(var), 0.1, k)
    alone = mixtures.local_process(asked, seen.limit(0), "id", "x", "y", "v").collect()
    assert {(r.mean, r.epistemic, r.n_near) for r in alone} == {(0.0, 1.0, 0)}


def test_local_process_of_crowded_places(spark):
    """Many observations in one cell and at one place: the cells get finer, equally near ones are taken by their number."""
    from tidewatch.operators import match

    o = spark.range(20000).selectExpr("id", "(id % 5000) / 5000 as x", "0.0D as y", "cast(id as double) as v")
    assert match.uncrowded(o, 1.0, 2) < 0.02
    asked = spark.createDataFrame([(0, 0.3, 0.0), (1, 0.9998, 0.0)], "a int, x double, y double")
    near = match.nearest_neighbors(asked.withColumnRenamed("a", "id"), "id", "x", "y", 2, 1.0, among=o.select("id", "x", "y")).collect()
    assert {(r.src, r.dst, r.distance, r.rank) for r in near} == {(0, 1500, 0.0, 1), (0, 6500, 0.0, 2), (1, 4999, 0.0, 1), (1, 9999, 0.0, 2)}
    back = o.orderBy(F.desc("id")).withColumn("id", F.col("id"))
    got = {r.a: r.mean for r in mixtures.local_process(asked, back, "a", "x", "y", "v", k=1, noise=0.0, order="id").collect()}
    assert got == {0: pytest.approx(1500), 1: pytest.approx(4999)}


def test_highest_density_in_ranges(spark, monkeypatch):
    """Ranks over several ranges and blocks; nulls are the last samples."""
    from tidewatch.operators import bayes

    monkeypatch.setattr(bayes, "RANGE_ROWS", 7)
    monkeypatch.setattr(bayes, "BLOCK_RANKS", 8)
    rng = np.random.default_rng(3)
    rows = [(g, None if i % 19 == 0 else float(x)) for g in "ab" for i, x in enumerate(rng.integers(0, 40, 120) ** 2 / 8)]
    want = {}
    for g in "ab":
        own = sorted(x for h, x in rows if h == g and x is not None)
        n = sum(h == g for h, _ in rows)
        k = math.ceil(n * 0.8)
        want[g] = min((own[i + k] - own[i], i, own[i], own[i + k]) for i in range(len(own) - k))[2:]
    df = spark.createDataFrame(rows, "g string, x double")
    assert {r.g: (r.hdi_low, r.hdi_high) for r in bayes.highest_density(df, "x", ["g"], 0.8).collect()} == want


def test_adjacent_rank_loss_in_ranges(spark, monkeypatch):
    """Pairs over the borders of ranges and of batches are counted once; null targets come last."""
    from tidewatch.operators import learning

    monkeypatch.setattr(learning, "RANGE_ROWS", 10)
    rng = np.random.default_rng(4)
    rows = [(g, i, None if i % 7 == 0 else float(t), None if i % 11 == 3 else float(p)) for g in ("a", "b", None) for i, (t, p) in enumerate(rng.normal(0, 0.1, (40, 2)).round(2))]
    want = {}
    for g in ("a", "b", None):
        p = [r[3] for r in sorted((r for r in rows if r[0] == g), key=lambda r: (r[2] is None, r[2] or 0.0, r[1]))]
        h = [max(0.1 - (y - x), 0) for x, y in zip(p, p[1:]) if x is not None and y is not None]
        want[g] = pytest.approx(sum(h) / len(h))
    df = spark.createDataFrame(rows, "g string, k int, t double, p double")
    assert {r.g: r.rank_loss for r in learning.adjacent_rank_loss(df, "k", "p", "t", ["g"]).collect()} == want


def test_extremes_uncertain_without_whole_draws(spark, monkeypatch):
    """The middle of each draw is exact, whether the first draw's window holds it or not, with ties and without noise."""
    from tidewatch.operators import calibrate

    rows = [("a", i, float(i % 50), 5.0) for i in range(601)] + [("b", i, float(i % 3), 0.0) for i in range(400)] + [("c", 1, 2.0, 1.0)]

    def x(k, v, s, n):
        h = hashlib.md5(f"{k}:{n}".encode()).hexdigest()
        a, b = ((int(h[i : i + 8], 16) + 0.5) / 2**32 for i in (0, 8))
        return v + s * math.sqrt(-2 * math.log(a)) * math.cos(2 * math.pi * b)

    want = {}
    for g in "abc":
        each = [[x(k, v, s, n) for h, k, v, s in rows if h == g] for n in range(1, 21)]
        want[g] = tuple(pytest.approx(np.std([f(e) for e in each]), abs=1e-9) for f in (max, min, np.median))
    df = spark.createDataFrame(rows, "g string, k long, v double, s double")
    for around in (calibrate.AROUND, [1e-6] * 16):
        monkeypatch.setattr(calibrate, "AROUND", around)
        monkeypatch.setattr(calibrate, "NEAR", 5.0 if around[0] > 1e-3 else 0.0)
        got = {r.g: (r.max_sigma, r.min_sigma, r.median_sigma) for r in calibrate.extremes_uncertain(df, "k", "v", "s", ["g"], 20).collect()}
        assert got == want


def test_days_of_equal_sums(spark):
    """Sums of a cell's days don't follow the order of events: the first of equal days is the peak, and nothing rises."""
    import datetime

    from tidewatch.operators import grid, series

    day = lambda n, values: [(datetime.datetime(2024, 1, 1 + n, 1, i), 0, v, "click") for i, v in enumerate(values)]
    e = spark.createDataFrame([*day(0, [0.3, 0.2, 0.1]), *day(1, [0.1, 0.2, 0.3]), *day(2, [0.3, 0.2, 0.1])], "ts timestamp, user_id long, value double, event_type string").coalesce(1)
    g = grid.dense(e)
    assert [(r.peak_t, r.peak_value) for r in series.peak_times(g, "v", "cell", "t").collect()] == [(0, 0.6)]
    assert [(r.mean_rise, r.mean_fall) for r in series.asymmetry(g, "v", "cell", "t").collect()] == [(0.0, 0.0)]


def test_poisson_count_stops_at_the_first_share(spark):
    """Counts by comparisons that stop, not by a fold over all shares; a missing number has none."""
    us = [0.0, *[f(p) for p in bootstrap.POISSON for f in (lambda p: np.nextafter(p, 0), float)], 0.999999]
    rows = spark.createDataFrame([(float(u),) for u in us] + [(None,)], "u double").select("u", bootstrap.poisson_count(F.col("u")).alias("n"))
    assert all(r.n == (None if r.u is None else sum(r.u >= p for p in bootstrap.POISSON)) for r in rows.collect())
    assert "aggregate(" not in rows._jdf.queryExecution().optimizedPlan().toString()
