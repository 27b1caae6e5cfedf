"""The composed inference against plain loops, stage by stage."""

import math

import numpy as np
import pytest

from tidewatch.operators import engine, mixtures

T, H, W = 6, 12, 13


@pytest.fixture(scope="module")
def field(spark):
    rng = np.random.default_rng(21)
    rain, up = rng.gamma(1.5, 1, (T, H, W)), rng.uniform(0, 1, (H, W))
    count = np.where(rng.random((T, H, W)) < 0.3, rng.choice([1, 1, 2, 6, 7], (T, H, W)), 0).astype(float)
    rows = [(t, r * W + q, r, q, H, W, float(rain[t, r, q]), float(up[r, q]), float(count[t, r, q])) for t in range(T) for r in range(H) for q in range(W)]
    df = spark.createDataFrame(rows, "t int, cell long, r int, q int, h int, w int, rain double, up double, k double").repartition(3).cache()
    return rain, up, count, df


def gaussian(z, sigma):
    reach = int(4 * sigma + 0.5)
    half = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
    half /= half.sum()
    a = np.pad(z, reach, "symmetric")
    a = np.array([np.convolve(a[:, j], half, "valid") for j in range(a.shape[1])]).T
    return np.array([np.convolve(a[i], half, "valid") for i in range(a.shape[0])])


def enlarged(z, h, w):
    """Bilinear, corners kept."""
    out = np.empty((h, w))
    for r in range(h):
        for q in range(w):
            y, x = r * (z.shape[0] - 1) / (2 * z.shape[0] - 1), q * (z.shape[1] - 1) / (2 * z.shape[1] - 1)
            i, j = min(int(y), z.shape[0] - 1), min(int(x), z.shape[1] - 1)
            i2, j2, fy, fx = min(i + 1, z.shape[0] - 1), min(j + 1, z.shape[1] - 1), y - i, x - j
            out[r, q] = (z[i, j] * (1 - fx) + z[i, j2] * fx) * (1 - fy) + (z[i2, j] * (1 - fx) + z[i2, j2] * fx) * fy
    return out


def plain(rain, up, count, s, shift):
    share = up / (up.max() + engine.EPSILON)
    m = rain * (share + 0.5) * 0.5 if s.prior else np.zeros_like(rain)
    v0 = np.broadcast_to((rain.var() + 0.1) * (1 + 0.5 * share), rain.shape) if s.prior else np.full(rain.shape, 0.5)
    v = np.array(v0)
    if s.state_space:
        a, b = m[0], v[0]
        m, v = m.copy(), v.copy()
        for t in range(T):
            b = b + 0.1
            gain = b / (b + 0.2)
            a, b = np.where(count[t] > 0, a + gain * (count[t] - a), a), np.where(count[t] > 0, (1 - gain) * b, b)
            m[t], v[t] = a, b
    if s.dynamics:
        pm, pv, m, v = m, v, m.copy(), v.copy()
        keep = math.exp(-0.6)
        for t in range(1, T):
            m[t] = m[t - 1] + 0.3 * (0.5 * rain[t] - m[t - 1]) + 0.3 * pm[t]
            v[t] = v[t - 1] * keep + 0.01 / 0.6 * (1 - keep) + 0.3 * pv[t]
    if s.mixture:
        m, v = m + shift * (count > 0), v * (1 + 0.2 * (count > 0))
    seen = np.cumsum(count > 0, 0)
    e, a = (0.6 * v / (1 + 0.2 * seen), 0.4 * v + 0.05) if s.decomposition else (v / 2, v / 2)
    if s.smoothing:
        m = np.array([0.7 * gaussian(x, 1 + 2 * up.mean() / (up.max() + engine.EPSILON)) + 0.3 * x for x in m])
    if s.multi_resolution:
        m = np.array([(x + enlarged(gaussian(x[::2, ::2], 1.0), H, W)) / 2 for x in m])
    v = np.clip(e + a, s.least_variance, s.most_variance)
    cvar, utility = m + 2.326 * np.sqrt(v), np.maximum(m - v / (m + 1e-9), 0)
    if s.evidence:
        belief = 0.4 * m / (m.max() + 1e-9) + 0.3 * count / (count.max() + 1e-9) + 0.3 * up
        v = v * (1 - 0.3 * np.clip(belief, 0, 1))
    return {"mean": m, "var": v, "epistemic": e, "aleatoric": a, "cvar": cvar, "utility": utility, "ci_lower": m - 1.96 * np.sqrt(v), "reducible": e / (e + a)}


ALL = engine.Stages()
OFF = engine.Stages(prior=False, state_space=False, dynamics=False, mixture=False, decomposition=False, smoothing=False, multi_resolution=False, evidence=False)


@pytest.mark.parametrize("stages", [ALL, OFF, engine.Stages(state_space=False, mixture=False), engine.Stages(dynamics=False, smoothing=False, evidence=False)], ids=["all", "none", "some", "others"])
def test_composed(field, stages):
    rain, up, count, df = field
    found = mixtures.fit_mixture(df.where("k > 0").selectExpr("k as _k"), ["_k"], 2)
    assert found.n > 50
    want = plain(rain, up, count, stages, 0.1 * float(found.means.max() - found.means.min()))
    out = engine.composed(df, "rain", "up", "k", stages=stages).collect()
    assert len(out) == T * H * W
    for name, values in want.items():
        got = np.empty((T, H, W))
        for r in out:
            got[r.t, r.r, r.q] = r[name]
        assert np.allclose(got, values, rtol=1e-8, atol=1e-9), name


def test_stage_names_and_summary(field):
    *_, df = field
    assert OFF.used() == [] and ALL.used()[0] == "prior" and len(ALL.used()) == 8
    out = engine.composed(df, "rain", "up", "k", stages=engine.Stages(mixture=False, smoothing=False, multi_resolution=False))
    row = engine.composed_summary(out).first()
    assert row.coverage == 1.0 and row.roughness > 0 and row.spread_enough == (row.uncertainty_cv >= 0.2)
    assert engine.composed(df.limit(0), "rain", "up", "k").count() == 0
