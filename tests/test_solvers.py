"""Metric paths, sparse solvers and eigenvalues against plain versions."""

import heapq
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from tidewatch.operators import graph, paths, solve

EIGHT = [(i, j) for i in (-1, 0, 1) for j in (-1, 0, 1) if i or j]


def raster(spark, h, w, seed, missing=()):
    rng = np.random.default_rng(seed)
    z = rng.normal(0, 1, (h, w)).round(3)
    rows = [(r, q, h, w, r * w + q, float(z[r, q])) for r in range(h) for q in range(w) if (r, q) not in missing]
    return spark.createDataFrame(rows, "r int, q int, h int, w int, cell int, z double"), z


def plain_distances(cells, h, w, sources, dx, dy, most=math.inf):
    """{cell: (distance, least previous)} by Dijkstra over all cells."""
    far, heap = {s: 0.0 for s in sources}, [(0.0, s) for s in sources]
    step = lambda m, i, j: math.sqrt(m[0] * (j * dx) * (j * dx) + 2 * m[1] * (j * dx) * (i * dy) + m[2] * (i * dy) * (i * dy))
    while heap:
        d, (r, q) = heapq.heappop(heap)
        if d > far[r, q]:
            continue
        for i, j in EIGHT:
            n = (r + i, q + j)
            if n in cells and (new := d + step(cells[r, q], i, j)) <= most and new < far.get(n, math.inf):
                far[n] = new
                heapq.heappush(heap, (new, n))
    before = {}
    for (r, q), d in far.items():
        if (r, q) not in sources:
            before[r, q] = min(a * w + b for i, j in EIGHT if (a := r + i, b := q + j) in far and far[a, b] + step(cells[a, b], -i, -j) == d)
    return {k: (d, before.get(k)) for k, d in far.items()}


@pytest.mark.parametrize("tile,missing", [(3, ()), (4, ((2, 2), (3, 2), (4, 2), (5, 2))), (64, ())])
def test_distance_field_and_paths(spark, tile, missing):
    h, w = 9, 11
    df, _ = raster(spark, h, w, 4, missing)
    metric = paths.slope_metric(df, "z", 0.5, 2.0)
    cells = {(r.r, r.q): (r.m11, r.m12, r.m22) for r in metric.collect()}
    sources = {(0, 0), (8, 3)}
    src = spark.createDataFrame([(*s,) for s in sources], "r int, q int")
    tree = paths.distance_field(metric, src, 0.5, 2.0, tile=tile)
    want = plain_distances(cells, h, w, sources, 0.5, 2.0)
    got = {(r.r, r.q): (r.distance, r.previous) for r in tree.collect()}
    assert got == want
    targets = [r * w + q for r, q in want]
    found = paths.path_cells(tree, spark.createDataFrame([(t,) for t in [*targets, 10_000]], "cell long")).collect()
    steps = {}
    for r in found:
        steps.setdefault(r.target, {})[r.step] = r.cell
    assert set(steps) == set(targets)
    for t, path in steps.items():
        cell, back = t, []
        while cell is not None:
            back.append(cell)
            cell = want[divmod(cell, w)][1]
        assert [path[k] for k in range(len(path))] == back[::-1]


def test_distance_field_limits(spark):
    df, _ = raster(spark, 6, 6, 1)
    metric = paths.slope_metric(df, "z")
    cells = {(r.r, r.q): (r.m11, r.m12, r.m22) for r in metric.collect()}
    one = spark.createDataFrame([(2, 2)], "r int, q int")
    near = paths.distance_field(metric, one, most=2.5, tile=2)
    assert {(r.r, r.q): r.distance for r in near.collect()} == {k: d for k, (d, _) in plain_distances(cells, 6, 6, {(2, 2)}, 1, 1, 2.5).items()}
    assert near.where("distance = 0").first().uncertainty == paths.EPSILON
    assert paths.distance_field(metric, one.limit(0)).count() == 0
    assert paths.distance_field(metric, spark.createDataFrame([(50, 50)], "r int, q int")).count() == 0


def test_metrics(spark):
    flat = paths.slope_metric(spark.createDataFrame([(r, q, 2, 3, 5.0) for r in range(2) for q in range(3)], "r int, q int, h int, w int, z double"), "z")
    assert {(r.m11, r.m12, r.m22) for r in flat.collect()} == {(1.0, 0.0, 1.0)}
    flow = paths.flow_metric(spark.createDataFrame([(3.0, 4.0), (0.0, 0.0)], "x double, y double"), "x", "y").collect()
    assert [flow[0].m11, flow[0].m12, flow[0].m22] == pytest.approx([1 + 0.25 * 0.36, 0.25 * 0.48, 1 + 0.25 * 0.64]) and flow[1].m11 == 1.0
    df, z = raster(spark, 5, 4, 2)
    got = {(r.r, r.q): (r.gx, r.gy) for r in paths.gradients(df, "z", 0.5, 2.0).collect()}
    gy, gx = np.gradient(z, 2.0, 0.5)
    assert all(got[r, q] == pytest.approx((gx[r, q], gy[r, q])) for r in range(5) for q in range(4))


def test_metric_pairs(spark):
    rng = np.random.default_rng(6)
    rows = []
    for k in range(150):
        a, b, t = rng.uniform(0.2, 4), rng.uniform(0.2, 4), rng.uniform(0, 3)
        m = np.array([[math.cos(t), -math.sin(t)], [math.sin(t), math.cos(t)]]) @ np.diag([a, b]) @ np.array([[math.cos(t), math.sin(t)], [-math.sin(t), math.cos(t)]])
        place = (1.0, 1.0) if k % 10 == 0 else rng.uniform(-5, 5, 2)
        rows.append((k, float(place[0]), float(place[1]), float(m[0, 0]), float(m[0, 1]), float(m[1, 1])))
    rows.append((999, None, 1.0, 1.0, 0.0, 1.0))
    df = spark.createDataFrame(rows, "k int, x double, y double, m11 double, m12 double, m22 double")
    want = {}
    for a in rows[:-1]:
        for b in rows[:-1]:
            if a[0] < b[0]:
                gx, gy = b[1] - a[1], b[2] - a[2]
                fa, fb = (math.sqrt(p[3] * gx * gx + 2 * p[4] * gx * gy + p[5] * gy * gy) for p in (a, b))
                if min(fa, fb) <= 0.9:
                    want[a[0], b[0]] = (fa + fb) / 2
    for cell in (None, 0.2, 5.0):
        got = paths.metric_pairs(df, "k", "x", "y", 0.9, cell).collect()
        assert len(got) == len(want) and {(r.a, r.b): pytest.approx(r.distance) for r in got} == want


def system(spark, n, seed):
    rng = np.random.default_rng(seed)
    m = np.where(rng.random((n, n)) < 0.2, rng.normal(0, 1, (n, n)), 0)
    m = m @ m.T + np.diag(rng.uniform(0.5, 3, n))
    b = rng.normal(0, 1, n)
    b[::4] = 0
    matrix = spark.createDataFrame([(i, j, float(m[i, j])) for i in range(n) for j in range(n) if m[i, j]], "i long, j long, a double")
    rhs = spark.createDataFrame([(i, float(b[i])) for i in range(n) if b[i]], "i long, x double")
    return m, b, matrix, rhs


def test_conjugate_gradients(spark):
    m, b, matrix, rhs = system(spark, 18, 3)
    done = solve.conjugate_gradients(matrix, rhs, 1e-11)
    x = {r.i: r.x for r in done.x.collect()}
    assert done.converged and done.residual < 1e-10 and done.rounds <= 30
    assert [x[i] for i in range(18)] == pytest.approx(np.linalg.solve(m, b).tolist(), rel=1e-7, abs=1e-9)
    assert max(abs(r.residual) for r in done.x.collect()) < 1e-9
    short = solve.conjugate_gradients(matrix, rhs, 1e-11, most=2)
    assert not short.converged and short.rounds == 2 and short.residual > 1e-11


def test_conjugate_gradients_of_odd_systems(spark):
    _, _, matrix, rhs = system(spark, 6, 5)
    zero = solve.conjugate_gradients(matrix, rhs.limit(0))
    assert zero.converged and {r.x for r in zero.x.collect()} == {0.0}
    with pytest.raises(ValueError, match="diagonal"):
        solve.conjugate_gradients(matrix, spark.createDataFrame([(77, 1.0)], "i long, x double"))
    bent = spark.createDataFrame([(0, 0, 1.0), (1, 1, 1.0), (0, 1, 3.0), (1, 0, 3.0)], "i long, j long, a double")
    with pytest.raises(ValueError, match="positive definite"):
        solve.conjugate_gradients(bent, spark.createDataFrame([(0, 1.0), (1, -1.0)], "i long, x double"))


def test_implicit_step(spark):
    df, z = raster(spark, 4, 5, 9)
    vec = lambda c: df.select(F.col("cell").cast("long").alias("i"), c.alias("x"))
    lap = np.zeros((20, 20))
    for r in graph.laplacian(df).collect():
        lap[r.i, r.j] = r.a
    got = {r.i: r.x for r in solve.implicit_step(df, vec(F.col("z")), vec(F.lit(2.0)), 0.3).x.collect()}
    assert [got[i] for i in range(20)] == pytest.approx(np.linalg.solve(np.eye(20) - 0.3 * lap, z.ravel() + 0.6).tolist())


def test_dominant_eigenvalue(spark):
    m, _, matrix, _ = system(spark, 8, 12)
    top = solve.dominant_eigenvalue(matrix, 1e-7)
    values, vectors = np.linalg.eigh(m)
    assert top.converged and top.value == pytest.approx(values[-1], rel=1e-9)
    x = {r.i: r.x for r in top.vector.collect()}
    assert abs(sum(x[i] * vectors[i, -1] for i in range(8))) == pytest.approx(1, abs=1e-6)
    assert not solve.dominant_eigenvalue(matrix, 1e-12, most=2).converged
    none = solve.dominant_eigenvalue(matrix.limit(0))
    assert none.value == 0.0 and none.converged


def test_conjugate_gradients_with_sine_transforms(spark):
    """A raster's Poisson equation takes one or two rounds with the sine transforms, and gives the dense solution."""
    h, w = 9, 14
    g = spark.range(h * w).selectExpr("id as cell", "id div 14 as r", "id % 14 as q", "9L as h", "14L as w", "cos(id) as x")
    matrix = solve.shifted(graph.laplacian(g, boundary="dirichlet"), 0.0, -1.0)
    done = solve.conjugate_gradients(matrix, g.select(F.col("cell").alias("i"), "x"), precondition=solve.sine_inverse(h, w))
    line = lambda n: 2 * np.eye(n) - np.eye(n, k=1) - np.eye(n, k=-1)
    want = np.linalg.solve(np.kron(line(h), np.eye(w)) + np.kron(np.eye(h), line(w)), np.cos(np.arange(h * w)))
    got = {r.i: r.x for r in done.x.collect()}
    assert done.converged and done.rounds <= 2 and all(abs(got[i] - want[i]) < 1e-9 for i in range(h * w))
