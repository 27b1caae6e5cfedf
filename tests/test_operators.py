"""Hand-made cases: ties, single rows, nulls, borders, order, errors."""

import pandas as pd
import pytest
from pyspark.sql import functions as F

from tidewatch.functions import mathx, text
from tidewatch.operators import bins, bayes, calibrate, clean, decide, evidence, graph, grid, groups, learning, match, quality, scalars, series, solve
from tidewatch.sources import readers, writers


def rows(df):
    return [tuple(r) for r in df.collect()]


def test_exact_quantiles(spark):
    for values in ([3.0], [1.0, 1.0, 1.0], [5.0, 1.0, 9.0, 2.0, 2.0], [None, 4.0, 8.0], list(map(float, range(1000)))):
        df = spark.createDataFrame([(v,) for v in values], "v double")
        got = scalars.quantiles(df, "v", a=0.1, b=0.5, c=0.99).first()
        want = pd.Series([v for v in values if v is not None]).quantile([0.1, 0.5, 0.99]).tolist()
        assert [got.a, got.b, got.c] == pytest.approx(want)
    assert scalars.quantiles(spark.createDataFrame([], "v double"), "v", a=0.5).first().a is None


def test_quality_flags(spark):
    data = [(1, "2024-01-01", 500.0), (2, "2024-01-02", -1.0), (3, "2024-01-03", None), (4, None, 1.0), (5, "2024-01-05", 7.0), (6, "2024-01-05", 8.0)]
    df = spark.createDataFrame(data, "event_id long, t string, value double").select("event_id", F.to_timestamp("t").alias("ts"), "value", F.lit(1).alias("station"))
    got = {r.event_id: r.qc_flag for r in clean.qc_flags(df).collect()}
    assert got == {1: "extreme_value", 2: "negative_value", 3: "missing_value", 4: "missing_timestamp", 5: "duplicate_timestamp", 6: "duplicate_timestamp"}
    same = spark.range(7).select(F.col("id").alias("event_id"), F.timestamp_seconds("id").alias("ts"), F.lit(2.0).alias("value"), F.lit(1).alias("station"))
    assert [r.qc_flag for r in clean.qc_flags(same).orderBy("event_id").collect()] == ["ok"] * 4 + ["constant_sequence"] * 3


def test_stuck_runs_of_exactly_the_limit(spark):
    df = spark.createDataFrame([(i, 1, 5.0 if 3 <= i < 27 else float(i)) for i in range(40)], "k long, g int, v double")
    assert rows(quality.stuck_runs(df, ["g"], "v", ["k"], 24).select("run_length", "run_k")) == [(24, 3)]
    assert rows(quality.stuck_runs(df, ["g"], "v", ["k"], 25)) == []


def test_bins_keep_null_times(spark):
    df = spark.createDataFrame([("a", None, 1.0), ("a", "2024-01-01 00:30:00", 0.5), (None, "2024-01-01 00:59:59", 0.3)], "area string, t string, c double").withColumn("ts", F.to_timestamp("t"))
    bias = spark.createDataFrame([("a", 2.0)], "area string, bias double")
    got = bins.time_bins(df, "area", "ts", "c", 60, bias)
    assert got.count() == 3 and {(r.area, r.bias) for r in got.collect()} == {("a", 2.0), (None, 1.0)}
    assert bins.event_windows(spark, "2024-01-01", "2024-01-01 02:00:00", 60).count() == 2


def sequential_groups(data, hours, metres):
    """The rule one row after the other."""
    from math import asin, cos, radians, sin, sqrt

    far = lambda a, b: 2 * 6371000.0 * asin(min(1.0, sqrt(sin(radians(b[2] - a[2]) / 2) ** 2 + cos(radians(a[2])) * cos(radians(b[2])) * sin(radians(b[3] - a[3]) / 2) ** 2)))
    order, seen, out = sorted(data, key=lambda r: (r[1], r[0])), set(), set()
    for i, a in enumerate(order):
        if a[0] in seen:
            continue
        own = [b[0] for b in order[i + 1 :] if b[0] not in seen and b[1] - a[1] <= hours * 3600 and far(a, b) <= metres]
        if own:
            seen.update([a[0], *own])
            out |= {(a[0], a[0]), *((k, a[0]) for k in own)}
    return out


@pytest.mark.parametrize("kind", ["chain", "one place", "scattered", "same time"])
def test_first_come_groups(spark, kind):
    import random

    r = random.Random(kind)
    if kind == "chain":  # A - B - C whose ends are apart: A takes B, and C anchors D
        data = [(1, 0, 47.5, -122.0), (2, 10, 47.5008, -122.0), (3, 20, 47.5016, -122.0), (4, 30, 47.5017, -122.0)]
    elif kind == "one place":
        data = [(k, r.randrange(200_000), 47.5, -122.0) for k in range(150)]
    elif kind == "same time":
        data = [(k, 5 * (k % 3), 47.5 + r.random() / 400, -122.0 + r.random() / 400) for k in range(80)]
    else:
        data = [(k, r.randrange(150_000), 47.5 + r.randrange(8) / 2000, -122.0 + r.randrange(5) / 1500) for k in range(300)]
    df = spark.createDataFrame([*data, (900, None, 47.5, -122.0), (901, 5, None, -122.0)], "k long, s long, lat double, lon double").withColumn("ts", F.timestamp_seconds("s"))
    got = {tuple(x) for x in match.first_come_groups(df, "k", "ts", "lat", "lon", 1, 100).collect()}
    assert got == sequential_groups(data, 1, 100)
    if kind == "chain":
        assert got == {(1, 1), (2, 1), (3, 3), (4, 3)}
        assert match.first_come_groups(df.limit(0), "k", "ts", "lat", "lon", 1, 100).count() == 0


def test_asof_ties_take_the_first(spark):
    left = spark.createDataFrame([(1, 0, 100), (2, 0, 10_000)], "i long, g int, s long").select("i", "g", F.timestamp_seconds("s").alias("ts"))
    right = spark.createDataFrame([(7, 0, 90, 1.0), (5, 0, 110, 2.0)], "o long, g int, s long, v double").select("o", "g", F.timestamp_seconds("s").alias("ts"), "v")
    got = {r.i: (r.matched_value, r.status) for r in match.asof_nearest(left, right, ["g"], "ts", "v", "o", 600).collect()}
    assert got == {1: (2.0, "aligned"), 2: (None, "no_match")}


def test_folds(spark):
    df = spark.createDataFrame([(1, t, float(t)) for t in range(4)] + [(2, 0, 9.0)], "cell int, t int, v double")
    got = {(r.cell, r.t): r.m for r in series.ewma(df, "v", "cell", "t", 0.5).collect()}
    assert got == {(1, 0): 0.0, (1, 1): 0.5, (1, 2): 1.25, (1, 3): 2.125, (2, 0): 9.0}
    assert rows(series.peak_times(spark.createDataFrame([(1, 0, 5.0), (1, 1, 5.0)], "cell int, t int, v double"), "v", "cell", "t")) == [(1, 0, 5.0)]


def test_raster_edges(spark):
    z = [[9, 9, 9, 9], [9, 5, 9, 9], [9, 4, 1, 9], [9, 9, 9, 9]]
    df = spark.createDataFrame([(i * 4 + j, i, j, 4, 4, float(z[i][j])) for i in range(4) for j in range(4)], "cell long, r long, q long, h long, w long, z double")
    code = {(r.r, r.q): r.code for r in grid.flow_direction(df).collect()}
    assert code[1, 1] == 3 and code[2, 1] == 2 and code[2, 2] == -1 and code[0, 0] == -1
    acc = {r.cell: r.accumulation for r in grid.flow_accumulation(grid.flow_direction(df)).collect()}
    assert acc[10] == 4 and acc[5] == 1 and acc[0] == 1
    wrapped = {(r.r, r.q): r.n for r in grid.neighbors(df, "z", ((0, -1),), "wrap").collect()}
    assert wrapped[0, 0] == 9.0 and len(wrapped) == 16
    assert grid.neighbors(df, "z").count() == 4 * 3 + 8 * 5 + 4 * 8


def test_histogram_closes_its_last_bin(spark):
    df = spark.createDataFrame([(0.0,), (5.0,), (10.0,), (11.0,)], "v double")
    ends = spark.createDataFrame([(0.0, 10.0)], "lo double, hi double")
    assert {tuple(r) for r in calibrate.histogram(df, "v", ends, 10).collect()} == {(0, 1), (5, 1), (9, 1)}


def test_self_shift_is_zero(spark):
    df = spark.range(500).select((F.col("id") * 1.7).alias("v"))
    assert calibrate.shift_wasserstein(df, df, "v").first()[0] == 0 and abs(calibrate.shift_kl(df, df, "v").first()[0]) < 1e-9
    moved = df.select((F.col("v") + 3).alias("v"))
    assert calibrate.shift_wasserstein(df, moved, "v").first()[0] == pytest.approx(3)


def test_single_row_groups_have_no_sampling_part(spark):
    df = spark.createDataFrame([("a", 2.0, 0.5)], "g string, v double, s double")
    r = calibrate.aggregate_uncertain(df, "v", "s", ["g"]).first()
    assert (r.mean_sigma, r.sum_sigma, r.median_value) == (0.5, 0.5, 2.0)


def test_total_conflict_has_no_mass(spark):
    a, b = (spark.createDataFrame([(1, s, 1.0)], "g int, set long, mass double") for s in (1, 2))
    assert evidence.dempster(a, b, ["g"]).count() == 0
    c = spark.createDataFrame([(1, 1, 0.5), (1, 3, 0.5)], "g int, set long, mass double")
    assert {(r.element, r.probability) for r in evidence.pignistic(c, ["g"], 2).collect()} == {(0, 0.75), (1, 0.25)}


def test_decisions(spark):
    df = spark.createDataFrame([(95.0, 0.6, 0.9), (80.0, 0.1, 0.9), (60.0, 0.1, 0.4), (10.0, 0.4, 0.1), (10.0, 0.1, 0.1), (10.0, 0.1, 0.9)], "p double, e double, c double")
    p, e, c = F.col("p"), F.col("e"), F.col("c")
    got = [r[0] for r in df.select(decide.relative_decision(p, e, c)).collect()]
    assert got == ["urgent", "action", "monitor", "action", "no_decision", "no_action"]
    strict = [r[0] for r in df.select(decide.relative_decision(p, e, c, strict_precedence=True, conservative=True)).collect()]
    assert strict[3] == "no_decision" and strict[2] == "no_decision"
    states = [r[0] for r in spark.createDataFrame([(0.9, 2.0), (0.8, 0.1), (0.5, 0.1), (0.1, 0.1)], "c double, s double").select(decide.contract_state(F.col("c"), F.col("s"))).collect()]
    assert states == ["REFUSED", "CONFIDENT", "UNCERTAIN", "REFUSED"]


def test_special_functions(spark):
    r = spark.range(1).select(mathx.normal_cdf(F.lit(1.959964)), mathx.normal_ppf(F.lit(0.975)), mathx.log_gamma(F.lit(4.5)), mathx.log_factorial(F.lit(5)), mathx.haversine(F.lit(0.0), F.lit(0.0), F.lit(0.0), F.lit(1.0)), mathx.safe_divide(F.lit(1.0), F.lit(0.0))).first()
    assert tuple(r) == pytest.approx((0.975, 1.96, 2.4537365708, 4.7874917427, 111194.926645, 0.0), abs=1e-3)


def test_text(spark):
    df = spark.createDataFrame([("Élan  123 N. Main ST!!", "Flooded basement!!! water..  again"), (None, None)], "a string, b string")
    r = df.select(text.without_accents(F.col("a")), text.normalize_address(F.col("a")), text.normalize_description(F.col("b")), text.flood_keywords(F.col("b")), text.text_digest(F.col("b"))).collect()
    assert r[0][0] == "Elan  123 N. Main ST!!" and r[0][2] == "flooded basement! water. again" and r[0][3] == ["flood", "flooded"] and len(r[0][4]) == 12
    assert r[1][0] is None and r[1][2] is None


def test_shortest_paths_and_solver(spark):
    e = spark.createDataFrame([(1, 2, 1.0), (2, 3, 1.0), (1, 3, 5.0), (4, 1, 1.0)], "src long, dst long, weight double")
    assert {tuple(r) for r in graph.distances(e, spark.createDataFrame([(1,)], "node long")).collect()} == {(1, 0.0), (2, 1.0), (3, 2.0)}
    m = spark.createDataFrame([(0, 0, 4.0), (0, 1, 1.0), (1, 0, 1.0), (1, 1, 3.0)], "i long, j long, a double")
    b = spark.createDataFrame([(0, 1.0), (1, 2.0)], "i long, x double")
    x = {r.i: r.x for r in solve.conjugate_gradients(m, b).x.collect()}
    assert (x[0], x[1]) == pytest.approx((1 / 11, 7 / 11))


def test_windows_of_a_table(spark):
    df = spark.createDataFrame([(100,), (3_700,), (3_800,), (9_000,), (None,)], "s long").withColumn("ts", F.timestamp_seconds("s"))
    got = [(int(r.window_start.timestamp()), r.n) for r in bins.windows_of(df, "ts", 30).orderBy("window_start").collect()]
    assert got == [(0, 1), (1800, 0), (3600, 2), (5400, 0), (7200, 0), (9000, 1)] and bins.windows_of(df.limit(0), "ts", 30).count() == 0


def test_geocode_by_parts_of_names(spark):
    places = [("Ash", 1.0, 2.0, 0.5), ("Ashton Gate", 3.0, 4.0, 0.9), ("X", 5.0, 6.0, 0.4), ("Unsure", 7.0, 8.0, 0.1), ("", 0.0, 0.0, 1.0), ("Ashe", 9.0, 9.0, 0.5)]
    g = spark.createDataFrame(places, "name string, place_lat double, place_lon double, place_confidence double")
    asked = ["12 ASHTON gate, north", "near Washington", "Exit 5", "unsure lane", "", None, "Ashes", "Ashes"]
    df = spark.createDataFrame([(a, 1) for a in asked], "address string, extra int")
    got = sorted(((r.address or "-", r.place) for r in match.geocode(df, g, "address").collect()), key=str)
    want = [(a or "-", max(((c, -len(n), n) for n, _, _, c in places if n and c >= 0.3 and a and n.lower() in a.lower()), default=(0, 0, None))[2]) for a in asked]
    assert got == sorted(want, key=str) and ("Ashes", "Ash") in got
    assert {r.place for r in match.geocode(df, g.limit(0), "address").collect()} == {None}


def test_ridge(spark):
    df = spark.range(200).select((F.col("id") % 7).cast("double").alias("a"), (F.col("id") % 5).cast("double").alias("b")).withColumn("y", F.col("a") * 2 + F.col("b") * 0.5)
    assert bayes.solve_ridge(bayes.ridge_gram(df, ["a", "b"], "y"), 2, 1e-6) == pytest.approx([2.0, 0.5], abs=1e-4)


def test_model_hook(spark):
    df = spark.range(5).withColumn("x", F.col("id") * 2.0)
    assert rows(learning.score_batches(df, lambda pdf: pdf["x"] + 1, ["x"], "y").agg(F.sum("y"))) == [(25.0,)]


def test_sources_and_sinks(spark, tmp_path):
    (tmp_path / "a.csv").write_text("time,rain\n2024-01-01,1.5\nbad,x\n")
    (tmp_path / "b.json").write_text('[{"time": "2024-01-02", "rain": "2"}, {"time": "2024-01-03", "rain": "3"}]')
    (tmp_path / "c.ndjson").write_text('{"time": "2024-01-04", "rain": "4"}\n')
    df = readers.read_gauges(spark, [str(tmp_path / x) for x in ("a.csv", "b.json", "c.ndjson")], "cm")
    assert df.count() == 5 and df.agg(F.sum("value")).first()[0] == 105.0 and df.where("ts is null").count() == 1
    with pytest.raises(ValueError):
        readers.read_table(spark, "x.xls")
    boxes = spark.createDataFrame([(-122.4, 47.5, -121.9, 48.1), (-122.1, 48.0, -121.5, 48.5), (None, 0.0, 1.0, 1.0), (3.0, 0.0, 2.0, 1.0)], "w double, s double, e double, n double")
    assert {tuple(r) for r in readers.tiles(boxes, "w", "s", "e", "n").collect()} == {(47, -123), (47, -122), (48, -123), (48, -122)}
    g = readers.geojson_box(spark.createDataFrame([('{"coordinates": [[[1.5, 2], [3, -4], [0, 0]]]}',)], "j string"), "j").first()
    assert (g.west, g.south, g.east, g.north) == (0.0, -4.0, 3.0, 2.0)
    cells = grid.cell_boxes(readers.synthetic_terrain(spark, 2, 3), 0.0, 1.0, 0.1, 0.1)
    writers.write_geojson(cells, str(tmp_path / "g"), ["z"])
    assert spark.read.json(str(tmp_path / "g")).where("geometry.type = 'Polygon'").count() == 6
    writers.write_fields(cells, str(tmp_path / "f"), "r")
    assert spark.read.parquet(str(tmp_path / "f")).where("r = 1").count() == 3
    assert writers.file_digests(spark, str(tmp_path / "a.csv")).first().length == 31
    assert readers.synthetic_reports(spark, 100, 1, 0, 0, 1, 1).where("lon between 0 and 1").count() == 100
    scans = spark.createDataFrame([(t, x, r) for t, r in ((0, 1.0), (60, None), (120, 500.0), (600, 1.0)) for x in (1, 2)], "s long, longitude int, rain_rate double").withColumn("time", F.timestamp_seconds("s"))
    got = {r.s: (r.reliability, r.missing_scan, r.temporal_gap) for r in readers.read_cube(scans).collect()}
    assert got == {0: (0.9, False, False), 60: (0.0, True, False), 120: (0.5, False, False), 600: (0.9, False, True)}


def test_quantiles_by_narrowing(spark):
    """Exact quantiles of heavy tails, ties, one value, none, and values one step apart."""
    import numpy as np

    from tidewatch.operators.scalars import quantiles

    rng = np.random.default_rng(3)
    columns = [rng.standard_cauchy(3000), np.repeat([1.0, 2.0, 2.0, 9.0], 50), np.array([4.0]), np.array([1.0, np.nextafter(1.0, 2.0), 1e300, -1e300]), np.r_[np.full(500, 7.0), rng.exponential(1e-9, 500)]]
    for x in columns:
        df = spark.createDataFrame([(float(v),) for v in x] + [(None,)], "v double").repartition(3)
        levels = {"a": 0.0, "b": 0.13, "c": 0.5, "e": 0.905, "f": 1.0}
        row = quantiles(df, "v", **levels).first()
        for name, p in levels.items():
            assert row[name] == pytest.approx(np.quantile(x, p), rel=1e-12, abs=1e-300), (name, len(x))
    assert quantiles(spark.createDataFrame([], "v double"), "v", m=0.5).first()["m"] is None


def test_ranked_values(spark):
    import numpy as np

    from tidewatch.operators.scalars import ranked

    x = np.random.default_rng(4).integers(0, 40, 500)
    rows = ranked(spark.createDataFrame([(int(v),) for v in x], "x int"), "x").collect()
    for r in rows:
        assert (r.n, r.before, r.dense, r.n_all, r.n_values) == ((x == r.v).sum(), (x < r.v).sum(), len(set(x[x < r.v])), 500, len(set(x)))


def test_mixture(spark):
    """Two clear groups are found, and two components fit better than one."""
    import numpy as np

    from tidewatch.operators.calibrate import fit_mixture

    rng = np.random.default_rng(5)
    x = np.r_[rng.normal(0, 1, 600), rng.normal(8, 0.5, 400)]
    df = spark.createDataFrame([(float(v),) for v in x], "x double")
    one, two = fit_mixture(df, "x", 1), fit_mixture(df, "x", 2)
    assert one["means"][0] == pytest.approx(x.mean()) and one["variances"][0] == pytest.approx(x.var(), rel=1e-4)
    assert sorted(two["means"]) == pytest.approx([x[:600].mean(), x[600:].mean()], abs=0.05) and sorted(two["weights"]) == pytest.approx([0.4, 0.6], abs=0.01)
    assert two["bic"] < one["bic"] and fit_mixture(df.where("false"), "x")["n"] == 0


def test_blur(spark):
    """Against a plain mirrored convolution, for rasters smaller than the kernel, too."""
    import numpy as np

    from tidewatch.operators.grid import blur

    rng = np.random.default_rng(6)
    for h, w, sigma in ((7, 5, 1.0), (3, 12, 1.9)):
        z = rng.normal(0, 1, (h, w))
        reach = int(4 * sigma + 0.5)
        k = np.exp(-0.5 * (np.arange(-reach, reach + 1) / sigma) ** 2)
        k /= k.sum()
        soft = z
        for axis in (0, 1):
            padded = np.pad(soft, [(reach, reach) if a == axis else (0, 0) for a in (0, 1)], mode="symmetric")
            soft = np.apply_along_axis(lambda v: np.convolve(v, k, "valid"), axis, padded)
        df = spark.createDataFrame([(r, q, h, w, float(z[r, q])) for r in range(h) for q in range(w)], "r long, q long, h long, w long, z double")
        got = {(r.r, r.q): r.blurred for r in blur(df, "z", sigma).collect()}
        assert len(got) == h * w and all(abs(got[r, q] - soft[r, q]) < 1e-9 for r, q in got)


def test_nearest_neighbors_far_apart(spark):
    """Scattered points find all their neighbours, however far the cells must grow."""
    import numpy as np

    from tidewatch.operators.match import nearest_neighbors

    rng = np.random.default_rng(7)
    p = np.r_[rng.normal(0, 1, (25, 2)), rng.normal(400, 90, (5, 2))]
    df = spark.createDataFrame([(i, float(a), float(b)) for i, (a, b) in enumerate(p)], "k long, x double, y double")
    far = np.hypot(p[:, None, 0] - p[None, :, 0], p[:, None, 1] - p[None, :, 1])
    got = {}
    for r in nearest_neighbors(df, "k", "x", "y", 4, 0.5).collect():
        got.setdefault(r.src, []).append((r.rank, r.dst))
    for i in range(len(p)):
        want = [j for j in np.argsort(far[i], kind="stable") if j != i][:4]
        assert [j for _, j in sorted(got[i])] == want


def test_accents_of_few_texts_at_a_time(spark):
    """Whole texts go to Python by hundreds, not as Arrow batches of ten thousand, and only where accents can be."""
    import unicodedata

    texts = [None, "", "plain", "caf\u00e9", "\u0301", "\ufb01n \u00bd", "\ud55c\uae00", "a\u0323\u0307b", "\U0001d400\U0001f600", "\u00c5\u212b stra\u00dfe"]
    df = spark.createDataFrame([(i, t) for i, t in enumerate(texts * 150)], "i long, t string")
    got = df.select("i", "t", text.without_accents(F.col("t")).alias("o"))
    for r in got.collect():
        assert r.o == (None if r.t is None else "".join(c for c in unicodedata.normalize("NFKD", r.t) if not unicodedata.combining(c)))
    plan = got._jdf.queryExecution().executedPlan().toString()
    assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan


def test_near_groups_by_plain_greedy(spark, sf_dir):
    """Groups of near reports as the rule reads: in time order, a free report takes the free ones near it."""
    from tidewatch import registry
    from tidewatch.operators import match
    from tidewatch.sources.tables import reports

    rows = reports(spark, sf_dir)
    near, when = {}, {r.event_id: r.ts for r in rows.where("ts is not null").collect()}
    for r in match.nearby_pairs(rows, "event_id", "ts", "lat", "lon", 6, 100).collect():
        near.setdefault(r.a, set()).add(r.b)
        near.setdefault(r.b, set()).add(r.a)
    taken, want = set(), set()
    for k in sorted(near, key=lambda k: (when[k], k)):
        members = {m for m in near[k] - taken if (when[m], m) > (when[k], k)} if k not in taken else set()
        if members:
            taken |= members | {k}
            want |= {(k, k)} | {(m, k) for m in members}
    assert {(r.k, r.anchor) for r in registry.queries()["near_groups"](spark, sf_dir).collect()} == want


def test_file_digests(spark, sf_dir):
    import hashlib
    from pathlib import Path

    from tidewatch import registry

    data = Path(f"{sf_dir}/nation.parquet").read_bytes()
    r = registry.queries()["file_digests"](spark, sf_dir).first()
    assert (r.n_files, r.length, r.sha256) == (1, len(data), hashlib.sha256(data).hexdigest())
