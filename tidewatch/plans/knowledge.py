"""Queries of evidence, logic, geometry, catalogs, model metrics and validation."""

from __future__ import annotations

from pyspark.sql import functions as F

from tidewatch.functions import geometry, logic, mathx
from tidewatch.functions.mathx import d
from tidewatch.operators import catalog, evidence, learning, ranking
from tidewatch.plans.inference import POST, post
from tidewatch.registry import query
from tidewatch.sources.tables import table

R6 = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)


def r6(x: str) -> str:
    return f"round({x} + 1e-8::DOUBLE, 6)"


MASSES = """m1 AS (SELECT n_nationkey AS g, UNNEST([1, 3, 7]) AS s, UNNEST([0.5::DOUBLE - n_nationkey / 100.0::DOUBLE, 0.3::DOUBLE, 0.2::DOUBLE + n_nationkey / 100.0::DOUBLE]) AS m FROM nation),
m2 AS (SELECT n_nationkey AS g, UNNEST([2, 5, 7]) AS s, UNNEST([0.4::DOUBLE, 0.25::DOUBLE, 0.35::DOUBLE]) AS m FROM nation),
x AS (SELECT m1.g, m1.s & m2.s AS s, SUM(m1.m * m2.m) AS p FROM m1 JOIN m2 USING (g) GROUP BY 1, 2), k AS (SELECT g, SUM(CASE WHEN s = 0 THEN p ELSE 0 END) AS k FROM x GROUP BY 1), c AS (SELECT g, s, p / (1 - k) AS m, k FROM x JOIN k USING (g) WHERE s <> 0)"""


def masses(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey")
    x = F.col("n_nationkey") / 100.0
    made = lambda sets, ms: n.select("n_nationkey", F.inline(F.array(*[F.struct(F.lit(s).cast("long").alias("set"), m.alias("mass")) for s, m in zip(sets, ms)])))
    return evidence.dempster(made((1, 3, 7), (d(0.5) - x, d(0.3), d(0.2) + x)), made((2, 5, 7), (d(0.4), d(0.25), d(0.35))), ["n_nationkey"])


@query("dempster", f"WITH {MASSES} SELECT g AS n_nationkey, CAST(s AS BIGINT) AS set, {r6('m')} AS mass, {r6('k')} AS conflict FROM c")
def dempster(spark, sf_dir):
    return masses(spark, sf_dir).select("n_nationkey", "set", R6("mass"), R6("conflict"))


@query("belief", f"WITH {MASSES} SELECT a.g AS n_nationkey, CAST(a.s AS BIGINT) AS set, {r6('SUM(CASE WHEN b.s & a.s = b.s THEN b.m ELSE 0 END)')} AS belief, {r6('SUM(CASE WHEN b.s & a.s <> 0 THEN b.m ELSE 0 END)')} AS plausibility FROM c a JOIN c b USING (g) GROUP BY 1, 2")
def belief(spark, sf_dir):
    return evidence.belief_and_plausibility(masses(spark, sf_dir), ["n_nationkey"]).select("n_nationkey", "set", R6("belief"), R6("plausibility"))


@query("pignistic", f"WITH {MASSES}, e AS (SELECT UNNEST([0, 1, 2]) AS e) SELECT g AS n_nationkey, e AS element, {r6('SUM(m / bit_count(s))')} AS probability FROM c, e WHERE (s >> e) & 1 = 1 GROUP BY 1, 2")
def pignistic(spark, sf_dir):
    return evidence.pignistic(masses(spark, sf_dir), ["n_nationkey"], 3).select("n_nationkey", "element", R6("probability"))


@query("logodds_fusion", f"WITH p AS (SELECT l_orderkey, 0.05::DOUBLE + l_discount * 5 AS p FROM lineitem) SELECT l_orderkey, {r6('1 / (1 + exp(-SUM(ln(p / (1 - p)))))')} AS by_odds, {r6('exp(SUM(ln(p)))')} AS by_product FROM p GROUP BY 1")
def logodds_fusion(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", (d(0.05) + F.col("l_discount") * 5).alias("p"))
    return evidence.combined_odds(li, "p", ["l_orderkey"]).select("l_orderkey", R6("by_odds"), R6("by_product"))


@query("fuzzy_ops", """WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_discount * 10 AS a, l_tax * 10 AS b FROM lineitem) SELECT l_orderkey, l_linenumber, round(GREATEST(0, a + b - 1), 6) AS l_and, round(LEAST(1, a + b), 6) AS l_or, round(LEAST(1, 1 - a + b), 6) AS l_imp,
 round(LEAST(a, b), 6) AS g_and, round(GREATEST(a, b), 6) AS g_or, round(CASE WHEN a <= b THEN 1.0::DOUBLE ELSE b END, 6) AS g_imp, round(a * b, 6) AS p_and, round(a + b - a * b, 6) AS p_or, round(CASE WHEN a <= b THEN 1.0::DOUBLE ELSE b / a END, 6) AS p_imp, round(1 - a, 6) AS neg FROM p""")  # fmt: skip
def fuzzy_ops(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_discount") * 10).alias("a"), (F.col("l_tax") * 10).alias("b"))
    a, b = F.col("a"), F.col("b")
    ops = {"l_and": logic.lukasiewicz_and(a, b), "l_or": logic.lukasiewicz_or(a, b), "l_imp": logic.lukasiewicz_implies(a, b), "g_and": logic.godel_and(a, b), "g_or": logic.godel_or(a, b), "g_imp": logic.godel_implies(a, b), "p_and": logic.product_and(a, b), "p_or": logic.product_or(a, b), "p_imp": logic.product_implies(a, b), "neg": logic.negate(a)}
    return p.select("l_orderkey", "l_linenumber", *[F.round(c, 6).alias(n) for n, c in ops.items()])


@query("utilities", f"WITH x AS (SELECT o_orderkey, o_totalprice / 1000 AS x FROM orders) SELECT o_orderkey, {r6('(power(x, -1.0::DOUBLE) - 1) / -1.0::DOUBLE')} AS crra, {r6('ln(x)')} AS crra_log, {r6('-exp(-0.01::DOUBLE * x) / 0.01::DOUBLE')} AS cara, {r6('CASE WHEN x >= 100 THEN power(x - 100, 0.88::DOUBLE) ELSE -2.25::DOUBLE * power(100 - x, 0.88::DOUBLE) END')} AS prospect, {r6('0.6::DOUBLE * x / 500 + 0.4::DOUBLE * (1 - x / 600)')} AS multi FROM x")
def utilities(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", (F.col("o_totalprice") / 1000).alias("x"))
    x = F.col("x")
    made = {"crra": logic.crra(x, 2.0), "crra_log": logic.crra(x, 1.0), "cara": logic.cara(x, 0.01), "prospect": logic.prospect(x, reference=100.0), "multi": logic.multi_attribute([x / 500, d(1) - x / 600], [0.6, 0.4])}
    return o.select("o_orderkey", *[c.alias(n) for n, c in made.items()]).select("o_orderkey", *[R6(n) for n in made])


@query("probability_weights", f"WITH p AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, 0.01::DOUBLE + l_discount * 9 AS p FROM lineitem) SELECT l_orderkey, l_linenumber, {r6('power(p, 0.61::DOUBLE) / power(power(p, 0.61::DOUBLE) + power(1 - p, 0.61::DOUBLE), 1 / 0.61::DOUBLE)')} AS weighted FROM p")
def probability_weights(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (d(0.01) + F.col("l_discount") * 9).alias("p"))
    return li.select("l_orderkey", "l_linenumber", logic.weighted_probability(F.col("p")).alias("weighted")).select("l_orderkey", "l_linenumber", R6("weighted"))


@query("safe_numerics", f"WITH x AS (SELECT c_custkey, c_acctbal AS x, (c_custkey % 5 - 2)::DOUBLE AS y FROM customer) SELECT c_custkey, {r6('CASE WHEN y = 0 THEN 0.0::DOUBLE ELSE x / y END')} AS quotient, {r6('sqrt(GREATEST(x, 0))')} AS root, {r6('exp(LEAST(x / 1000, 2))')} AS power, {r6('ln(GREATEST(x, 1e-3::DOUBLE))')} AS logarithm, {r6('ln(1 + exp(-abs(y))) + GREATEST(y, 0)')} AS softplus FROM x")
def safe_numerics(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select("c_custkey", F.col("c_acctbal").alias("x"), (F.col("c_custkey") % 5 - 2).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    made = {"quotient": mathx.safe_divide(x, y), "root": mathx.safe_sqrt(x), "power": mathx.safe_exp(x / 1000, 2.0), "logarithm": mathx.safe_log(x, 1e-3), "softplus": mathx.softplus(y)}
    return c.select("c_custkey", *[v.alias(n) for n, v in made.items()]).select("c_custkey", *[R6(n) for n in made])


#: Rings of five corners around (n_nationkey, n_regionkey).
RING = [(0.0, 0.0), (4.0, 0.5), (5.0, 3.0), (2.0, 5.0), (-1.0, 2.0)]
SHOELACE = " + ".join(f"({x1} * {y2} - {x2} * {y1})" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))


def rings(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", (F.col("n_regionkey") + 1.0).alias("k"))
    return n.withColumn("ring", F.array(*[F.struct((F.col("k") * x).alias("x"), (F.col("k") * y).alias("y")) for x, y in RING]))


@query("shoelace", f"SELECT n_nationkey, {r6(f'power(n_regionkey + 1.0::DOUBLE, 2) * ({SHOELACE})::DOUBLE / 2')} AS area FROM nation")
def shoelace(spark, sf_dir):
    return rings(spark, sf_dir).select("n_nationkey", geometry.signed_area(F.col("ring")).alias("area")).select("n_nationkey", R6("area"))


CX = " + ".join(f"({x1} + {x2}) * ({x1} * {y2} - {x2} * {y1})" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))
CY = " + ".join(f"({y1} + {y2}) * ({x1} * {y2} - {x2} * {y1})" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))


@query("polygon_centroid", f"SELECT n_nationkey, {r6(f'(n_regionkey + 1) * ({CX})::DOUBLE / (3 * ({SHOELACE})::DOUBLE)')} AS cx, {r6(f'(n_regionkey + 1) * ({CY})::DOUBLE / (3 * ({SHOELACE})::DOUBLE)')} AS cy FROM nation")
def polygon_centroid(spark, sf_dir):
    c = rings(spark, sf_dir).select("n_nationkey", geometry.centroid(F.col("ring")).alias("c"))
    return c.select("n_nationkey", F.col("c.x").alias("cx"), F.col("c.y").alias("cy")).select("n_nationkey", R6("cx"), R6("cy"))


EDGES = ", ".join(f"({x1}::DOUBLE, {y1}::DOUBLE, {x2}::DOUBLE, {y2}::DOUBLE)" for (x1, y1), (x2, y2) in zip(RING, [*RING[1:], RING[0]]))


@query("point_in_polygon", f"WITH e AS (SELECT * FROM (VALUES {EDGES}) e(x1, y1, x2, y2)), p AS (SELECT DISTINCT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_quantity / 8 - 0.51::DOUBLE AS x, l_discount * 50 + 0.013::DOUBLE AS y FROM lineitem) SELECT l_orderkey, l_linenumber, COUNT(*) FILTER (WHERE (y1 > y) <> (y2 > y) AND x < (x2 - x1) * (y - y1) / (y2 - y1) + x1) % 2 = 1 AS inside, {r6('MIN(sqrt(power(x - x1 - LEAST(GREATEST(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) * (x2 - x1), 2) + power(y - y1 - LEAST(GREATEST(((x - x1) * (x2 - x1) + (y - y1) * (y2 - y1)) / (power(x2 - x1, 2) + power(y2 - y1, 2)), 0), 1) * (y2 - y1), 2)))')} AS distance FROM p, e GROUP BY 1, 2, x, y")
def point_in_polygon(spark, sf_dir):
    p = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), (F.col("l_quantity") / 8 - 0.51).alias("x"), (F.col("l_discount") * 50 + 0.013).alias("y")).distinct()
    ring = F.array(*[F.struct(d(x).alias("x"), d(y).alias("y")) for x, y in RING])
    out = p.select("l_orderkey", "l_linenumber", geometry.contains_point(ring, F.col("x"), F.col("y")).alias("inside"), F.abs(geometry.distance_to_boundary(ring, F.col("x"), F.col("y"))).alias("distance"))
    return out.select("l_orderkey", "l_linenumber", "inside", R6("distance"))


@query("orientation", f"SELECT s_suppkey, CAST(sign((0 - x) * (4 - y) - (0 - y) * (3 - x)) AS INT) AS turn, {r6('-((x) * (x - 4) + (y) * (y - 3)) * 12')} AS circle FROM (SELECT s_suppkey, s_nationkey / 4.0::DOUBLE + 0.1::DOUBLE AS x, (s_suppkey % 7)::DOUBLE AS y FROM supplier)")
def orientation(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_nationkey") / 4.0 + 0.1).alias("x"), (F.col("s_suppkey") % 7).cast("double").alias("y"))
    x, y = F.col("x"), F.col("y")
    return s.select("s_suppkey", geometry.orient2d(d(0), d(0), d(3), d(4), x, y).alias("turn"), geometry.incircle2d(d(0), d(0), d(4), d(0), d(0), d(3), x, y).alias("circle")).select("s_suppkey", "turn", R6("circle"))


CATALOG = "cat AS (SELECT s_suppkey AS id, CASE s_suppkey % 3 WHEN 0 THEN 'dem' WHEN 1 THEN 'rainfall' ELSE 'complaints' END AS kind, s_nationkey AS city, s_suppkey % 4 AS rank, s_acctbal / 100 AS quality, TIMESTAMP '2024-01-01' + INTERVAL (s_suppkey % 20) DAY AS d0, TIMESTAMP '2024-01-10' + INTERVAL (s_suppkey % 25) DAY AS d1 FROM supplier)"


def datasets(spark, sf_dir):
    s = table(spark, sf_dir, "supplier")
    kind = F.when(F.col("s_suppkey") % 3 == 0, "dem").when(F.col("s_suppkey") % 3 == 1, "rainfall").otherwise("complaints")
    at = lambda day, k: F.timestamp_seconds(F.unix_timestamp(F.lit(day), "yyyy-MM-dd") + F.col("s_suppkey") % k * 86400)
    return s.select(F.col("s_suppkey").alias("id"), kind.alias("kind"), F.col("s_nationkey").alias("city"), (F.col("s_suppkey") % 4).alias("rank"), (F.col("s_acctbal") / 100).alias("quality"), at("2024-01-01", 20).alias("d0"), at("2024-01-10", 25).alias("d1"))


@query("registry_best", f"WITH {CATALOG} SELECT kind, id FROM cat QUALIFY ROW_NUMBER() OVER (PARTITION BY kind ORDER BY rank DESC, quality DESC, d1 DESC, id) = 1")
def registry_best(spark, sf_dir):
    return catalog.best_dataset(datasets(spark, sf_dir), "kind", F.col("rank"), "quality", "d1", "id").select("kind", "id")


@query("registry_query", f"WITH {CATALOG} SELECT id FROM cat WHERE kind = 'dem' AND rank = 2")
def registry_query(spark, sf_dir):
    from tidewatch.operators.clean import where_all

    return where_all(datasets(spark, sf_dir), kind="dem", rank=2, city=None).select("id")


@query("coverage_overlap", f"WITH {CATALOG}, o AS (SELECT id, GREATEST(epoch(LEAST(d1, TIMESTAMP '2024-01-22')) - epoch(GREATEST(d0, TIMESTAMP '2024-01-08')), 0) / (14 * 86400.0::DOUBLE) AS f, d0 <= TIMESTAMP '2024-01-08' AND d1 >= TIMESTAMP '2024-01-22' AS whole FROM cat) SELECT id, {r6('f')} AS overlap, CASE WHEN f >= 0.9 THEN 'PASS' WHEN f >= 0.7 THEN 'WARN' ELSE 'FAIL' END AS status, whole FROM o")
def coverage_overlap(spark, sf_dir):
    t0, t1 = F.to_timestamp(F.lit("2024-01-08")), F.to_timestamp(F.lit("2024-01-22"))
    x = datasets(spark, sf_dir).withColumn("overlap", catalog.overlap_fraction(F.col("d0"), F.col("d1"), t0, t1)).withColumn("whole", catalog.covers(F.col("d0"), F.col("d1"), t0, t1, F.lit(False)))
    return x.select("id", R6("overlap"), catalog.graded(F.col("overlap"), catalog.TEMPORAL).alias("status"), "whole")


@query("spatial_overlap", f"SELECT n_nationkey, {r6('GREATEST(LEAST(n_regionkey + 2.0::DOUBLE, 5) - GREATEST(n_regionkey::DOUBLE, 1), 0) * GREATEST(LEAST(n_nationkey / 5.0::DOUBLE + 2, 4) - GREATEST(n_nationkey / 5.0::DOUBLE, 0), 0) / 16')} AS share FROM nation")
def spatial_overlap(spark, sf_dir):
    n = table(spark, sf_dir, "nation")
    a = [F.col("n_regionkey").cast("double"), F.col("n_nationkey") / 5.0, F.col("n_regionkey") + d(2), F.col("n_nationkey") / 5.0 + 2]
    return n.select("n_nationkey", catalog.box_overlap_area(a, [d(1), d(0), d(5), d(4)]).alias("share")).select("n_nationkey", R6("share"))


@query("missing_required", f"WITH {CATALOG} SELECT k AS kind FROM (VALUES ('dem'), ('rainfall'), ('complaints')) v(k) WHERE k NOT IN (SELECT kind FROM cat WHERE quality > 99)")
def missing_required(spark, sf_dir):
    return catalog.missing_required(datasets(spark, sf_dir).where("quality > 99"), "kind", "full")


RUNS = "runs AS (SELECT city, BOOL_OR(kind = 'dem') AS has_dem, BOOL_OR(kind = 'rainfall') AS has_rainfall, BOOL_OR(kind = 'complaints') AS has_complaints, COUNT(*) FILTER (WHERE quality < 0) AS n_fail, AVG(quality) AS q FROM cat GROUP BY 1)"


def runs(spark, sf_dir):
    has = lambda k: F.bool_or(F.col("kind") == k).alias(f"has_{k}")
    return datasets(spark, sf_dir).groupBy("city").agg(has("dem"), has("rainfall"), has("complaints"), F.count_if(F.col("quality") < 0).alias("n_fail"), F.avg("quality").alias("q"))


@query("gate_decision", f"WITH {CATALOG}, {RUNS} SELECT city, CASE WHEN has_dem AND has_rainfall AND has_complaints AND n_fail = 0 THEN 'FULL' WHEN has_dem AND has_rainfall THEN 'DEGRADED' ELSE 'ABORT' END AS gate FROM runs")
def gate_decision(spark, sf_dir):
    return catalog.gate(runs(spark, sf_dir)).select("city", "gate")


@query("gate_factors", f"WITH {CATALOG}, {RUNS} SELECT city, CASE WHEN has_dem AND has_rainfall AND has_complaints AND n_fail = 0 THEN 1.0::DOUBLE ELSE round_even((CASE WHEN NOT has_complaints THEN 1.2::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN q < 50 THEN 1.25::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN n_fail > 0 THEN 1.4::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN q < 45 THEN 1.15::DOUBLE ELSE 1.0::DOUBLE END) * (CASE WHEN NOT has_dem THEN 1.1::DOUBLE ELSE 1.0::DOUBLE END), 2) END AS factor FROM runs")
def gate_factors(spark, sf_dir):
    flags = {"missing_complaints": ~F.col("has_complaints"), "low_quality_rainfall": F.col("q") < 50, "low_quality_dem": F.col("n_fail") > 0, "low_quality_complaints": F.col("q") < 45, "missing_dem": ~F.col("has_dem")}
    return catalog.gate(runs(spark, sf_dir)).select("city", catalog.uncertainty_factor(flags, F.col("gate")).alias("factor"))


@query("integrity", f"WITH {CATALOG}, s AS (SELECT city, kind, CASE WHEN quality >= 70 THEN 'PASS' WHEN quality >= 50 THEN 'WARN' ELSE 'FAIL' END AS st, 1.0::DOUBLE + rank AS w FROM cat) SELECT city, {r6('SUM(CASE st WHEN $$PASS$$ THEN 100.0::DOUBLE WHEN $$WARN$$ THEN 60.0::DOUBLE ELSE 0.0::DOUBLE END * w) / SUM(w)')} AS integrity, CASE WHEN BOOL_OR(st = 'FAIL') THEN 'FAIL' WHEN BOOL_OR(st = 'WARN') THEN 'WARN' ELSE 'PASS' END AS overall FROM s GROUP BY 1")
def integrity(spark, sf_dir):
    c = datasets(spark, sf_dir).withColumn("status", catalog.graded(F.col("quality"), catalog.QUALITY)).withColumn("w", F.col("rank") + d(1))
    return catalog.integrity_score(c, "status", "w", ["city"]).join(catalog.worst(c, "status", ["city"]), "city").select("city", R6("integrity"), "overall")


@query("source_score", f"WITH {CATALOG} SELECT id, {r6('0.4::DOUBLE * quality + LEAST(id * 300 / 1000.0::DOUBLE, 30) + 20 * (rank / 4.0::DOUBLE) + CASE WHEN kind = $$complaints$$ THEN 10 ELSE 0 END')} AS score FROM cat")
def source_score(spark, sf_dir):
    s = catalog.source_score(F.col("quality"), F.col("id") * 300, F.col("rank") / 4.0, F.col("kind") == "complaints")
    return datasets(spark, sf_dir).select("id", s.alias("score")).select("id", R6("score"))


@query("provenance_latest", "SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS version, sha256(CAST(l_partkey AS VARCHAR)) AS digest FROM lineitem QUALIFY ROW_NUMBER() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber DESC, sha256(CAST(l_partkey AS VARCHAR)) DESC) = 1")
def provenance_latest(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("version"), F.sha2(F.col("l_partkey").cast("string").cast("binary"), 256).alias("digest"))
    return catalog.latest(li, "l_orderkey", "version").select("l_orderkey", "version", "digest")


MODEL = "mo AS (SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, l_returnflag AS g, l_extendedprice / 10000 AS t, l_quantity / 10 + l_tax AS b, (l_discount - 0.05::DOUBLE) * 10 AS r, 0.5::DOUBLE + l_tax * 10 AS s FROM lineitem)"


def model(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), F.col("l_returnflag").alias("g"), (F.col("l_extendedprice") / 10000).alias("t"), (F.col("l_quantity") / 10 + F.col("l_tax")).alias("b"), ((F.col("l_discount") - 0.05) * 10).alias("r"), (d(0.5) + F.col("l_tax") * 10).alias("s"))


@query("metrics_regression", f"WITH {MODEL} SELECT g, COUNT(*) AS n, {r6('sqrt(AVG(power(t - b, 2)))')} AS rmse, {r6('AVG(abs(t - b))')} AS mae, {r6('1 - SUM(power(t - b, 2)) / (VAR_POP(t) * COUNT(*))')} AS r2, {r6('1 - VAR_POP(t - b) / VAR_POP(t)')} AS explained, {r6('CORR(b, t)')} AS corr FROM mo GROUP BY 1")
def metrics_regression(spark, sf_dir):
    return learning.regression_metrics(model(spark, sf_dir), "b", "t", ["g"]).select("g", "n", *[R6(c) for c in ("rmse", "mae", "r2", "explained", "corr")])


@query("coverage95", f"WITH {MODEL} SELECT {r6('AVG(CASE WHEN abs(t - b) <= 1.959964::DOUBLE * s THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS coverage, {r6('CORR(abs(t - b), s)')} AS error_sigma_corr FROM mo")
def coverage95(spark, sf_dir):
    return learning.coverage(model(spark, sf_dir), "b", "t", "s").select(R6("coverage"), R6("error_sigma_corr"))


@query("decision_stability", f"WITH {MODEL}, w AS (SELECT (b > 3) <> (t > 3) AS w, (b + r > 3) = (t > 3) AS m FROM mo) SELECT COUNT(*) FILTER (WHERE w) AS n_wrong, COUNT(*) FILTER (WHERE w AND m) AS n_mended, {r6('COUNT(*) FILTER (WHERE w AND m) / COUNT(*) FILTER (WHERE w)::DOUBLE')} AS stability FROM w")
def decision_stability(spark, sf_dir):
    return learning.decision_stability(model(spark, sf_dir), "b", "t", "r", 3.0).select("n_wrong", "n_mended", R6("stability"))


@query("ablation", " UNION ALL ".join(f"SELECT '{n}' AS run, {r6(f'sqrt(AVG(power(t - ({p}), 2)))')} AS rmse, {r6(f'AVG(abs(t - ({p})))')} AS mae, {r6(f'1 - SUM(power(t - ({p}), 2)) / (VAR_POP(t) * COUNT(*))')} AS r2 FROM (WITH {MODEL} SELECT * FROM mo)" for n, p in (("base", "b"), ("hybrid", "b + r"), ("residual", "r"))))
def ablation(spark, sf_dir):
    return learning.ablation(model(spark, sf_dir), "b", "r", "t").select("run", R6("rmse"), R6("mae"), R6("r2"))


@query("zscore_check", f"WITH {MODEL}, z AS (SELECT (t - (SELECT AVG(t) FROM mo)) / (SELECT STDDEV_POP(t) FROM mo) AS z FROM mo) SELECT {r6('abs(round(AVG(z), 6))')} AS mean, {r6('STDDEV_POP(z)')} AS std, {r6('MAX(abs(z))')} AS max_abs, TRUE AS ok FROM z")
def zscore_check(spark, sf_dir):
    z = learning.standardized(model(spark, sf_dir), "t", "z")
    return learning.zscore_check(z, "z").select(F.round(F.abs(F.round("mean", 6)) + 1e-8, 6).alias("mean"), R6("std"), R6("max_abs"), "ok")


@query("role_audit", f"WITH {MODEL} SELECT {r6('AVG(CASE WHEN (b > 3) <> (b + r / 5 > 3) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS changed_share, {r6('AVG(abs(r / 5)) / AVG(abs(b))')} AS size_ratio FROM mo")
def role_audit(spark, sf_dir):
    m = model(spark, sf_dir).withColumns({"c": F.col("r") / 5, "x": F.col("b") > 3, "y": F.col("b") + F.col("r") / 5 > 3})
    return learning.role_audit(m, "b", "c", "x", "y").select(R6("changed_share"), R6("size_ratio"))


@query("residual_clip", f"WITH {MODEL}, q AS (SELECT quantile_cont(t - b, 0.01) AS lo, quantile_cont(t - b, 0.99) AS hi FROM mo) SELECT l_orderkey, l_linenumber, {r6('LEAST(GREATEST(t - b, lo), hi)')} AS residual FROM mo, q")
def residual_clip(spark, sf_dir):
    return learning.residual_targets(model(spark, sf_dir), "t", "b").select("l_orderkey", "l_linenumber", R6("residual"))


@query("residual_integrate", f"WITH {MODEL} SELECT l_orderkey, l_linenumber, {r6('CASE WHEN s > 1 THEN b ELSE GREATEST(b + LEAST(GREATEST(r, -0.3::DOUBLE), 0.3::DOUBLE), 0) END')} AS mean, {r6('CASE WHEN s > 1 THEN GREATEST(sqrt(0.7::DOUBLE * s * s + 0.3::DOUBLE * r * r), s * 1.5::DOUBLE) ELSE sqrt(0.7::DOUBLE * s * s + 0.3::DOUBLE * r * r) END')} AS sigma FROM mo")
def residual_integrate(spark, sf_dir):
    m = model(spark, sf_dir)
    out = learning.integrate_residual(F.col("b"), F.col("s"), F.col("r"), F.col("r"), F.col("s") > 1, most=0.3)
    return m.select("l_orderkey", "l_linenumber", *[c.alias(n) for n, c in out.items()]).select("l_orderkey", "l_linenumber", R6("mean"), R6("sigma"))


@query("composite_loss", f"WITH {MODEL}, n AS (SELECT power(b - t, 2) AS e, (ln(GREATEST(s * s, 1e-6::DOUBLE)) + power(t - b, 2) / GREATEST(s * s, 1e-6::DOUBLE)) / 2 AS l FROM mo) SELECT {r6('AVG(e)')} AS mse, {r6('AVG(l)')} AS nll, {r6('10 * AVG(e) + 0.2::DOUBLE * AVG(l)')} AS loss FROM n")
def composite_loss(spark, sf_dir):
    return learning.composite_loss(model(spark, sf_dir), "b", "t", "s").select(R6("mse"), R6("nll"), R6("loss"))


@query("adjacent_rank_loss", f"WITH {MODEL}, p AS (SELECT g, b - LAG(b) OVER (PARTITION BY g ORDER BY t, l_orderkey * 10 + l_linenumber, b) AS s FROM mo) SELECT g, {r6('AVG(GREATEST(0.1::DOUBLE - s, 0)) FILTER (WHERE s IS NOT NULL)')} AS rank_loss FROM p GROUP BY 1")
def adjacent_rank_loss(spark, sf_dir):
    m = model(spark, sf_dir).withColumn("k", F.col("l_orderkey") * 10 + F.col("l_linenumber"))
    w = learning.adjacent_rank_loss(m, "k", "b", "t", ["g"])
    return w.select("g", R6("rank_loss"))


@query("rank_loss", f"""WITH {MODEL}, p AS (SELECT g, l_linenumber, t, b FROM mo), n AS (SELECT g, l_linenumber, COUNT(*) AS n FROM p GROUP BY ALL),
 s AS (SELECT x.g, x.l_linenumber, SUM(GREATEST(0.1::DOUBLE - sign(x.t - y.t) * (x.b - y.b), 0)) AS s FROM p x JOIN p y ON x.g = y.g AND x.l_linenumber = y.l_linenumber GROUP BY ALL)
 SELECT g, l_linenumber, n, {r6('s / n / n')} AS rank_loss FROM s JOIN n USING (g, l_linenumber)""")  # fmt: skip
def rank_loss(spark, sf_dir):
    return ranking.rank_hinge(model(spark, sf_dir), "b", "t", ["g", "l_linenumber"]).select("g", "l_linenumber", "n", R6("rank_loss"))


@query("distance_uncertainty", f"WITH {MODEL}, m AS (SELECT AVG(t) AS mt, VAR_POP(t) AS vt, AVG(b) AS mb, VAR_POP(b) AS vb FROM mo) SELECT l_orderkey, l_linenumber, {r6('0.1::DOUBLE * sqrt((power(t - mt, 2) / (vt + 1e-6::DOUBLE) + power(b - mb, 2) / (vb + 1e-6::DOUBLE)) / 2)')} AS uncertainty FROM mo, m")
def distance_uncertainty(spark, sf_dir):
    return learning.distance_uncertainty(model(spark, sf_dir), ["t", "b"]).select("l_orderkey", "l_linenumber", R6("uncertainty"))


@query("validation_checks", f"WITH {POST} SELECT {r6('STDDEV_POP(sqrt(v1)) / AVG(sqrt(v1))')} AS sigma_cv, {r6('AVG(CASE WHEN sqrt(v1) >= 0.9::DOUBLE * (SELECT quantile_cont(sqrt(v1), 0.9) FROM post) THEN 1.0::DOUBLE ELSE 0.0::DOUBLE END)')} AS undecided_share, {r6('AVG((v0 - v1) / v0) FILTER (WHERE k > 0)')} AS variance_drop, COUNT(*) FILTER (WHERE m1 < 0 OR v1 <= 0) AS n_unphysical FROM post")
def validation_checks(spark, sf_dir):
    from tidewatch.operators.scalars import with_quantiles

    p = with_quantiles(post(spark, sf_dir).withColumn("s", F.sqrt("v1")), "s", q90=0.9)
    return p.agg((F.stddev_pop("s") / F.avg("s")).alias("sigma_cv"), F.avg((F.col("s") >= d(0.9) * F.col("q90")).cast("double")).alias("undecided_share"), F.avg(F.when(F.col("k") > 0, (F.col("v0") - F.col("v1")) / F.col("v0"))).alias("variance_drop"), F.count_if((F.col("m1") < 0) | (F.col("v1") <= 0)).alias("n_unphysical")).select(R6("sigma_cv"), R6("undecided_share"), R6("variance_drop"), "n_unphysical")


@query("observation_impact", f"WITH {POST} SELECT {r6('AVG(abs(m1 - m0)) FILTER (WHERE k > 0)')} AS moved_observed, {r6('AVG(abs(m1 - m0)) FILTER (WHERE k = 0)')} AS moved_else FROM post")
def observation_impact(spark, sf_dir):
    p = post(spark, sf_dir)
    move = F.abs(F.col("m1") - F.col("m0"))
    return p.agg(F.avg(F.when(F.col("k") > 0, move)).alias("moved_observed"), F.avg(F.when(F.col("k") == 0, move)).alias("moved_else")).select(R6("moved_observed"), R6("moved_else"))


@query("temporal_cv", f"WITH {POST}, c AS (SELECT cell, STDDEV_POP(m1) / (AVG(m1) + 1e-9::DOUBLE) AS cv FROM post GROUP BY 1) SELECT {r6('AVG(cv)')} AS temporal_cv, COUNT(*) AS n_cells FROM c")
def temporal_cv(spark, sf_dir):
    c = post(spark, sf_dir).groupBy("cell").agg((F.stddev_pop("m1") / (F.avg("m1") + 1e-9)).alias("cv"))
    return c.agg(F.avg("cv").alias("temporal_cv"), F.count("*").alias("n_cells")).select(R6("temporal_cv"), "n_cells")


@query("extreme_events", "SELECT o_orderkey FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, 0.9) FROM orders)")
def extreme_events(spark, sf_dir):
    from tidewatch.operators.scalars import with_quantiles

    o = with_quantiles(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice", q90=0.9)
    return o.where("o_totalprice >= q90").select("o_orderkey")


@query("lead_time", f"WITH {POST}, a AS (SELECT cell, ARG_MIN(t, (-m1, t)) AS ps, SUM(k) AS n FROM post GROUP BY 1), b AS (SELECT cell, ARG_MIN(t, (-k, t)) AS pc FROM post GROUP BY 1) SELECT cell, CASE WHEN n > 0 THEN pc - ps END AS lead FROM a JOIN b USING (cell)")
def lead_time(spark, sf_dir):
    first = lambda c: F.max(F.struct(F.col(c).alias("v"), (-F.col("t")).alias("m")))
    p = post(spark, sf_dir).groupBy("cell").agg(first("m1").alias("a"), first("k").alias("b"), F.sum("k").alias("n"))
    return p.select("cell", F.when(F.col("n") > 0, F.col("a.m") - F.col("b.m")).cast("long").alias("lead"))


@query("sampling_locations", f"WITH {POST}, v AS (SELECT cell, AVG(v1) AS v FROM post GROUP BY 1) SELECT cell FROM v ORDER BY round(v, 9) DESC, cell LIMIT 5")
def sampling_locations(spark, sf_dir):
    v = post(spark, sf_dir).groupBy("cell").agg(F.round(F.avg("v1"), 9).alias("v"))
    return v.orderBy(F.desc("v"), "cell").limit(5).select("cell")


@query("error_propagation", f"SELECT l_orderkey, {r6('SUM(l_quantity)')} AS total, {r6('sqrt(SUM(power(l_tax * 10, 2)))')} AS error FROM lineitem GROUP BY 1")
def error_propagation(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem")
    return li.groupBy("l_orderkey").agg(F.sum("l_quantity").alias("total"), F.sqrt(F.sum(F.pow(F.col("l_tax") * 10, 2))).alias("error")).select("l_orderkey", R6("total"), R6("error"))
