"""Queries of models that are fitted by rounds of sums: mixtures, regressions with uneven noise, experts, local processes,
and the choice of a transform."""

from __future__ import annotations

import numpy as np
from pyspark.sql import functions as F

from tidewatch.operators import calibrate, mixtures
from tidewatch.registry import query
from tidewatch.sources.tables import table

SEEDS, ROUNDS = ((20.0, 2.0), (60.0, 7.0)), 6


def _rounds() -> str:
    """Expectation and maximisation, one round after the other, of two normal distributions with axes of their own."""
    steps = ["x AS MATERIALIZED (SELECT ROW_NUMBER() OVER () AS id, l_extendedprice / 1000 AS a, l_quantity / 5 AS b FROM lineitem)", "tot AS (SELECT VAR_POP(a) AS va, VAR_POP(b) AS vb, COUNT(*) AS n FROM x)"]
    steps.append("p0 AS (" + " UNION ALL ".join(f"SELECT {j} AS k, 0.5::DOUBLE AS w, {a}::DOUBLE AS ma, {b}::DOUBLE AS mb, va + 1e-6::DOUBLE AS va, vb + 1e-6::DOUBLE AS vb FROM tot" for j, (a, b) in enumerate(SEEDS)) + ")")
    for i in range(ROUNDS):
        steps.append(f"d{i} AS (SELECT id, a, b, k, ln(w) - 0.5::DOUBLE * (power(a - ma, 2) / va + power(b - mb, 2) / vb + ln(va) + ln(vb)) - ln(2 * pi()) AS l FROM x, p{i})")
        steps.append(f"r{i} AS (SELECT *, exp(l - MAX2) / SUM(exp(l - MAX2)) OVER o AS r FROM (SELECT *, MAX(l) OVER (PARTITION BY id) AS MAX2 FROM d{i}) WINDOW o AS (PARTITION BY id))")
        steps.append(f"m{i} AS (SELECT k, SUM(r) AS s, SUM(r * a) / SUM(r) AS ma, SUM(r * b) / SUM(r) AS mb FROM r{i} GROUP BY k)")
        steps.append(f"p{i + 1} AS (SELECT m.k, s / n AS w, m.ma, m.mb, (SELECT SUM(r * power(a - m.ma, 2)) / SUM(r) FROM r{i} WHERE r{i}.k = m.k) + 1e-6::DOUBLE AS va, (SELECT SUM(r * power(b - m.mb, 2)) / SUM(r) FROM r{i} WHERE r{i}.k = m.k) + 1e-6::DOUBLE AS vb FROM m{i} m, tot)")
    return "WITH " + ",\n".join(steps) + f"\nSELECT k AS component, round(w, 5) AS weight, round(ma, 4) AS mean_a, round(mb, 4) AS mean_b, round(va, 3) AS var_a, round(vb, 3) AS var_b FROM p{ROUNDS}"


@query("mixture_planes", _rounds())
def mixture_planes(spark, sf_dir):
    """Six rounds of a mixture over prices and quantities."""
    x = table(spark, sf_dir, "lineitem").select((F.col("l_extendedprice") / 1000).alias("a"), (F.col("l_quantity") / 5).alias("b"))
    m = mixtures.fit_mixture(x, ["a", "b"], 2, "diag", most=ROUNDS, tol=0.0, seeds=np.array(SEEDS))
    rows = [(k, round(float(w), 5), round(float(mean[0]), 4), round(float(mean[1]), 4), round(float(c[0, 0]), 3), round(float(c[1, 1]), 3)) for k, (w, mean, c) in enumerate(zip(m.weights, m.means, m.covariances))]
    return spark.createDataFrame(rows, "component int, weight double, mean_a double, mean_b double, var_a double, var_b double")


def _weighted(name: str, source: str, w: str, y: str) -> str:
    """Intercept and slope of a weighted regression on x."""
    return f"{name} AS (SELECT (sy - b * sx) / sw AS a, b FROM (SELECT *, (sw * sxy - sx * sy) / (sw * sxx - sx * sx) AS b FROM (SELECT SUM({w}) AS sw, SUM({w} * x) AS sx, SUM({w} * x * x) AS sxx, SUM({w} * ({y})) AS sy, SUM({w} * x * ({y})) AS sxy FROM {source})))"


def _noise() -> str:
    steps = ["d AS (SELECT o_orderkey, (o_orderkey % 100) / 100.0::DOUBLE AS x, o_totalprice / 100000 * (0.2::DOUBLE + (o_orderkey % 100) / 100.0::DOUBLE) AS y FROM orders)"]
    for i in range(3):
        weight = "1.0::DOUBLE" if i == 0 else f"1 / (exp((SELECT a FROM v{i - 1}) + (SELECT b FROM v{i - 1}) * x) + 1e-6::DOUBLE)"
        steps += [_weighted(f"m{i}", "d", weight, "y"), _weighted(f"v{i}", "d", "1.0::DOUBLE", f"ln(power(y - (SELECT a FROM m{i}) - (SELECT b FROM m{i}) * x, 2) + 1e-6::DOUBLE)")]
    return "WITH " + ",\n".join(steps) + " SELECT o_orderkey, round(m2.a + m2.b * x, 6) AS mean, round(GREATEST(exp(v2.a + v2.b * x), 1e-6::DOUBLE), 6) AS variance FROM d, m2, v2"


@query("noise_model", _noise())
def noise_model(spark, sf_dir):
    """Order totals whose spread grows with a feature: mean and variance of each order."""
    x = (F.col("o_orderkey") % 100) / F.lit(100.0)
    d = table(spark, sf_dir, "orders").select("o_orderkey", x.alias("x"), (F.col("o_totalprice") / 100000 * (F.lit(0.2) + x)).alias("y"))
    m = mixtures.fit_noise_model(d, ["x"], "y")
    (a, b), (c, e) = m.mean.tolist(), m.log_variance.tolist()
    return d.select("o_orderkey", F.round(F.lit(a) + F.lit(b) * F.col("x"), 6).alias("mean"), F.round(F.greatest(F.exp(F.lit(c) + F.lit(e) * F.col("x")), F.lit(1e-6)), 6).alias("variance"))


@query("experts")
def experts(spark, sf_dir):
    """Two linear experts of prices by quantity and discount, with their gate; the rounds have no short SQL form."""
    d = table(spark, sf_dir, "lineitem").select((F.col("l_quantity") / 50).alias("q"), (F.col("l_discount") * 10).alias("c"), (F.col("l_extendedprice") / 50000).alias("y"))
    m = mixtures.fit_experts(d, ["q", "c"], "y", 2, most=12, tol=1e-6)
    rows = [(k, *map(float, w), float(v), *map(float, g), m.rounds, m.converged) for k, (w, v, g) in enumerate(zip(m.weights, m.variances, m.gate))]
    return spark.createDataFrame(rows, "expert int, intercept double, quantity double, discount double, variance double, gate_intercept double, gate_quantity double, gate_discount double, rounds int, converged boolean")


@query("local_process", """WITH o AS (SELECT c_custkey, c_acctbal / 1000 AS x, (c_custkey % 10)::DOUBLE AS y, sin(c_acctbal / 500) AS v FROM customer), q AS (SELECT s_suppkey, s_acctbal / 1000 AS x, (s_suppkey % 10)::DOUBLE AS y FROM supplier),
 n AS (SELECT s_suppkey, q.x, q.y, o.x AS ox, o.y AS oy, v, ROW_NUMBER() OVER (PARTITION BY s_suppkey ORDER BY sqrt(power(q.x - o.x, 2) + power(q.y - o.y, 2)), c_custkey) AS i FROM q, o QUALIFY i <= 2),
 w AS (SELECT a.s_suppkey, exp(-0.5::DOUBLE * (power(a.ox - b.ox, 2) + power(a.oy - b.oy, 2)) / 4) AS k12, 1.1::DOUBLE AS k, exp(-0.5::DOUBLE * (power(a.x - a.ox, 2) + power(a.y - a.oy, 2)) / 4) AS c1, exp(-0.5::DOUBLE * (power(a.x - b.ox, 2) + power(a.y - b.oy, 2)) / 4) AS c2, a.v AS v1, b.v AS v2 FROM n a JOIN n b USING (s_suppkey) WHERE a.i = 1 AND b.i = 2)
 SELECT s_suppkey, round((c1 * (k * v1 - k12 * v2) + c2 * (k * v2 - k12 * v1)) / (k * k - k12 * k12), 6) AS mean, round(GREATEST(1 - (k * c1 * c1 - 2 * k12 * c1 * c2 + k * c2 * c2) / (k * k - k12 * k12), 0), 6) AS epistemic, 0.1::DOUBLE AS aleatoric, 2 AS n_near FROM w""")  # fmt: skip
def local_process(spark, sf_dir):
    """A Gaussian process at the suppliers, each conditioned on its two nearest customers."""
    o = table(spark, sf_dir, "customer").select("c_custkey", (F.col("c_acctbal") / 1000).alias("x"), (F.col("c_custkey") % 10).cast("double").alias("y"), F.sin(F.col("c_acctbal") / 500).alias("v"))
    q = table(spark, sf_dir, "supplier").select("s_suppkey", (F.col("s_acctbal") / 1000).alias("x"), (F.col("s_suppkey") % 10).cast("double").alias("y"))
    out = mixtures.local_process(q, o, "s_suppkey", "x", "y", "v", k=2, cell=1.0, scale=2.0, order="c_custkey")
    return out.select("s_suppkey", F.round("mean", 6).alias("mean"), F.round("epistemic", 6).alias("epistemic"), "aleatoric", "n_near")


#: A grid of powers, the likelihood of both transforms at each, and normal scores of the values' mid-ranks.
POWERS = """x AS (SELECT o_totalprice / 1000 AS x FROM orders), g AS (SELECT UNNEST(range(-400, 401)) / 200.0::DOUBLE AS l),
yj AS (SELECT l, -COUNT(*) / 2.0::DOUBLE * ln(VAR_POP(CASE WHEN l = 0 THEN ln(x + 1) ELSE (power(x + 1, l) - 1) / l END)) + (l - 1) * SUM(ln(x + 1)) AS ll FROM x, g GROUP BY l),
bc AS (SELECT l, -COUNT(*) / 2.0::DOUBLE * ln(VAR_POP(CASE WHEN l = 0 THEN ln(x) ELSE (power(x, l) - 1) / l END)) + (l - 1) * SUM(ln(x)) AS ll FROM x, g GROUP BY l)"""


@query("power_search", f"WITH {POWERS} SELECT 'yeo_johnson' AS kind, round(MAX(ll), 1) AS loglik, round(arg_max(l, ll), 1) AS power FROM yj UNION ALL SELECT 'box_cox', round(MAX(ll), 1), round(arg_max(l, ll), 1) FROM bc")
def power_search(spark, sf_dir):
    """The likeliest power of order totals under two transforms."""
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    found = [(k, *calibrate.power_search(o, "x", k)) for k in ("yeo_johnson", "box_cox")]
    return spark.createDataFrame([(k, round(ll, 1), round(lam, 1)) for k, lam, ll in found], "kind string, loglik double, power double")


@query("transform_choice", f"""WITH {POWERS}, lam AS (SELECT (SELECT arg_max(l, ll) FROM yj) AS y, (SELECT arg_max(l, ll) FROM bc) AS b),
 r AS (SELECT x, (RANK() OVER (ORDER BY x) + (COUNT(*) OVER (PARTITION BY x) - 1) / 2.0::DOUBLE - 0.375::DOUBLE) / (COUNT(*) OVER () + 0.25::DOUBLE) AS p FROM x),
 t AS (SELECT *, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM r), z AS (SELECT x, (CASE WHEN p < 0.5 THEN -1 ELSE 1 END) * (t - (2.515517::DOUBLE + t * (0.802853::DOUBLE + t * 0.010328::DOUBLE)) / (1 + t * (1.432788::DOUBLE + t * (0.189269::DOUBLE + t * 0.001308::DOUBLE)))) AS s FROM t),
 w AS (SELECT CORR(x, s) AS a, CORR(ln(x), s) AS b, CORR((power(x, lam.b) - 1) / lam.b, s) AS c, CORR(sqrt(x), s) AS d, CORR((power(x + 1, lam.y) - 1) / lam.y, s) AS e FROM z, lam)
 SELECT 'none' AS name, round(a * a, 4) AS normality FROM w UNION ALL SELECT 'log', round(b * b, 4) FROM w UNION ALL SELECT 'box-cox', round(c * c, 4) FROM w UNION ALL SELECT 'sqrt', round(d * d, 4) FROM w UNION ALL SELECT 'yeo-johnson', round(e * e, 4) FROM w UNION ALL SELECT 'quantile', 1.0::DOUBLE""")  # fmt: skip
def transform_choice(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select((F.col("o_totalprice") / 1000).alias("x"))
    return calibrate.transform_choice(o, "x").select("name", F.round("normality", 4).alias("normality"))
