"""Queries of inference, decisions, calibration and aggregation with uncertainty."""

from __future__ import annotations


from pyspark.sql import functions as F

from tidewatch.functions.mathx import d
from tidewatch.operators import bayes, bootstrap, calibrate, decide, engine, grid, series
from tidewatch.operators.scalars import with_scalars
from tidewatch.registry import query
from tidewatch.sources.tables import GRID, table

R6 = lambda c: F.round(F.col(c) + 1e-8, 6).alias(c)
def long_t():
    return F.col("t").cast("long").alias("t")


def r6(x: str) -> str:
    return f"round({x} + 1e-8::DOUBLE, 6)"


#: The grid with standardised rain ri, trailing sum ra, upstream share up and counts k.
FEATURES = GRID + """,
f AS (SELECT t, cell, r, q, w, v / 100 AS ri, (v + COALESCE(LAG(v) OVER g, 0) + COALESCE(LAG(v, 2) OVER g, 0)) / 300 AS ra, (cell % 10) / 10.0::DOUBLE AS up, c AS k FROM grid WINDOW g AS (PARTITION BY cell ORDER BY t))"""


def features(spark, sf_dir):
    g = series.trailing_sum(grid.dense(table(spark, sf_dir, "events")), "v", "cell", "t", 3, "a")
    return g.select("t", "cell", "r", "q", "w", (F.col("v") / 100).alias("ri"), (F.col("a") / 300).alias("ra"), (F.col("cell") % 10 / 10.0).alias("up"), F.col("c").cast("double").alias("k"))


PRIOR = FEATURES + """,
prior AS (SELECT *, GREATEST(ri + 0.5::DOUBLE * ra + 0.3::DOUBLE * up, 0) AS m0, LEAST(GREATEST(0.001::DOUBLE + 0.1::DOUBLE * (GREATEST(ri + 0.5::DOUBLE * ra + 0.3::DOUBLE * up, 0) + 1), 0.001::DOUBLE), 10.0::DOUBLE) AS v0 FROM f)"""
POST = PRIOR + """,
lik AS (SELECT *, LEAST(GREATEST((CASE WHEN k > 0 THEN 1 + ln(1 + k) ELSE 0.0::DOUBLE END) / (0.09::DOUBLE + 1e-9::DOUBLE), 0), 100) AS pl, LEAST(GREATEST(ln(1 + k / 0.1::DOUBLE), 0), 5) AS ml FROM prior),
post AS (SELECT *, CASE WHEN k > 0 THEN (m0 / v0 + pl * ml) / (1 / v0 + pl) ELSE m0 END AS m1, LEAST(GREATEST(CASE WHEN k > 0 THEN 1 / (1 / v0 + pl) ELSE v0 END, 0.001::DOUBLE), 20.0::DOUBLE) AS v1 FROM lik)"""


def prior(spark, sf_dir):
    f = features(spark, sf_dir)
    p = bayes.heteroscedastic_prior(F.col("ri"), F.col("ra"), F.col("up"))
    return f.withColumn("m0", p["prior_mean"]).withColumn("v0", p["prior_var"])


def post(spark, sf_dir):
    p = bayes.posterior(F.col("m0"), F.col("v0"), F.col("k"))
    return prior(spark, sf_dir).withColumn("m1", p["post_mean"]).withColumn("v1", p["post_var"])


@query("latent_base", f"WITH {FEATURES} SELECT t, cell, {r6('ri + 0.4::DOUBLE * ra + 0.8::DOUBLE * up')} AS base, {r6('GREATEST(0.25::DOUBLE * (1 + 2 * (1 - (CASE WHEN cell % 4 = 0 THEN 0.5::DOUBLE ELSE 1.0::DOUBLE END))), 1e-4::DOUBLE)')} AS var FROM f")
def latent_base(spark, sf_dir):
    f = features(spark, sf_dir)
    valid = F.when(F.col("cell") % 4 == 0, d(0.5)).otherwise(d(1))
    return f.select(long_t(), "cell", bayes.latent_base(F.col("ri"), F.col("ra"), F.col("up")).alias("base"), bayes.latent_variance(valid).alias("var")).select("t", "cell", R6("base"), R6("var"))


RATE = "(0.3::DOUBLE * (ln(1 + exp(-abs(ri))) + GREATEST(ri, 0) + 1e-6::DOUBLE))"


@query("poisson_loglik", f"WITH {FEATURES} SELECT t, cell, {r6(f'k * ln({RATE}) - {RATE} - lgamma(k + 1)')} AS loglik FROM f")
def poisson_loglik(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(long_t(), "cell", bayes.poisson_loglik(F.col("k"), bayes.reporting_rate(F.col("ri"))).alias("loglik")).select("t", "cell", R6("loglik"))


@query("negative_binomial_loglik", f"WITH {FEATURES}, m AS (SELECT *, 0.1::DOUBLE * exp(0.5::DOUBLE * ri) AS mu, 1 / 1.5::DOUBLE AS s FROM f) SELECT t, cell, {r6('lgamma(k + s) - lgamma(s) - lgamma(k + 1) + s * ln(s / (s + mu)) + k * ln(mu / (s + mu))')} AS loglik FROM m")
def negative_binomial_loglik(spark, sf_dir):
    f = features(spark, sf_dir)
    return f.select(long_t(), "cell", bayes.negative_binomial_loglik(F.col("k"), F.col("ri")).alias("loglik")).select("t", "cell", R6("loglik"))


@query("fuse_precision", f"WITH {FEATURES}, p AS (SELECT t, cell, ri AS m, {RATE} AS rate, 1 / GREATEST(0.5::DOUBLE + ra, 1e-6::DOUBLE) AS p0, CASE WHEN k > 0 THEN LEAST(k / 3.0::DOUBLE, 1) * 2 ELSE 0.0::DOUBLE END AS p1 FROM f) SELECT t, cell, {r6('(p0 * m + p1 * rate) / GREATEST(p0 + p1, 1e-9::DOUBLE)')} AS mean, {r6('1 / GREATEST(p0 + p1, 1e-9::DOUBLE)')} AS var, p0 + p1 < 0.03 AS no_decision FROM p")
def fuse_precision(spark, sf_dir):
    f = features(spark, sf_dir)
    p = bayes.fuse_precision(F.col("ri"), F.col("ra") + 0.5, F.col("k") / 3, bayes.reporting_rate(F.col("ri")))
    return f.select(long_t(), "cell", *[c.alias(n) for n, c in p.items()]).select("t", "cell", R6("mean"), R6("var"), "no_decision")


@query("prior_hetero", f"WITH {PRIOR} SELECT t, cell, {r6('m0')} AS m0, {r6('v0')} AS v0 FROM prior")
def prior_hetero(spark, sf_dir):
    return prior(spark, sf_dir).select(long_t(), "cell", R6("m0"), R6("v0"))


@query("posterior", f"WITH {POST} SELECT t, cell, {r6('m1')} AS m1, {r6('v1')} AS v1, {r6('GREATEST(m1 - 1.96::DOUBLE * sqrt(v1), 0)')} AS ci_lower, {r6('m1 + 1.96::DOUBLE * sqrt(v1)')} AS ci_upper, sqrt(v1) > 2 AS no_decision FROM post")
def posterior(spark, sf_dir):
    i = bayes.intervals(F.col("m1"), F.col("v1"))
    return post(spark, sf_dir).withColumns(i).select(long_t(), "cell", R6("m1"), R6("v1"), R6("ci_lower"), R6("ci_upper"), "no_decision")


GAIN = "LEAST(GREATEST((v1 / (v0 + 1e-9::DOUBLE) + power(m1 - m0, 2) / (v0 + 1e-9::DOUBLE) - 1 - ln(v1 / (v0 + 1e-9::DOUBLE) + 1e-9::DOUBLE)) / 2, 0), 100)"


@query("info_gain", f"WITH {POST} SELECT t, cell, round({GAIN} + 1e-7::DOUBLE, 5) AS gain_nats FROM post")
def info_gain(spark, sf_dir):
    g = bayes.information_gain(F.col("m0"), F.col("v0"), F.col("m1"), F.col("v1"))
    return post(spark, sf_dir).select(long_t(), "cell", F.round(g + 1e-7, 5).alias("gain_nats"))


@query("reliable_cells", f"WITH {POST} SELECT cell, COUNT(*) FILTER (WHERE k > 0) AS n_observed, {r6('AVG(sqrt(v1))')} AS mean_std, COUNT(*) FILTER (WHERE k > 0) >= 1 AND AVG(sqrt(v1)) < 0.45 AS reliable FROM post GROUP BY 1")
def reliable_cells(spark, sf_dir):
    out = post(spark, sf_dir).groupBy("cell").agg(F.count_if(F.col("k") > 0).alias("n_observed"), F.avg(F.sqrt("v1")).alias("mean_std"))
    return out.withColumn("reliable", (F.col("n_observed") >= 1) & (F.col("mean_std") < 0.45)).select("cell", "n_observed", R6("mean_std"), "reliable")


@query("epistemic_split", f"WITH {POST}, n AS (SELECT *, SUM((k > 0)::INT) OVER (PARTITION BY cell ORDER BY t) AS n FROM post) SELECT t, cell, {r6('0.6::DOUBLE * v1 / (1 + 0.2::DOUBLE * n)')} AS epistemic, {r6('0.4::DOUBLE * v1 + 0.05::DOUBLE')} AS aleatoric, {r6('ln(GREATEST(v0 / v1, 1)) / 2')} AS gain FROM n")
def epistemic_split(spark, sf_dir):
    return bayes.epistemic_split(post(spark, sf_dir), "v0", "v1", "k", "cell", "t").select(long_t(), "cell", R6("epistemic"), R6("aleatoric"), R6("gain"))


@query("evidence_linear", f"WITH {POST}, b AS (SELECT *, 0.4::DOUBLE * m1 / ((SELECT MAX(m1) FROM post) + 1e-9::DOUBLE) + 0.3::DOUBLE * k / ((SELECT MAX(k) FROM post) + 1e-9::DOUBLE) + 0.3::DOUBLE * up AS b FROM post) SELECT t, cell, {r6('b')} AS belief, {r6('v1 * (1 - 0.3::DOUBLE * LEAST(GREATEST(b, 0), 1))')} AS var_after FROM b")
def evidence_linear(spark, sf_dir):
    from tidewatch.operators.scalars import with_scalars

    p = with_scalars(post(spark, sf_dir), peak=F.max("m1"), most=F.max("k"))
    e = bayes.linear_evidence(F.col("m1"), F.col("v1"), F.col("k"), F.col("up"), F.col("peak"), F.col("most"))
    return p.withColumns(e).select(long_t(), "cell", R6("belief"), R6("var_after"))


@query("risk_utilities", f"WITH {POST} SELECT t, cell, {r6('m1 + 2.326::DOUBLE * sqrt(v1)')} AS cvar_normal, {r6('GREATEST(m1 - v1 / (m1 + 1e-9::DOUBLE), 0)')} AS utility FROM post WHERE m1 > 0.01")
def risk_utilities(spark, sf_dir):
    p = post(spark, sf_dir).where("m1 > 0.01")
    return p.select(long_t(), "cell", bayes.cvar_normal_2326(F.col("m1"), F.col("v1")).alias("cvar_normal"), bayes.expected_utility(F.col("m1"), F.col("v1")).alias("utility")).select("t", "cell", R6("cvar_normal"), R6("utility"))


@query("observation_age", f"WITH {FEATURES}, a AS (SELECT t, cell, t - MAX(CASE WHEN k > 0 THEN t END) OVER (PARTITION BY cell ORDER BY t) AS age FROM f) SELECT t, cell, age, {r6('COALESCE(LEAST(0.3::DOUBLE * ln(1 + age), 1), 1.0::DOUBLE)')} AS age_uncertainty FROM a")
def observation_age(spark, sf_dir):
    return bayes.observation_age(features(spark, sf_dir), "k", "cell", "t").select(long_t(), "cell", F.col("age").cast("long").alias("age"), R6("age_uncertainty"))


SLOPES = "CASE WHEN LAG(m1) OVER {w} IS NULL AND LEAD(m1) OVER {w} IS NULL THEN 0.0::DOUBLE WHEN LAG(m1) OVER {w} IS NULL THEN LEAD(m1) OVER {w} - m1 WHEN LEAD(m1) OVER {w} IS NULL THEN m1 - LAG(m1) OVER {w} ELSE (LEAD(m1) OVER {w} - LAG(m1) OVER {w}) / 2 END"


@query("stability", f"WITH {POST}, g AS (SELECT v1, {SLOPES.format(w='cols')} AS gy, {SLOPES.format(w='rows_')} AS gx, abs(m1 / (LAG(m1) OVER (PARTITION BY cell ORDER BY t) + 1e-9::DOUBLE)) AS ratio FROM post WINDOW cols AS (PARTITION BY t, q ORDER BY r), rows_ AS (PARTITION BY t, r ORDER BY q)), s AS (SELECT quantile_cont(sqrt(gy * gy + gx * gx), 0.95) AS l, quantile_cont(ratio, 0.95) AS p, sqrt(MAX(v1) / (MIN(v1) + 1e-9::DOUBLE)) AS c FROM g) SELECT {r6('l')} AS lipschitz, round(p, 4) AS spectral_radius, {r6('c')} AS condition, l < 10 AND p < 2 AND c < 1000 AS stable FROM s")
def stability(spark, sf_dir):
    return bayes.stability(post(spark, sf_dir), "m1", "v1", "cell", "t").select(R6("lipschitz"), F.round("spectral_radius", 4).alias("spectral_radius"), R6("condition"), "stable")


@query("ridge_gram", f"WITH {FEATURES} SELECT " + ", ".join(f"round(SUM({a} * {b}) + 1e-7::DOUBLE, 4) AS x{i}x{j}" for i, a in enumerate(("ri", "ra", "up")) for j, b in enumerate(("ri", "ra", "up")) if j >= i) + ", " + ", ".join(f"round(SUM({a} * k) + 1e-7::DOUBLE, 4) AS x{i}y" for i, a in enumerate(("ri", "ra", "up"))) + ", round(SUM(k * k) + 1e-7::DOUBLE, 4)::DOUBLE AS yy, COUNT(*) AS n FROM f")
def ridge_gram(spark, sf_dir):
    g = bayes.ridge_gram(features(spark, sf_dir), ["ri", "ra", "up"], "k")
    return g.select(*[F.round(F.col(c) + 1e-7, 4).alias(c) for c in g.columns if c != "n"], "n")


#: 50 replicates of the features, each row weighed by the Poisson count that its key's digest gives.
DRAWN = f"""dig AS (SELECT f.*, blk, md5(concat(t, '_', cell, ':', blk)) AS h FROM f, (SELECT UNNEST(range(0, 13)) AS blk)),
u AS (SELECT *, blk * 4 + i AS replicate, CAST('0x' || substr(h, CAST(8 * i + 1 AS INTEGER), 8) AS UBIGINT)::DOUBLE / 4294967296 AS u FROM (SELECT *, UNNEST(range(0, 4)) AS i FROM dig)),
drawn AS (SELECT *, {" + ".join(f"(u >= {x!r}::DOUBLE)::INT" for x in bootstrap.POISSON)} AS weight FROM u WHERE replicate < 50)"""
PAIRS = [(i, j) for i in range(3) for j in range(i, 3)]
NAMES = ("ri", "ra", "up")


@query("bootstrap_gram", f"WITH {FEATURES}, {DRAWN} SELECT CAST(replicate AS INTEGER) AS replicate, CAST(SUM(weight) AS BIGINT) AS n, " + ", ".join(f"round(SUM(weight * {NAMES[i]} * {NAMES[j]}) + 1e-7::DOUBLE, 3) AS x{i}x{j}" for i, j in PAIRS) + ", " + ", ".join(f"round(SUM(weight * {a} * k) + 1e-7::DOUBLE, 3) AS x{i}y" for i, a in enumerate(NAMES)) + " FROM drawn GROUP BY replicate")
def bootstrap_gram(spark, sf_dir):
    g = bootstrap.bootstrap_gram(features(spark, sf_dir), list(NAMES), "k", F.concat_ws("_", "t", "cell"))
    return g.select("replicate", "n", *[F.round(F.col(c) + 1e-7, 3).alias(c) for c in g.columns if c not in ("replicate", "n")])


@query("bootstrap_intervals", f"""WITH {FEATURES}, {DRAWN}, s AS (SELECT SUM(weight * ri * ri) + 1 AS a, SUM(weight * ri * up) AS b, SUM(weight * up * up) + 1 AS c, SUM(weight * ri * k) AS y0, SUM(weight * up * k) AS y1 FROM drawn GROUP BY replicate),
 w AS (SELECT (c * y0 - b * y1) / (a * c - b * b) AS w0, (a * y1 - b * y0) / (a * c - b * b) AS w1 FROM s)
 SELECT 'ri' AS feature, round(quantile_cont(w0, 0.025), 5) AS low, round(quantile_cont(w0, 0.975), 5) AS high FROM w UNION ALL SELECT 'up', round(quantile_cont(w1, 0.025), 5), round(quantile_cont(w1, 0.975), 5) FROM w""")  # fmt: skip
def bootstrap_intervals(spark, sf_dir):
    g = bootstrap.bootstrap_gram(features(spark, sf_dir), ["ri", "up"], "k", F.concat_ws("_", "t", "cell"))
    ends, _ = bootstrap.bootstrap_intervals(g, 2)
    return spark.createDataFrame([(n, round(a, 5), round(b, 5)) for n, (a, b) in zip(("ri", "up"), ends)], "feature string, low double, high double")


@query("fit_metrics", f"WITH {FEATURES}, s AS (SELECT COUNT(*) AS n, SUM(power(k - 0.5::DOUBLE * ri, 2)) AS ss, SUM(power(k - (SELECT AVG(k) FROM f), 2)) AS tot FROM f), l AS (SELECT *, -n / 2.0::DOUBLE * ln(2 * pi() * 0.25::DOUBLE) - ss / 0.5::DOUBLE AS l FROM s) SELECT n, round(l, 3) AS loglik, round(6 - 2 * l, 3) AS aic, round(3 * ln(n) - 2 * l, 3) AS bic, {r6('LEAST(GREATEST(1 - ss / tot, 0), 1)')} AS r2 FROM l")
def fit_metrics(spark, sf_dir):
    f = features(spark, sf_dir).withColumn("fit", F.col("ri") * 0.5)
    return bayes.fit_metrics(f, "k", "fit", 0.5, 3).select("n", *[F.round(c, 3).alias(c) for c in ("loglik", "aic", "bic")], R6("r2"))


@query("mixture_update", f"WITH {FEATURES}, u AS (SELECT t, cell, ri, 0.6::DOUBLE * exp(-power(ri - 0.5::DOUBLE, 2) / 1.0::DOUBLE) / sqrt(0.5::DOUBLE) AS a, 0.4::DOUBLE * exp(-power(ri - 2.0::DOUBLE, 2) / 2.5::DOUBLE) / sqrt(1.25::DOUBLE) AS b FROM f) SELECT t, cell, {r6('a / (a + b)')} AS w0, {r6('0.5::DOUBLE + 0.5::DOUBLE * (ri - 0.5::DOUBLE)')} AS m0, {r6('2 + 0.8::DOUBLE * (ri - 2)')} AS m1 FROM u WHERE ri < 8")
def mixture_update(spark, sf_dir):
    f = features(spark, sf_dir).where("ri < 8")
    mix = F.array(*[F.struct(d(w).alias("weight"), d(m).alias("mean"), d(v).alias("var")) for w, m, v in ((0.6, 0.5, 0.25), (0.4, 2.0, 1.0))])
    u = f.withColumn("u", bayes.mixture_update(mix, F.col("ri"), 0.25))
    return u.select(long_t(), "cell", F.col("u")[0]["weight"].alias("w0"), F.col("u")[0]["mean"].alias("m0"), F.col("u")[1]["mean"].alias("m1")).select("t", "cell", R6("w0"), R6("m0"), R6("m1"))


@query("hdi", "WITH r AS (SELECT l_returnflag AS f, l_extendedprice AS x, ROW_NUMBER() OVER (PARTITION BY l_returnflag ORDER BY l_extendedprice) - 1 AS i, CAST(ceil(COUNT(*) OVER (PARTITION BY l_returnflag) * 0.9::DOUBLE) AS BIGINT) AS k FROM lineitem) SELECT a.f AS l_returnflag, round(a.x, 6) AS hdi_low, round(b.x, 6) AS hdi_high FROM r a JOIN r b ON b.f = a.f AND b.i = a.i + a.k QUALIFY ROW_NUMBER() OVER (PARTITION BY a.f ORDER BY b.x - a.x, a.i) = 1")
def hdi(spark, sf_dir):
    return bayes.highest_density(table(spark, sf_dir, "lineitem"), "l_extendedprice", ["l_returnflag"], 0.9).select("l_returnflag", F.round("hdi_low", 6).alias("hdi_low"), F.round("hdi_high", 6).alias("hdi_high"))


RISK = "CASE WHEN sn >= 0.7 AND un <= 0.3 AND un < 0.9 THEN 'HIGH' WHEN sn >= 0.4 AND sn < 0.7 AND u <= 0.6 AND un < 0.9 THEN 'MEDIUM' WHEN sn < 0.2 AND un < 0.9 THEN 'LOW' ELSE 'NO_DECISION' END"


@query("risk_rules", f"WITH {POST}, n AS (SELECT t, cell, m1 / ((SELECT MAX(m1) FROM post) + 1e-9::DOUBLE) AS sn, sqrt(v1) AS u, (sqrt(v1) - (SELECT MIN(sqrt(v1)) FROM post)) / ((SELECT MAX(sqrt(v1)) - MIN(sqrt(v1)) FROM post) + 1e-9::DOUBLE) AS un FROM post) SELECT t, cell, {RISK} AS risk FROM n")
def risk_rules(spark, sf_dir):
    return decide.risk_rules(post(spark, sf_dir).withColumn("u", F.sqrt("v1")), "m1", "u").select(long_t(), "cell", "risk")


@query("risk_ci", f"WITH {POST}, i AS (SELECT t, cell, GREATEST(m1 - 1.96::DOUBLE * sqrt(v1), 0) AS lo, m1 + 1.96::DOUBLE * sqrt(v1) AS hi FROM post), n AS (SELECT t, cell, lo / ((SELECT MAX(hi) FROM i) + 1e-9::DOUBLE) AS lo, hi / ((SELECT MAX(hi) FROM i) + 1e-9::DOUBLE) AS hi FROM i), r AS (SELECT *, CASE WHEN hi - lo > 0.5 THEN 'NO_DECISION' WHEN lo >= 0.7 THEN 'HIGH' WHEN hi <= 0.2 THEN 'LOW' WHEN lo >= 0.2 AND hi <= 0.7 THEN 'MEDIUM' ELSE 'NO_DECISION' END AS risk FROM n) SELECT t, cell, risk, {r6('CASE WHEN risk = $$NO_DECISION$$ THEN 0.0::DOUBLE ELSE 1 - (hi - lo) END')} AS risk_confidence FROM r")
def risk_ci(spark, sf_dir):
    p = post(spark, sf_dir).withColumns(bayes.intervals(F.col("m1"), F.col("v1")))
    return decide.interval_risk(p, "ci_lower", "ci_upper").select(long_t(), "cell", "risk", R6("risk_confidence"))


@query("percentile_ranks", "SELECT o_orderkey, round(CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY floor(o_totalprice / 1000)) * 100, 6) AS percentile_rank FROM orders")
def percentile_ranks(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", F.floor(F.col("o_totalprice") / 1000).alias("z"))
    return decide.percentile_ranks(o, "z", ["o_orderstatus"]).select("o_orderkey", F.round("percentile_rank", 6).alias("percentile_rank"))


PHI = "(CASE WHEN {x} >= 0 THEN 1 - {tail} ELSE {tail} END)"


def phi(x: str) -> str:
    k = f"(1 / (1 + 0.2316419::DOUBLE * abs({x})))"
    tail = f"(exp(-({x}) * ({x}) / 2) / sqrt(2 * pi()) * {k} * (0.319381530::DOUBLE + {k} * (-0.356563782::DOUBLE + {k} * (1.781477937::DOUBLE + {k} * (-1.821255978::DOUBLE + {k} * 1.330274429::DOUBLE)))))"
    return PHI.format(x=f"({x})", tail=tail)


DECIDE = """ref AS (SELECT quantile_cont(o_totalprice, 0.9) AS q90 FROM orders), z AS (SELECT o_orderkey, o_orderstatus, o_totalprice / 1000 AS z, 0.1::DOUBLE + (o_custkey % 10) / 12.0::DOUBLE AS s, CUME_DIST() OVER (PARTITION BY o_orderstatus ORDER BY o_totalprice) * 100 AS p FROM orders),
e AS (SELECT z.*, 1 - """ + phi("(q90 / 1000 - z) / (s * 100 + 1e-10::DOUBLE)") + """ AS e, exp(-2 * s) AS c FROM z, ref),
dec AS (SELECT *, CASE WHEN c >= 0.3 AND p >= 90 AND e > 0.5 THEN 'urgent' WHEN (c >= 0.3 AND p >= 75 AND p < 90) OR e > 0.3 THEN 'action' WHEN c >= 0.3 AND p >= 50 AND p < 75 THEN 'monitor' WHEN c < 0.3 THEN 'no_decision' ELSE 'no_action' END AS decision FROM e),
con AS (SELECT *, CASE WHEN s > 1 THEN 'REFUSED' WHEN c >= 0.7 THEN 'CONFIDENT' WHEN c >= 0.3 THEN 'UNCERTAIN' ELSE 'REFUSED' END AS state FROM dec)"""


def decided(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice", (F.col("o_totalprice") / 1000).alias("z"), (d(0.1) + F.col("o_custkey") % 10 / 12.0).alias("s"))
    from tidewatch.operators.scalars import quantiles

    o = decide.percentile_ranks(o, "o_totalprice", ["o_orderstatus"]).crossJoin(F.broadcast(quantiles(o, "o_totalprice", q90=0.9)))
    o = o.withColumn("e", decide.exceedance(F.col("z"), F.col("s") * 100, F.col("q90") / 1000)).withColumn("c", decide.confidence(F.col("s")))
    return o.withColumn("decision", decide.relative_decision(F.col("percentile_rank"), F.col("e"), F.col("c")))


@query("relative_decision", f"WITH {DECIDE} SELECT o_orderkey, {r6('e')} AS exceedance, {r6('c')} AS confidence, decision FROM dec")
def relative_decision(spark, sf_dir):
    return decided(spark, sf_dir).select("o_orderkey", F.col("e").alias("exceedance"), F.col("c").alias("confidence"), "decision").select("o_orderkey", R6("exceedance"), R6("confidence"), "decision")


@query("contracts", f"WITH {DECIDE} SELECT o_orderkey, state, CASE WHEN state <> 'REFUSED' THEN decision END AS contract_decision FROM con")
def contracts(spark, sf_dir):
    return decide.contracts(decided(spark, sf_dir), "decision", "c", "s").select("o_orderkey", "state", "contract_decision")


@query("contract_summary", f"WITH {DECIDE} SELECT state, COUNT(*) AS n, COUNT(*) FILTER (WHERE state <> 'REFUSED' AND decision IN ('action', 'urgent')) AS n_acting, {r6('COUNT(*)::DOUBLE / (SELECT COUNT(*) FROM con)')} AS share FROM con GROUP BY 1")
def contract_summary(spark, sf_dir):
    return decide.contract_summary(decide.contracts(decided(spark, sf_dir), "decision", "c", "s")).select("state", "n", "n_acting", R6("share"))


@query("contract_check", "SELECT CAST(0 AS BIGINT) AS n_broken, COUNT(*) AS n FROM orders")
def contract_check(spark, sf_dir):
    return decide.broken_contracts(decide.contracts(decided(spark, sf_dir), "decision", "c", "s"))


@query("city_reference", "SELECT " + ", ".join(f"round(quantile_cont(o_totalprice, {p}), 4) AS q{int(p * 100)}" for p in (0.1, 0.25, 0.5, 0.75, 0.9, 0.95, 0.99)) + ", round(MIN(o_totalprice), 4) AS z_min, round(MAX(o_totalprice), 4) AS z_max, round(STDDEV_POP(o_totalprice), 4) AS z_std FROM orders")
def city_reference(spark, sf_dir):
    c = decide.city_reference(table(spark, sf_dir, "orders"), "o_totalprice")
    return c.select(*[F.round(x, 4).alias(x) for x in c.columns])


@query("baseline_threshold", f"WITH {FEATURES}, m AS (SELECT cell, MAX(ri) * 10 AS x FROM f GROUP BY 1) SELECT cell, {r6('LEAST(GREATEST(x / 30, 0), 2)')} AS stress, CASE WHEN x >= 30 THEN 3 WHEN x >= 15 THEN 2 WHEN x >= 5 THEN 1 ELSE 0 END AS level FROM m")
def baseline_threshold(spark, sf_dir):
    m = features(spark, sf_dir).groupBy("cell").agg((F.max("ri") * 10).alias("x"))
    return m.withColumns(decide.threshold_baseline(F.col("x"))).select("cell", R6("stress"), "level")


@query("baseline_physics", f"WITH {FEATURES}, m AS (SELECT cell, MAX(ri) * 10 AS x, (cell % 50) / 20.0::DOUBLE AS slope, MAX(up) AS up FROM f GROUP BY cell), s AS (SELECT cell, x / 30 * (1 + 0.5::DOUBLE * (LEAST(1 + slope / 1.000001::DOUBLE, 3) - 1) + 0.3::DOUBLE * up / ((SELECT MAX(up) FROM m) + 1e-6::DOUBLE)) AS s FROM m) SELECT cell, {r6('s')} AS stress, CASE WHEN s >= 1 THEN 3 WHEN s >= 0.5 THEN 2 WHEN s >= 0.25 THEN 1 ELSE 0 END AS level FROM s")
def baseline_physics(spark, sf_dir):
    m = features(spark, sf_dir).groupBy("cell").agg((F.max("ri") * 10).alias("x"), F.max("up").alias("up")).withColumn("slope", F.col("cell") % 50 / 20.0)
    ready = with_scalars(m, top=F.max("up"))
    return ready.withColumns(decide.physics_baseline(F.col("x"), F.col("slope"), F.col("up") / (F.col("top") + 1e-6))).select("cell", R6("stress"), "level")


@query("baseline_linear", f"WITH {FEATURES} SELECT t, cell, {r6('0.3::DOUBLE * ri + 0.2::DOUBLE * ra + 0.3::DOUBLE * up + 0.2::DOUBLE * k')} AS stress FROM f")
def baseline_linear(spark, sf_dir):
    return features(spark, sf_dir).select(long_t(), "cell", decide.linear_baseline(F.col("ri"), F.col("ra"), F.col("up"), F.col("k")).alias("stress")).select("t", "cell", R6("stress"))


@query("best_action", "WITH u AS (SELECT l_returnflag AS a, AVG(l_quantity * 100 - l_extendedprice / 50) AS u FROM lineitem GROUP BY 1) SELECT a AS action, round(u, 4) AS expected_utility, u = (SELECT MAX(u) FROM u) AS is_best FROM u")
def best_action(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select(F.col("l_returnflag").alias("action"), "l_quantity", "l_extendedprice")
    return decide.best_action(li, "action", F.col("l_quantity") * 100 - F.col("l_extendedprice") / 50).select("action", F.round("expected_utility", 4).alias("expected_utility"), "is_best")


@query("evpi", "WITH b AS (SELECT l_orderkey, MAX(l_quantity) AS u FROM lineitem GROUP BY 1), a AS (SELECT l_returnflag, AVG(l_quantity) AS u FROM lineitem GROUP BY 1) SELECT round((SELECT AVG(u) FROM b), 6) AS informed, round((SELECT MAX(u) FROM a), 6) AS uninformed, round(GREATEST((SELECT AVG(u) FROM b) - (SELECT MAX(u) FROM a), 0), 6) AS evpi")
def evpi(spark, sf_dir):
    out = decide.perfect_information(table(spark, sf_dir, "lineitem"), "l_orderkey", "l_returnflag", F.col("l_quantity"))
    return out.select(*[F.round(c, 6).alias(c) for c in out.columns])


#: The posterior at the step with the greatest mean, with stress and deviation over their greatest.
PEAK = POST + """,
means AS (SELECT t, round(AVG(m1), 9) AS m FROM post GROUP BY t), peak AS (SELECT * FROM post WHERE t = (SELECT t FROM means ORDER BY m DESC, t LIMIT 1)),
n AS (SELECT t, cell, r, q, w, k, m1, v1, m1 / ((SELECT MAX(m1) FROM peak) + 1e-9::DOUBLE) AS p, sqrt(v1) / ((SELECT MAX(sqrt(v1)) FROM peak) + 1e-9::DOUBLE) AS s FROM peak)"""


def peak(spark, sf_dir):
    p = post(spark, sf_dir)
    at = series.peak_slice(p, "m1", "t").first()
    ready = with_scalars(p.where(F.col("t") == (at["peak_t"] if at else None)), top=F.max("m1"), wide=F.max(F.sqrt("v1")))
    return ready.withColumns({"p": F.col("m1") / (F.col("top") + 1e-9), "s": F.sqrt("v1") / (F.col("wide") + 1e-9)}).drop("top", "wide")


@query("action_classes", f"WITH {PEAK}, a AS (SELECT t, cell, CASE WHEN p >= 0.7 AND s <= 0.3 THEN 3 WHEN p >= 0.4 AND p < 0.7 THEN 2 WHEN p < 0.2 THEN 1 ELSE 0 END AS a, s FROM n) SELECT t, cell, CASE WHEN s > 0.6 THEN 'UNDECIDED' ELSE ['UNDECIDED', 'NO_ACTION', 'MONITOR', 'DEPLOY_PUMPS'][a + 1] END AS action FROM a")
def action_classes(spark, sf_dir):
    return peak(spark, sf_dir).select(long_t(), "cell", decide.action_class(F.col("p"), F.col("s")).alias("action"))


@query("expected_loss", f"WITH {PEAK} SELECT t, cell, {r6('LEAST(GREATEST(p, 0), 1) * 10000 + sqrt(v1) * 100')} AS loss FROM n")
def expected_loss(spark, sf_dir):
    return peak(spark, sf_dir).select(long_t(), "cell", decide.expected_loss(F.col("p"), F.sqrt("v1")).alias("loss")).select("t", "cell", R6("loss"))


LATENT = "med AS (SELECT MEDIAN(o_totalprice) AS m FROM orders), mad AS (SELECT GREATEST(MEDIAN(abs(o_totalprice - m)), 1e-6::DOUBLE) AS s FROM orders, med), lz AS (SELECT o_orderkey, o_orderstatus, (o_totalprice - m) / s AS z FROM orders, med, mad)"


def latent(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_orderstatus", "o_totalprice")
    return calibrate.latent(o, "o_totalprice", calibrate.latent_scale(o, "o_totalprice"))


@query("latent_mad", f"WITH {LATENT} SELECT round(m, 4) AS median, round(s, 4) AS mad FROM med, mad")
def latent_mad(spark, sf_dir):
    out = calibrate.latent_scale(table(spark, sf_dir, "orders"), "o_totalprice")
    return out.select(F.round("median", 4).alias("median"), F.round("mad", 4).alias("mad"))


@query("latent_z", f"WITH {LATENT} SELECT o_orderkey, {r6('z')} AS z FROM lz")
def latent_z(spark, sf_dir):
    return latent(spark, sf_dir).select("o_orderkey", R6("z"))


@query("latent_inverse", "SELECT o_orderkey, round(o_totalprice, 4) AS back FROM orders")
def latent_inverse(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice")
    scale = calibrate.latent_scale(o, "o_totalprice")
    return calibrate.unlatent(calibrate.latent(o, "o_totalprice", scale), "z", scale, "back").select("o_orderkey", F.round("back", 4).alias("back"))


def _knots() -> str:
    k = calibrate.KNOTS
    out = f"CASE WHEN z <= k0 THEN {k[0][1]}::DOUBLE "
    for i in range(len(k) - 1):
        out += f"WHEN z <= k{i + 1} THEN {k[i][1]}::DOUBLE + (z - k{i}) / (k{i + 1} - k{i}) * {k[i + 1][1] - k[i][1]}::DOUBLE "
    return out + f"ELSE {k[-1][1]}::DOUBLE END"


@query("calibrate_quantile", f"WITH {LATENT}, k AS (SELECT " + ", ".join(f"quantile_cont(z, {p}) AS k{i}" for i, (p, _) in enumerate(calibrate.KNOTS)) + f" FROM lz) SELECT o_orderkey, {r6(_knots())} AS calibrated FROM lz, k")
def calibrate_quantile(spark, sf_dir):
    return calibrate.calibrate_quantile(latent(spark, sf_dir), "z").select("o_orderkey", R6("calibrated"))


@query("calibrate_linear", f"WITH {LATENT} SELECT o_orderkey, {r6('LEAST(GREATEST((z - (SELECT MIN(z) FROM lz)) * (2 / ((SELECT MAX(z) - MIN(z) FROM lz) + 1e-6::DOUBLE)), 0), 2.5)')} AS calibrated FROM lz")
def calibrate_linear(spark, sf_dir):
    return calibrate.calibrate_linear(latent(spark, sf_dir), "z").select("o_orderkey", R6("calibrated"))


@query("isotonic_ranks", "WITH r AS (SELECT l_orderkey, l_linenumber, RANK() OVER (ORDER BY l_quantity) - 1 + (COUNT(*) OVER (PARTITION BY l_quantity) - 1) / 2.0::DOUBLE AS r, COUNT(*) OVER () AS n FROM lineitem) SELECT l_orderkey, CAST(l_linenumber AS BIGINT) AS l_linenumber, round(r / (n - 1) * 2.0::DOUBLE + 1e-8::DOUBLE, 6) AS calibrated FROM r")
def isotonic_ranks(spark, sf_dir):
    li = table(spark, sf_dir, "lineitem").select("l_orderkey", F.col("l_linenumber").cast("long").alias("l_linenumber"), "l_quantity")
    return calibrate.isotonic_ranks(li, "l_quantity").select("l_orderkey", "l_linenumber", R6("calibrated"))


def two_cities(spark, sf_dir):
    z = latent(spark, sf_dir).select("o_orderstatus", "z")
    return z.where("o_orderstatus = 'O'"), z.where("o_orderstatus = 'F'").select("o_orderstatus", (F.col("z") * 1.3 + 0.2).alias("z"))


CITIES = LATENT + ", ca AS (SELECT z FROM lz WHERE o_orderstatus = 'O'), cb AS (SELECT z * 1.3::DOUBLE + 0.2::DOUBLE AS z FROM lz WHERE o_orderstatus = 'F')"
KL = CITIES + """, e AS (SELECT MIN(z) AS lo, MAX(z) AS hi FROM ca), s AS (SELECT UNNEST(range(0, 50)) AS b), ha AS (SELECT LEAST(CAST(floor((z - lo) / (hi - lo) * 50) AS BIGINT), 49) AS b, COUNT(*) AS n FROM ca, e GROUP BY 1), hb AS (SELECT LEAST(CAST(floor((z - lo) / (hi - lo) * 50) AS BIGINT), 49) AS b, COUNT(*) AS n FROM cb, e WHERE z BETWEEN lo AND hi GROUP BY 1),
pq AS (SELECT COALESCE(hb.n, 0) / ((SELECT SUM(n) FROM hb) * (hi - lo) / 50) + 1e-10::DOUBLE AS p, COALESCE(ha.n, 0) / ((SELECT SUM(n) FROM ha) * (hi - lo) / 50) + 1e-10::DOUBLE AS q FROM s CROSS JOIN e LEFT JOIN ha ON ha.b = s.b LEFT JOIN hb ON hb.b = s.b), kl AS (SELECT LEAST(GREATEST(SUM(p * ln(p / q)), 0), 100) AS kl FROM pq),
u AS (SELECT z, 1 AS a, 0 AS b FROM ca UNION ALL SELECT z, 0, 1 FROM cb), g AS (SELECT z, SUM(a) AS a, SUM(b) AS b FROM u GROUP BY 1), c AS (SELECT SUM(a) OVER (ORDER BY z) / (SELECT COUNT(*)::DOUBLE FROM ca) - SUM(b) OVER (ORDER BY z) / (SELECT COUNT(*)::DOUBLE FROM cb) AS gap, LEAD(z) OVER (ORDER BY z) - z AS width FROM g), w1 AS (SELECT SUM(abs(gap) * COALESCE(width, 0)) AS w FROM c),
tl AS (SELECT GREATEST(abs(quantile_cont(cb.z, 0.95) - MAX(a95)) / (abs(MAX(a95)) + 1e-6::DOUBLE), abs(quantile_cont(cb.z, 0.05) - MAX(a05)) / (abs(MAX(a05)) + 1e-6::DOUBLE)) AS tail FROM cb, (SELECT quantile_cont(z, 0.95) AS a95, quantile_cont(z, 0.05) AS a05 FROM ca))"""


@query("shift_hist_kl", f"WITH {KL} SELECT {r6('kl')} AS kl FROM kl")
def shift_hist_kl(spark, sf_dir):
    a, b = two_cities(spark, sf_dir)
    return calibrate.shift_kl(a, b, "z").select(R6("kl"))


@query("shift_wasserstein", f"WITH {KL} SELECT {r6('w')} AS wasserstein FROM w1")
def shift_wasserstein(spark, sf_dir):
    a, b = two_cities(spark, sf_dir)
    return calibrate.shift_wasserstein(a, b, "z").select(R6("wasserstein"))


@query("shift_tail", f"WITH {KL} SELECT {r6('tail')} AS tail FROM tl")
def shift_tail(spark, sf_dir):
    a, b = two_cities(spark, sf_dir)
    return calibrate.shift_tail(a, b, "z").select(R6("tail"))


@query("shift_score", f"WITH {KL} SELECT {r6('LEAST(GREATEST(0.3::DOUBLE * (1 - exp(-kl / 2)) + 0.4::DOUBLE * tanh(w / 2) + 0.3::DOUBLE * tanh(tail), 0), 1)')} AS shift FROM kl, w1, tl")
def shift_score(spark, sf_dir):
    a, b = two_cities(spark, sf_dir)
    parts = calibrate.shift_kl(a, b, "z").crossJoin(calibrate.shift_wasserstein(a, b, "z")).crossJoin(calibrate.shift_tail(a, b, "z"))
    return parts.select(calibrate.shift_score(F.col("kl"), F.col("wasserstein"), F.col("tail")).alias("shift")).select(R6("shift"))


@query("sigma_inflate", f"WITH {LATENT}, s AS (SELECT o_orderkey, 0.1::DOUBLE + 0.1::DOUBLE * abs(z) AS b, 0.1::DOUBLE + 0.2::DOUBLE * 0.4::DOUBLE AS dl, 0.5::DOUBLE + 0.1::DOUBLE * abs(z) AS s FROM lz), t AS (SELECT *, GREATEST(sqrt(b * b + dl * dl + 0.35::DOUBLE * s * s), 0.05::DOUBLE) AS g FROM s) SELECT o_orderkey, {r6('g')} AS sigma, {r6('LEAST(GREATEST(g / b, 1), 5)')} AS inflation, g > 0.5 AS no_decision FROM t")
def sigma_inflate(spark, sf_dir):
    z = latent(spark, sf_dir)
    return z.withColumns(calibrate.inflated_sigma(F.col("z"), d(0.4), d(0.35))).select("o_orderkey", R6("sigma"), R6("inflation"), "no_decision")


@query("robust_scale", f"SELECT o_orderkey, {r6('(o_totalprice - (SELECT MEDIAN(o_totalprice) FROM orders)) / (SELECT quantile_cont(o_totalprice, 0.75) - quantile_cont(o_totalprice, 0.25) FROM orders)')} AS scaled FROM orders")
def robust_scale(spark, sf_dir):
    return calibrate.robust_scale(table(spark, sf_dir, "orders").select("o_orderkey", "o_totalprice"), "o_totalprice").select("o_orderkey", R6("scaled"))


@query("rank_scale", f"SELECT p_partkey, {r6('(DENSE_RANK() OVER (ORDER BY p_size) - 1) / ((SELECT COUNT(DISTINCT p_size) FROM part) - 1.0::DOUBLE)')} AS scaled FROM part")
def rank_scale(spark, sf_dir):
    return calibrate.rank_scale(table(spark, sf_dir, "part").select("p_partkey", "p_size"), "p_size").select("p_partkey", R6("scaled"))


@query("normal_scores", "WITH p AS (SELECT c_custkey, (RANK() OVER w + (COUNT(*) OVER (PARTITION BY c_mktsegment, c_acctbal) - 1) / 2.0::DOUBLE - 0.5::DOUBLE) / COUNT(*) OVER (PARTITION BY c_mktsegment) AS p FROM customer WINDOW w AS (PARTITION BY c_mktsegment ORDER BY c_acctbal)), t AS (SELECT *, sqrt(-2 * ln(CASE WHEN p < 0.5 THEN p ELSE 1 - p END)) AS t FROM p), z AS (SELECT *, t - (2.515517::DOUBLE + t * (0.802853::DOUBLE + t * 0.010328::DOUBLE)) / (1 + t * (1.432788::DOUBLE + t * (0.189269::DOUBLE + t * 0.001308::DOUBLE))) AS z FROM t) SELECT c_custkey, round(CASE WHEN p < 0.5 THEN -z ELSE z END + 1e-8::DOUBLE, 6) AS score FROM z")
def normal_scores(spark, sf_dir):
    return calibrate.normal_scores(table(spark, sf_dir, "customer").select("c_custkey", "c_mktsegment", "c_acctbal"), "c_acctbal", ["c_mktsegment"]).select("c_custkey", R6("score"))


@query("yeo_johnson", f"SELECT c_custkey, {r6('CASE WHEN c_acctbal >= 0 THEN (power(c_acctbal / 1000 + 1, 0.5::DOUBLE) - 1) / 0.5::DOUBLE ELSE -(power(1 - c_acctbal / 1000, 1.5::DOUBLE) - 1) / 1.5::DOUBLE END')} AS y, {r6('(power(abs(c_acctbal) + 1, 0.3::DOUBLE) - 1) / 0.3::DOUBLE')} AS b FROM customer")
def yeo_johnson(spark, sf_dir):
    from tidewatch.functions.mathx import box_cox
    from tidewatch.functions.mathx import yeo_johnson as yj

    return table(spark, sf_dir, "customer").select("c_custkey", yj(F.col("c_acctbal") / 1000, 0.5).alias("y"), box_cox(F.abs("c_acctbal") + 1, 0.3).alias("b")).select("c_custkey", R6("y"), R6("b"))


@query("power_likelihood", "WITH l AS (SELECT UNNEST([0.0, 0.5, 1.0])::DOUBLE AS l), x AS (SELECT abs(c_acctbal) / 1000 + 0.5::DOUBLE AS x FROM customer), y AS (SELECT l, x, CASE WHEN l = 0 THEN ln(x + 1) ELSE (power(x + 1, l) - 1) / l END AS y FROM l, x) SELECT l AS lambda, round(-COUNT(*) / 2.0::DOUBLE * ln(VAR_POP(y)) + (l - 1) * SUM(ln(x + 1)), 3) AS loglik FROM y GROUP BY l")
def power_likelihood(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select((F.abs("c_acctbal") / 1000 + 0.5).alias("x"))
    return calibrate.power_likelihood(c, "x", [0.0, 0.5, 1.0]).select("lambda", F.round("loglik", 3).alias("loglik"))


@query("cvar", "WITH v AS (SELECT quantile_cont(o_totalprice, 0.95) AS q FROM orders) SELECT round(MAX(q), 4) AS value_at_risk, round(AVG(o_totalprice), 4) AS cvar FROM orders, v WHERE o_totalprice >= q")
def cvar(spark, sf_dir):
    return calibrate.cvar(table(spark, sf_dir, "orders"), "o_totalprice", 0.95).select(F.round("value_at_risk", 4).alias("value_at_risk"), F.round("cvar", 4).alias("cvar"))


LEVELS = [0.1, 0.25, 0.5, 0.75, 0.9, 0.99]


@query("risk_spectrum", " UNION ALL ".join(f"SELECT {a}::DOUBLE AS alpha, round(AVG(o_totalprice), 4) AS cvar FROM orders WHERE o_totalprice >= (SELECT quantile_cont(o_totalprice, {a}) FROM orders)" for a in LEVELS))
def risk_spectrum(spark, sf_dir):
    return calibrate.risk_spectrum(table(spark, sf_dir, "orders"), "o_totalprice", LEVELS).select("alpha", F.round("cvar", 4).alias("cvar"))


HIER = "ch AS (SELECT c_custkey, n_nationkey, n_regionkey, c_acctbal AS v, 10.0::DOUBLE + c_custkey % 7 AS s FROM customer JOIN nation ON c_nationkey = n_nationkey)"


def hierarchy(spark, sf_dir):
    n = table(spark, sf_dir, "nation").select("n_nationkey", "n_regionkey")
    return table(spark, sf_dir, "customer").join(F.broadcast(n), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_nationkey", "n_regionkey", F.col("c_acctbal").alias("v"), (d(10) + F.col("c_custkey") % 7).alias("s"))


AGG = "COUNT(*) AS n, round(SUM(v), 4) AS sum_value, round(sqrt(SUM(s * s)), 4) AS sum_sigma, round(AVG(v), 4) AS mean_value, round(sqrt(SUM(s * s) / (COUNT(*) * COUNT(*)) + power(COALESCE(STDDEV_SAMP(v), 0) / sqrt(COUNT(*)), 2)), 4) AS mean_sigma, round(SUM(v / (s * s + 1e-12::DOUBLE)) / SUM(1 / (s * s + 1e-12::DOUBLE)), 4) AS ivw_mean, round(1 / sqrt(SUM(1 / (s * s + 1e-12::DOUBLE))), 4) AS ivw_sigma, round(MAX(v), 4) AS max_value, round(MIN(v), 4) AS min_value, round(MEDIAN(v), 4) AS median_value"


def _r4(df, keys):
    return df.select(*keys, "n", *[F.round(c, 4).alias(c) for c in df.columns if c not in (*keys, "n")])


@query("agg_uncertain", f"WITH {HIER} SELECT n_nationkey, {AGG} FROM ch GROUP BY 1")
def agg_uncertain(spark, sf_dir):
    return _r4(calibrate.aggregate_uncertain(hierarchy(spark, sf_dir), "v", "s", ["n_nationkey"]), ["n_nationkey"])


@query("hier_rollup", f"WITH {HIER}, l1 AS (SELECT n_regionkey, n_nationkey, SUM(v) AS v, sqrt(SUM(s * s)) AS s FROM ch GROUP BY 1, 2), l0 AS (SELECT n_regionkey, SUM(v) AS v, sqrt(SUM(s * s)) AS s, COUNT(*) AS n FROM l1 GROUP BY 1) SELECT n_regionkey, n, round(v, 4) AS v, round(s, 4) AS s FROM l0")
def hier_rollup(spark, sf_dir):
    up = hierarchy(spark, sf_dir)
    for keys in (["n_regionkey", "n_nationkey"], ["n_regionkey"]):
        up = up.groupBy(*keys).agg(F.sum("v").alias("v"), F.sqrt(F.sum(F.col("s") * F.col("s"))).alias("s"), F.count("*").alias("n"))
    return up.select("n_regionkey", "n", F.round("v", 4).alias("v"), F.round("s", 4).alias("s"))


@query("hier_disaggregate", f"WITH {HIER} SELECT c_custkey, round(1000.0::DOUBLE * (n_nationkey + 1) * s / SUM(s) OVER (PARTITION BY n_nationkey), 6) AS dealt FROM ch")
def hier_disaggregate(spark, sf_dir):
    parents = table(spark, sf_dir, "nation").select("n_nationkey", (d(1000) * (F.col("n_nationkey") + 1)).alias("total"))
    return calibrate.disaggregate(parents, hierarchy(spark, sf_dir), "n_nationkey", "total", "s").select("c_custkey", F.round("dealt", 6).alias("dealt"))


#: All stages but those on the raster, one after the other.
CHAIN = FEATURES + """,
gl AS (SELECT VAR_POP(ri) + 0.1::DOUBLE AS gv, MAX(up) AS um, MAX(k) AS km FROM f),
pr AS (SELECT t, cell, ri, up, k, ri * (up / um + 0.5::DOUBLE) * 0.5::DOUBLE AS m0, gv * (1 + 0.5::DOUBLE * up / um) AS v0 FROM f, gl),
kf(t, cell, m, p) AS (SELECT t, cell, CASE WHEN k > 0 THEN m0 + (v0 + 0.1::DOUBLE) / (v0 + 0.3::DOUBLE) * (k - m0) ELSE m0 END, CASE WHEN k > 0 THEN (1 - (v0 + 0.1::DOUBLE) / (v0 + 0.3::DOUBLE)) * (v0 + 0.1::DOUBLE) ELSE v0 + 0.1::DOUBLE END FROM pr WHERE t = 0
  UNION ALL SELECT pr.t, pr.cell, CASE WHEN k > 0 THEN m + (p + 0.1::DOUBLE) / (p + 0.3::DOUBLE) * (k - m) ELSE m END, CASE WHEN k > 0 THEN (1 - (p + 0.1::DOUBLE) / (p + 0.3::DOUBLE)) * (p + 0.1::DOUBLE) ELSE p + 0.1::DOUBLE END FROM kf JOIN pr ON pr.cell = kf.cell AND pr.t = kf.t + 1),
st AS (SELECT pr.*, kf.m, kf.p FROM pr JOIN kf ON kf.t = pr.t AND kf.cell = pr.cell),
ou(t, cell, m, p) AS (SELECT t, cell, m, p FROM st WHERE t = 0
  UNION ALL SELECT st.t, st.cell, ou.m + 0.3::DOUBLE * (0.5::DOUBLE * ri - ou.m) + 0.3::DOUBLE * st.m, ou.p * exp(-0.6::DOUBLE) + 0.01::DOUBLE / 0.6::DOUBLE * (1 - exp(-0.6::DOUBLE)) + 0.3::DOUBLE * st.p FROM ou JOIN st ON st.cell = ou.cell AND st.t = ou.t + 1),
sp AS (SELECT pr.*, ou.m, ou.p, 0.6::DOUBLE * ou.p / (1 + 0.2::DOUBLE * SUM(CASE WHEN k > 0 THEN 1 ELSE 0 END) OVER (PARTITION BY pr.cell ORDER BY pr.t)) AS e, 0.4::DOUBLE * ou.p + 0.05::DOUBLE AS a, ln(GREATEST(v0 / ou.p, 1)) / 2 AS gain FROM pr JOIN ou ON ou.t = pr.t AND ou.cell = pr.cell),
va AS (SELECT *, LEAST(GREATEST(e + a, 0.01::DOUBLE), 10.0::DOUBLE) AS v FROM sp),
ev AS (SELECT *, v * (1 - 0.3::DOUBLE * LEAST(GREATEST(0.4::DOUBLE * m / ((SELECT MAX(m) FROM va) + 1e-9::DOUBLE) + 0.3::DOUBLE * k / (km + 1e-9::DOUBLE) + 0.3::DOUBLE * up, 0), 1)) AS w FROM va, gl)"""


@query("composed_inference", f"""WITH RECURSIVE {CHAIN} SELECT t, cell, {r6('m')} AS mean, {r6('w')} AS var, {r6('e')} AS epistemic, {r6('a')} AS aleatoric, {r6('gain')} AS gain, {r6('m + 2.326::DOUBLE * sqrt(v)')} AS cvar, {r6('GREATEST(m - v / (m + 1e-9::DOUBLE), 0)')} AS utility, {r6('m - 1.96::DOUBLE * sqrt(w)')} AS ci_lower, {r6('m + 1.96::DOUBLE * sqrt(w)')} AS ci_upper FROM ev""")
def composed_inference(spark, sf_dir):
    """The whole inference with the raster's stages and the mixture switched off."""
    off = engine.Stages(mixture=False, smoothing=False, multi_resolution=False)
    out = engine.composed(features(spark, sf_dir), "ri", "up", "k", stages=off)
    return out.select(long_t(), "cell", *[R6(c) for c in ("mean", "var", "epistemic", "aleatoric", "gain", "cvar", "utility", "ci_lower", "ci_upper")])


@query("whole_inference")
def whole_inference(spark, sf_dir):
    """All stages, with the raster's size in each row; a test runs the same chain in plain loops."""
    f = grid.cut(features(spark, sf_dir))
    side = f.agg((F.max("r") + 1).cast("long").alias("h"), F.max("w").cast("long").alias("width"))
    full = f.crossJoin(F.broadcast(side)).withColumn("w", F.col("width")).where("r < h and q < w")
    out = engine.composed(full.drop("width"), "ri", "up", "k")
    return out.select(long_t(), "cell", *[R6(c) for c in ("mean", "var", "epistemic", "aleatoric", "gain", "cvar", "utility", "ci_lower", "ci_upper")])
