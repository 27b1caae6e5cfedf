"""Belief functions over sets as bit masks, and combination of probabilities."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from tidewatch.functions.mathx import d


def dempster(a: DataFrame, b: DataFrame, by: list[str]) -> DataFrame:
    """Dempster's rule within each group: masses (by..., set, mass) over bit masks, with the conflict K.

    Total conflict (K = 1) gives a null mass. A group holds at most 2^frame sets, so its pairs are few.
    """
    pairs = a.select(*by, F.col("set").alias("s1"), F.col("mass").alias("m1")).join(b.select(*by, F.col("set").alias("s2"), F.col("mass").alias("m2")), by)
    meets = pairs.select(*by, F.col("s1").bitwiseAND(F.col("s2")).alias("set"), (F.col("m1") * F.col("m2")).alias("p")).groupBy(*by, "set").agg(F.sum("p").alias("p"))
    conflict = meets.groupBy(*by).agg(F.coalesce(F.sum(F.when(F.col("set") == 0, F.col("p"))), d(0)).alias("conflict"))
    return meets.where("set <> 0").join(conflict, by).select(*by, "set", F.when(F.col("conflict") < 1 - 1e-12, F.col("p") / (d(1) - F.col("conflict"))).alias("mass"), "conflict")


def belief_and_plausibility(masses: DataFrame, by: list[str]) -> DataFrame:
    """For each set that has mass: the mass of its subsets and of the sets that meet it."""
    a = masses.select(*by, F.col("set").alias("s"))
    b = masses.select(*by, F.col("set").alias("t"), "mass")
    pairs = a.join(b, by)
    inside, meets = F.col("t").bitwiseAND(F.col("s")) == F.col("t"), F.col("t").bitwiseAND(F.col("s")) != 0
    return pairs.groupBy(*by, F.col("s").alias("set")).agg(F.sum(F.when(inside, F.col("mass")).otherwise(d(0))).alias("belief"), F.sum(F.when(meets, F.col("mass")).otherwise(d(0))).alias("plausibility"))


def pignistic(masses: DataFrame, by: list[str], frame: int) -> DataFrame:
    """Each set's mass dealt evenly to its elements 0 .. frame - 1."""
    bits = F.filter(F.sequence(F.lit(0), F.lit(frame - 1)), lambda i: F.pmod(F.floor(F.col("set") / F.pow(d(2), i)), F.lit(2)) == 1)
    return masses.select(*by, (F.col("mass") / F.bit_count("set")).alias("p"), F.explode(bits).alias("element")).groupBy(*by, "element").agg(F.sum("p").alias("probability"))


def log_odds(p: Column) -> Column:
    q = F.least(F.greatest(p, d(1e-10)), d(1 - 1e-10))
    return F.log(q / (d(1) - q))


def combined_odds(df: DataFrame, p: str, by: list[str]) -> DataFrame:
    """Independent probabilities by the sum of their log odds, and as plain and normalised products."""
    s, prod, anti = F.sum(log_odds(F.col(p))), F.product(F.col(p)), F.product(d(1) - F.col(p))
    return df.groupBy(*by).agg((d(1) / (d(1) + F.exp(-s))).alias("by_odds"), prod.alias("by_product"), (prod / (prod + anti)).alias("by_bayes"))
