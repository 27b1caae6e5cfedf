"""Poisson bootstrap: each replicate weighs each row by a count that a hash of the row's key gives."""

from __future__ import annotations

import math

import numpy as np
from pyspark.sql import Column, DataFrame, functions as F

#: Shares of Poisson(1) counts up to 0, 1, 2, ...; the last is 1 in double precision.
POISSON = [sum(math.exp(-1) / math.factorial(j) for j in range(k + 1)) for k in range(18)]


def poisson_count(u: Column) -> Column:
    """The Poisson(1) count of a uniform number: how many of the cumulative shares it reaches."""
    count = F.when(u.isNull(), F.lit(None).cast("int"))
    for n, share in enumerate(POISSON):  # most numbers are settled by the first shares
        count = count.when(u < share, F.lit(n))
    return count.otherwise(F.lit(len(POISSON)))


def replicate_weights(df: DataFrame, key: Column, replicates: int) -> DataFrame:
    """``df`` once for each ``replicate`` in which its ``weight`` is not 0.

    The weights follow from MD5 of the key and the replicate, so every run and every engine gives the same; rows of one
    key share them. A digest serves four replicates.
    """
    digest = F.md5(F.concat(key.cast("string"), F.lit(":"), F.col("_block").cast("string")).cast("binary"))
    uniform = lambda i: F.conv(F.substring("_digest", 8 * i + 1, 8), 16, 10).cast("double") / 4294967296.0
    four = F.array(*[F.struct((F.col("_block") * 4 + i).alias("replicate"), uniform(i).alias("u")) for i in range(4)])
    dealt = df.repartition(int(df.sparkSession.conf.get("spark.sql.shuffle.partitions")), key)  # few bytes make many draws
    blocks = dealt.withColumn("_block", F.explode(F.sequence(F.lit(0), F.lit((replicates - 1) // 4)))).withColumn("_digest", digest)
    drawn = blocks.withColumn("_r", F.explode(four)).where(F.col("_r.replicate") < replicates)  # a number is computed once
    return drawn.select(*df.columns, "_r.replicate", poisson_count(F.col("_r.u")).alias("weight")).where("weight > 0")


def bootstrap_gram(df: DataFrame, features: list[str], target: str, key: Column, replicates: int = 50) -> DataFrame:
    """(replicate, n, x0x0, ..., x0y, ...): weighted sums of products of each replicate, in one pass.

    The sums are combined before the shuffle, so a task sends at most one row a replicate.
    """
    w, own = F.col("weight"), [F.col(f).cast("double") for f in features]
    sums = [F.sum(w * a * b).alias(f"x{i}x{i + j}") for i, a in enumerate(own) for j, b in enumerate(own[i:])]
    sums += [F.sum(w * a * F.col(target)).alias(f"x{i}y") for i, a in enumerate(own)]
    return replicate_weights(df, key, replicates).groupBy("replicate").agg(F.sum("weight").alias("n"), *sums)


def bootstrap_intervals(gram: DataFrame, k: int, penalty: float = 1.0, level: float = 0.95) -> tuple[list[tuple[float, float]], np.ndarray]:
    """Percentile intervals of the ``k`` ridge weights, and each replicate's weights: one small system for each row.

    Replicates whose system is singular are left out; with fewer than ten left there are no intervals.
    """
    weights = []
    for r in gram.orderBy("replicate").collect():
        a = np.array([[r[f"x{min(i, j)}x{max(i, j)}"] for j in range(k)] for i in range(k)]) + penalty * np.eye(k)
        if np.linalg.cond(a) < 1 / np.finfo(float).eps:
            weights.append(np.linalg.solve(a, [r[f"x{i}y"] for i in range(k)]))
    weights = np.array(weights).reshape(-1, k)
    if len(weights) < 10:
        return [], weights
    ends = np.percentile(weights, [50 - 50 * level, 50 + 50 * level], axis=0)
    return [(float(a), float(b)) for a, b in ends.T], weights
