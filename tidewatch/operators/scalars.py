"""Exact global statistics without a sort in one task, for joining to every row."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.operators.grid import cut

#: Ranges that each pass of the selection counts.
RANGES = 4096


def with_scalars(df: DataFrame, **scalars: Column) -> DataFrame:
    """``df`` with global aggregates as columns. The aggregate is one row, so the join broadcasts one row."""
    return df.crossJoin(F.broadcast(df.agg(*[c.alias(n) for n, c in scalars.items()])))


def order_statistics(values: DataFrame, ranks: list[int], lo: float, hi: float) -> dict[int, float]:
    """The values of these ranks (from 0) in a column ``v`` between lo and hi, by narrowing ranges.

    Each pass counts the values in 4096 ranges of every interval that still holds a wanted rank, with each range's
    ends, and keeps the ranges that hold one: a few passes of plain counts, whatever the number of values. What comes
    to the driver is at most 4096 rows an interval.
    """
    found: dict[int, float] = {}
    open_: dict[tuple[float, float, int], list[int]] = {(lo, hi, 0): sorted(set(ranks))}
    while open_:
        spans = sorted(open_)
        place = F.lit(None)
        for i, (a, b, _) in enumerate(spans):
            width = (b - a) / RANGES
            within = F.when(F.col("v") == F.lit(b), F.lit(RANGES - 1)).otherwise(F.least(F.floor((F.col("v") - F.lit(a)) / F.lit(width)), F.lit(RANGES - 2)) if width > 0 else F.lit(0))
            place = F.when(F.col("v").between(F.lit(a), F.lit(b)), F.lit(i * RANGES) + within).otherwise(place)
        rows = values.select(place.cast("long").alias("k"), "v").where("k is not null").groupBy("k").agg(F.count("*").alias("n"), F.min("v").alias("a"), F.max("v").alias("b")).collect()
        wanted, open_ = open_, {}
        for i, span in enumerate(spans):
            before = span[2]
            for r in sorted((r for r in rows if r["k"] // RANGES == i), key=lambda r: r["k"]):
                inside = [x for x in wanted[span] if before <= x < before + r["n"]]
                if inside and r["a"] == r["b"]:
                    found.update(dict.fromkeys(inside, r["a"]))
                elif inside:
                    open_[r["a"], r["b"], before] = inside
                before += r["n"]
    return found


def quantiles(df: DataFrame, column: str, **levels: float) -> DataFrame:
    """One row of exact quantiles with linear interpolation, such as quantiles(df, "v", q10=0.1).

    The row is computed at once and returned as constants, so plans that use it several times don't repeat the work.
    Nulls are left out; an empty column gives nulls. Unlike the ``percentile`` aggregate no task holds all distinct
    values.
    """
    values = df.where(F.col(column).isNotNull()).select(F.col(column).cast("double").alias("v"))
    n, lo, hi = values.agg(F.count("*"), F.min("v"), F.max("v")).first()
    one = df.sparkSession.range(1)
    if not n:
        return one.select(*[F.lit(None).cast("double").alias(name) for name in levels])
    at = {name: p * (n - 1) for name, p in levels.items()}
    got = order_statistics(values, [r for x in at.values() for r in (math.floor(x), math.ceil(x))], lo, hi)
    low, high = {k: got[math.floor(x)] for k, x in at.items()}, {k: got[math.ceil(x)] for k, x in at.items()}
    return one.select(*[F.lit(low[k] + (high[k] - low[k]) * (x - math.floor(x))).alias(k) for k, x in at.items()])


def with_quantiles(df: DataFrame, column: str, **levels: float) -> DataFrame:
    return df.crossJoin(F.broadcast(quantiles(df, column, **levels)))


def ranked(df: DataFrame, column: str) -> DataFrame:
    """(v, n, before, dense, n_all, n_values): each distinct value with its count, the rows and values below it, and the totals.

    The distinct values are sorted into ranges of about equal size, one a task; running sums are taken inside the ranges
    and then over their totals, so no task holds all values.
    """
    counts = df.where(F.col(column).isNotNull()).groupBy(F.col(column).alias("v")).agg(F.count("*").alias("n"))
    dealt = cut(counts.repartitionByRange("v").withColumn("part", F.spark_partition_id()))
    order = Window.orderBy("part")  # one row a range
    before = order.rowsBetween(Window.unboundedPreceding, -1)
    sums = dealt.groupBy("part").agg(F.sum("n").alias("rows"), F.count("*").alias("values"))
    sums = sums.select("part", *[F.coalesce(F.sum(c).over(before), F.lit(0)).alias(f"base_{c}") for c in ("rows", "values")], F.sum("rows").over(Window.partitionBy()).alias("n_all"), F.sum("values").over(Window.partitionBy()).alias("n_values"))
    inside = Window.partitionBy("part").orderBy("v").rowsBetween(Window.unboundedPreceding, -1)
    own = dealt.withColumns({"own": F.coalesce(F.sum("n").over(inside), F.lit(0)), "turn": F.count("*").over(inside)})
    return own.join(F.broadcast(sums), "part").select("v", "n", (F.col("own") + F.col("base_rows")).alias("before"), (F.col("turn") + F.col("base_values")).alias("dense"), "n_all", "n_values")
