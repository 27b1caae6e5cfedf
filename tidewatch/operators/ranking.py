"""Sums over all pairs of rows by two orders at once, without making the pairs."""

from __future__ import annotations

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, functions as F

from tidewatch.operators.grid import cut


def above_sum(rank: np.ndarray, p: np.ndarray, asking_rank: np.ndarray, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """For each asking row: how many rows of lesser rank have p > at, and the sum of their p.

    Two ranks differ first in one bit; at that bit the lesser row is on the left of a node and the greater on its right.
    So for each bit the left rows are sorted once by node and p, and every right row takes a range of them.
    """
    n, order = len(p), np.argsort(p, kind="stable")
    ordered = p[order]
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    from_place = np.searchsorted(ordered, at, "right")
    count, total = np.zeros(len(at), np.int64), np.zeros(len(at))
    top = int(max(rank.max(initial=0), asking_rank.max(initial=0)))
    for bit in range(top.bit_length()):
        left, right = np.flatnonzero((rank >> bit) & 1 == 0), np.flatnonzero((asking_rank >> bit) & 1 == 1)
        keys = (rank[left] >> (bit + 1)) * (n + 1) + place[left]
        by = np.argsort(keys)
        keys, sums = keys[by], np.r_[0.0, np.cumsum(p[left][by])]
        node = asking_rank[right] >> (bit + 1)
        lo, hi = np.searchsorted(keys, node * (n + 1) + from_place[right]), np.searchsorted(keys, (node + 1) * (n + 1))
        count[right] += hi - lo
        total[right] += sums[hi] - sums[lo]
    return count, total


def ranges(df: DataFrame, column: str, blocks: int) -> np.ndarray:
    """Values that cut a column into about ``blocks`` equal parts."""
    found = df.approxQuantile(column, [k / blocks for k in range(1, blocks)], 0.25 / blocks) if blocks > 1 else []
    return np.unique(np.array(found, float))


def range_of(bounds: np.ndarray, x: np.ndarray) -> np.ndarray:
    """2 k between bounds k - 1 and k, 2 k + 1 on bound k itself: a value of many rows is a range of its own."""
    left = np.searchsorted(bounds, x, "left")
    return 2 * left + (np.searchsorted(bounds, x, "right") > left)


def rank_hinge(df: DataFrame, predicted: str, target: str, by: list[str], margin: float = 0.1, rows: int = 200_000, blocks: int | None = None) -> DataFrame:
    """(by..., n, rank_loss): the mean over all ordered pairs of a group, a row with itself included, of
    max(0, margin - sign(target_i - target_j) (predicted_i - predicted_j)).

    Pairs of equal targets give the margin. The others are counted by two orders: the targets' and the predictions'.
    Both are cut into about ``blocks`` ranges (by default one for each ``rows`` rows, 1024 at most; a group's tables of
    ranges are its only part that comes to the driver). Pairs in different ranges of both orders follow from the ranges'
    counts and sums; pairs within one range of targets, and those of different ranges of targets within one range of
    predictions, are summed range by range (``above_sum``). Values that many rows share are ranges of their own, in
    which no pair is left to count, so they are never gathered. Rows without a target or a prediction take no part.
    """
    group = F.to_json(F.struct(*by)) if by else F.lit("")  # one text for each group, null groups among them
    known = df.where(F.col(predicted).isNotNull() & F.col(target).isNotNull())
    own = cut(known.select(group.alias("g"), F.col(predicted).cast("double").alias("p"), F.col(target).cast("double").alias("t")))
    blocks = blocks or int(min(1024, max(1, -(-own.count() // rows))))
    t_bounds, p_bounds = ranges(own, "t", blocks), ranges(own, "p", blocks)

    def placed(frames):
        for pdf in frames:
            yield pdf.assign(tb=range_of(t_bounds, pdf.t.to_numpy()), pb=range_of(p_bounds, pdf.p.to_numpy()), cb=range_of(p_bounds, pdf.p.to_numpy() - margin))

    own = cut(own.mapInPandas(placed, "g string, p double, t double, tb long, pb long, cb long"))

    def summed(pdf: pd.DataFrame, count: np.ndarray, total: np.ndarray, p: np.ndarray) -> pd.DataFrame:
        return pd.DataFrame({"g": pdf.g.iloc[:1], "s": float((count * (margin - p) + total).sum())})

    def within_targets(pdf: pd.DataFrame) -> pd.DataFrame:
        p, rank = pdf.p.to_numpy(), np.unique(pdf.t.to_numpy(), return_inverse=True)[1]
        return summed(pdf, *above_sum(rank, p, rank, p - margin), p)

    def within_predictions(pdf: pd.DataFrame) -> pd.DataFrame:
        giving = pdf.gives.to_numpy(bool)
        p, rank = pdf.p.to_numpy(), pdf.tb.to_numpy()
        return summed(pdf, *above_sum(rank[giving], p[giving], rank[~giving], p[~giving] - margin), p[~giving])

    out = "g string, s double"
    inside = own.where("tb % 2 = 0").groupBy("g", "tb").applyInPandas(within_targets, out)
    gives = own.where("pb % 2 = 0").select("g", "tb", "p", F.col("pb").alias("b"), F.lit(True).alias("gives"))
    asks = own.where("cb % 2 = 0").select("g", "tb", "p", F.col("cb").alias("b"), F.lit(False).alias("gives"))
    across = gives.unionByName(asks).groupBy("g", "b").applyInPandas(within_predictions, out)
    # a row for each group and pair of ranges: what lies apart in both orders
    giving = own.groupBy("g", "tb", "pb").agg(F.count("*").alias("nj"), F.sum("p").alias("sj"))
    asking = own.groupBy("g", "tb", F.col("cb").alias("pb")).agg(F.count("*").alias("ni"), F.sum("p").alias("si"))
    cells = giving.join(asking, ["g", "tb", "pb"], "full")
    size = 2 * blocks + 1

    def apart(pdf: pd.DataFrame) -> pd.DataFrame:
        table = np.zeros((4, size, size))
        table[:, pdf.tb, pdf.pb] = pdf[["nj", "sj", "ni", "si"]].fillna(0).to_numpy(float).T
        nj, sj, ni, si = table
        before = lambda x: np.pad(np.cumsum(np.cumsum(x[:, ::-1], 1)[:, ::-1], 0), ((1, 0), (0, 1)))[:-1, 1:]  # noqa: E731  lesser targets, greater predictions
        return pd.DataFrame({"g": pdf.g.iloc[:1], "s": float((before(nj) * (margin * ni - si) + before(sj) * ni).sum())})

    beyond = cells.groupBy("g").applyInPandas(apart, out)
    total = inside.unionByName(across).unionByName(beyond).groupBy("g").agg(F.sum("s").alias("s"))
    ties = known.groupBy(*by, F.col(target).alias("_t")).agg(F.count("*").alias("k")).groupBy(*by).agg(F.sum("k").alias("n"), F.sum(F.col("k") * F.col("k").cast("double")).alias("_ties"))
    loss = (2 * F.coalesce("s", F.lit(0.0)) + F.lit(float(margin)) * F.col("_ties")) / (F.col("n").cast("double") * F.col("n"))
    return ties.withColumn("_g", group).join(total.withColumnRenamed("g", "_g"), "_g", "left").select(*by, "n", loss.alias("rank_loss"))
