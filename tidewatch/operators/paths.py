"""Shortest paths over rasters with a metric in each cell, and pairs of points that are near under it."""

from __future__ import annotations

import heapq
import math
import sys
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d
from tidewatch.operators.grid import EIGHT, cut

EPSILON = sys.float_info.epsilon


def gradients(df: DataFrame, value: str, dx: float = 1.0, dy: float = 1.0) -> DataFrame:
    """``gx`` and ``gy``: central differences along columns and rows, one-sided ones on the borders, 0 in single lines."""

    def along(axis: str, other: str, step: float) -> Column:
        w = Window.partitionBy(other).orderBy(axis)
        before, after, own = F.lag(value).over(w), F.lead(value).over(w), F.col(value)
        inside = (after - before) / d(2 * step)
        return F.coalesce(inside, (after - own) / d(step), (own - before) / d(step), d(0))

    return df.withColumns({"gx": along("q", "r", dx), "gy": along("r", "q", dy)})


def _tensor(df: DataFrame, x: str, y: str, along: Column, across: Column) -> DataFrame:
    """m11, m12, m22: cost ``along`` the direction (x, y), ``across`` elsewhere; the same everywhere without a direction."""
    size = F.hypot(x, y)
    ux, uy, more = F.col(x) / size, F.col(y) / size, along - across
    flat = size < EPSILON
    return df.withColumns({"m11": F.when(flat, across).otherwise(across + more * ux * ux), "m12": F.when(flat, d(0)).otherwise(more * ux * uy), "m22": F.when(flat, across).otherwise(across + more * uy * uy)})


def slope_metric(df: DataFrame, elevation: str, dx: float = 1.0, dy: float = 1.0, uphill: float = 2.0, downhill: float = 0.5, base: float = 1.0) -> DataFrame:
    """A metric tensor from each cell's gradient: the mean of the costs up and down the slope along it, ``base`` across."""
    df = gradients(df, elevation, dx, dy)
    steep = F.hypot("gx", "gy")
    return _tensor(df, "gx", "gy", (d(base * uphill) * (1 + steep) + d(base * downhill) / (1 + steep)) / 2, d(base))


def flow_metric(df: DataFrame, x: str, y: str, along: float = 0.5, against: float = 2.0, across: float = 1.0) -> DataFrame:
    """A metric tensor from each cell's flow: the mean of the costs with and against it along the flow."""
    return _tensor(df, x, y, d((along + against) / 2), d(across))


def step_length(dx: Column, dy: Column) -> Column:
    """Length of a displacement under a row's metric."""
    return F.sqrt(F.col("m11") * dx * dx + 2 * F.col("m12") * dx * dy + F.col("m22") * dy * dy)


def relaxed(tile: pd.DataFrame, dx: float, dy: float, most: float) -> list[tuple[int, int, float, int, int]]:
    """(r, q, distance, previous, outside) of a tile's cells that came nearer by their offers, and offers to cells outside.

    A cell's label is the least (distance, previous); an equal distance by a lesser previous cell is taken, too.
    """
    w, h = int(tile.w.iloc[0]), int(tile.h.iloc[0])
    steps = [(i, j, j * dx, i * dy) for i, j in EIGHT]
    place = {k: n for n, k in enumerate(zip(tile.r.tolist(), tile.q.tolist()))}
    cells = list(place)
    m11, m12, m22 = tile.m11.tolist(), tile.m12.tolist(), tile.m22.tolist()
    label = list(zip(tile.distance.tolist(), tile.previous.tolist()))
    heap, changed = [], set()
    for n, offer in enumerate(zip(tile.offer.tolist(), tile.offer_previous.tolist())):
        if offer < label[n]:
            if offer[0] < label[n][0]:
                heap.append((offer[0], n))
            label[n] = offer
            changed.add(n)
    heapq.heapify(heap)
    out: dict[tuple[int, int], tuple[float, int]] = {}
    while heap:
        far, n = heapq.heappop(heap)
        if far > label[n][0]:
            continue
        r, q = cells[n]
        own = r * w + q
        for i, j, x, y in steps:
            offer = (far + math.sqrt(m11[n] * x * x + 2 * m12[n] * x * y + m22[n] * y * y), own)
            if offer[0] > most or not (0 <= r + i < h and 0 <= q + j < w):
                continue
            m = place.get((r + i, q + j))
            if m is None:
                out[r + i, q + j] = min(offer, out.get((r + i, q + j), (math.inf, 0)))
            elif offer < label[m]:
                if offer[0] < label[m][0]:
                    heapq.heappush(heap, (offer[0], m))
                label[m] = offer
                changed.add(m)
    return [(*cells[n], *label[n], 0) for n in sorted(changed)] + [(*k, *v, 1) for k, v in out.items()]


def distance_field(metric: DataFrame, sources: DataFrame, dx: float = 1.0, dy: float = 1.0, most: float = math.inf, tile: int = 128) -> DataFrame:
    """(r, q, cell, distance, previous, uncertainty): shortest distances from the source cells (r, q) of a raster.

    ``metric`` has r, q, h, w and the tensor m11, m12, m22 of each cell (positive definite); a step to one of the eight
    neighbours is measured by the cell that it leaves. ``previous`` is the cell before on the shortest path, the
    least of equals, null at sources. Cells that no source reaches within ``most`` are left out; so are missing cells.

    The raster is cut into tiles. In each round the tiles that got a nearer offer from outside settle inside
    (``relaxed``, one task a tile) and send offers over their borders, so the rounds follow the number of tiles that
    paths cross and not their cells, and a round touches only tiles where something changed.
    """
    by = ["tr", "tc"]
    at = {"tr": F.floor(F.col("r") / tile), "tc": F.floor(F.col("q") / tile)}
    long = lambda c: F.col(c).cast("long").alias(c)
    base = cut(metric.select(long("r"), long("q"), long("h"), long("w"), *[F.col(c).cast("double").alias(c) for c in ("m11", "m12", "m22")]).withColumns(at))
    offers = sources.select(long("r"), long("q"), d(0).alias("distance"), F.lit(-1).cast("long").alias("previous")).withColumns(at)
    schema = "tr long, tc long, r long, q long, distance double, previous long, outside int"
    settled: list[DataFrame] = []

    def settle(pdf: pd.DataFrame) -> pd.DataFrame:
        out = pd.DataFrame(relaxed(pdf, dx, dy, most), columns=["r", "q", "distance", "previous", "outside"])
        out.insert(0, "tr", np.floor_divide(out.r, tile))
        out.insert(1, "tc", np.floor_divide(out.q, tile))
        return out

    def labels(rows: list[DataFrame]) -> DataFrame:
        every = reduce(DataFrame.unionByName, rows)
        return every.groupBy(*by, "r", "q").agg(F.min(F.struct("distance", "previous")).alias("l")).select(*by, "r", "q", "l.distance", "l.previous")

    while True:
        best = labels([offers]).join(base.select("r", "q"), ["r", "q"], "left_semi").withColumnsRenamed({"distance": "offer", "previous": "offer_previous"})
        if settled:
            old = labels(settled).select("r", "q", "distance", "previous")
            best = best.join(old, ["r", "q"], "left").where(F.col("distance").isNull() | (F.struct(F.col("offer").alias("distance"), F.col("offer_previous").alias("previous")) < F.struct("distance", "previous"))).drop("distance", "previous")
        best = cut(best)
        if best.isEmpty():
            break
        active = best.select(*by).distinct()
        cells = base.join(active, by, "left_semi").join(best.select("r", "q", "offer", "offer_previous"), ["r", "q"], "left")
        if settled:
            cells = cells.join(labels(settled).join(active, by, "left_semi").select("r", "q", "distance", "previous"), ["r", "q"], "left")
        else:
            cells = cells.withColumns({"distance": F.lit(None).cast("double"), "previous": F.lit(None).cast("long")})
        full = cells.fillna(math.inf, ["distance", "offer"]).fillna(0, ["previous", "offer_previous"])
        moved = cut(full.groupBy(*by).applyInPandas(settle, schema))
        settled.append(moved.where("outside = 0"))
        if len(settled) > 16:
            settled = [cut(labels(settled))]
        offers = moved.where("outside = 1")
    if not settled:
        return base.limit(0).select("r", "q", F.lit(0).cast("long").alias("cell"), d(0).alias("distance"), F.lit(0).cast("long").alias("previous"), d(0).alias("uncertainty"))
    width = base.select("r", "q", "w")
    out = labels(settled).join(width, ["r", "q"])
    return out.select("r", "q", (F.col("r") * F.col("w") + F.col("q")).alias("cell"), "distance", F.when(F.col("previous") >= 0, F.col("previous")).alias("previous"), (EPSILON * (1 + F.col("distance") / d(dx))).alias("uncertainty"))


def path_cells(tree: DataFrame, targets: DataFrame) -> DataFrame:
    """(target, step, cell, n_cells, distance, uncertainty): the cells of the shortest path to each target ``cell``, from
    its source (step 0) on; targets out of reach have none.

    Pointer doubling: a round adds to every listed cell the one 2**k steps before it, so the rounds follow the
    logarithm of the longest path. ``tree`` is a distance field.
    """
    jump = cut(tree.where("previous is not null").select("cell", F.col("previous").alias("to")))
    found = cut(targets.select("cell").distinct().join(tree.select("cell", "distance"), "cell").select(F.col("cell").alias("target"), "cell", F.lit(0).cast("long").alias("back"), "distance"))
    reach = 1
    while True:
        more = cut(found.join(jump, "cell").select("target", F.col("to").alias("cell"), (F.col("back") + reach).alias("back"), "distance"))
        if more.isEmpty():
            break
        found = cut(found.unionByName(more))
        jump = cut(jump.alias("a").join(jump.alias("b"), F.col("a.to") == F.col("b.cell")).select("a.cell", "b.to"))
        reach *= 2
    size = found.groupBy("target").agg(F.count("*").alias("n_cells"))
    return found.join(size, "target").select("target", (F.col("n_cells") - 1 - F.col("back")).alias("step"), "cell", "n_cells", "distance", (EPSILON * F.col("n_cells")).alias("uncertainty"))


def metric_pairs(points: DataFrame, key: str, x: str, y: str, radius: float, cell: float | None = None) -> DataFrame:
    """(a, b, distance), a < b: points nearer than ``radius`` under either's metric, with the mean of the two distances.

    ``points`` has the tensor m11, m12, m22 of each point's surroundings. Each point covers the cells that the bounding
    box of its ellipse meets (half axes radius * sqrt(m22 / det) and radius * sqrt(m11 / det)), and meets the points
    inside them: a join on cells whose size follows the ellipses and not all pairs. Pairs found from both ends come once.
    """
    half = lambda m: d(radius) * F.sqrt(F.col(m) / (F.col("m11") * F.col("m22") - F.col("m12") * F.col("m12")))
    own = points.where(F.col(x).isNotNull() & F.col(y).isNotNull()).select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y"), "m11", "m12", "m22")
    own = cut(own.withColumns({"wx": half("m22"), "wy": half("m11")}))
    if cell is None:
        cell = own.agg(F.avg(F.greatest("wx", "wy"))).first()[0] or radius
    place = lambda c: F.floor(c / d(cell))
    covered = lambda c, half: F.explode(F.sequence(place(F.col(c) - F.col(half)), place(F.col(c) + F.col(half))))
    asking = own.withColumn("cx", covered("x", "wx")).withColumn("cy", covered("y", "wy"))
    there = own.select(place(F.col("x")).alias("cx"), place(F.col("y")).alias("cy"), F.col("k").alias("k2"), F.col("x").alias("x2"), F.col("y").alias("y2"), F.struct("m11", "m12", "m22").alias("other"))
    gx, gy = F.col("x2") - F.col("x"), F.col("y2") - F.col("y")
    far = step_length(gx, gy)
    back = F.sqrt(F.col("other.m11") * gx * gx + 2 * F.col("other.m12") * gx * gy + F.col("other.m22") * gy * gy)
    met = asking.join(there, ["cx", "cy"]).where(F.col("k") != F.col("k2")).withColumns({"far": far, "back": back}).where(F.col("far") <= d(radius))
    # a pair within both ellipses is found twice: it is kept where the lesser key asks
    once = met.where((F.col("k") < F.col("k2")) | (F.col("back") > d(radius)))
    return once.select(F.least("k", "k2").alias("a"), F.greatest("k", "k2").alias("b"), ((F.col("far") + F.col("back")) / 2).alias("distance"))
