"""Space-time grids as long tables (t, cell, r, q, ...) and neighbourhood operators as equi-joins on shifted indices."""

from __future__ import annotations

import math
import tempfile
import uuid
from functools import reduce

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d

EIGHT = ((-1, 0), (-1, 1), (0, 1), (1, 1), (1, 0), (1, -1), (0, -1), (-1, -1))  # from north, clockwise
#: Cells on each side of a filter up to which it works on tiles, and the cells along a tile's side.
NEAR, TILE = 32, 128
#: Cells of a dense frame that are made at once.
SPAN = 8192
NINE = tuple((i, j) for i in (-1, 0, 1) for j in (-1, 0, 1))


def dense(events: DataFrame, time: str = "ts", cell: str = "user_id", value: str = "value", kind: str = "event_type", report: str = "error") -> DataFrame:
    """(t, cell, r, q, w, v, c): every day and cell from 0 to the greatest, with summed values and counted reports.

    Events are summed by day and cell first; the dense frame is made from ranges, spread over tasks, so its size is days x cells
    and no event meets another. Sums are rounded to nine decimals, so that they don't follow the order of the events: equal days
    stay equal, and reruns agree.
    """
    ends = events.agg(F.min(F.to_date(time)).alias("d0"), F.max(F.to_date(time)).alias("d1"), F.max(cell).alias("u"))
    days = ends.select(F.explode(F.sequence(F.lit(0), F.date_diff("d1", "d0"))).alias("t"), "u", F.ceil(F.sqrt(F.col("u") + 1)).cast("long").alias("w"))
    spans = days.select("t", "w", "u", F.explode(F.sequence(F.lit(0).cast("long"), F.col("u"), F.lit(SPAN).cast("long"))).alias("_c"))
    spans = spans.repartition(int(events.sparkSession.conf.get("spark.sql.shuffle.partitions")), "t", "_c")
    frame = spans.select("t", "w", F.explode(F.sequence("_c", F.least(F.col("_c") + (SPAN - 1), F.col("u")))).alias("cell"))
    day = F.date_diff(F.to_date(time), F.col("d0"))
    sums = events.crossJoin(F.broadcast(ends.select("d0"))).groupBy(day.alias("t"), F.col(cell).alias("cell")).agg(F.round(F.sum(value), 9).alias("v"), F.count_if(F.col(kind) == report).alias("c"))
    out = frame.join(sums, ["t", "cell"], "left")
    return out.select("t", "cell", F.floor(F.col("cell") / F.col("w")).alias("r"), (F.col("cell") % F.col("w")).alias("q"), "w", F.coalesce("v", d(0)).alias("v"), F.coalesce("c", F.lit(0)).alias("c"))


def terrain(events: DataFrame, cell: str = "user_id", value: str = "value") -> DataFrame:
    """(cell, r, q, h, w, z): mean value of each cell, to four decimals, as its elevation on a full raster; absent cells take the mean of all."""
    each = events.groupBy(F.col(cell).alias("cell")).agg(F.avg(value).alias("z"))
    ends = each.agg(F.max("cell").alias("u"), F.avg("z").alias("m")).withColumn("w", F.ceil(F.sqrt(F.col("u") + 1)).cast("long"))
    frame = ends.select("w", "m", F.explode(F.sequence(F.lit(0).cast("long"), F.col("w") * F.col("w") - 1)).alias("cell"))
    return frame.join(each, "cell", "left").select("cell", F.floor(F.col("cell") / F.col("w")).alias("r"), (F.col("cell") % F.col("w")).alias("q"), F.col("w").alias("h"), "w", F.round(F.coalesce("z", "m"), 4).alias("z"))


def neighbors(df: DataFrame, value: str, offsets=EIGHT, edges: str = "clip", by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., r, q, di, dj, n): the values at the offsets around each cell.

    Edges: ``clip`` leaves out what is off the raster, ``wrap`` goes around, ``clamp`` takes the nearest cell. Each
    cell sends its value to its neighbours, so the join is an equi-join of at most nine rows a cell.
    """
    around = F.explode(F.array(*[F.struct(F.lit(i).alias("di"), F.lit(j).alias("dj")) for i, j in offsets])).alias("o")
    asked = df.select(*by, "r", "q", "h", "w", around)
    rr, qq = F.col("r") + F.col("o.di"), F.col("q") + F.col("o.dj")
    if edges == "wrap":
        rr, qq = F.pmod(rr, F.col("h")), F.pmod(qq, F.col("w"))
    elif edges == "clamp":
        rr, qq = F.greatest(F.least(rr, F.col("h") - 1), F.lit(0)), F.greatest(F.least(qq, F.col("w") - 1), F.lit(0))
    asked = asked.select(*by, "r", "q", F.col("o.di").alias("di"), F.col("o.dj").alias("dj"), rr.cast("long").alias("_r"), qq.cast("long").alias("_q"))
    given = df.select(*by, F.col("r").cast("long").alias("_r"), F.col("q").cast("long").alias("_q"), F.col(value).alias("n"))
    return asked.join(given, [*by, "_r", "_q"]).drop("_r", "_q")


def slope_degrees(df: DataFrame, value: str = "z", size: float = 1.0) -> DataFrame:
    """Slope by central differences that wrap around the borders."""
    n = neighbors(df, value, ((-1, 0), (1, 0), (0, -1), (0, 1)), "wrap")
    pick = lambda i, j: F.max(F.when((F.col("di") == i) & (F.col("dj") == j), F.col("n")))
    g = n.groupBy("r", "q").agg(((pick(1, 0) - pick(-1, 0)) / (2 * size)).alias("gy"), ((pick(0, 1) - pick(0, -1)) / (2 * size)).alias("gx"))
    return g.select("r", "q", F.degrees(F.atan(F.hypot("gx", "gy"))).alias("slope"))


def fill_sinks(df: DataFrame, value: str = "z", depth: float = 0.5) -> DataFrame:
    """Raises cells below all eight neighbours (wrapped) to the least of them, by at most ``depth``; one pass."""
    low = neighbors(df, value, EIGHT, "wrap").groupBy("r", "q").agg(F.min("n").alias("least"))
    raise_ = F.when(F.col("least") > F.col(value), F.least(F.col("least") - F.col(value), d(depth))).otherwise(d(0))
    return df.join(low, ["r", "q"]).select("r", "q", "least", (F.col(value) + raise_).alias("filled"))


def mean_filter(df: DataFrame, value: str = "z", by: tuple[str, ...] = ()) -> DataFrame:
    """3 x 3 mean with clamped borders."""
    return neighbors(df, value, NINE, "clamp", by).groupBy(*by, "r", "q").agg(F.avg("n").alias("smooth"))


def spikes(df: DataFrame, value: str = "z", limit: float = 6.0, flat: float = 0.1) -> DataFrame:
    """3 x 3 median and median deviation (each cell's from its own median, then their 3 x 3 median); spike beyond ``limit``."""
    med = neighbors(df, value, NINE, "clamp").groupBy("r", "q").agg(F.median("n").alias("med"))
    dev = df.join(med, ["r", "q"]).withColumn("dev", F.abs(F.col(value) - F.col("med")))
    mad = neighbors(dev, "dev", NINE, "clamp").groupBy("r", "q").agg(F.median("n").alias("mad"))
    z = F.abs(F.col(value) - F.col("med")) / (F.col("mad") * 1.4826 + 1e-6)
    return dev.join(mad, ["r", "q"]).join(slope_degrees(df, value), ["r", "q"]).select("r", "q", "med", "mad", (z > limit).alias("spike"), (F.col("slope") < flat).alias("flat"))


def flow_direction(df: DataFrame, value: str = "z") -> DataFrame:
    """D8 code of the greatest drop (0 north, clockwise), the first of equals; -1 for pits and on the border."""
    code = F.lit(-1)
    for k, (i, j) in enumerate(EIGHT):
        code = F.when((F.col("di") == i) & (F.col("dj") == j), F.lit(k)).otherwise(code)
    n = neighbors(df, value).join(df.select("r", "q", F.col(value).alias("own")), ["r", "q"])
    best = n.withColumn("drop", F.col("own") - F.col("n")).withColumn("code", code).where("drop > 0").groupBy("r", "q").agg(F.max(F.struct("drop", (-F.col("code")).alias("m"))).alias("b"))
    inner = F.col("r").between(1, F.col("h") - 2) & F.col("q").between(1, F.col("w") - 2)
    return df.join(best, ["r", "q"], "left").select("r", "q", "h", "w", F.when(inner & F.col("b").isNotNull(), -F.col("b.m")).otherwise(F.lit(-1)).alias("code"))


def flow_targets(directions: DataFrame) -> DataFrame:
    """(src, dst) cell numbers along the flow; cells that flow nowhere have no row."""
    di, dj = F.array(*[F.lit(i) for i, _ in EIGHT]), F.array(*[F.lit(j) for _, j in EIGHT])
    to = (F.col("r") + F.get(di, F.col("code"))) * F.col("w") + F.col("q") + F.get(dj, F.col("code"))
    return directions.where("code >= 0").select((F.col("r") * F.col("w") + F.col("q")).cast("long").alias("src"), to.cast("long").alias("dst"))


def flow_accumulation(directions: DataFrame) -> DataFrame:
    """Cells that drain through each cell, itself included.

    The flow is a forest, as it falls strictly. Path doubling: each round a cell's reach jumps twice as far, so the
    rounds follow the logarithm of the longest path and not its length.
    """
    cells = directions.select((F.col("r") * F.col("w") + F.col("q")).cast("long").alias("cell"))
    jump = flow_targets(directions)
    count = cells.withColumn("n", F.lit(1).cast("long"))
    while not jump.isEmpty():
        passed = count.join(jump, count.cell == jump.src).groupBy("dst").agg(F.sum("n").alias("more"))
        count = count.join(passed, count.cell == passed.dst, "left").select("cell", (F.col("n") + F.coalesce("more", F.lit(0))).alias("n"))
        a, b = jump.alias("a"), jump.alias("b")
        jump = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        count, jump = cut(count), cut(jump)
    return count.select("cell", F.col("n").alias("accumulation"))


_local: list[str] = []


def cut(df: DataFrame) -> DataFrame:
    """Cuts the lineage by a table in the folder that all executors share, so that ``df`` is computed once.

    The folder is that of ``spark.checkpoint.dir``; only where none is named, in local sessions, one is made.
    """
    spark = df.sparkSession
    folder = spark.conf.get("spark.checkpoint.dir", None)
    if not folder:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir must name a folder that driver and executors share")
        if not _local:
            _local.append("file://" + tempfile.mkdtemp(prefix="tidewatch-"))
        folder = _local[0]
    path = f"{folder.rstrip('/')}/cut-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


def upstream_index(accumulation: DataFrame, artifact: Column | None = None, floor: float = 0.4) -> DataFrame:
    """Accumulation scaled to 0 .. 1, with confidence 0.5 at artifacts and never below ``floor``."""
    ends = accumulation.agg(F.min("accumulation").alias("lo"), F.max("accumulation").alias("hi"))
    share = (F.col("accumulation") - F.col("lo")) / (F.col("hi") - F.col("lo") + 1e-6)
    sure = F.lit(1.0) if artifact is None else F.when(artifact, d(0.5)).otherwise(d(1))
    return accumulation.crossJoin(F.broadcast(ends)).select("cell", share.alias("contribution"), F.greatest(sure, d(floor)).alias("contribution_confidence"))


def terrain_chain(df: DataFrame, value: str = "z", fill: bool = True, depth: float = 0.5, smooth: bool = True, spike: float = 6.0, flat: float = 0.1) -> DataFrame:
    """(cell, r, q, processed, code, accumulation, artifact, contribution, contribution_confidence): elevations to upstream shares.

    Sinks are filled by at most ``depth``, then the raster is smoothed; the flow, its accumulation and the marks of spikes
    and flat places are those of the processed raster, and marks halve the confidence of the share. The processed raster is
    stored once, since the flow and the marks both read it.
    """
    own = df.select(*[F.col(c).cast("long").alias(c) for c in ("r", "q", "h", "w")], F.col(value).cast("double").alias("z"))
    if fill:
        own = own.join(fill_sinks(own, "z", depth).select("r", "q", "filled"), ["r", "q"]).withColumn("z", F.col("filled")).drop("filled")
    if smooth:
        own = own.join(mean_filter(own), ["r", "q"]).withColumn("z", F.col("smooth")).drop("smooth")
    own = cut(own)
    directions = cut(flow_direction(own))
    number = (F.col("r") * F.col("w") + F.col("q")).alias("cell")
    marks = spikes(own, "z", spike, flat).join(own.select("r", "q", "w"), ["r", "q"]).select(number, (F.col("spike") | F.col("flat")).alias("artifact"))
    flow = cut(flow_accumulation(directions).join(marks, "cell"))
    index = upstream_index(flow, F.col("artifact"))
    cells = own.join(directions.select("r", "q", "code"), ["r", "q"]).select(number, "r", "q", F.col("z").alias("processed"), "code")
    return cells.join(flow, "cell").join(index, "cell")


def coarsen(df: DataFrame, value: str, variance: str, by: tuple[str, ...] = (), factor: int = 2) -> DataFrame:
    """Inverse-variance means of square blocks: one level of a pyramid."""
    weight = d(1) / F.col(variance)
    out = df.groupBy(*by, F.floor(F.col("r") / factor).alias("r"), F.floor(F.col("q") / factor).alias("q"))
    return out.agg((F.sum(weight * F.col(value)) / F.sum(weight)).alias("value"), (d(1) / F.sum(weight)).alias("variance"), F.count("*").alias("n_cells"))


def strided_means(df: DataFrame, value: str) -> DataFrame:
    """Means over every cell, every second and every fourth row and column."""
    each = lambda k: F.avg(F.when((F.col("r") % k == 0) & (F.col("q") % k == 0), F.col(value)))
    return df.agg(F.avg(value).alias("level0"), each(2).alias("level1"), each(4).alias("level2"))


def roughness(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Mean gradient magnitude, with one-sided differences on the borders."""
    rows, cols = Window.partitionBy(*by, "q").orderBy("r"), Window.partitionBy(*by, "r").orderBy("q")

    def gradient(w):
        before, after = F.lag(value).over(w), F.lead(value).over(w)
        return F.when(before.isNull() & after.isNull(), d(0)).when(before.isNull(), after - F.col(value)).when(after.isNull(), F.col(value) - before).otherwise((after - before) / 2)

    out = df.withColumn("_gy", gradient(rows)).withColumn("_gx", gradient(cols))
    return out.groupBy(*by).agg(F.avg(F.hypot("_gx", "_gy")).alias("roughness"))


def local_spread(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """Count, mean and deviation of the 3 x 3 cells around each cell that are there."""
    return neighbors(df, value, NINE, "clip", by).groupBy(*by, "r", "q").agg(F.count("n").alias("n_around"), F.avg("n").alias("mean_around"), F.stddev_pop("n").alias("std_around"))


def sample_at(points: DataFrame, raster: DataFrame, x: str, y: str, value: str, cell_size: float) -> DataFrame:
    """Raster values at points by rounding to the nearest cell; null off the raster."""
    asked = points.withColumn("r", F.rint(F.col(y) / d(cell_size)).cast("long")).withColumn("q", F.rint(F.col(x) / d(cell_size)).cast("long"))
    return asked.join(raster.select(F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"), F.col(value).alias("sampled")), ["r", "q"], "left")


def cell_boxes(df: DataFrame, west: float, north: float, width: float, height: float) -> DataFrame:
    """Corners of each cell's box under a north-up affine transform."""
    x0, y1 = d(west) + F.col("q") * d(width), d(north) - F.col("r") * d(height)
    return df.withColumns({"x0": x0, "y0": y1 - d(height), "x1": x0 + d(width), "y1": y1})


def mosaic(tiles: DataFrame, order: str, value: str) -> DataFrame:
    """One value for each cell from overlapping tiles: the first tile with a value wins; combined before the shuffle."""
    valid = tiles.where(F.col(value).isNotNull())
    return valid.groupBy("r", "q").agg(F.min(F.struct(order, value)).alias("b")).select("r", "q", F.col(f"b.{value}").alias(value), F.col(f"b.{order}").alias(order))


def separable(df: DataFrame, values: list[str], weights: list[float], by: tuple[str, ...] = ()) -> DataFrame:
    """(by..., r, q, h, w, values): full rasters filtered along rows, then columns, with mirrored borders.

    ``weights`` are those of the distances 0, 1, 2, ... on both sides. Border cells get their mirror images as further rows.
    Filters of up to ``NEAR`` cells on each side see a raster by tiles with as much margin, a task's group each, in one
    shuffle. Wider ones take one window along each line; so an axis shuffles each cell once.
    """
    reach = len(weights) - 1
    table = F.array(*[d(x) for x in weights])

    def mirrored(axis: str, size: str) -> Column:
        n, s = F.col(size).cast("long"), F.col(axis).cast("long")
        turns = F.ceil((n + reach) / (2 * n)).cast("long")
        images = F.flatten(F.transform(F.sequence(-turns, turns), lambda m: F.array(s + n * 2 * m, n * 2 * m - 1 - s)))
        far = (s >= reach) & (s < n - reach)  # no image of it is in reach of the line
        return F.explode(F.when(far, F.array(s)).otherwise(F.filter(images, lambda i: (i >= -reach) & (i < n + reach))))

    def along(x: DataFrame, axis: str, size: str) -> DataFrame:
        spread = x.withColumn("_i", mirrored(axis, size))
        other = "q" if axis == "r" else "r"
        line = Window.partitionBy(*by, other).orderBy("_i").rangeBetween(-reach, reach)
        framed = spread.withColumn("_f", F.collect_list(F.struct("_i", *values)).over(line)).where((F.col("_i") >= 0) & (F.col("_i") < F.col(size).cast("long")))
        dot = lambda v: F.aggregate("_f", d(0), lambda a, c: a + c[v] * F.get(table, F.abs(c["_i"] - F.col("_i")).cast("int")))
        return framed.select(*by, F.col("_i").alias(axis), other, "h", "w", *[dot(v).alias(v) for v in values])

    rows = df.select(*by, F.col("r").cast("long").alias("r"), F.col("q").cast("long").alias("q"), "h", "w", *[F.col(v).cast("double").alias(v) for v in values])
    if reach > NEAR:
        return along(along(rows, "r", "h"), "q", "w")

    def tiles(at: str, size: str) -> Column:
        last = F.floor((F.col(size).cast("long") - 1) / TILE)
        return F.explode(F.sequence(F.greatest(F.floor((F.col(at) - reach) / TILE), F.lit(0).cast("long")), F.least(F.floor((F.col(at) + reach) / TILE), last)))

    def filtered(pdf: pd.DataFrame) -> pd.DataFrame:
        first = pdf.iloc[0]
        top, left = int(first["_tile_r"]) * TILE, int(first["_tile_q"]) * TILE
        n, m = min(TILE, int(first["h"]) - top), min(TILE, int(first["w"]) - left)
        i, j = pdf["_at_r"].to_numpy() - top, pdf["_at_q"].to_numpy() - left
        own = (i >= 0) & (i < n) & (j >= 0) & (j < m)
        out = pdf.loc[own, [*by, "r", "q", "h", "w"]]
        for v in values:
            z = np.zeros((n + 2 * reach, m + 2 * reach))
            z[i + reach, j + reach] = pdf[v].to_numpy()
            z = sum(z[reach + k : reach + k + n] * weights[abs(k)] for k in range(-reach, reach + 1))
            z = sum(z[:, reach + k : reach + k + m] * weights[abs(k)] for k in range(-reach, reach + 1))
            out[v] = z[i[own], j[own]]
        return out

    spread = rows.withColumn("_at_r", mirrored("r", "h")).withColumn("_at_q", mirrored("q", "w")).withColumn("_tile_r", tiles("_at_r", "h")).withColumn("_tile_q", tiles("_at_q", "w"))
    return spread.groupBy(*by, "_tile_r", "_tile_q").applyInPandas(filtered, rows.schema)


def blurs(df: DataFrame, values: list[str], sigma: float, by: tuple[str, ...] = ()) -> DataFrame:
    """Gaussian blur of full rasters, cut at four deviations."""
    reach = int(4 * sigma + 0.5)
    half = [math.exp(-0.5 * (k / sigma) ** 2) for k in range(reach + 1)]
    total = 2 * sum(half) - half[0]
    return separable(df, values, [x / total for x in half], by)


def blur(df: DataFrame, value: str, sigma: float, by: tuple[str, ...] = (), name: str = "blurred") -> DataFrame:
    return blurs(df, [value], sigma, by).withColumnRenamed(value, name)


def box_mean(df: DataFrame, values: list[str], window: int, by: tuple[str, ...] = ()) -> DataFrame:
    """Means over squares of ``window`` cells, an odd number."""
    return separable(df, values, [1 / window] * (window // 2 + 1), by)


def sparse_smoothing(df: DataFrame, value: str, upstream_mean: float, by: tuple[str, ...] = ()) -> DataFrame:
    """``smoothed``: 0.7 of the blur with deviation 1 + 2 ``upstream_mean`` (the mean share of the greatest) and 0.3 of the value."""
    soft = blur(df, value, 1.0 + 2.0 * upstream_mean, by, "_soft").select(*by, "r", "q", "_soft")
    return df.join(soft, [*by, "r", "q"]).withColumn("smoothed", d(0.7) * F.col("_soft") + d(0.3) * F.col(value)).drop("_soft")


def bilinear(points: DataFrame, raster: DataFrame, y: str, x: str, value: str, by: tuple[str, ...] = (), name: str = "interpolated") -> DataFrame:
    """``points`` with the raster's value between its four cells at fractional rows and columns; null off the raster.

    A raster's cell first takes the values of the three cells after it, so that each point meets one row.
    """
    at = points.withColumns({"_r": F.floor(y).cast("long"), "_q": F.floor(x).cast("long")})
    given = raster.select(*by, F.col("r").cast("long").alias("_r"), F.col("q").cast("long").alias("_q"), F.col(value).alias("_00"))

    def after(cells: DataFrame, axis: str, other: str, **found: str) -> DataFrame:
        line = Window.partitionBy(*by, other).orderBy(axis)
        return cells.withColumns({n: F.when(F.lead(axis).over(line) == F.col(axis) + 1, F.lead(c).over(line)) for n, c in found.items()})

    given = after(after(given, "_q", "_r", _01="_00"), "_r", "_q", _10="_00", _11="_01")
    fy, fx = F.col(y) - F.col("_r"), F.col(x) - F.col("_q")
    part = lambda i, j: F.when((fy if i else 1 - fy) * (fx if j else 1 - fx) > 0, (fy if i else 1 - fy) * (fx if j else 1 - fx) * F.col(f"_{i}{j}")).otherwise(d(0))
    met = at.join(given, [*by, "_r", "_q"], "left")
    return met.select(*points.columns, F.when(F.col("_00").isNotNull(), reduce(lambda a, b: a + b, [part(i, j) for i in (0, 1) for j in (0, 1)])).alias(name))


def multi_resolution(df: DataFrame, value: str, by: tuple[str, ...] = ()) -> DataFrame:
    """``blended``: half the value, half the blur of every second cell, enlarged again; rasters up to 10 cells wide keep theirs."""
    h, w = (F.col(c).cast("long") for c in ("h", "w"))
    wide = (h > 10) & (w > 10)
    coarse = df.where(wide & (F.col("r") % 2 == 0) & (F.col("q") % 2 == 0)).select(*by, F.floor(F.col("r") / 2).alias("r"), F.floor(F.col("q") / 2).alias("q"), F.ceil(h / 2).alias("h"), F.ceil(w / 2).alias("w"), value)
    soft = blur(coarse, value, 1.0, by, "_soft")
    back = lambda c, n: F.col(c) * (F.ceil(n / 2) - 1) / (F.ceil(n / 2) * 2 - 1)
    asked = df.where(wide).select(*by, "r", "q", back("r", h).alias("_y"), back("q", w).alias("_x"))
    up = bilinear(asked, soft, "_y", "_x", "_soft", by, "_up").select(*by, "r", "q", "_up")
    return df.join(up, [*by, "r", "q"], "left").withColumn("blended", F.coalesce((F.col(value) + F.col("_up")) / 2, F.col(value))).drop("_up")


def structural_uncertainty(df: DataFrame, upstream: str, penalty: float = 0.3) -> DataFrame:
    """``structural``: a penalty on the two outer rows and columns, half as much again in corners, and 0.3 for each deviation over two of upstream."""
    row, col = (F.col("r") < 2) | (F.col("r") >= F.col("h") - 2), (F.col("q") < 2) | (F.col("q") >= F.col("w") - 2)
    edge = row.cast("double") + col.cast("double") + d(0.5) * (row & col).cast("double")
    ready = df.crossJoin(F.broadcast(df.agg(F.avg(upstream).alias("_m"), F.stddev_pop(upstream).alias("_s"))))
    z = F.abs(F.col(upstream) - F.col("_m")) / (F.col("_s") + 1e-9)
    return ready.withColumn("structural", edge * penalty + F.when(z > 2, d(0.3) * (z - 2)).otherwise(d(0))).drop("_m", "_s")


def spatial_structure(df: DataFrame, value: str, limit: float = 0.05) -> DataFrame:
    """Mean variance of whole 3 x 3 windows over the variance of all: PASS from ``limit``, WARN below, SKIP under ten windows."""
    inner = (F.col("r") >= 1) & (F.col("r") < F.col("h") - 1) & (F.col("q") >= 1) & (F.col("q") < F.col("w") - 1)
    around = neighbors(df, value, NINE, "clip").groupBy("r", "q").agg(F.count("n").alias("n"), F.var_pop("n").alias("v"))
    local = around.join(df.where(inner).select("r", "q"), ["r", "q"]).where("n = 9").agg(F.count("*").alias("n_windows"), F.avg("v").alias("local"))
    both = local.crossJoin(df.agg(F.var_pop(value).alias("whole"))).withColumn("roughness", F.col("local") / (F.col("whole") + 1e-9))
    return both.select("n_windows", "roughness", F.when(F.col("n_windows") < 10, "SKIP").when(F.col("roughness") >= limit, "PASS").otherwise("WARN").alias("status"))
