"""Matching in time and space: as-of joins, band joins, lookups, duplicate groups."""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame, Window, functions as F

from tidewatch.functions.mathx import d, haversine
from tidewatch.operators.grid import cut


def asof_nearest(left: DataFrame, right: DataFrame, by: list[str], time: str, value: str, order: str, tolerance_s: int) -> DataFrame:
    """Each left row with the right row nearest in time within the tolerance, the first of equals.

    Right rows are put in time buckets as wide as the tolerance, and left rows look into three of them: an equi-join
    whose size follows the rows near each other, not the product of the tables. ``status`` is aligned, missing (the
    match has no value) or no_match.
    """
    micros = tolerance_s * 1_000_000
    lt, rt = F.unix_micros(F.col(time)), F.unix_micros(F.col(time))
    l = left.withColumn("_t", lt).withColumn("_b", F.explode(F.array(*[F.floor(lt / micros) + k for k in (-1, 0, 1)])))
    r = right.select(*by, F.col(value).alias("matched_value"), F.col(order).alias("_o"), rt.alias("_rt"), F.floor(rt / micros).alias("_b"), F.lit(True).alias("_hit"))
    near = l.join(r, [*by, "_b"]).where(F.abs(F.col("_t") - F.col("_rt")) <= micros)
    best = near.groupBy(*left.columns).agg(F.min(F.struct(F.abs(F.col("_t") - F.col("_rt")).alias("gap"), F.col("_o").alias("o"), F.col("matched_value").alias("v"))).alias("m"))
    a, b = left.alias("a"), best.alias("b")
    same = [F.col(f"a.{c}").eqNullSafe(F.col(f"b.{c}")) for c in left.columns]
    out = a.join(b, same, "left").select(*[F.col(f"a.{c}").alias(c) for c in left.columns], F.col("m.v").alias("matched_value"), (F.col("m.gap") / 1e6).alias("gap_s"), F.col("m.o").alias("matched_row"))
    return out.withColumn("status", F.when(F.col("matched_row").isNull(), "no_match").when(F.col("matched_value").isNull(), "missing").otherwise("aligned"))


def nearby_pairs(df: DataFrame, key: str, time: str, lat: str, lon: str, hours: float, metres: float) -> DataFrame:
    """Pairs (a, b) with times within ``hours`` and places within ``metres``: a < b.

    Rows meet in cells of that size in time and space; one side looks into the neighbouring cells. The cells'
    populations bound the work, and a crowded cell is split by adaptive execution.
    """
    size_lat = metres / 111_000.0
    size_lon = size_lat * 2.5  # wide enough up to 66 degrees of latitude
    micros = int(hours * 3600 * 1_000_000)
    cell = lambda c, s: F.floor(F.col(c) / d(s))
    rows = df.where(F.col(time).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(time).alias("t"), F.col(lat).alias("y"), F.col(lon).alias("x"))
    rows = rows.withColumns({"ct": F.floor(F.col("t") / micros), "cy": cell("y", size_lat), "cx": cell("x", size_lon)})
    near = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    a = rows.withColumn("ct", near("ct")).withColumn("cy", near("cy")).withColumn("cx", near("cx")).select("ct", "cy", "cx", F.col("k").alias("a"), F.col("t").alias("ta"), F.col("y").alias("ya"), F.col("x").alias("xa"))
    b = rows.select("ct", "cy", "cx", F.col("k").alias("b"), F.col("t").alias("tb"), F.col("y").alias("yb"), F.col("x").alias("xb"))
    metres_apart = haversine(F.col("ya"), F.col("xa"), F.col("yb"), F.col("xb"))
    pairs = a.join(b, ["ct", "cy", "cx"]).where((F.col("a") < F.col("b")) & (F.abs(F.col("ta") - F.col("tb")) <= micros) & (metres_apart <= metres))
    return pairs.select("a", "b", (F.abs(F.col("ta") - F.col("tb")) / 1e6).alias("seconds"), metres_apart.alias("metres"))


def near_places(places: DataFrame, metres: float) -> DataFrame:
    """(y, x, y2, x2): pairs of distinct places within ``metres``, each in both orders and with itself."""
    size_lat = metres / 111_000.0
    size_lon = size_lat * 2.5  # wide enough up to 66 degrees of latitude
    at = places.withColumns({"cy": F.floor(F.col("y") / d(size_lat)), "cx": F.floor(F.col("x") / d(size_lon))})
    around = lambda c: F.explode(F.array(F.col(c) - 1, F.col(c), F.col(c) + 1))
    other = at.select(F.col("y").alias("y2"), F.col("x").alias("x2"), "cy", "cx").withColumn("cy", around("cy")).withColumn("cx", around("cx"))
    same = (F.col("y") == F.col("y2")) & (F.col("x") == F.col("x2"))
    return at.join(other, ["cy", "cx"]).where(same | (haversine(F.col("y"), F.col("x"), F.col("y2"), F.col("x2")) <= metres)).select("y", "x", "y2", "x2")


def first_come_groups(df: DataFrame, key: str, time: str, lat: str, lon: str, hours: float, metres: float) -> DataFrame:
    """(k, anchor): duplicate groups in order of time and key. The earliest free row anchors a group of the free later
    rows within ``hours`` and ``metres`` of it; anchors without members are left out, and so are rows without time or place.

    A row is an anchor exactly if no earlier row near it is one, so rows are decided in rounds: those with no
    earlier undecided row near them anchor, those near an earlier anchor are taken, until none is left. Rows meet on time
    lines, one for each place and span of time, that hold the rows of all places near it; there the latest undecided row
    and the latest anchor before a row are all that matters, so no pair is ever made: a place with very many rows
    costs its rows times the places near it, and is cut by time. The rounds follow the longest chain of
    rows that wait for each other. A taken row belongs to the earliest anchor near it; anchors on a line are few.
    """
    reach = int(hours * 3600 * 1_000_000)
    span = 4 * reach
    rows = df.where(F.col(time).isNotNull() & F.col(lat).isNotNull() & F.col(lon).isNotNull()).select(F.col(key).alias("k"), F.unix_micros(time).alias("t"), F.col(lat).cast("double").alias("y2"), F.col(lon).cast("double").alias("x2"))
    near = near_places(rows.select(F.col("y2").alias("y"), F.col("x2").alias("x")).distinct(), metres)
    home = F.floor(F.col("t") / span)
    spans = F.array_compact(F.array(home, F.when(F.floor((F.col("t") + reach) / span) > home, home + 1)))
    copies = rows.join(near, ["y2", "x2"]).withColumn("line", F.explode(spans))
    own = (F.col("y") == F.col("y2")) & (F.col("x") == F.col("x2")) & (F.col("line") == home)
    lines = cut(copies.select("y", "x", "line", "t", "k", own.alias("own"), F.lit(None).cast("string").alias("state")))

    line = Window.partitionBy("y", "x", "line")
    before = line.orderBy("t", "k").rowsBetween(Window.unboundedPreceding, -1)
    last = lambda c: F.last(F.when(c, F.col("t")), ignorenulls=True).over(before) >= F.col("t") - reach
    free = F.col("state").isNull()
    decided, open_lines = [], lines
    while True:
        taken, waits = F.coalesce(last(F.col("state") == "anchor"), F.lit(False)), F.coalesce(last(free), F.lit(False))
        verdict = F.when(F.col("own") & free, F.when(taken, "taken").when(~waits, "anchor"))
        step = cut(open_lines.withColumn("verdict", verdict))
        fresh = step.where("verdict is not null").select("k", F.col("verdict").alias("fresh"))
        if fresh.isEmpty():
            break
        decided.append(fresh)
        known = step.join(fresh, "k", "left").select("y", "x", "line", "t", "k", "own", F.coalesce("state", "fresh").alias("state"))
        left = known.where("state is null or state = 'anchor'")
        open_lines = left.withColumn("_open", F.max((F.col("own") & free).cast("int")).over(line)).where("_open = 1").drop("_open")
    empty = lines.limit(0).select("k", F.lit("").alias("fresh"))
    state = cut(reduce(DataFrame.unionByName, decided, empty))
    anchors = lines.join(state.where("fresh = 'anchor'"), "k").select("y", "x", "line", F.col("t").alias("ta"), F.col("k").alias("a"))
    members = lines.where("own").join(state.where("fresh = 'taken'"), "k").join(anchors, ["y", "x", "line"])
    members = members.where((F.struct("ta", "a") < F.struct(F.col("t").alias("ta"), F.col("k").alias("a"))) & (F.col("ta") >= F.col("t") - reach))
    members = cut(members.groupBy("k").agg(F.min(F.struct("ta", "a")).alias("_a")).select("k", F.col("_a.a").alias("anchor")))
    return members.unionByName(members.select(F.col("anchor").alias("k"), "anchor").distinct())


def digest_groups(df: DataFrame, digest: Column, key: str) -> DataFrame:
    """Rows whose non-empty digest occurs more than once, with the group's size and smallest key.

    Digests are computed once into a narrow table, and counted before joining.
    """
    rows = cut(df.select(key, digest.alias("digest"))).where("digest <> ''")
    groups = rows.groupBy("digest").agg(F.count("*").alias("n"), F.min(key).alias("anchor")).where("n > 1")
    return rows.join(groups, "digest").select(key, "digest", "n", "anchor", (F.col(key) == F.col("anchor")).alias("is_representative"))


def ward_lookup(df: DataFrame, wards: DataFrame, ward: str, lat: str, lon: str) -> DataFrame:
    """Rows without a point get their ward's centroid: precision point, ward_centroid or unknown, radius 75, 300 or null."""
    places = wards.select(F.col("ward").cast("string").alias("_w"), "centroid_lat", "centroid_lon")
    out = df.join(places, F.col(ward).cast("string") == F.col("_w"), "left")
    point, known = F.col(lat).isNotNull() & F.col(lon).isNotNull(), F.col("centroid_lat").isNotNull()
    return out.withColumns({
        "precision": F.when(point, "point").when(known, "ward_centroid").otherwise("unknown"), "radius_m": F.when(point, d(75)).when(known, d(300)),
        "geo_lat": F.when(point, F.col(lat)).otherwise(F.col("centroid_lat")), "geo_lon": F.when(point, F.col(lon)).otherwise(F.col("centroid_lon")),
    }).drop("_w", "centroid_lat", "centroid_lon")


def geocode(df: DataFrame, gazetteer: DataFrame, address: str, least: float = 0.3, letters: int = 4) -> DataFrame:
    """The best-confidence place whose name the address contains, in any case; the shortest, then last name of equals.

    Names meet addresses on their first ``letters`` letters (all of a shorter name), of which an address has about as many
    as it has letters: a join on equal keys for gazetteers of any size, confirmed on whole names. Empty names are in no
    address. Repeated rows stay.
    """
    name = F.lower("name")
    places = gazetteer.where((F.length("name") > 0) & (F.col("place_confidence") >= least)).select("name", "place_lat", "place_lon", "place_confidence", F.substring(name, 1, letters).alias("_start"))
    sizes = [r[0] for r in places.select(F.length("_start")).distinct().collect()]  # at most ``letters`` numbers
    rows = cut(df.withColumn("_row", F.monotonically_increasing_id()))
    text = F.lower(F.col(address))

    def parts(n: int) -> Column:
        return F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substr(text, i, F.lit(n)))

    pieces = [parts(n) for n in sizes] or [F.array().cast("array<string>")]
    asked = rows.where(F.col(address).isNotNull()).select("_row", F.col(address).alias("_text"), F.explode(F.array_distinct(F.flatten(F.array(*pieces)))).alias("_start"))
    hits = asked.join(places, "_start").where(F.contains(F.lower("_text"), name))
    best = hits.groupBy("_row").agg(F.max(F.struct("place_confidence", (-F.length("name")).alias("short"), "name", "place_lat", "place_lon")).alias("_b"))
    return rows.join(best, "_row", "left").select(*df.columns, F.col("_b.name").alias("place"), F.col("_b.place_lat").alias("place_lat"), F.col("_b.place_lon").alias("place_lon"))


def station_table(df: DataFrame, time: str, station: str, value: str, stations: list) -> DataFrame:
    """One row for each time of any station and one column for each station; nothing is averaged."""
    wide = df.groupBy(time).pivot(station, stations).agg(F.first(value))
    return wide.select(time, *[F.col(f"`{s}`").alias(f"rainfall_{s}") for s in stations])


#: Points that a point should meet in a cell, for each neighbour sought.
CROWD = 16


def uncrowded(pts: DataFrame, cell: float, k: int) -> float:
    """A width of at most ``cell`` whose cells hold about ``CROWD`` points a neighbour, as a point of ``pts`` (x, y) sees it."""
    for _ in range(16):  # each is one row of sums
        each = pts.groupBy(F.floor(F.col("x") / d(cell)), F.floor(F.col("y") / d(cell))).agg(F.count("*").cast("double").alias("n"))
        n, squares = each.agg(F.sum("n"), F.sum(F.col("n") * F.col("n"))).first()
        if not n or squares / n <= CROWD * k:
            break
        cell /= max(2, int(math.sqrt(squares / n / (CROWD * k))))
    return cell


def nearest_neighbors(df: DataFrame, key: str, x: str, y: str, k: int, cell: float, among: DataFrame | None = None) -> DataFrame:
    """The ``k`` nearest points, by distance and then key: (src, dst, distance, rank).

    ``among``: the points that are sought, with the same columns; without it they are those of ``df`` less the asking one.

    Points meet those of the 3 x 3 cells around them. A point whose k-th neighbour is not nearer than the cells reach,
    or that has fewer, is asked again with cells twice as large, until the cells hold all points. The first cells are
    ``cell`` wide, or less where they would be crowded, so the pairs grow with the points. Of the points at one place only
    those with the smallest keys can be among the nearest, and the others are not sought.
    """
    own_points = lambda p: cut(p.select(F.col(key).alias("k"), F.col(x).cast("double").alias("x"), F.col(y).cast("double").alias("y")))
    asked = own_points(df)
    pts = asked if among is None else own_points(among)
    place = Window.partitionBy("x", "y").orderBy("k")
    pts = cut(pts.withColumn("_n", F.row_number().over(place)).where(F.col("_n") <= (k + 1 if among is None else k)).drop("_n"))
    extent = (pts if among is None else pts.unionByName(asked)).agg(F.greatest(F.max("x") - F.min("x"), F.max("y") - F.min("y"))).first()[0] or 0.0
    cell = uncrowded(pts, cell, k)
    done = None
    while True:
        at = lambda c: F.floor(F.col(c) / d(cell))  # noqa: E731, B023
        ring = lambda c: F.explode(F.array(*[at(c) + i for i in (-1, 0, 1)]))  # noqa: E731, B023
        a = asked.withColumn("cx", ring("x")).withColumn("cy", ring("y")).select("cx", "cy", F.col("k").alias("src"), F.col("x").alias("xa"), F.col("y").alias("ya"))
        b = pts.select(at("x").alias("cx"), at("y").alias("cy"), F.col("k").alias("dst"), F.col("x").alias("xb"), F.col("y").alias("yb"))
        pairs = a.join(b, ["cx", "cy"]).where("src <> dst" if among is None else "true").withColumn("distance", F.sqrt((F.col("xa") - F.col("xb")) * (F.col("xa") - F.col("xb")) + (F.col("ya") - F.col("yb")) * (F.col("ya") - F.col("yb"))))
        own = Window.partitionBy("src")
        near = pairs.withColumn("rank", F.row_number().over(own.orderBy("distance", "dst"))).where(F.col("rank") <= k)
        if cell > extent:
            last = near.select("src", "dst", "distance", "rank")
            return last if done is None else done.unionByName(last)
        near = near.withColumns({"got": F.count("*").over(own), "far": F.max("distance").over(own)})
        sure = cut(near.where((F.col("got") == k) & (F.col("far") < d(cell))).select("src", "dst", "distance", "rank"))
        done = sure if done is None else done.unionByName(sure)
        asked = cut(asked.join(sure.select(F.col("src").alias("k")).distinct(), "k", "left_anti"))
        if asked.isEmpty():
            return done
        cell *= 2


def box_join(boxes: DataFrame, asked: DataFrame, key: str, asked_key: str, cell: float) -> DataFrame:
    """(asked_key, key) of boxes (x0, y0, x1, y1) that meet the asked boxes, borders included; a point is a box of no size.

    Both sides are dealt to the cells that they cover and meet there; a pair is reported in the first cell that both
    cover, so nothing is made distinct. Cells should be about as large as most boxes.
    """
    at = lambda c: F.floor(F.col(c) / d(cell))
    covered = lambda lo, hi: F.explode(F.sequence(at(lo), at(hi)))
    own = lambda df, k, p: df.select(F.col(k), *[F.col(c).alias(p + c) for c in ("x0", "y0", "x1", "y1")]).withColumn("cx", covered(p + "x0", p + "x1")).withColumn("cy", covered(p + "y0", p + "y1"))
    met = own(boxes, key, "_a").join(own(asked, asked_key, "_b"), ["cx", "cy"])
    first = (F.col("cx") == F.greatest(at("_ax0"), at("_bx0"))) & (F.col("cy") == F.greatest(at("_ay0"), at("_by0")))
    meets = (F.col("_ax0") <= F.col("_bx1")) & (F.col("_ax1") >= F.col("_bx0")) & (F.col("_ay0") <= F.col("_by1")) & (F.col("_ay1") >= F.col("_by0"))
    return met.where(first & meets).select(asked_key, key)
