"""Planar predicates and measures as columns; polygons as arrays of (x, y) structs."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from tidewatch.functions.mathx import d


def in_box(lon: Column, lat: Column, box: tuple[float, float, float, float]) -> Column:
    """Closed bounding-box test; both range predicates reach the scan."""
    west, south, east, north = box
    return lon.between(west, east) & lat.between(south, north)


def boxes_overlap(a: list[Column], b: list[Column]) -> Column:
    """Closed overlap of (west, south, east, north) boxes."""
    return (a[0] <= b[2]) & (b[0] <= a[2]) & (a[1] <= b[3]) & (b[1] <= a[3])


def orient2d(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """1 counter-clockwise, -1 clockwise, 0 within the rounding bound of the determinant."""
    left, right = (ax - cx) * (by - cy), (ay - cy) * (bx - cx)
    det, bound = left - right, (F.abs(left) + F.abs(right)) * d(3.3306690738754716e-16)
    return F.when(det > bound, F.lit(1)).when(det < -bound, F.lit(-1)).otherwise(F.lit(0))


def incircle2d(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column, px: Column, py: Column) -> Column:
    """Positive if the point lies inside the circle through a, b, c taken counter-clockwise."""
    ax, ay, bx, by, cx, cy = ax - px, ay - py, bx - px, by - py, cx - px, cy - py
    a, b, c = ax * ax + ay * ay, bx * bx + by * by, cx * cx + cy * cy
    return ax * (by * c - cy * b) - ay * (bx * c - cx * b) + a * (bx * cy - cx * by)


def edges(ring: Column) -> Column:
    """Edges of a ring: structs of its vertices and their successors, the last joined to the first."""
    after = F.concat(F.slice(ring, 2, F.size(ring)), F.slice(ring, 1, 1))
    return F.zip_with(ring, after, lambda p, q: F.struct(p["x"].alias("x1"), p["y"].alias("y1"), q["x"].alias("x2"), q["y"].alias("y2")))


def signed_area(ring: Column) -> Column:
    return F.aggregate(edges(ring), d(0), lambda a, e: a + (e["x1"] * e["y2"] - e["x2"] * e["y1"])) / 2


def centroid(ring: Column) -> Column:
    """Area-weighted centroid as (x, y)."""
    cross = lambda e: e["x1"] * e["y2"] - e["x2"] * e["y1"]
    over = signed_area(ring) * 6
    x = F.aggregate(edges(ring), d(0), lambda a, e: a + (e["x1"] + e["x2"]) * cross(e)) / over
    y = F.aggregate(edges(ring), d(0), lambda a, e: a + (e["y1"] + e["y2"]) * cross(e)) / over
    return F.struct(x.alias("x"), y.alias("y"))


def contains_point(ring: Column, x: Column, y: Column) -> Column:
    """Ray casting: odd number of edges crossed to the right."""
    hit = lambda e: ((e["y1"] > y) != (e["y2"] > y)) & (x < (e["x2"] - e["x1"]) * (y - e["y1"]) / (e["y2"] - e["y1"] + d(1e-10)) + e["x1"])
    return F.size(F.filter(edges(ring), hit)) % 2 == 1


def distance_to_boundary(ring: Column, x: Column, y: Column) -> Column:
    """Least distance to an edge; negative inside."""

    def to_edge(e: Column) -> Column:
        dx, dy = e["x2"] - e["x1"], e["y2"] - e["y1"]
        s = F.greatest(d(0), F.least(d(1), ((x - e["x1"]) * dx + (y - e["y1"]) * dy) / F.greatest(dx * dx + dy * dy, d(1e-300))))
        return F.hypot(x - e["x1"] - s * dx, y - e["y1"] - s * dy)

    near = F.array_min(F.transform(edges(ring), to_edge))
    return F.when(contains_point(ring, x, y), -near).otherwise(near)


def box_area_km2(west: float, south: float, east: float, north: float) -> Column:
    """Planar area of a small box: 111 km a degree, longitudes shrunk by the middle latitude."""
    return F.abs(d(east - west) * F.cos(F.radians(d((south + north) / 2)))) * d(111.0) * F.abs(d(north - south)) * d(111.0)
