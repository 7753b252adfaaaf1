"""Geometry on lon/lat structs, rings as arrays of points, and boxes."""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

from tessera.functions.text import bound

#: Mean radius of the Earth in metres (fixed value).
EARTH = 6_371_008.8


def point(lon: Column, lat: Column) -> Column:
    return F.struct(lon.cast("double").alias("lon"), lat.cast("double").alias("lat"))


def bbox(west: Column, south: Column, east: Column, north: Column) -> Column:
    return F.struct(west.cast("double").alias("west"), south.cast("double").alias("south"), east.cast("double").alias("east"), north.cast("double").alias("north"))


def bounding_box(ring: Column) -> Column:
    def of(r: Column) -> Column:
        lon, lat = F.transform(r, lambda p: p["lon"]), F.transform(r, lambda p: p["lat"])
        return bbox(F.array_min(lon), F.array_min(lat), F.array_max(lon), F.array_max(lat))

    return bound(ring, of)


def _edges(ring: Column) -> Column:
    """Pairs of neighbouring points of a closed ring."""
    return bound(ring, lambda r: F.transform(r, lambda p, i: F.struct(p.alias("a"), F.get(r, F.pmod(i + 1, F.size(r))).alias("b"))))


def _cross(e: Column) -> Column:
    return e["a"]["lon"] * e["b"]["lat"] - e["b"]["lon"] * e["a"]["lat"]


def area(ring: Column) -> Column:
    return F.abs(F.aggregate(_edges(ring), F.lit(0.0), lambda s, e: s + _cross(e))) / 2


def centroid(ring: Column) -> Column:
    """Of the area; of a degenerate ring, the mean of its points."""

    def of(r: Column) -> Column:
        total = lambda edges, f: F.aggregate(edges, F.lit(0.0), lambda s, e: s + f(e))
        both = lambda f: lambda e: (e["a"][f] + e["b"][f]) * _cross(e)
        sums = bound(_edges(r), lambda e: F.struct(total(e, _cross).alias("twice"), total(e, both("lon")).alias("x"), total(e, both("lat")).alias("y")))
        mean = lambda f: F.aggregate(r, F.lit(0.0), lambda s, p: s + p[f]) / F.size(r)
        return bound(sums, lambda t: F.when(t["twice"] != 0, point(t["x"] / (3 * t["twice"]), t["y"] / (3 * t["twice"]))).otherwise(point(mean("lon"), mean("lat"))))

    return bound(ring, of)


def distance(a: Column, b: Column) -> Column:
    return F.sqrt(F.pow(a["lon"] - b["lon"], 2) + F.pow(a["lat"] - b["lat"], 2))


def length(line: Column) -> Column:
    steps = bound(line, lambda r: F.transform(F.slice(r, 2, F.greatest(F.size(r), F.lit(1))), lambda p, i: distance(F.get(r, i), p)))
    return F.aggregate(steps, F.lit(0.0), lambda s, d: s + d)


def haversine(a: Column, b: Column) -> Column:
    """Metres along the surface."""
    dlat, dlon = F.radians(b["lat"] - a["lat"]), F.radians(b["lon"] - a["lon"])
    h = F.pow(F.sin(dlat / 2), 2) + F.cos(F.radians(a["lat"])) * F.cos(F.radians(b["lat"])) * F.pow(F.sin(dlon / 2), 2)
    return 2 * EARTH * F.asin(F.sqrt(F.least(h, F.lit(1.0))))


def box_contains(box: Column, p: Column) -> Column:
    return bound(F.struct(box.alias("box"), p.alias("p")), lambda x: _box_contains(x["box"], x["p"]))


def _box_contains(box: Column, p: Column) -> Column:
    return p["lon"].between(box["west"], box["east"]) & p["lat"].between(box["south"], box["north"])


def ring_contains(ring: Column, p: Column) -> Column:
    """Ray casting; points on an edge may fall on either side."""

    def crosses(e: Column, p: Column) -> Column:
        a, b = e["a"], e["b"]
        spans = (a["lat"] > p["lat"]) != (b["lat"] > p["lat"])
        return F.when(spans, p["lon"] < (b["lon"] - a["lon"]) * (p["lat"] - a["lat"]) / (b["lat"] - a["lat"]) + a["lon"]).otherwise(F.lit(False))

    return bound(p, lambda q: F.pmod(F.size(F.filter(_edges(ring), lambda e: crosses(e, q))), F.lit(2)) == 1)


def _boxes(a: Column, b: Column, body) -> Column:
    """``body`` of two boxes that are each evaluated once."""
    return bound(F.struct(a.alias("a"), b.alias("b")), lambda x: body(x["a"], x["b"]))


def _intersects(a: Column, b: Column) -> Column:
    return (a["west"] <= b["east"]) & (b["west"] <= a["east"]) & (a["south"] <= b["north"]) & (b["south"] <= a["north"])


def _overlaps(a: Column, b: Column) -> Column:
    return (a["west"] < b["east"]) & (b["west"] < a["east"]) & (a["south"] < b["north"]) & (b["south"] < a["north"])


def box_intersects(a: Column, b: Column) -> Column:
    return _boxes(a, b, _intersects)


def box_overlaps(a: Column, b: Column) -> Column:
    return _boxes(a, b, _overlaps)


def box_touches(a: Column, b: Column) -> Column:
    return _boxes(a, b, lambda x, y: _intersects(x, y) & ~_overlaps(x, y))


def covering_cells(box: Column, size: float) -> Column:
    """Cells of a lon/lat grid that a box meets, as column:row."""
    cell = lambda v: F.floor(v / size).cast("int")

    def of(b: Column) -> Column:
        rows = F.sequence(cell(b["south"]), cell(b["north"]))
        return F.flatten(F.transform(F.sequence(cell(b["west"]), cell(b["east"])), lambda c: F.transform(rows, lambda r: F.concat_ws(":", c.cast("string"), r.cast("string")))))

    return bound(box, of)


def tile_bounds(z: Column, x: Column, y: Column) -> Column:
    """Box of a Web-Mercator tile."""
    n = F.pow(F.lit(2.0), z)
    lat = lambda v: F.degrees(F.atan((F.exp(math.pi * (1 - 2 * v / n)) - F.exp(-math.pi * (1 - 2 * v / n))) / 2))
    return bbox(x / n * 360 - 180, lat(y + 1), (x + 1) / n * 360 - 180, lat(y))


def simplify(line: Column, tolerance: float) -> Column:
    """The line without points that are nearer than ``tolerance`` to the last
    one kept; both ends stay."""

    def step(kept: Column, p: Column) -> Column:
        return F.when(F.size(kept) == 0, F.array(p)).when(distance(F.try_element_at(kept, F.lit(-1)), p) >= tolerance, F.array_append(kept, p)).otherwise(kept)

    def of(r: Column) -> Column:
        inner = F.aggregate(F.slice(r, 1, F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 0), step)
        return F.when(F.size(r) > 1, F.array_append(inner, F.try_element_at(r, F.lit(-1)))).otherwise(r)

    return bound(line, of)


def transform(p: Column, crs: str) -> Column:
    """A point between lon/lat degrees (EPSG:4326) and Web Mercator metres (EPSG:3857)."""
    if crs == "EPSG:3857":
        r = 6_378_137.0  # fixed value: the sphere of Web Mercator
        return point(F.radians(p["lon"]) * r, F.log(F.tan(F.lit(math.pi / 4) + F.radians(p["lat"]) / 2)) * r)
    if crs == "EPSG:4326":
        r = 6_378_137.0
        return point(F.degrees(p["lon"] / r), F.degrees(2 * F.atan(F.exp(p["lat"] / r)) - math.pi / 2))
    raise ValueError(f"unknown reference system {crs}")
