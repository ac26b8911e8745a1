"""Projection, grid and polygon expressions.

WGS84 and UTM are converted with a three-term Krüger series (published constants
of the transverse Mercator projection), sub-millimetre inside a zone.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

# WGS84 ellipsoid and the UTM scale and offsets.
A_AXIS = 6378137.0
FLATTENING = 1 / 298.257223563
K0, FALSE_EAST, FALSE_NORTH = 0.9996, 500000.0, 10000000.0

_N = FLATTENING / (2 - FLATTENING)
_RADIUS = A_AXIS / (1 + _N) * (1 + _N ** 2 / 4 + _N ** 4 / 64)
_E = 2 * math.sqrt(_N) / (1 + _N)
_ALPHA = (_N / 2 - 2 * _N ** 2 / 3 + 5 * _N ** 3 / 16,
          13 * _N ** 2 / 48 - 3 * _N ** 3 / 5,
          61 * _N ** 3 / 240)
_BETA = (_N / 2 - 2 * _N ** 2 / 3 + 37 * _N ** 3 / 96,
         _N ** 2 / 48 + _N ** 3 / 15,
         17 * _N ** 3 / 480)
_DELTA = (2 * _N - 2 * _N ** 2 / 3 - 2 * _N ** 3 + 116 * _N ** 4 / 45,
          7 * _N ** 2 / 3 - 8 * _N ** 3 / 5 - 227 * _N ** 4 / 45,
          56 * _N ** 3 / 15 - 136 * _N ** 4 / 35,
          4279 * _N ** 4 / 630)


def let(value: Column, body) -> Column:
    """``body(v)`` with ``v`` bound to ``value``, which is then evaluated once."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def _atanh(x: Column) -> Column:
    return 0.5 * F.log((1 + x) / (1 - x))


def _point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def utm_zone(epsg: Column) -> tuple[Column, Column]:
    """Central meridian in degrees and false northing of a UTM EPSG code."""
    zone = F.pmod(epsg, F.lit(100))
    return zone * 6 - 183, F.when(F.floor(epsg / 100) == 327, F.lit(FALSE_NORTH)).otherwise(F.lit(0.0))


def project_point(lon: Column, lat: Column, epsg: Column) -> Column:
    """``struct<x,y>`` in metres.

    Each intermediate is bound once; spelled out, the series would repeat the
    latitude terms dozens of times.
    """
    meridian, north0 = utm_zone(epsg)

    def conformal(s):
        return _point(F.radians(lon - meridian), F.sinh(_atanh(s) - _E * _atanh(_E * s)))

    def sphere(v):
        return _point(F.atan2(v["y"], F.cos(v["x"])), _atanh(F.sin(v["x"]) / F.sqrt(1 + v["y"] * v["y"])))

    def series(v):
        xi, eta = v["x"], v["y"]
        east, north = eta, xi
        for j, a in enumerate(_ALPHA, start=1):
            east = east + a * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
            north = north + a * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
        return _point(FALSE_EAST + K0 * _RADIUS * east, north0 + K0 * _RADIUS * north)

    return let(let(let(F.sin(F.radians(lat)), conformal), sphere), series)


def unproject_point(x: Column, y: Column, epsg: Column) -> Column:
    """``struct<x,y>`` of longitude and latitude in degrees."""
    meridian, north0 = utm_zone(epsg)

    def sphere(v):
        xi, eta = v["x"], v["y"]
        xi1, eta1 = xi, eta
        for j, b in enumerate(_BETA, start=1):
            xi1 = xi1 - b * F.sin(2 * j * xi) * F.cosh(2 * j * eta)
            eta1 = eta1 - b * F.cos(2 * j * xi) * F.sinh(2 * j * eta)
        return _point(xi1, eta1)

    def degrees(v):
        lon = F.radians(meridian.cast("double")) + F.atan2(F.sinh(v["y"]), F.cos(v["x"]))
        chi = F.asin(F.sin(v["x"]) / F.cosh(v["y"]))
        return let(chi, lambda c: _point(F.degrees(lon), F.degrees(
            c + sum((d * F.sin(2 * j * c) for j, d in enumerate(_DELTA, start=1)), F.lit(0.0)))))

    start = _point((y - north0) / (K0 * _RADIUS), (x - FALSE_EAST) / (K0 * _RADIUS))
    return let(let(start, sphere), degrees)


def project_utm(lon: Column, lat: Column, epsg: Column) -> tuple[Column, Column]:
    """Easting and northing in metres."""
    p = project_point(lon, lat, epsg)
    return p["x"], p["y"]


def unproject_utm(x: Column, y: Column, epsg: Column) -> tuple[Column, Column]:
    """Longitude and latitude in degrees."""
    p = unproject_point(x, y, epsg)
    return p["x"], p["y"]


def epsg_of(crs: Column) -> Column:
    """Integer code out of ``EPSG:n`` text."""
    return F.regexp_extract(crs, r"(?i)^EPSG:(\d+)$", 1).try_cast("int")


def is_utm(epsg: Column) -> Column:
    return F.floor(epsg / 100).isin(326, 327)


def hull_of_corners(west: Column, south: Column, east: Column, north: Column, epsg: Column) -> Column:
    """Projected envelope of a lon/lat box, from its four corners."""
    corners = F.array(*[project_point(x, y, epsg) for x in (west, east) for y in (south, north)])

    def envelope(pts):
        xs, ys = F.transform(pts, lambda p: p["x"]), F.transform(pts, lambda p: p["y"])
        return F.struct(F.array_min(xs).alias("west"), F.array_min(ys).alias("south"),
                        F.array_max(xs).alias("east"), F.array_max(ys).alias("north"))

    return let(corners, envelope)


def snap_bounds(box: Column, gsd: Column) -> Column:
    """Grow a projected box outward to multiples of ``gsd``."""
    return F.struct((F.floor(box["west"] / gsd) * gsd).alias("west"),
                    (F.floor(box["south"] / gsd) * gsd).alias("south"),
                    (F.ceil(box["east"] / gsd) * gsd).alias("east"),
                    (F.ceil(box["north"] / gsd) * gsd).alias("north"))


def grid_from_box(box: Column, gsd: Column) -> Column:
    """North-up grid (origin at the north-west corner) over a projected, snapped box."""
    return F.struct(gsd.cast("double").alias("gsd"), box["west"].alias("x0"), box["north"].alias("y0"),
                    F.rint((box["east"] - box["west"]) / gsd).cast("int").alias("width"),
                    F.rint((box["north"] - box["south"]) / gsd).cast("int").alias("height"))


def pixel_center(grid: Column, row: Column, col: Column) -> tuple[Column, Column]:
    return (grid["x0"] + (col + F.lit(0.5)) * grid["gsd"],
            grid["y0"] - (row + F.lit(0.5)) * grid["gsd"])


def window_for(grid: Column, box: Column) -> Column:
    """Pixel window (row, col, height, width) of a projected box; NULL when disjoint."""
    c0 = F.greatest(F.lit(0), F.floor((box["west"] - grid["x0"]) / grid["gsd"]))
    r0 = F.greatest(F.lit(0), F.floor((grid["y0"] - box["north"]) / grid["gsd"]))
    c1 = F.least(grid["width"], F.ceil((box["east"] - grid["x0"]) / grid["gsd"]))
    r1 = F.least(grid["height"], F.ceil((grid["y0"] - box["south"]) / grid["gsd"]))
    return F.when((c1 > c0) & (r1 > r0), F.struct(
        r0.cast("int").alias("row_off"), c0.cast("int").alias("col_off"),
        (r1 - r0).cast("int").alias("height"), (c1 - c0).cast("int").alias("width")))


def tile_corners(grid: Column, row: Column, col: Column, size, epsg: Column) -> Column:
    """Lon/lat corners TL, TR, BR, BL of a tile, rounded to 7 places."""
    size = F.lit(size) if isinstance(size, int) else size
    points = []
    for dr, dc in ((0, 0), (0, 1), (1, 1), (1, 0)):
        x = grid["x0"] + (col + size * dc) * grid["gsd"]
        y = grid["y0"] - (row + size * dr) * grid["gsd"]
        points.append(unproject_point(x, y, epsg))
    return F.transform(F.array(*points), lambda p: F.array(F.round(p["x"], 7), F.round(p["y"], 7)))


def ring_area(ring: Column) -> Column:
    """Unsigned planar area of a ring of ``struct<x,y>`` (closed or open), by shoelace."""
    def shoelace(r):
        terms = F.zip_with(r, next_points(r), lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
        return F.abs(F.aggregate(terms, F.lit(0.0), lambda acc, t: acc + t)) / 2
    return let(ring, lambda r: F.when(F.size(r) >= 3, shoelace(r)).when(r.isNotNull(), F.lit(0.0)))


def next_points(r: Column) -> Column:
    """The ring rotated by one vertex."""
    return F.concat(F.slice(r, F.lit(2), F.greatest(F.size(r) - 1, F.lit(0))), F.slice(r, 1, 1))


def project_ring(ring: Column, epsg: Column) -> Column:
    return F.transform(ring, lambda p: project_point(p["x"], p["y"], epsg))


def polygon_area_m2(rings: Column, epsg: Column) -> Column:
    """Area of a lon/lat polygon (outer ring, then holes) in the area's projected CRS."""
    areas = F.transform(rings, lambda r: ring_area(project_ring(r, epsg)))

    def net(a):
        holes = F.aggregate(F.slice(a, F.lit(2), F.greatest(F.size(a) - 1, F.lit(0))), F.lit(0.0), lambda acc, x: acc + x)
        return F.try_element_at(a, F.lit(1)) - holes

    return let(areas, net)


def bbox_ring(west: Column, south: Column, east: Column, north: Column) -> Column:
    """Closed ring W-S, E-S, E-N, W-N, W-S as nested coordinate arrays."""
    return F.array(*[F.array(x, y) for x, y in
                     ((west, south), (east, south), (east, north), (west, north), (west, south))])


def close_ring(points: Column) -> Column:
    return F.concat(points, F.slice(points, 1, 1))
