"""Geometry as plain structs and Column arithmetic: points are (lon, lat), polygons are rings.

``rings`` is ``array<array<struct<x: double, y: double>>>``; the even-odd rule makes holes and
multipolygons work.  Distances are great circles on a sphere.
"""

from __future__ import annotations

import math

from pyspark.sql import Column
from pyspark.sql import functions as F

EARTH_KM = 6371.0088
RINGS = "array<array<struct<x:double,y:double>>>"


def haversine_km(lon1: Column, lat1: Column, lon2: Column, lat2: Column) -> Column:
    a = F.pow(F.sin(F.radians(lat2 - lat1) / 2), 2) + F.cos(F.radians(lat1)) * F.cos(F.radians(lat2)) * F.pow(F.sin(F.radians(lon2 - lon1) / 2), 2)
    return F.lit(2 * EARTH_KM) * F.asin(F.least(F.lit(1.0), F.sqrt(a)))


def normal_lon(lon: Column) -> Column:
    """Longitude in [-180, 180)."""
    return F.pmod(lon + 180.0, F.lit(360.0)) - 180.0


def contains(rings: Column, x: Column, y: Column) -> Column:
    """Even-odd test of one point against rings (closed or not); many points of a grid go by ``operators.cover``."""

    def crossings(ring: Column) -> Column:
        edges = F.transform(F.sequence(F.lit(0), F.size(ring) - 1), lambda i: F.struct(F.get(ring, i).alias("a"), F.get(ring, F.pmod(i + 1, F.size(ring))).alias("b")))
        crosses = lambda e: ((e["a"]["y"] > y) != (e["b"]["y"] > y)) & (
            x < F.try_divide((e["b"]["x"] - e["a"]["x"]) * (y - e["a"]["y"]), e["b"]["y"] - e["a"]["y"]) + e["a"]["x"]
        )
        return F.size(F.filter(edges, crosses))

    return F.aggregate(F.filter(rings, lambda r: F.size(r) > 0), F.lit(0), lambda n, r: n + crossings(r)) % 2 == 1


def short_way(a: Column, b: Column) -> Column:
    """Longitude ``b`` by the name that is nearest to ``a``; a difference of a full turn stays."""
    far = F.abs(b - a)
    return F.when((far > 180.0) & (far < 360.0 - 1e-9) | (far > 360.0 + 1e-9), a + F.pmod(b - a + 180.0, F.lit(360.0)) - 180.0).otherwise(b)


def _unit(lon: Column, lat: Column) -> tuple[Column, Column, Column]:
    across = F.cos(F.radians(lat))
    return across * F.cos(F.radians(lon)), across * F.sin(F.radians(lon)), F.sin(F.radians(lat))


def _cross(a, b):
    return a[1] * b[2] - a[2] * b[1], a[2] * b[0] - a[0] * b[2], a[0] * b[1] - a[1] * b[0]


def _dot(a, b):
    return a[0] * b[0] + a[1] * b[1] + a[2] * b[2]


def arc(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    """Of the shorter great-circle arc between two points: its circle's normal and the bounds of what lies beside it, as unit vectors."""
    a, b = _unit(ax, ay), _unit(bx, by)
    n = _cross(a, b)
    vectors = {"n": n, "from": _cross(n, a), "to": _cross(b, n)}
    return F.struct(F.sqrt(_dot(n, n)).alias("size"), *[v.alias(f"{k}{i}") for k, xyz in vectors.items() for i, v in enumerate(xyz)])


def arc_km(arc: Column, ax: Column, ay: Column, bx: Column, by: Column, x: Column, y: Column) -> Column:
    """Distance in km from a point to an arc (``arc`` of its ends).

    To the arc's circle if the point's foot lies on the arc, else to the nearer end.
    """
    p = _unit(x, y)
    of = lambda k: _dot([arc[f"{k}{i}"] for i in range(3)], p)
    beside = (arc["size"] > 1e-12) & (of("from") >= 0) & (of("to") >= 0)
    off = F.lit(EARTH_KM) * F.abs(F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), of("n") / F.greatest(arc["size"], F.lit(1e-300))))))
    return F.when(beside, off).otherwise(F.least(haversine_km(ax, ay, x, y), haversine_km(bx, by, x, y)))


def bounds(rings: Column) -> dict[str, Column]:
    points = F.flatten(rings)
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    return {"xmin": F.array_min(xs), "xmax": F.array_max(xs), "ymin": F.array_min(ys), "ymax": F.array_max(ys)}


#: Fixed values of EPSG:3035 (GRS 80, centre 52 N 10 E, false easting and northing).
_A, _F, _LAT0, _LON0, _E0, _N0 = 6378137.0, 1 / 298.257222101, 52.0, 10.0, 4321000.0, 3210000.0
_E2 = _F * (2 - _F)
_E = math.sqrt(_E2)


def _q(sin):
    """Authalic function of a sine, for numbers and columns."""
    log = (lambda v: F.log(v)) if isinstance(sin, Column) else math.log
    return (1 - _E2) * (sin / (1 - _E2 * sin * sin) - log((1 - _E * sin) / (1 + _E * sin)) / (2 * _E))


_QP, _Q0 = _q(1.0), _q(math.sin(math.radians(_LAT0)))
_RQ = _A * math.sqrt(_QP / 2)
_B0 = math.asin(_Q0 / _QP)
_M0 = math.cos(math.radians(_LAT0)) / math.sqrt(1 - _E2 * math.sin(math.radians(_LAT0)) ** 2)
_D = _A * _M0 / (_RQ * math.cos(_B0))


def to_laea(lon: Column, lat: Column) -> tuple[Column, Column]:
    """Longitude and latitude to EPSG:3035 easting and northing, in metres."""
    beta = F.asin(_q(F.sin(F.radians(lat))) / _QP)
    d = F.radians(lon - _LON0)
    b = F.lit(_RQ) * F.sqrt(2 / (1 + math.sin(_B0) * F.sin(beta) + math.cos(_B0) * F.cos(beta) * F.cos(d)))
    return _E0 + b * _D * F.cos(beta) * F.sin(d), _N0 + b / _D * (math.cos(_B0) * F.sin(beta) - math.sin(_B0) * F.cos(beta) * F.cos(d))


def from_laea(east: Column, north: Column) -> tuple[Column, Column]:
    """EPSG:3035 to longitude and latitude (series in the eccentricity)."""
    x, y = (east - _E0) / _D, (north - _N0) * _D
    rho = F.sqrt(x * x + y * y)
    c = 2 * F.asin(rho / (2 * _RQ))
    beta = F.when(rho == 0, F.lit(_B0)).otherwise(F.asin(F.cos(c) * math.sin(_B0) + F.try_divide(y * F.sin(c) * math.cos(_B0), rho)))
    lon = F.lit(_LON0) + F.degrees(F.atan2(x * F.sin(c), rho * math.cos(_B0) * F.cos(c) - y * math.sin(_B0) * F.sin(c)))
    e4, e6 = _E2**2, _E2**3
    lat = beta + (_E2 / 3 + 31 * e4 / 180 + 517 * e6 / 5040) * F.sin(2 * beta) + (23 * e4 / 360 + 251 * e6 / 3780) * F.sin(4 * beta) + 761 * e6 / 45360 * F.sin(6 * beta)
    return F.when(rho == 0, F.lit(_LON0)).otherwise(lon), F.degrees(lat)
