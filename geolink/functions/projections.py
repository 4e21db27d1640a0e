"""Projected coordinate systems as column formulas, by EPSG code.

Transverse Mercator by Krueger's series to the fourth order (UTM zones), polar
stereographic in both variants, and the equal-area system of EPSG:3035.  Datums are
taken as they are: WGS 84 and ETRS 89 coincide, others are not shifted.
"""

from __future__ import annotations

import math
from dataclasses import dataclass
from functools import cached_property

from pyspark.sql import Column
from pyspark.sql import functions as F

from geolink.functions.geometry import from_laea, to_laea

#: Half axis and flattening of WGS 84 and GRS 80.
WGS84, GRS80 = (6378137.0, 1 / 298.257223563), (6378137.0, 1 / 298.257222101)


def _series(odd: tuple[float, ...], of) -> Column:
    out = F.lit(0.0)
    for j, c in enumerate(odd, 1):
        out = out + c * of(2 * j)
    return out


def _latitude(chi: Column, e: float) -> Column:
    """Latitude in radians from the conformal latitude."""
    e2, e4, e6, e8 = (e**k for k in (2, 4, 6, 8))
    terms = (e2 / 2 + 5 * e4 / 24 + e6 / 12 + 13 * e8 / 360, 7 * e4 / 48 + 29 * e6 / 240 + 811 * e8 / 11520, 7 * e6 / 120 + 81 * e8 / 1120, 4279 * e8 / 161280)
    return chi + _series(terms, lambda k: F.sin(k * chi))


@dataclass(frozen=True)
class TransverseMercator:
    axis: float
    flattening: float
    lat0: float
    lon0: float
    scale: float
    east: float
    north: float

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @cached_property
    def n(self) -> float:
        return self.flattening / (2 - self.flattening)

    @cached_property
    def radius(self) -> float:
        return self.scale * self.axis / (1 + self.n) * (1 + self.n**2 / 4 + self.n**4 / 64)

    @cached_property
    def there(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 5 * n**3 / 16 + 41 * n**4 / 180, 13 * n**2 / 48 - 3 * n**3 / 5 + 557 * n**4 / 1440, 61 * n**3 / 240 - 103 * n**4 / 140, 49561 * n**4 / 161280

    @cached_property
    def back(self) -> tuple[float, ...]:
        n = self.n
        return n / 2 - 2 * n**2 / 3 + 37 * n**3 / 96 - n**4 / 360, n**2 / 48 + n**3 / 15 - 437 * n**4 / 1440, 17 * n**3 / 480 - 37 * n**4 / 840, 4397 * n**4 / 161280

    @cached_property
    def start(self) -> float:
        """Northing of the origin's latitude above the equator, in radii."""
        s = math.sin(math.radians(self.lat0))
        xi = math.atan(math.sinh(math.atanh(s) - self.e * math.atanh(self.e * s)))
        return xi + sum(c * math.sin(2 * j * xi) for j, c in enumerate(self.there, 1))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        d = F.radians(lon - self.lon0)
        s = F.sin(F.radians(lat))
        t = F.sinh(F.atanh(s) - self.e * F.atanh(self.e * s))
        xi, eta = F.atan2(t, F.cos(d)), F.asinh(F.sin(d) / F.sqrt(t * t + F.cos(d) * F.cos(d)))
        x = eta + _series(self.there, lambda k: F.cos(k * xi) * F.sinh(k * eta))
        y = xi + _series(self.there, lambda k: F.sin(k * xi) * F.cosh(k * eta))
        return self.east + self.radius * x, self.north + self.radius * (y - self.start)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        xi, eta = (north - self.north) / self.radius + self.start, (east - self.east) / self.radius
        x = xi - _series(self.back, lambda k: F.sin(k * xi) * F.cosh(k * eta))
        y = eta - _series(self.back, lambda k: F.cos(k * xi) * F.sinh(k * eta))
        chi = F.asin(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), F.sin(x) / F.cosh(y))))
        return F.lit(self.lon0) + F.degrees(F.atan2(F.sinh(y), F.cos(x))), F.degrees(_latitude(chi, self.e))


@dataclass(frozen=True)
class PolarStereographic:
    """Round the pole of ``true``'s sign: true to scale at that latitude, or by ``scale`` at the pole (90 or -90)."""

    axis: float
    flattening: float
    true: float
    lon0: float
    scale: float
    east: float
    north: float

    @cached_property
    def e(self) -> float:
        return math.sqrt(self.flattening * (2 - self.flattening))

    @property
    def side(self) -> int:
        return 1 if self.true > 0 else -1

    @cached_property
    def radius(self) -> float:
        """Metres from the pole for each unit of t."""
        e = self.e
        if abs(self.true) == 90:
            return 2 * self.axis * self.scale / math.sqrt((1 + e) ** (1 + e) * (1 - e) ** (1 - e))
        phi = math.radians(abs(self.true))
        s = math.sin(phi)
        return self.axis * math.cos(phi) / math.sqrt(1 - e * e * s * s) / (math.tan(math.pi / 4 - phi / 2) / ((1 - e * s) / (1 + e * s)) ** (e / 2))

    def forward(self, lon: Column, lat: Column) -> tuple[Column, Column]:
        phi, d = F.radians(self.side * lat), F.radians(lon - self.lon0)
        s = self.e * F.sin(phi)
        rho = self.radius * F.tan(math.pi / 4 - phi / 2) / F.pow((1 - s) / (1 + s), self.e / 2)
        return self.east + rho * F.sin(d), self.north - self.side * rho * F.cos(d)

    def inverse(self, east: Column, north: Column) -> tuple[Column, Column]:
        x, y = east - self.east, self.side * (self.north - north)
        t = F.sqrt(x * x + y * y) / self.radius
        lon = F.lit(self.lon0) + F.degrees(F.atan2(x, y))
        return lon, self.side * F.degrees(_latitude(math.pi / 2 - 2 * F.atan(t), self.e))


class Laea3035:
    forward = staticmethod(to_laea)
    inverse = staticmethod(from_laea)


class Geographic:
    """Longitude and latitude themselves."""

    @staticmethod
    def forward(lon: Column, lat: Column) -> tuple[Column, Column]:
        return lon, lat

    inverse = forward


def projection(code: int):
    """The system of an EPSG code: 4326, 4258, 3035, UTM (326zz, 327zz, 258zz) and polar stereographic ones; ValueError for others."""
    if code in (4326, 4258):
        return Geographic
    if code == 3035:
        return Laea3035
    if 32601 <= code <= 32660 or 32701 <= code <= 32760:
        return TransverseMercator(*WGS84, 0.0, (code % 100) * 6 - 183.0, 0.9996, 500_000.0, 10_000_000.0 if code > 32700 else 0.0)
    if 25828 <= code <= 25838:
        return TransverseMercator(*GRS80, 0.0, (code % 100) * 6 - 183.0, 0.9996, 500_000.0, 0.0)
    #: Latitude of true scale, longitude down or up, scale at the pole, false origin.
    polar = {3413: (70.0, -45.0, 1.0, 0.0), 3995: (71.0, 0.0, 1.0, 0.0), 3031: (-71.0, 0.0, 1.0, 0.0), 3032: (-71.0, 70.0, 1.0, 6e6), 32661: (90.0, 0.0, 0.994, 2e6), 32761: (-90.0, 0.0, 0.994, 2e6)}
    if code in polar:
        true, lon0, scale, origin = polar[code]
        return PolarStereographic(*WGS84, true, lon0, scale, origin, origin)
    raise ValueError(f"no formulas for EPSG:{code}")


def unproject(rings: Column, code: int) -> Column:
    """Rings of a projected system to longitude and latitude."""
    inverse = projection(code).inverse

    def point(p: Column) -> Column:
        lon, lat = inverse(p["x"], p["y"])
        return F.struct(lon.alias("x"), lat.alias("y"))

    return F.transform(rings, lambda r: F.transform(r, point))
