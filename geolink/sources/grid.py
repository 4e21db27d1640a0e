"""Grid geometry: a cell is found by arithmetic, never by search."""

from __future__ import annotations

import math
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.functions.geometry import EARTH_KM, haversine_km


@dataclass(frozen=True)
class Grid:
    """Top-left origin, half-open cells [x, x + dx) and, downwards, (y - dy, y]."""

    xmin: float
    ymax: float
    dx: float
    dy: float
    nx: int
    ny: int

    @property
    def wraps(self) -> bool:
        """Whether the grid goes round the globe, so that its last column meets its first."""
        return abs(self.nx * self.dx - 360.0) < self.dx / 2

    def near_lon(self, lon: Column) -> Column:
        """The longitude's name (-180 to 180, 0 to 360, ...) that lies within half a turn of the grid's middle."""
        west = self.xmin + self.nx * self.dx / 2 - 180.0
        return F.when((lon >= west) & (lon < west + 360.0), lon).otherwise(F.pmod(lon - west, F.lit(360.0)) + west)

    def centre(self, ix: Column, iy: Column) -> tuple[Column, Column]:
        return self.xmin + (ix + 0.5) * self.dx, self.ymax - (iy + 0.5) * self.dy

    def cell(self, lon: Column, lat: Column, beyond: bool = False) -> Column:
        """struct(ix, iy) of the containing cell; NULL outside the grid and for coordinates that are none (NULL, NaN, infinite).

        ``beyond``: rows and columns are counted on outside the grid.
        """
        u, v = (self.near_lon(lon) - self.xmin) / self.dx, (self.ymax - lat) / self.dy
        across = (u > -1) & (u < self.nx + 1) if self.wraps else (u >= 0) & (u < self.nx)
        # compared before the cast: a NaN is greater than any number
        held = usable(lon, lat) if beyond else usable(lon, lat) & across & (v >= 0) & (v < self.ny)
        ix = F.floor(u).cast("int")
        return F.when(held, F.struct((F.pmod(ix, F.lit(self.nx)) if self.wraps else ix).alias("ix"), F.floor(v).cast("int").alias("iy")))

    def _box(self, x0: Column, x1: Column, y0: Column, y1: Column) -> Column:
        """All cells that a box touches, as array<struct(ix, iy)>; columns of a grid that wraps run on beyond its edge."""
        i0, i1 = (F.floor((x - self.xmin) / self.dx).cast("int") for x in (x0, x1))
        if self.wraps:
            i1 = F.least(i1, i0 + (self.nx - 1))
        else:
            i0, i1 = F.greatest(i0, F.lit(0)), F.least(i1, F.lit(self.nx - 1))
        row = lambda y: F.floor((self.ymax - y) / self.dy).cast("int")
        j0, j1 = F.greatest(row(y1), F.lit(0)), F.least(row(y0), F.lit(self.ny - 1))
        every = F.flatten(F.transform(F.sequence(i0, i1), lambda i: F.transform(F.sequence(j0, j1), lambda j: F.struct(i.alias("ix"), j.alias("iy")))))
        return F.when((i0 <= i1) & (j0 <= j1), every).otherwise(_no_cells())

    def _named(self, cells: Column) -> Column:
        """Cells of ``_box`` by their numbers in the grid."""
        return F.transform(cells, lambda c: F.struct(F.pmod(c["ix"], F.lit(self.nx)).alias("ix"), c["iy"].alias("iy"))) if self.wraps else cells

    def buffer(self, lon: Column, lat: Column, km: float) -> Column:
        """Cells whose centre lies within ``km`` of a point; the containing cell if there is none."""
        here = self.cell(lon, lat)
        own = F.when(here.isNotNull(), F.array(here)).otherwise(_no_cells())
        if km <= 0:
            return own
        up, aside = reach(lat, km)
        x = self.near_lon(lon)
        box = F.when(usable(lon, lat), self._box(x - aside, x + aside, lat - up, lat + up)).otherwise(_no_cells())
        near = F.filter(box, lambda c: haversine_km(x, lat, *self.centre(c["ix"], c["iy"])) <= km)
        return _first_full(self._named(near), own)


def usable(lon: Column, lat: Column) -> Column:
    """Whether coordinates are finite numbers, the latitude at most 90 degrees; longitudes may have any name."""
    return (F.abs(lon) <= 1e6) & (F.abs(lat) <= 90.0)


def _no_cells() -> Column:
    return F.array().cast("array<struct<ix:int,iy:int>>")


def _first_full(cells: Column, other: Column) -> Column:
    """``cells`` unless it's empty; a lambda's argument is computed once, however often it is read."""
    return F.get(F.transform(F.array(cells), lambda c: F.when(F.size(c) > 0, c).otherwise(other)), F.lit(0))


def reach(lat: Column, km: float) -> tuple[float, Column]:
    """Degrees of latitude and of longitude that ``km`` span at a latitude; all longitudes where the circle holds a pole."""
    angle = min(km / EARTH_KM, math.pi / 2)
    ratio = math.sin(angle) / F.greatest(F.cos(F.radians(lat)), F.lit(1e-12))
    return math.degrees(angle), F.when(ratio >= 1, F.lit(180.0)).otherwise(F.degrees(F.asin(F.least(F.lit(1.0), ratio))))


def target_grid(spark: SparkSession, grid: Grid) -> DataFrame:
    """(tx, ty, lon, lat): the cells of a target grid and their centres."""
    cells = spark.range(grid.nx * grid.ny).select((F.col("id") % grid.nx).cast("int").alias("tx"), F.floor(F.col("id") / grid.nx).cast("int").alias("ty"))
    lon, lat = grid.centre(F.col("tx"), F.col("ty"))
    return cells.select("tx", "ty", lon.alias("lon"), lat.alias("lat"))
