"""Indicator cubes as long tables: one row per non-missing cell and time stamp.

Columns: ``obs_date, year, md, ix, iy, value`` and optionally ``catalogue,
indicator``.  ``year`` and ``md`` are stored because conditions on them prune files
and row groups, which conditions on functions of a date do not.
"""

from __future__ import annotations

import json
from dataclasses import asdict, dataclass, field
from datetime import date

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.functions.dates import month_day
from geolink.sources.grid import Grid


def ingest(df: DataFrame, date: str = "obs_date", value: str = "value", keep: tuple[str, ...] = ()) -> DataFrame:
    """Bring a table of (date, ix, iy, value) into cube form: NaN and missing values go, keys are added."""
    v = F.nullif(F.col(value).cast("double"), F.lit(float("nan")))
    d = F.col(date).cast("date")
    out = df.select(d.alias("obs_date"), F.year(d).alias("year"), month_day(d).alias("md"), F.col("ix").cast("int").alias("ix"), F.col("iy").cast("int").alias("iy"), v.alias("value"), *keep)
    return out.where(F.col("value").isNotNull())


#: Cells on a side of the tiles that a written cube's files keep together.
BLOCK = 32
#: Ranges of tiles that a scan is given at most; the smallest gaps between them close first.
RANGES = 64


def tile(ix: Column, iy: Column) -> Column:
    """Number of a cell's tile on a curve that keeps neighbours together (the bits of its row and column by turns)."""

    def spread(v: Column) -> Column:
        for by, mask in ((8, 0x00FF00FF), (4, 0x0F0F0F0F), (2, 0x33333333), (1, 0x55555555)):
            v = (v.bitwiseOR(F.shiftleft(v, by))).bitwiseAND(F.lit(mask).cast("bigint"))
        return v

    part = lambda v: F.floor(v / BLOCK).cast("bigint")
    return spread(part(ix)).bitwiseOR(F.shiftleft(spread(part(iy)), 1))


def write_cube(cube: DataFrame, path: str, grid: Grid | None = None) -> None:
    """Parquet by year, files of neighbouring tiles, sorted by tile, date and cell.

    So a file spans few tiles: conditions on ``tile`` (a link's own set of tiles), ``ix``
    and ``iy`` skip files and row groups, those on ``md`` and ``obs_date`` row groups.
    """
    if grid and max(grid.nx, grid.ny) > BLOCK << 16:
        raise ValueError("the grid has too many tiles")
    rows = cube.withColumn("tile", tile(F.col("ix"), F.col("iy"))).repartitionByRange("year", "tile").sortWithinPartitions("year", "tile", "obs_date", "iy", "ix")
    rows.write.partitionBy("year").mode("overwrite").parquet(path)


def tile_ranges(tiles: list[int], most: int = RANGES) -> tuple[tuple[int, int], ...]:
    """Sorted ranges that hold all of the tiles, ``most`` at most."""
    tiles = sorted(set(tiles))
    gaps = sorted(((b - a, b) for a, b in zip(tiles, tiles[1:], strict=False) if b > a + 1), reverse=True)[: most - 1]
    starts = sorted({tiles[0], *(b for _, b in gaps)}) if tiles else []
    ends = [max(t for t in tiles if t < s) for s in starts[1:]] + tiles[-1:]
    return tuple(zip(starts, ends, strict=True))


_STATISTIC = {"daily_mean": F.avg, "daily_maximum": F.max, "daily_minimum": F.min}


def zone_hours(zone: str) -> int:
    return int(zone[3:6])


def daily_statistics(hourly: DataFrame, names: dict[str, str], zone: str = "utc+00:00", ts: str = "ts", by: tuple[str, ...] = ("ix", "iy"), value: str = "value") -> DataFrame:
    """Daily statistics in a fixed offset from UTC, one column for each of ``names`` (statistic: column), in one aggregation."""
    day = F.to_date(F.col(ts) + F.make_dt_interval(F.lit(0), F.lit(zone_hours(zone))))
    return hourly.groupBy(day.alias("obs_date"), *by).agg(*[_STATISTIC[s](value).alias(name) for s, name in names.items()])


def daily_statistic(hourly: DataFrame, statistic: str = "daily_mean", zone: str = "utc+00:00") -> DataFrame:
    """Daily mean, maximum or minimum of ``value`` as ``value``."""
    return daily_statistics(hourly, {statistic: "value"}, zone)


def monthly_mean(hourly: DataFrame, by_hour: str | bool = False, ts: str = "ts", by: tuple[str, ...] = ("ix", "iy"), value: str = "value") -> DataFrame:
    """Monthly mean, of all hours or of one hour of the day; stamped with the first of the month it represents."""
    rows = hourly if by_hour is False else hourly.where(F.hour(ts) == int(by_hour[:2]))
    return rows.groupBy(F.to_date(F.trunc(F.col(ts).cast("date"), "month")).alias("obs_date"), *by).agg(F.avg(value).alias("value"))


@dataclass(frozen=True)
class Request:
    """What a link needs from a cube: used to prune the scan and as the key of reuse."""

    indicator: str | None = None
    catalogue: str | None = None
    extent: tuple[float, float, float, float] | None = None  # north, west, south, east
    years: tuple[int, ...] = ()
    months: tuple[int, ...] = ()
    days: tuple[int, ...] = ()
    dates: tuple[date, date] | None = None
    month_days: tuple[str, ...] = ()
    tiles: tuple[tuple[int, int], ...] = ()
    options: dict = field(default_factory=dict)

    def canonical(self) -> str:
        return json.dumps(asdict(self), sort_keys=True, default=str)


def extent(obs: DataFrame, lon: str = "lon", lat: str = "lat") -> DataFrame:
    """One row (n, w, s, e): the bounding box, rounded outward to whole degrees."""
    return obs.agg(F.ceil(F.max(lat)).cast("double").alias("n"), F.floor(F.min(lon)).cast("double").alias("w"), F.floor(F.min(lat)).cast("double").alias("s"), F.ceil(F.max(lon)).cast("double").alias("e"))


def scan(cube: DataFrame, request: Request, grid: Grid | None = None) -> DataFrame:
    """The part of a cube that a request names, as conditions that reach the Parquet scan.

    Years, months and days are a cross product, so the result may hold more dates
    than any observation asks for; the join decides.
    """
    where: list[Column] = []
    for name in ("indicator", "catalogue"):
        value = getattr(request, name)
        if value and name in cube.columns:
            where.append(F.col(name) == value)
    if request.years:
        where.append(F.col("year").isin(*request.years) if len(request.years) < 200 else F.col("year").between(min(request.years), max(request.years)))
    if request.months and request.days:
        where.append(F.col("md").isin(*[f"{m:02d}-{d:02d}" for m in request.months for d in request.days]))
    elif request.months:
        where.append(F.col("md").isin(*[f"{m:02d}-{d:02d}" for m in request.months for d in range(1, 32)]))
    if request.month_days:
        where.append(F.col("md").isin(*request.month_days))
    if request.dates:
        first, last = request.dates
        where += [F.col("obs_date").between(F.lit(first), F.lit(last)), F.col("year").between(first.year, last.year)]
    if request.tiles and "tile" in cube.columns:
        near = [F.col("tile").between(a, b) for a, b in request.tiles]
        # a balanced tree: a long chain of conditions is deep
        while len(near) > 1:
            near = [a | b for a, b in zip(near[::2], near[1::2], strict=False)] + near[len(near) // 2 * 2 :]
        where.append(near[0])
    if request.extent and grid:
        n, w, s, e = request.extent
        i0, i1 = int((w - grid.xmin) // grid.dx), int((e - grid.xmin) // grid.dx)
        j0, j1 = int((grid.ymax - n) // grid.dy), int((grid.ymax - s) // grid.dy)
        where += [F.col("ix").between(max(i0, 0), min(i1, grid.nx - 1)), F.col("iy").between(max(j0, 0), min(j1, grid.ny - 1))]
    for condition in where:
        cube = cube.where(condition)
    return cube
