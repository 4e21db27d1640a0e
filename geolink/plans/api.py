"""Entry points: link observations or a target grid to a cube, by day or by month."""

from __future__ import annotations

import math
from dataclasses import dataclass, replace
from datetime import date, timedelta

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.functions.dates import link_date, month_day
from geolink.functions.geometry import EARTH_KM, bounds
from geolink.functions.projections import Geographic, projection, unproject
from geolink.operators import cover, extract, gridlink
from geolink.sources import catalogue as C
from geolink.sources.cube import BLOCK, Request, daily_statistic, ingest, monthly_mean, scan, tile, tile_ranges
from geolink.sources.cumulative import CumulativeCube
from geolink.sources.grid import Grid, usable


@dataclass(frozen=True)
class LinkSpec:
    """Validated arguments of a link."""

    indicator: str
    catalogue: str
    grain: str
    time_span: int = 0
    time_lag: int = 0
    buffer_km: float = 0.0
    baseline: tuple[int, int] | None = None
    statistic: str = "daily_mean"
    time_zone: str = "utc+00:00"
    by_hour: str | bool = False
    method: str = "bilinear"
    stamp: str = "catalogue"
    cell: tuple[float, float] | None = None

    @staticmethod
    def of(resolution: str, indicator: str, catalogue: str, **options) -> LinkSpec:
        C.check_catalogue(catalogue, resolution)
        C.check_indicator(indicator, catalogue)
        C.check_statistic(options.get("statistic", "daily_mean"))
        C.check_time_zone(options.get("time_zone", "utc+00:00"))
        C.check_by_hour(options.get("by_hour", False))
        if options.get("time_span", 0) < 0:
            raise ValueError("time_span must not be negative")
        if options.get("buffer_km", 0) < 0:
            raise ValueError("buffer must not be negative")
        C.check_stamp(options.get("stamp", "catalogue"))
        options["baseline"] = C.check_baseline(options.get("baseline"))
        return LinkSpec(indicator, catalogue, "day" if resolution == "daily" else "month", **options)


def _cube(cube: DataFrame, spec: LinkSpec) -> DataFrame:
    """The cube at the link's grain: hourly data (a ``ts`` column) is aggregated, other data is keyed.

    By month, dates become the first of the month they stand for, by the indicator's
    stamp rule; means are formed after pruning.  Options that a cube without ``ts``
    can't honour are conditions on its columns of that name, or an error.
    """
    for name in ("indicator", "catalogue"):
        if name in cube.columns:
            cube = cube.where(F.col(name) == getattr(spec, name))
    if "ts" in cube.columns:
        cube = daily_statistic(cube, spec.statistic, spec.time_zone) if spec.grain == "day" else monthly_mean(cube, spec.by_hour)
        return ingest(cube)
    for name, default in (("statistic", "daily_mean"), ("time_zone", "utc+00:00"), ("by_hour", False)):
        value = getattr(spec, name)
        if name in cube.columns:
            # a mean over all hours has no hour
            cube = cube.where(F.col(name).isNull() if value is False else F.col(name) == value)
        elif value != default:
            raise ValueError(f"{name} needs hours (a column ts) or a column {name}; the cube has neither")
    if spec.grain == "month":
        shift = C.stamp_shift(spec.stamp, spec.indicator, spec.catalogue, spec.by_hour)
        if shift:
            stands_for = F.trunc(F.date_add(F.col("obs_date").cast("date"), shift), "month")
            return ingest(cube.withColumn("obs_date", stands_for))
        cube = cube.withColumn("obs_date", F.to_date(F.trunc("obs_date", "month")))
    return cube if {"year", "md"} <= set(cube.columns) else ingest(cube)


def _days_before(days: set[str], span: int) -> set[str] | None:
    """The days of the year (MM-dd) within ``span`` days before the given ones; None for (nearly) all of them."""
    if span >= 300:
        return None
    out = set()
    for day in days:
        month, number = map(int, day.split("-"))
        for year in (2001, 2004, 2005):  # with a leap day before, after and nowhere near
            if (month, number) != (2, 29) or year == 2004:
                last = date(year, month, number)
                out |= {(last - timedelta(k)).strftime("%m-%d") for k in range(span + 1)}
    return out if len(out) < 300 else None


def _requests(places: DataFrame, grid: Grid, spec: LinkSpec) -> tuple[Request, Request] | None:
    """What the link and its baseline need of the cube: one small aggregate over (date, xmin, xmax, ymin, ymax).

    Bounds of the cells, dates and days of the year, over places whose coordinates
    are numbers; None without any.
    """
    places = places.where(usable(F.col("xmin"), F.col("ymin")) & usable(F.col("xmax"), F.col("ymax"))).withColumn("middle", (F.col("xmin") + F.col("xmax")) / 2)
    places = places.withColumn("shift", grid.near_lon(F.col("middle")) - F.col("middle"))
    when, shift = F.col("date"), F.col("shift")
    facts = places.agg(
        F.min(when).alias("first"), F.max(when).alias("last"), F.collect_set(month_day(when)).alias("days"), F.min("ymin").alias("s"), F.max("ymax").alias("n"),
        F.min(F.col("xmin") + shift).alias("w"), F.max(F.col("xmax") + shift).alias("e"), F.bool_or(F.col("xmax") - F.col("xmin") > 180).alias("wide"),
    ).first()
    if facts["first"] is None or facts["s"] is None:
        return None
    span = spec.time_span if spec.grain == "day" else 31 * (spec.time_span + 1)
    up = math.degrees(spec.buffer_km / EARTH_KM)
    south, north = facts["s"] - up, facts["n"] + up
    steep = max(abs(south), abs(north))
    aside = min(180.0, up / math.cos(math.radians(steep)) * 1.1) if steep < 80 else 180.0
    west, east = facts["w"] - aside, facts["e"] + aside
    whole = facts["wide"] or east < west or (grid.wraps and not (grid.xmin <= west and east < grid.xmin + 360)) or aside >= 180 and spec.buffer_km > 0
    extent = (north, grid.xmin, south, grid.xmin + grid.nx * grid.dx) if whole else (north, west, south, east)
    days = _days_before(set(facts["days"]), spec.time_span if spec.grain == "day" else 0)
    if spec.grain == "month":
        months = {int(d[:2]) for d in facts["days"]}
        months = {(m - 1 - k) % 12 + 1 for m in months for k in range(min(spec.time_span, 11) + 1)}
        days = None if len(months) == 12 else {f"{m:02d}-{d:02d}" for m in months for d in range(1, 32)}
    month_days = tuple(sorted(days)) if days else ()
    first = facts["first"] - timedelta(min(span, (facts["first"] - date.min).days))
    last = facts["last"] + timedelta(min(0 if spec.grain == "day" else 31, (date.max - facts["last"]).days))
    return Request(extent=extent, dates=(first, last), month_days=month_days), Request(extent=extent, month_days=month_days)


def _tiles(places: DataFrame, grid: Grid, aside: float, up: float) -> tuple[tuple[int, int], ...]:
    """Ranges of the tiles that the places' own boxes touch; what reaches the driver is bounded by the grid's tiles.

    Boxes over the grid's edge take its whole width.
    """
    places = places.where(usable(F.col("xmin"), F.col("ymin")) & usable(F.col("xmax"), F.col("ymax")))
    middle = (F.col("xmin") + F.col("xmax")) / 2
    shift = grid.near_lon(middle) - middle
    at = lambda v, n: F.least(F.lit(float(n - 1)), F.greatest(F.lit(0.0), v))
    west, east = (F.col("xmin") + shift - aside - grid.xmin) / grid.dx, (F.col("xmax") + shift + aside - grid.xmin) / grid.dx
    over = (F.col("xmax") - F.col("xmin") > 180) | (west < 0) | (east >= grid.nx)
    part = lambda v, n: F.floor(at(v, n) / BLOCK).cast("int")
    box = places.select(
        F.when(over, 0).otherwise(part(west, grid.nx)).alias("i0"), F.when(over, (grid.nx - 1) // BLOCK).otherwise(part(east, grid.nx)).alias("i1"),
        part((grid.ymax - F.col("ymax") - up) / grid.dy, grid.ny).alias("j0"), part((grid.ymax - F.col("ymin") + up) / grid.dy, grid.ny).alias("j1"),
    ).distinct()
    cells = box.select("j0", "j1", F.explode(F.sequence("i0", "i1")).alias("i")).distinct().select("i", F.explode(F.sequence("j0", "j1")).alias("j")).distinct()
    return tile_ranges([r.t for r in cells.select(tile(F.col("i") * BLOCK, F.col("j") * BLOCK).alias("t")).collect()])


def link_observations(obs: DataFrame, cube: DataFrame | CumulativeCube, grid: Grid, spec: LinkSpec, *, date_col: str = "date", lon: str = "lon", lat: str = "lat", rings: str | None = None, crs: int = 4326, prune: bool = True) -> DataFrame:
    """Points (``lon``, ``lat``) or polygons (``rings``) with ``linked`` and, given a baseline, ``baseline`` and ``deviation``.

    ``crs`` is the EPSG code of the coordinates (``functions.projections``); the columns stay as
    they are, whatever their names (one called like a result gives way to it).  So do
    rows and their number, whatever the observations' ids and however many rows the
    cube holds for a cell and date (their mean counts).  ``cube`` may also be running
    totals (``sources.cumulative``).  Coordinates that are NULL,
    NaN, infinite or beyond the poles link with nothing.
    """
    C.check_columns(obs, date_col, *([rings] if rings else [lon, lat]))
    system = projection(crs)
    names = ["linked", *(["baseline", "deviation"] if spec.baseline else [])]
    when = link_date(obs[f"`{date_col}`"].cast("date"), spec.time_lag, spec.grain)
    if rings:
        shape = obs[f"`{rings}`"]
        at = extract.wrapped(obs, names, date=when, shape=shape if system is Geographic else unproject(shape, crs))
        # an outer explode of one: what reads the shape stops there instead of copying its formula; 128 bits stand for it
        at = at.select("row", "date", F.explode_outer(F.array("shape")).alias("shape")).withColumns({"p": F.xxhash64("shape"), "q": F.xxhash64(F.lit("rings"), "shape")})
        place, box = ["p", "q"], bounds(F.col("shape"))
    else:
        x, y = obs[f"`{lon}`"].cast("double"), obs[f"`{lat}`"].cast("double")
        x, y = system.inverse(x, y)
        at = extract.wrapped(obs, names, date=when, at=F.struct(x.alias("x"), y.alias("y")))
        at = at.select("row", "date", F.explode_outer(F.array("at")).alias("at")).select("row", "date", "at.x", "at.y")
        place, box = ["x", "y"], {"xmin": F.col("x"), "xmax": F.col("x"), "ymin": F.col("y"), "ymax": F.col("y")}
    running = cube if isinstance(cube, CumulativeCube) else None
    if running and spec.grain != "day":
        raise ValueError("running totals are daily")
    cube = _cube(running.cube if running else cube, spec)
    recent = past = cube
    places = at.select("date", *[box[k].cast("double").alias(k) for k in box])
    wanted = _requests(places, grid, spec) if prune and not running else None
    if wanted and "tile" in cube.columns:
        n, w, s, e = wanted[0].extent
        up = math.degrees(spec.buffer_km / EARTH_KM)
        aside = 0.0 if up == 0 else 360.0 if max(abs(n), abs(s)) >= 80 else up / math.cos(math.radians(max(abs(n), abs(s)))) * 1.1
        tiles = _tiles(places, grid, aside, up)
        wanted = tuple(replace(r, tiles=tiles) for r in wanted)
    if wanted:
        recent, past = scan(recent, wanted[0], grid), scan(past, wanted[1], grid)
    measures = [("linked", lambda keys: running.span_means(keys, spec.time_span) if running else extract.span_means(keys, recent, spec.time_span, spec.grain))]
    if spec.baseline:
        measures.append(("baseline", lambda keys: running.baseline_means(keys, *spec.baseline, spec.time_span) if running else extract.baseline_means(keys, past, *spec.baseline, spec.time_span, spec.grain)))
    if rings:
        # cells once for each place; rows of one place hold one shape, so it doesn't matter which of them gives it
        spots = at.groupBy(*place).agg(F.first("shape").alias("shape"))
        out = extract.link_runs(at, cover.polygon_runs(spots, place, grid, spec.buffer_km), place, measures)
    elif spec.buffer_km > 0:
        spots = at.select(*place).distinct()
        out = extract.link_runs(at, cover.point_runs(spots, place, grid, spec.buffer_km), place, measures)
    else:
        out = extract.link_cells(at.withColumn("cell", grid.cell(F.col("x"), F.col("y"))), measures)
    return extract.deviation(out) if spec.baseline else out


def link_daily(obs: DataFrame, cube: DataFrame, grid: Grid, indicator: str, *, date_var: str = "date", rings: str | None = None, crs: int = 4326, catalogue: str = "derived-era5-land-daily-statistics", prune: bool = True, **options) -> DataFrame:
    """Link points or polygons by day.

    Options: ``time_span`` and ``time_lag`` (days), ``buffer_km``, ``baseline`` (first,
    last year), ``statistic``, ``time_zone``.
    """
    spec = LinkSpec.of("daily", indicator, catalogue, **options)
    return link_observations(obs, cube, grid, spec, date_col=date_var, rings=rings, crs=crs, prune=prune)


def link_monthly(obs: DataFrame, cube: DataFrame, grid: Grid, indicator: str, *, date_var: str = "date", rings: str | None = None, crs: int = 4326, catalogue: str = "reanalysis-era5-land-monthly-means", prune: bool = True, **options) -> DataFrame:
    """Link points or polygons by month; span and lag count months.

    Options: ``time_span``, ``time_lag``, ``buffer_km``, ``baseline``, ``by_hour`` and
    ``stamp``, which says what dates of a monthly cube mean: ``catalogue`` (the
    indicator's own rule), ``first`` or ``last`` (a day of the month itself), ``last_of_previous``, ``first_of_next``.
    """
    spec = LinkSpec.of("monthly", indicator, catalogue, **options)
    return link_observations(obs, cube, grid, spec, date_col=date_var, rings=rings, crs=crs, prune=prune)


def _link_grid(target: DataFrame, cube: DataFrame, grid: Grid, spec: LinkSpec, date_col: str) -> DataFrame:
    C.check_columns(target, "tx", "ty", "lon", "lat", date_col)
    C.check_uniform_date(target, date_col)
    at = target.select(link_date(F.col(date_col).cast("date"), spec.time_lag, spec.grain).cast("string").alias("d")).first()["d"]
    return gridlink.grid_link(target, _cube(cube, spec), grid, at, span=spec.time_span, baseline=spec.baseline, method=spec.method, grain=spec.grain, cell=spec.cell)


def link_daily_grid(target: DataFrame, cube: DataFrame, grid: Grid, indicator: str, *, date_col: str = "date", catalogue: str = "derived-era5-land-daily-statistics", **options) -> DataFrame:
    """Link a target grid (tx, ty, lon, lat, one date) by day; also takes ``method`` (``catalogue.METHODS``) and, for those by area, ``cell``, the size of its cells."""
    C._one_of(options.get("method", "bilinear"), C.METHODS, "method")
    return _link_grid(target, cube, grid, LinkSpec.of("daily", indicator, catalogue, **options), date_col)


def link_monthly_grid(target: DataFrame, cube: DataFrame, grid: Grid, indicator: str, *, date_col: str = "date", catalogue: str = "reanalysis-era5-land-monthly-means", **options) -> DataFrame:
    """Link a target grid by month; also takes ``method`` and ``cell``."""
    C._one_of(options.get("method", "bilinear"), C.METHODS, "method")
    return _link_grid(target, cube, grid, LinkSpec.of("monthly", indicator, catalogue, **options), date_col)
