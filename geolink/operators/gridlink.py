"""Linking a target grid: average the cube's layers, then resample onto the target's cells."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.functions.dates import month_day, span_dates
from geolink.sources.grid import Grid


def _near(grid: Grid, lon: Column, lat: Column) -> Column:
    c = grid.cell(lon, lat)
    return F.when(c.isNotNull(), F.array(F.struct(c["ix"].alias("ix"), c["iy"].alias("iy"), F.lit(1.0).alias("w"))))


def _cubic(d: Column) -> Column:
    """Cubic convolution weight (a = -1/2) at distance d."""
    d = F.abs(d)
    return F.when(d <= 1, (1.5 * d - 2.5) * d * d + 1).when(d < 2, ((-0.5 * d + 2.5) * d - 4) * d + 2).otherwise(0.0)


def _spline(d: Column) -> Column:
    """Cubic B-spline weight at distance d: smooths, as it isn't 1 at a cell's own centre."""
    d = F.abs(d)
    return F.when(d <= 1, (3 * d - 6) * d * d / 6 + F.lit(4.0) / 6).when(d < 2, (2 - d) * (2 - d) * (2 - d) / 6).otherwise(0.0)


def _lanczos(d: Column) -> Column:
    """Windowed sinc of three lobes at distance d."""
    x = d * math.pi
    return F.when(F.abs(d) < 1e-9, 1.0).when(F.abs(d) < 3, 3 * F.sin(x) * F.sin(x / 3) / (x * x)).otherwise(0.0)


def _tensor(grid: Grid, lon: Column, lat: Column, offsets: range, weight) -> Column:
    u, v = (lon - grid.xmin) / grid.dx - 0.5, (grid.ymax - lat) / grid.dy - 0.5
    i0, j0 = F.floor(u).cast("int"), F.floor(v).cast("int")
    f, g = u - i0, v - j0
    clamp = lambda k, n: F.greatest(F.lit(0), F.least(k, F.lit(n - 1))).cast("int")
    columns = F.array(*[F.struct(clamp(i0 + a, grid.nx).alias("ix"), weight(f - a).alias("w")) for a in offsets])
    rows = F.array(*[F.struct(clamp(j0 + b, grid.ny).alias("iy"), weight(g - b).alias("w")) for b in offsets])
    cells = F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: F.struct(c["ix"].alias("ix"), r["iy"].alias("iy"), (c["w"] * r["w"]).alias("w")))))
    return F.when(grid.cell(lon, lat).isNotNull(), cells)


def _overlaps(grid: Grid, lon: Column, lat: Column, cell: tuple[float, float]) -> Column:
    """The cells that a target cell of size ``cell`` overlaps, by their share of its area: one overlap an axis, multiplied."""

    def axis(low: Column, high: Column, n: int) -> Column:
        """Numbers and lengths of the unit intervals between two places on an axis of n of them."""
        a, b = F.greatest(low, F.lit(0.0)), F.least(high, F.lit(float(n)))
        steps = F.sequence(F.floor(a).cast("int"), F.greatest(F.floor(a), F.ceil(b) - 1).cast("int"))
        return F.when(a < b, F.transform(steps, lambda k: F.struct(k.alias("k"), (F.least(b, k + F.lit(1.0)) - F.greatest(a, k.cast("double"))).alias("w"))))

    u, v = (lon - grid.xmin) / grid.dx, (grid.ymax - lat) / grid.dy
    du, dv = cell[0] / grid.dx / 2, cell[1] / grid.dy / 2
    columns, rows = axis(u - du, u + du, grid.nx), axis(v - dv, v + dv, grid.ny)
    return F.flatten(F.transform(columns, lambda c: F.transform(rows, lambda r: F.struct(c["k"].alias("ix"), r["k"].alias("iy"), (c["w"] * r["w"]).alias("w")))))


#: Methods by distance to the target's centre: offsets of the cells and their weight.
KERNELS = {
    "bilinear": (range(0, 2), lambda d: 1.0 - F.abs(d)), "cubic": (range(-1, 3), _cubic), "cubicspline": (range(-1, 3), _spline), "lanczos": (range(-2, 4), _lanczos),
}
#: Methods over the cells that a target's cell overlaps, ``w`` being the share of the cube's cell.
AREAS = {
    "average": lambda w, v: F.sum(w * v) / F.sum(w), "sum": lambda w, v: F.sum(w * v), "min": lambda w, v: F.min(v), "max": lambda w, v: F.max(v),
    "rms": lambda w, v: F.sqrt(F.sum(w * v * v) / F.sum(w)),
}


def neighbours(grid: Grid, lon: Column, lat: Column, method: str, cell: tuple[float, float] | None = None) -> Column:
    """array<struct(ix, iy, w)>: the cells a target centre (for ``AREAS``, its cell) takes its value from; NULL outside the grid."""
    if method in AREAS:
        if cell is None:
            raise ValueError(f"method {method} needs the size of the target's cells")
        return _overlaps(grid, lon, lat, cell)
    if method == "near":
        return _near(grid, lon, lat)
    if method in KERNELS:
        return _tensor(grid, lon, lat, *KERNELS[method])
    raise ValueError(f"method must be one of near, {', '.join([*KERNELS, *AREAS])}")


def resample(target: DataFrame, layer: DataFrame, grid: Grid, method: str = "bilinear", out: str = "linked", cell: tuple[float, float] | None = None) -> DataFrame:
    """``target`` (tx, ty, lon, lat) with the layer's (ix, iy, value); weights renormalise over cells with a value.

    ``average`` is conservative: where every cell has a value and the target covers the
    grid, areas times values add up to the same; of ``sum`` the values themselves do.
    A cell that is overlapped by less than a billionth counts for nothing.
    """
    wide = target.select("tx", "ty", F.explode(neighbours(grid, F.col("lon"), F.col("lat"), method, cell)).alias("n")).select("tx", "ty", "n.ix", "n.iy", "n.w")
    hit = wide.join(layer.where("value is not null").select("ix", "iy", "value"), ["ix", "iy"])
    weight = F.sum("w")
    value = AREAS[method](F.col("w"), F.col("value")) if method in AREAS else F.when(F.abs(weight) > 1e-9, F.sum(F.col("w") * F.col("value")) / weight)
    hit = hit.where("w > 1e-9") if method in AREAS else hit
    means = hit.groupBy(F.col("tx").alias("_tx"), F.col("ty").alias("_ty")).agg(value.alias(out))
    return target.join(means, (F.col("tx") == F.col("_tx")) & (F.col("ty") == F.col("_ty")), "left").drop("_tx", "_ty")


def span_layer(cube: DataFrame, link_date: Column, span: int = 0, grain: str = "day") -> DataFrame:
    """(ix, iy, value): mean over the dates of one span; ``link_date`` is a literal."""
    wanted = cube.where(F.col("obs_date").between(F.element_at(span_dates(link_date, span, grain), 1), link_date))
    return wanted.groupBy("ix", "iy").agg(F.avg("value").alias("value"))


def baseline_layer(cube: DataFrame, link_date: Column, first: int, last: int, span: int = 0, grain: str = "day") -> DataFrame:
    """(ix, iy, value): mean over the baseline years' anniversaries of the span's days (months)."""
    if grain == "day":
        match = F.array_contains(F.transform(span_dates(link_date, span, grain), month_day), F.col("md"))
    else:
        match = F.array_contains(F.transform(span_dates(link_date, span, grain), lambda d: F.date_format(d, "MM")), F.substring("md", 1, 2))
    return cube.where(F.col("year").between(first, last) & match).groupBy("ix", "iy").agg(F.avg("value").alias("value"))


def grid_link(target: DataFrame, cube: DataFrame, grid: Grid, date: str, *, span: int = 0, baseline: tuple[int, int] | None = None, method: str = "bilinear", grain: str = "day", cell: tuple[float, float] | None = None) -> DataFrame:
    """Target cells with ``linked`` and, given a baseline, ``baseline`` and ``deviation`` (same method for both)."""
    at = F.to_date(F.lit(date))
    out = resample(target, span_layer(cube, at, span, grain), grid, method, "linked", cell)
    if baseline:
        out = resample(out, baseline_layer(cube, at, *baseline, span, grain), grid, method, "baseline", cell)
        out = out.withColumn("deviation", F.col("linked") - F.col("baseline"))
    return out


def bind_layers(left: DataFrame, right: DataFrame) -> DataFrame:
    """Join co-registered grids on their cells, never by position."""
    return left.join(right, ["tx", "ty"], "left")
