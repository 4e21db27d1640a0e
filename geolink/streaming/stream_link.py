"""Streams: observations against a static cube, hourly data to daily statistics, and observations against arriving layers (extensions)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.operators.extract import point_link
from geolink.sources.grid import Grid


def link_stream(observations: DataFrame, cube: DataFrame, grid: Grid, date: str = "d", lon: str = "lon", lat: str = "lat") -> DataFrame:
    """Stateless stream-static left join: each arriving point gets its cell's value on its date."""
    return point_link(observations, cube, grid.cell(F.col(lon), F.col(lat)), F.col(date).cast("date"))


def daily_statistics_stream(hourly: DataFrame, delay: str = "1 day", ts: str = "ts", value: str = "value") -> DataFrame:
    """Daily mean, maximum and minimum per cell; a day closes once the watermark passes its end."""
    day = F.window(F.col(ts), "1 day")
    rows = hourly.withWatermark(ts, delay).groupBy(day.alias("w"), "ix", "iy")
    out = rows.agg(F.avg(value).alias("mean"), F.max(value).alias("maximum"), F.min(value).alias("minimum"))
    return out.select(F.to_date("w.start").alias("obs_date"), "ix", "iy", "mean", "maximum", "minimum")


def link_streams(observations: DataFrame, layers: DataFrame, grid: Grid, *, ts: str = "ts", lon: str = "lon", lat: str = "lat", late: str = "2 days", wait: str = "1 day", out: str = "linked") -> DataFrame:
    """Points and layers that both arrive: each point gets the value of its cell and hour.

    ``layers`` holds (ts, ix, iy, value), one row an hour and cell.  A point waits for its
    layer up to ``wait`` of event time; one whose layer has not come when the
    watermarks (``late`` behind the latest times) pass that comes out with NULL.  Points without a
    cell come out with NULL too.  State holds what may still meet: points not yet older
    than the wait, layers not yet older than the points that may come.
    """
    cell = grid.cell(F.col(lon), F.col(lat))
    points = observations.withColumn("_cell", F.coalesce(cell, F.struct(F.lit(-1).alias("ix"), F.lit(-1).alias("iy")))).withWatermark(ts, late)
    right = layers.select(F.col("ts").alias("_at"), F.col("ix").alias("_ix"), F.col("iy").alias("_iy"), F.col("value").alias(out)).withWatermark("_at", late)
    hour = lambda c: F.date_trunc("hour", c)
    same = (F.col("_cell.ix") == F.col("_ix")) & (F.col("_cell.iy") == F.col("_iy")) & (hour(ts) == hour("_at"))
    near = (F.col("_at") >= F.col(ts) - F.expr("interval 1 hour")) & (F.col("_at") <= F.col(ts) + F.expr(f"interval {wait}"))
    return points.join(right, same & near, "left").select(*observations.columns, out)
