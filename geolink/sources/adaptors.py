"""Observation tables from other forms: coordinates, WKT, grids; and back."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.functions.geometry import RINGS


def from_lonlat(df: DataFrame, x: str, y: str) -> DataFrame:
    """Rename coordinate columns to ``lon`` and ``lat`` doubles."""
    return df.withColumn("lon", F.col(x).cast("double")).withColumn("lat", F.col(y).cast("double")).drop(*[c for c in (x, y) if c not in ("lon", "lat")])


def point_of_wkt(wkt: Column) -> tuple[Column, Column]:
    part = lambda i: F.nullif(F.regexp_extract(wkt, r"(?i)^\s*POINT\s*\(\s*([-+0-9.eE]+)\s+([-+0-9.eE]+)", i), F.lit("")).cast("double")
    return part(1), part(2)


def rings_of_wkt(wkt: Column) -> Column:
    """POLYGON or MULTIPOLYGON text to rings; NULL for anything else."""
    rings = F.regexp_extract_all(wkt, F.lit(r"\(([^()]+)\)"), 1)
    parsed = F.transform(
        rings,
        lambda r: F.transform(F.split(r, ","), lambda p: F.struct(F.get(F.split(F.trim(p), r"\s+"), F.lit(0)).cast("double").alias("x"), F.get(F.split(F.trim(p), r"\s+"), F.lit(1)).cast("double").alias("y"))),
    )
    return F.when(wkt.rlike(r"(?i)^\s*(MULTI)?POLYGON"), parsed).cast(RINGS)


def from_wkt(df: DataFrame, wkt: str) -> DataFrame:
    """Add ``lon``, ``lat`` (points) and ``rings`` (polygons) from a WKT column."""
    lon, lat = point_of_wkt(F.col(wkt))
    return df.withColumn("lon", lon).withColumn("lat", lat).withColumn("rings", rings_of_wkt(F.col(wkt)))


def to_wkt(df: DataFrame, out: str = "wkt") -> DataFrame:
    """Point columns ``lon``, ``lat`` as WKT."""
    return df.withColumn(out, F.format_string("POINT (%s %s)", F.col("lon").cast("string"), F.col("lat").cast("string")))


def move_to_back(df: DataFrame, column: str) -> DataFrame:
    return df.select(*[c for c in df.columns if c != column], column)
