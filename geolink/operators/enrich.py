"""Areal ids to reference geometries: recognise, parse, and join per row on (type, level, id)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from geolink.functions import ids as I
from geolink.functions.geometry import RINGS, to_laea

TYPES = ("gadm", "nuts", "lau", "ags", "postcode")


def parse_ids(df: DataFrame, col: str, kind: str) -> DataFrame:
    """Add ``country`` and ``level`` (string) as the id type defines them."""
    c = F.col(col)
    if kind == "gadm":
        level = F.coalesce(I.gadm_level(c), F.when(c.rlike("^[A-Z]{3}$"), F.lit(0)))
        return df.withColumn("country", F.coalesce(I.gadm_country(c), F.when(c.rlike("^[A-Z]{3}$"), c))).withColumn("level", level.cast("string"))
    if kind == "nuts":
        return df.withColumn("country", I.nuts_country(c)).withColumn("level", I.nuts_level(c).cast("string"))
    if kind == "lau":
        return df.withColumn("country", I.lau_country(c)).withColumn("level", F.lit(None).cast("string"))
    if kind == "ags":
        return I.parse_ags(df, col)
    return df.withColumn("country", F.lit(None).cast("string")).withColumn("level", F.lit(None).cast("string"))


def enrich(df: DataFrame, reference: DataFrame, ids: str = "id", *, type: str | None = None, country: str | None = None, level: str | None = None, codes: DataFrame | None = None, code_systems: tuple[str, ...] = (), crs: int = 3035) -> DataFrame:  # noqa: A002
    """Left join of ids to reference areas; every row is populated, unmatched rows hold NULL.

    ``reference``: (source, level, area_id, ...) with ``rings`` in longitude and
    latitude; of several entries for one area the first by all columns counts.
    ``codes`` lists countries by code system; where 90 % of the ids are country
    codes, they become ISO-3 and country-level GADM areas.  ``crs`` 3035 projects
    the rings, 4326 leaves them.
    """
    iso3 = False
    if type is None and codes is not None:
        df, iso3 = I.convert_to_iso3(df, ids, codes, code_systems)
    kind = type or I.guess_id_type(df, ids, iso3)
    if kind in ("short_inspire", "long_inspire"):
        raise ValueError("no geometry source for INSPIRE grid ids")
    if kind not in TYPES:
        raise ValueError(f"type must be one of {', '.join(TYPES)}")
    rows = parse_ids(df, ids, kind)
    if country is not None:
        rows = rows.withColumn("country", F.lit(country))
    if level is not None:
        rows = rows.withColumn("level", F.lit(str(level)))
    others = [c for c in reference.columns if c not in ("source", "level", "area_id")]
    areas = reference.where(F.col("source") == kind).groupBy(F.coalesce("level", F.lit("")).alias("_l"), F.col("area_id").alias("_a")).agg(F.min(F.struct(*others)).alias("_v"))
    joined = rows.join(areas, (F.coalesce("level", F.lit("")) == F.col("_l")) & (F.col(ids) == F.col("_a")), "left")
    out = joined.select(*rows.columns, *[F.col(f"_v.{c}").alias(c) for c in others])
    if crs == 3035 and "rings" in others:
        out = out.withColumn("rings", F.transform("rings", lambda r: F.transform(r, lambda p: F.struct(to_laea(p["x"], p["y"])[0].alias("x"), to_laea(p["x"], p["y"])[1].alias("y")))).cast(RINGS))
    return out
