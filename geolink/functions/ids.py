"""Areal identifiers: recognising and parsing GADM, NUTS, LAU, AGS and INSPIRE ids."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Id patterns.
GADM = r"^([A-Z]{3})(\.[0-9]+){1,4}_[0-9]{1}?$"
GADM_PARTS = r"^([A-Z]{3})(\.[0-9]+)?(\.[0-9]+)?(\.[0-9]+)?(\.[0-9]+)?_[0-9]{1}?$"
LAU = r"[A-Z]{2}_[0-9]+"
NUTS = r"^[A-Z]{2}[A-Z0-9]{1,3}$"
SHORT_INSPIRE = r"[0-9]+k?mN[0-9]+E[0-9]+"
LONG_INSPIRE = r"CRS[0-9]+RES[0-9]+mN[0-9]+E[0-9]+"
AGS = r"^[0-1]([0-9]{1})?([0-9]{1})?([0-9]{2})?([0-9]{3})?"
#: German states that are one city (Hamburg, Berlin).
CITY_STATES = ("02", "11")


def is_gadm(c: Column) -> Column:
    return c.rlike(GADM)


def is_lau(c: Column) -> Column:
    return c.rlike(LAU)


def is_nuts(c: Column) -> Column:
    return c.rlike(NUTS)


def is_short_inspire(c: Column) -> Column:
    return c.rlike(SHORT_INSPIRE)


def is_long_inspire(c: Column) -> Column:
    return c.rlike(LONG_INSPIRE)


def is_ags(c: Column) -> Column:
    return c.rlike(AGS)


#: Tests in the order in which a column's type is guessed; long INSPIRE ids also match the short pattern.
TESTS = (("gadm", is_gadm), ("long_inspire", is_long_inspire), ("short_inspire", is_short_inspire), ("nuts", is_nuts), ("lau", is_lau), ("ags", is_ags))


def gadm_country(c: Column) -> Column:
    return F.when(c.rlike(GADM_PARTS), F.substring(c, 1, 3))


def gadm_level(c: Column) -> Column:
    """Number of dotted parts."""
    return F.when(c.rlike(GADM_PARTS), F.size(F.split(c, r"\.")) - 1)


def nuts_country(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Z]{2}[A-Z0-9]{0,3}$"), F.substring(c, 1, 2))


def nuts_level(c: Column) -> Column:
    return F.when(c.rlike(r"^[A-Z]{2}[A-Z0-9]{0,3}$"), F.length(c) - 2)


def lau_country(c: Column) -> Column:
    return F.nullif(F.regexp_extract(c, r"([A-Z]{2})_[0-9]+", 1), F.lit(""))


def ags_own_level(c: Column) -> Column:
    """The deepest part that isn't zero: gem, krs, rbz, lan, or sta for the whole country."""
    p = F.rpad(c, 8, "0")
    depth = F.when(F.substring(p, 6, 3) > "000", "gem").when(F.substring(p, 4, 2) > "00", "krs").when(F.substring(p, 3, 1) > "0", "rbz").when(F.substring(p, 1, 2) > "00", "lan")
    return F.when(F.substring(p, 1, 2).isin(*CITY_STATES), "gem").otherwise(depth.otherwise("sta"))


def ags_is_city_state(c: Column) -> Column:
    return F.substring(F.rpad(c, 8, "0"), 1, 2).isin(*CITY_STATES)


def most_common(df: DataFrame, col: str) -> DataFrame:
    """One row: the most frequent non-null value; the smallest of equals."""
    counts = df.where(F.col(col).isNotNull()).groupBy(col).agg(F.count(F.lit(1)).alias("_n"))
    return counts.agg(F.min_by(F.col(col), F.struct(-F.col("_n"), F.col(col))).alias("most_common"))


def parse_ags(df: DataFrame, col: str) -> DataFrame:
    """Add ``country`` and ``level``; city states take the most common level of the column."""
    leveled = df.withColumn("_own", ags_own_level(F.col(col)))
    top = most_common(leveled, "_own")
    level = F.when(ags_is_city_state(F.col(col)), F.col("most_common")).otherwise(F.col("_own"))
    return leveled.crossJoin(F.broadcast(top)).withColumn("country", F.lit("DEU")).withColumn("level", level).drop("_own", "most_common")


def iso3_rates(df: DataFrame, col: str, codes: DataFrame, systems: tuple[str, ...]) -> DataFrame:
    """One row: for each code system, the share of the column's distinct ids that it knows."""
    ids = df.select(F.col(col).alias("_id")).where("_id is not null").distinct()
    known = codes.select(F.explode(F.array(*[F.struct(F.lit(s).alias("s"), F.col(s).alias("c")) for s in systems])).alias("k")).select("k.*").distinct()
    joined = ids.join(known, F.col("_id") == F.col("c"), "left").groupBy("_id").agg(F.collect_set("s").alias("_in"))
    return joined.agg(*[F.avg(F.array_contains("_in", s).cast("double")).alias(s) for s in systems])


def convert_to_iso3(df: DataFrame, col: str, codes: DataFrame, systems: tuple[str, ...], iso3: str = "iso3", least: float = 0.9) -> tuple[DataFrame, bool]:
    """Map the column to ISO-3 codes if another code system knows at least ``least`` of its distinct ids.

    Returns the frame and whether the ids are country codes now.
    """
    rates = iso3_rates(df, col, codes, systems).first().asDict()
    best = max(systems, key=lambda s: (rates[s] or 0, s == iso3))
    if (rates[best] or 0) < least:
        return df, False
    if best == iso3:
        return df, True
    lookup = codes.groupBy(F.col(best).alias("_from")).agg(F.min(iso3).alias("_to"))
    return df.join(lookup, F.col(col) == F.col("_from"), "left").withColumn(col, F.col("_to")).drop("_from", "_to"), True


def guess_id_types(df: DataFrame, col: str, *by: str) -> DataFrame:
    """One row per group (one for the whole frame without ``by``): ``kind``, the first id type that all ids of the group match.

    A null id matches none; ``kind`` is NULL where no type fits.
    """
    tests = [F.bool_and(F.coalesce(test(F.col(col)), F.lit(False))).alias(name) for name, test in TESTS]
    kind = F.coalesce(*[F.when(F.col(name), F.lit(name)) for name, _ in TESTS])
    return df.groupBy(*by).agg(*tests).select(*by, kind.alias("kind"))


def guess_id_type(df: DataFrame, col: str, iso3: bool = False) -> str:
    """The first id type that all ids of the column match (a null id matches none)."""
    kind = "gadm" if iso3 else guess_id_types(df, col).first()["kind"]
    if kind is None:
        raise ValueError("could not detect the id type; name it with `type`")
    return kind
