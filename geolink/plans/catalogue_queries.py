"""Queries on ids, dates, units and the indicator catalogue, over values that are derived from whole tables."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from geolink.functions import dates as D
from geolink.functions import ids as I
from geolink.functions import text as T
from geolink.functions.text import indicator_card
from geolink.plans.datasets import read
from geolink.plans.registry import query
from geolink.sources import catalogue as C

_DAY = "o_orderdate::DATE"
_DATED = f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 9 = 4 THEN NULL WHEN o_orderkey % 9 = 5 THEN strftime({_DAY}, '%m/%d/%Y') WHEN o_orderkey % 9 = 6 THEN strftime({_DAY}, '%Y-%m-%d 12:30:00') WHEN o_orderkey % 9 = 7 THEN '2019-2-31' ELSE strftime({_DAY}, '%Y-%-m-%-d') END AS s FROM orders"


@query("dt1_parse_column", f"SELECT k, try_strptime(regexp_replace(s, '[T ][0-9]+:.*$', ''), '%Y-%m-%d')::DATE AS date FROM ({_DATED})")
def dt1(spark, sf):
    """Order dates as text, with other layouts, times and an impossible date among them: the first value's layout counts."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    form = lambda f: F.date_format(d, f)
    text = F.when(k % 9 == 4, F.lit(None)).when(k % 9 == 5, form("MM/dd/yyyy")).when(k % 9 == 6, form("yyyy-MM-dd' 12:30:00'")).when(k % 9 == 7, "2019-2-31").otherwise(form("yyyy-M-d"))
    return D.parse_date_column(read(spark, sf, "orders").select(k.alias("k"), text.alias("s")), "s", "k").select("k", "date")


_LAYOUTS = ("%Y-%-m-%-d", "%m/%d/%Y", "%B %-d, %Y", "%-d-%b-%Y", "%Y/%-m/%-d", "%-d.%-m.%Y")
_PATTERNS = ("yyyy-M-d", "MM/dd/yyyy", "MMMM d, yyyy", "d-MMM-yyyy", "yyyy/M/d", "d.M.yyyy")


@query("dt1_parse_rowwise", f"SELECT o_orderkey AS k, CASE WHEN o_orderkey % 7 < 6 THEN {_DAY} END AS date FROM orders")
def dt1_rows(spark, sf):
    """Order dates written in six layouts and one that is none, each read by the first layout that fits."""
    k, d = F.col("o_orderkey"), F.col("o_orderdate").cast("date")
    text = F.lit("no date")
    for i, pattern in enumerate(_PATTERNS):
        text = F.when(k % 7 == i, F.date_format(d, pattern)).otherwise(text)
    return read(spark, sf, "orders").select(k.alias("k"), D.parse_date_rowwise(text).alias("date"))


@query("dt11_vocabulary", "SELECT event_id, lpad(hour(ts)::VARCHAR, 2, '0') || ':00' AS hour, 'utc' || CASE WHEN z < 0 THEN '-' ELSE '+' END || lpad(abs(z)::VARCHAR, 2, '0') || ':00' AS zone FROM (SELECT *, user_id % 27 - 12 AS z FROM events)")
def dt11(spark, sf):
    """The hour's name and a zone's name of every event."""
    at = lambda names, i: F.element_at(names, (i + 1).cast("int"))
    return read(spark, sf, "events").select("event_id", at(D.hour_names(), F.hour("ts")).alias("hour"), at(D.zone_names(), F.col("user_id") % 27).alias("zone"))


_IDS = """SELECT c_custkey, CASE c_custkey % 13 WHEN 0 THEN 'DE' || c_nationkey % 10 WHEN 1 THEN 'DEU.' || c_custkey || '_1' WHEN 2 THEN 'CRS3035RES1000mN' || c_custkey || 'E1' WHEN 3 THEN 'DE_' || c_custkey WHEN 4 THEN '0' || c_custkey
 WHEN 5 THEN '1kmN' || c_custkey || 'E43' WHEN 6 THEN 'DEU.1.2.' || c_nationkey || '_1' WHEN 7 THEN 'DEU' WHEN 8 THEN NULL WHEN 9 THEN 'FRA.1.2.3.' || c_nationkey || '_' WHEN 10 THEN 'DE' WHEN 11 THEN 'DE' || lpad((c_nationkey)::VARCHAR, 3, '1') ELSE '?' || c_custkey END AS id FROM customer"""


def _ids(spark, sf) -> DataFrame:
    k, c, n = F.col("c_custkey") % 13, F.col("c_custkey").cast("string"), F.col("c_nationkey").cast("string")
    join = lambda *parts: F.concat(*[p if isinstance(p, Column) else F.lit(p) for p in parts])
    forms = (
        join("DE", (F.col("c_nationkey") % 10).cast("string")), join("DEU.", c, "_1"), join("CRS3035RES1000mN", c, "E1"), join("DE_", c), join("0", c), join("1kmN", c, "E43"), join("DEU.1.2.", n, "_1"), F.lit("DEU"),
        F.lit(None).cast("string"), join("FRA.1.2.3.", n, "_"), F.lit("DE"), join("DE", F.lpad(n, 3, "1")), join("?", c),
    )
    id_ = forms[-1]
    for i, form in enumerate(forms[:-1]):
        id_ = F.when(k == i, form).otherwise(id_)
    return read(spark, sf, "customer").select("c_custkey", id_.alias("id"))


@query("str1_id_patterns", f"""SELECT c_custkey, coalesce(regexp_matches(id, '^([A-Z]{{3}})(\\.[0-9]+){{1,4}}_[0-9]{{1}}?$'), false) AS gadm, coalesce(regexp_matches(id, '[A-Z]{{2}}_[0-9]+'), false) AS lau, coalesce(regexp_matches(id, '^[A-Z]{{2}}[A-Z0-9]{{1,3}}$'), false) AS nuts,
 coalesce(regexp_matches(id, '[0-9]+k?mN[0-9]+E[0-9]+'), false) AS short_inspire, coalesce(regexp_matches(id, 'CRS[0-9]+RES[0-9]+mN[0-9]+E[0-9]+'), false) AS long_inspire, coalesce(regexp_matches(id, '^[0-1]([0-9]{{1}})?([0-9]{{1}})?([0-9]{{2}})?([0-9]{{3}})?'), false) AS ags FROM ({_IDS})""")
def str1(spark, sf):
    """Every pattern's answer for an id of each customer, twelve forms and none."""
    return _ids(spark, sf).select("c_custkey", *[F.coalesce(test(F.col("id")), F.lit(False)).alias(name) for name, test in I.TESTS])


@query("str7_parse_nuts", f"SELECT c_custkey, CASE WHEN regexp_matches(id, '^[A-Z]{{2}}[A-Z0-9]{{0,3}}$') THEN substr(id, 1, 2) END AS country, CASE WHEN regexp_matches(id, '^[A-Z]{{2}}[A-Z0-9]{{0,3}}$') THEN length(id) - 2 END AS level FROM ({_IDS})")
def str7(spark, sf):
    return _ids(spark, sf).select("c_custkey", I.nuts_country(F.col("id")).alias("country"), I.nuts_level(F.col("id")).alias("level"))


@query("str8_parse_lau", f"SELECT c_custkey, nullif(regexp_extract(id, '([A-Z]{{2}})_[0-9]+', 1), '') AS country, id AS gisco_id FROM ({_IDS})")
def str8(spark, sf):
    return _ids(spark, sf).select("c_custkey", I.lau_country(F.col("id")).alias("country"), F.col("id").alias("gisco_id"))


@query("str14_superscript", "SELECT p_partkey, 'm' || translate((p_size % 50)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' s⁻' || translate((p_partkey % 7)::VARCHAR, '0123456789', '⁰¹²³⁴⁵⁶⁷⁸⁹') || ' ' || p_brand AS unit FROM part")
def str14(spark, sf):
    """Units with powers, one for each part."""
    unit = F.format_string("m**%d s**-%d %s", F.col("p_size") % 50, F.col("p_partkey") % 7, F.col("p_brand"))
    return read(spark, sf, "part").select("p_partkey", T.superscript(unit).alias("unit"))


_INDICATORS = """
SELECT * FROM (VALUES ('2m_temperature', 'Temperature', 'K', 2, 3, true), ('total_precipitation', 'Precipitation', 'm', 2, 3, true), ('10m_u_component_of_wind', 'Wind', 'm s**-1', 3, 3, true),
 ('10m_v_component_of_wind', 'Wind', 'm s**-1', 3, 3, true), ('leaf_area_index_high_vegetation', 'Vegetation', 'm**2 m**-2', 2, 3, true), ('leaf_area_index_low_vegetation', 'Vegetation', 'm**2 m**-2', 2, 3, true),
 ('snow_cover', 'Snow', '%', 1, 3, true), ('snowfall', 'Snow', 'm to water equivalent', 1, 3, true), ('total_cloud_cover', 'Clouds', '(0 - 1)', 1, 3, true), ('fire_weather_index', 'Extreme weather', NULL, 0, 3, false),
 ('extreme_wind_speed_days', 'Extreme weather', 'days', 0, 3, false), ('mean_wind_speed', 'Wind', 'm s**-1', 0, 3, false), ('days_with_high_fire_danger', 'Extreme weather', 'days', 0, 3, false),
 ('magnitude_of_meteorological_droughts', 'Extreme weather', NULL, 0, 1, false), ('duration_of_meteorological_droughts', 'Extreme weather', 'months', 0, 1, false), ('consecutive_dry_days', 'Extreme weather', 'days', 0, 1, false),
 ('frequency_of_extreme_precipitation', 'Extreme weather', 'days', 0, 1, false), ('extreme_precipitation_total', 'Extreme weather', 'mm', 0, 1, false), ('maximum_consecutive_five_day_precipitation', 'Extreme weather', 'mm', 0, 1, false)
) AS t(indicator, category, unit, n_subsets, n_resolutions, reanalysis)"""
#: Every customer asks for one indicator.
_ASKED = f"SELECT c_custkey, t.* FROM customer JOIN (SELECT *, row_number() OVER (ORDER BY indicator) - 1 AS i FROM ({_INDICATORS})) t ON i = c_custkey % 19"


def _asked(spark, sf) -> DataFrame:
    """The indicator that each customer asks for, with the catalogue's fields."""
    listed = C.indicators(spark).withColumn("card", indicator_card())
    names = sorted(r.indicator for r in listed.select("indicator").collect())  # the catalogue: a constant of the library
    wanted = F.element_at(F.array(*map(F.lit, names)), (F.col("c_custkey") % len(names) + 1).cast("int"))
    return read(spark, sf, "customer").select("c_custkey", wanted.alias("indicator")).join(listed, "indicator", "left")


@query("src6_indicators", f"SELECT c_custkey, indicator, category, unit, n_subsets, n_resolutions, reanalysis FROM ({_ASKED})")
def src6(spark, sf):
    return _asked(spark, sf).select(
        "c_custkey", "indicator", "category", "unit", F.coalesce(F.size("subsets"), F.lit(0)).alias("n_subsets"), F.size("temporal_resolution").alias("n_resolutions"), (F.col("project") == "era5").alias("reanalysis")
    )


@query("srt3_by_category", f"SELECT row_number() OVER (ORDER BY category DESC, indicator) AS place, indicator, category, count(*) AS n FROM ({_ASKED}) GROUP BY indicator, category")
def srt3(spark, sf):
    """The indicators asked for by category from the end of the alphabet, and how often: at most the catalogue's rows are ordered."""
    counted = _asked(spark, sf).groupBy("indicator", "category").agg(F.count(F.lit(1)).alias("n"))
    return counted.select(F.row_number().over(W.orderBy(F.desc("category"), "indicator")).alias("place"), "indicator", "category", "n")


def _card(*lines: str) -> str:
    return "concat_ws(chr(10), " + ", ".join(f"'{x}'" for x in lines) + ")"


@query("str13_indicator_card", f"SELECT c_custkey, indicator, CASE indicator WHEN '2m_temperature' THEN " + _card(
    "Indicator:           2 metre temperature", "Category:            Temperature", "Data type:           gridded", "Unit:                K", "Spatial resolution:  0.25° x 0.25°", "Spatial coverage:    global",
    "Temporal resolution: - hourly", "                     - daily", "                     - monthly", "Temporal coverage:   1950-01-01 00:00") + " WHEN 'fire_weather_index' THEN " + _card(
    "Indicator:           Fire weather index", "Category:            Extreme weather", "Data type:           gridded", "Unit:                N/A", "Spatial resolution:  0.25° x 0.25°", "Spatial coverage:    global",
    "Temporal resolution: - monthly", "                     - seasonal", "                     - yearly", "Temporal coverage:   1940-01-01") + f" END AS card FROM ({_ASKED}) WHERE indicator IN ('2m_temperature', 'fire_weather_index')")
def str13(spark, sf):
    """The card of the indicator for every customer who asks for one of two."""
    return _asked(spark, sf).where(F.col("indicator").isin("2m_temperature", "fire_weather_index")).select("c_custkey", "indicator", "card")
