"""Registered queries, one or more for each operator, and their DuckDB oracles."""

from __future__ import annotations

import datetime
import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.functions import dates as D
from geolink.functions import geometry as G
from geolink.functions import ids as I
from geolink.functions import text as T
from geolink.operators import enrich as E
from geolink.operators import extract as X
from geolink.operators import gridlink as R
from geolink.operators import merge as M
from geolink.plans import api
from geolink.plans.datasets import GRID, cube, hourly, observations, polygons, read, sql, targets
from geolink.plans.registry import ORACLE_SQL, QUERIES, query  # noqa: F401  the first two are what the entry point reads here
from geolink.plans.registry import rounded as _r
from geolink.session import shared_dir
from geolink.sources import adaptors as A
from geolink.sources import catalogue as C
from geolink.sources import cube as Q
from geolink.sources.grid import Grid
from geolink.sources.sinks import temporary_cube
from geolink.sources.stash import Stash, clean_index, key_column, live, pop_last, restore_all
from geolink.streaming.stream_link import link_stream

_OBS = "SELECT * FROM cells"
_SPAN = "SELECT o.id, avg(c.v) AS linked FROM o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 3 AND o.d GROUP BY o.id"
_CLIM = "SELECT strftime(t, '%m-%d') AS md, ix, iy, sum(v) AS s, count(v) AS n FROM cube WHERE year(t) BETWEEN 1995 AND 1996 GROUP BY ALL"
_BASE = "SELECT id, sum(s) / sum(n) AS baseline FROM (SELECT DISTINCT o.id, o.ix, o.iy, strftime(o.d - k.range::INT, '%m-%d') AS md FROM o, range(4) AS k) w JOIN clim USING (md, ix, iy) GROUP BY id"


@query("flagship_link", sql(
    "SELECT o.id, o.d, round(linked, 6) AS linked, round(baseline, 6) AS baseline, round(linked - baseline, 6) + 0.0::DOUBLE AS deviation FROM o LEFT JOIN s USING (id) LEFT JOIN b USING (id)",
    "obs", "cells", "cube", o=_OBS, s=_SPAN, clim=_CLIM, b=_BASE))
def flagship_link(spark: SparkSession, sf: str) -> DataFrame:
    """Four-day span mean with 1995-1996 baseline and deviation, through the public entry point."""
    out = api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3, baseline=(1995, 1996))
    return out.select("id", "d", _r("linked"), _r("baseline"), _r("deviation"))


_JN1 = sql("SELECT o.id, o.d, c.v AS linked FROM cells o LEFT JOIN cube c ON c.t = o.d AND c.ix = o.ix AND c.iy = o.iy", "obs", "cells", "cube")


@query("jn1_point_link", _JN1)
def jn1(spark, sf):
    obs = observations(spark, sf)
    return X.point_link(obs, cube(spark, sf), GRID.cell(F.col("lon"), F.col("lat")), F.col("d")).select("id", "d", "linked")


@query("jn2_single_date", sql("SELECT o.id, c.v AS linked FROM cells o LEFT JOIN cube c ON c.t = DATE '1997-05-05' AND c.ix = o.ix AND c.iy = o.iy", "obs", "cells", "cube"))
def jn2(spark, sf):
    obs = observations(spark, sf).withColumn("d", F.to_date(F.lit("1997-05-05")))
    return api.link_daily(obs, cube(spark, sf), GRID, "2m_temperature", date_var="d").select("id", "linked")


@query("jn3_span_link", sql("SELECT o.id, round(linked, 6) AS linked FROM cells o LEFT JOIN s USING (id)", "obs", "cells", "cube", o=_OBS, s=_SPAN))
def jn3(spark, sf):
    return api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3).select("id", _r("linked"))


@query("jn4_baseline", sql("SELECT o.id, round(baseline, 6) AS baseline FROM o LEFT JOIN b USING (id)", "obs", "cells", "cube", o=_OBS, clim=_CLIM, b=_BASE))
def jn4(spark, sf):
    obs = observations(spark, sf)
    q = cube(spark, sf)
    at = X.wrapped(obs, ["baseline"], date=F.col("d"), cell=GRID.cell(F.col("lon"), F.col("lat")))
    return X.link_cells(at, [("baseline", lambda keys: X.baseline_means(keys, q, 1995, 1996, 3))]).select("id", _r("baseline"))


_POLY = dict(
    cover="SELECT p, ix, iy FROM (SELECT p, ix, iy, sum(CASE WHEN (ay > clat) <> (\"by\" > clat) AND clon < (bx - ax) * (clat - ay) / nullif(\"by\" - ay, 0) + ax THEN 1 ELSE 0 END) AS n FROM edges, grid GROUP BY ALL) WHERE n % 2 = 1",
    mid="SELECT p, floor((min(ax) + max(ax)) / 2 - 5)::INT AS ix, floor(51 - (min(ay) + max(ay)) / 2)::INT AS iy FROM edges GROUP BY p",
    pc="SELECT * FROM cover UNION ALL SELECT * FROM mid WHERE p NOT IN (SELECT p FROM cover) AND ix BETWEEN 0 AND 4 AND iy BETWEEN 0 AND 3",
    pd="SELECT DISTINCT p, 10 * p + k AS id, d FROM edges, (VALUES (0, DATE '1997-03-01'), (1, DATE '1998-07-15'), (2, DATE '1999-12-31')) AS x(k, d)",
)


@query("jn5_polygon_link", sql(
    "SELECT pd.id, round(m, 6) AS linked FROM pd LEFT JOIN (SELECT id, avg(cm) AS m FROM (SELECT pd.id, pc.ix, pc.iy, avg(v) AS cm FROM pd JOIN pc USING (p) JOIN cube c ON c.ix = pc.ix AND c.iy = pc.iy AND c.t BETWEEN pd.d - 6 AND pd.d GROUP BY ALL) GROUP BY id) AS a USING (id)",
    "edges", "grid", "cube", **_POLY))
def jn5(spark, sf):
    return api.link_daily(polygons(spark), cube(spark, sf), GRID, "2m_temperature", date_var="d", rings="rings", time_span=6).select("id", _r("linked"))


def _buffer(km: float) -> dict[str, str]:
    hav = "2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2))))"
    return dict(
        near=f"SELECT o.id, o.d, g.ix, g.iy FROM o, grid g WHERE {hav} <= {km}",
        bc="SELECT * FROM near UNION ALL SELECT id, d, ix, iy FROM o WHERE id NOT IN (SELECT id FROM near)",
    )


@query("jn6_buffer_link", sql(
    "SELECT o.id, round(m, 6) AS linked FROM o LEFT JOIN (SELECT bc.id, avg(v) AS m FROM bc JOIN cube c ON c.t = bc.d AND c.ix = bc.ix AND c.iy = bc.iy GROUP BY bc.id) AS a USING (id)",
    "obs", "cells", "cube", "grid", o=_OBS, **_buffer(60)))
def jn6(spark, sf):
    return api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", buffer_km=60.0).select("id", _r("linked"))


@query("agg3_two_stage_mean", sql(
    "SELECT o.id, round(m, 6) AS linked FROM o LEFT JOIN (SELECT id, avg(cm) AS m FROM (SELECT bc.id, c.ix, c.iy, avg(v) AS cm FROM bc JOIN cube c ON c.t BETWEEN bc.d - 3 AND bc.d AND c.ix = bc.ix AND c.iy = bc.iy GROUP BY ALL) GROUP BY id) AS a USING (id)",
    "obs", "cells", "cube", "grid", o=_OBS, **_buffer(90)))
def agg3(spark, sf):
    return api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", buffer_km=90.0, time_span=3).select("id", _r("linked"))


@query("agg4_climatology", sql("SELECT md, ix, iy, round(s / n, 6) AS mean, n FROM clim", "cube", clim=_CLIM))
def agg4(spark, sf):
    return X.climatology(cube(spark, sf), 1995, 1996).select("md", "ix", "iy", F.round(F.col("total") / F.col("n"), 6).alias("mean"), "n")


@query("win1_span_window", sql("SELECT t AS obs_date, ix, iy, round(avg(v) OVER (PARTITION BY ix, iy ORDER BY t RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND CURRENT ROW), 6) AS mean FROM cube", "cube"))
def win1(spark, sf):
    return X.span_window(cube(spark, sf), 3).select("obs_date", "ix", "iy", _r("mean"))


# merges


@query("jn7_left_merge", sql(
    "SELECT x.c_custkey, x.c_nationkey, y.s_name AS s_name FROM customer x LEFT JOIN (SELECT c_nationkey AS k, min(c_custkey) AS f FROM customer GROUP BY 1) a ON x.c_custkey = a.f"
    " LEFT JOIN (SELECT s_nationkey AS k, arg_max(s_name, s_suppkey) AS s_name FROM supplier GROUP BY 1) y ON a.k IS NOT DISTINCT FROM y.k"))  # fmt: skip
def jn7(spark, sf):
    x = read(spark, sf, "customer").select("c_custkey", "c_nationkey")
    return M.left_merge(x, read(spark, sf, "supplier").select("s_suppkey", "s_nationkey", "s_name"), "c_nationkey", "s_nationkey", "c_custkey", "s_suppkey")


def _nuts(nation: str):
    """Level 1 to 3 of a nation key, and an area id of that level."""
    level = (F.col(nation) % 3 + 1).cast("int")
    return level, F.concat(F.lit("DE"), F.substring(F.lpad(F.col(nation).cast("string"), 3, "1"), F.lit(1), level))


def _areas(spark, sf):
    level, area = _nuts("n_nationkey")
    return read(spark, sf, "nation").select(F.lit("nuts").alias("source"), level.cast("string").alias("level"), area.alias("area_id"), "n_name")


_NUTS = """
WITH ref AS (SELECT n_nationkey % 3 + 1 AS level, 'DE' || substr(lpad(n_nationkey::VARCHAR, 3, '1'), 1, n_nationkey % 3 + 1) AS area_id, min(n_name) AS n_name FROM nation GROUP BY ALL),
ids AS (SELECT c_custkey, 'DE' || substr(lpad(c_nationkey::VARCHAR, 3, '1'), 1, c_nationkey % 3 + 1) AS id FROM customer)
"""


@query("jn8_enrich", _NUTS + "SELECT c_custkey, id, 'DE' AS country, (length(id) - 2)::VARCHAR AS level, n_name FROM ids LEFT JOIN ref ON ref.area_id = ids.id AND ref.level = length(id) - 2")
def jn8(spark, sf):
    return E.enrich(read(spark, sf, "customer").select("c_custkey", _nuts("c_nationkey")[1].alias("id")), _areas(spark, sf), "id")


@query("str12_enrich_dispatch", _NUTS + "SELECT c_custkey, id, 'XX' AS country, '2' AS level, n_name FROM ids LEFT JOIN ref ON ref.area_id = ids.id AND ref.level = 2")
def str12(spark, sf):
    """Type, country and level named by the caller take the place of what the ids say."""
    rows = read(spark, sf, "customer").select("c_custkey", _nuts("c_nationkey")[1].alias("id"))
    return E.enrich(rows, _areas(spark, sf), "id", type="nuts", country="XX", level="2")


@query("jn9_bind_layers", sql("SELECT t.tx, t.ty, n.v AS near, p.v AS next_day FROM targets t LEFT JOIN cube n ON n.t = DATE '1998-03-03' AND n.ix = floor(t.lon - 5) AND n.iy = floor(51 - t.lat) LEFT JOIN cube p ON p.t = DATE '1998-03-04' AND p.ix = floor(t.lon - 5) AND p.iy = floor(51 - t.lat)", "targets", "cube"))
def jn9(spark, sf):
    q = cube(spark, sf)
    a, b = (R.resample(targets(spark), R.span_layer(q, F.to_date(F.lit(d))), GRID, "near", name) for d, name in (("1998-03-03", "near"), ("1998-03-04", "next_day")))
    return R.bind_layers(a.select("tx", "ty", "near"), b.select("tx", "ty", "next_day"))


@query("jn10_cross_dates", "SELECT DISTINCT make_date(y, m, d) AS date FROM (SELECT DISTINCT year(o_orderdate) AS y FROM orders), (VALUES (1), (2), (4)) AS a(m), (VALUES (15), (28), (30), (31)) AS b(d) WHERE d <= day(last_day(make_date(y, m, 1)))")
def jn10(spark, sf):
    years = read(spark, sf, "orders").agg(F.collect_set(F.year("o_orderdate")).alias("y"), F.first(F.array(F.lit(1), F.lit(2), F.lit(4))).alias("m"), F.first(F.array(*map(F.lit, (15, 28, 30, 31)))).alias("d"))
    return D.make_dates(years, "y", "m", "d").select("date")


@query("jn11_semi", "SELECT c_custkey FROM customer WHERE c_nationkey IN (SELECT s_nationkey FROM supplier WHERE s_acctbal > 5000)")
def jn11(spark, sf):
    return read(spark, sf, "customer").join(read(spark, sf, "supplier").where("s_acctbal > 5000"), F.col("c_nationkey") == F.col("s_nationkey"), "left_semi").select("c_custkey")


@query("jn12_anti", "SELECT c_custkey FROM customer WHERE c_custkey NOT IN (SELECT o_custkey FROM orders WHERE o_totalprice > 100000 AND o_custkey IS NOT NULL)")
def jn12(spark, sf):
    """Customers without a large order."""
    large = read(spark, sf, "orders").where("o_totalprice > 100000")
    return read(spark, sf, "customer").join(large, F.col("c_custkey") == F.col("o_custkey"), "left_anti").select("c_custkey")


# aggregates


@query("agg5_daily_statistic", sql("SELECT (ts + INTERVAL 5 HOUR)::DATE AS obs_date, ix, iy, round(avg(value), 6) AS mean, max(value) AS maximum, min(value) AS minimum FROM hourly GROUP BY ALL", "hourly"))
def agg5(spark, sf):
    h = hourly(spark, sf)
    every = Q.daily_statistics(h, {"daily_mean": "mean", "daily_maximum": "maximum", "daily_minimum": "minimum"}, "utc+05:00")
    return every.select("obs_date", "ix", "iy", _r("mean"), "maximum", "minimum")


@query("agg6_monthly_mean", sql("SELECT date_trunc('month', ts)::DATE AS obs_date, ix, iy, round(avg(value), 6) AS value FROM hourly GROUP BY ALL", "hourly"))
def agg6(spark, sf):
    return Q.monthly_mean(hourly(spark, sf)).select("obs_date", "ix", "iy", _r("value"))


@query("agg6_monthly_by_hour", sql("SELECT date_trunc('month', ts)::DATE AS obs_date, ix, iy, round(avg(value), 6) AS value FROM hourly WHERE hour(ts) = 13 GROUP BY ALL", "hourly"))
def agg6_hour(spark, sf):
    return Q.monthly_mean(hourly(spark, sf), "13:00").select("obs_date", "ix", "iy", _r("value"))


@query("agg7_extent", sql("SELECT ceil(max(lat))::DOUBLE AS n, floor(min(lon))::DOUBLE AS w, floor(min(lat))::DOUBLE AS s, ceil(max(lon))::DOUBLE AS e FROM obs", "obs"))
def agg7(spark, sf):
    return Q.extent(observations(spark, sf))


@query("agg8_distinct_keys", "SELECT array_to_string(list_sort(list_distinct(list(year(o_orderdate)))), ',') AS years, array_to_string(list_sort(list_distinct(list(month(o_orderdate)))), ',') AS months, array_to_string(list_sort(list_distinct(list(day(o_orderdate)))), ',') AS days FROM orders")
def agg8(spark, sf):
    y, m, d = D.distinct_keys(F.col("o_orderdate"))
    return read(spark, sf, "orders").agg(F.array_join(y, ",").alias("years"), F.array_join(m, ",").alias("months"), F.array_join(d, ",").alias("days"))


@query("agg9_distinct_dates", "SELECT count(DISTINCT o_orderdate::DATE) AS n FROM orders")
def agg9(spark, sf):
    return observations(spark, sf).agg(F.count_distinct("d").alias("n"))


@query("agg10_mode", "SELECT c_mktsegment AS most_common FROM customer GROUP BY 1 ORDER BY count(*) DESC, 1 LIMIT 1")
def agg10(spark, sf):
    return I.most_common(read(spark, sf, "customer"), "c_mktsegment")


@query("agg11_row_sum", "SELECT l_orderkey, l_linenumber, CASE WHEN a IS NULL AND b IS NULL THEN NULL ELSE coalesce(a, 0) + coalesce(b, 0) END AS total FROM (SELECT l_orderkey, l_linenumber, CASE WHEN l_quantity > 25 THEN l_quantity END AS a, CASE WHEN l_tax > 0.04 THEN l_linenumber END AS b FROM lineitem)")
def agg11(spark, sf):
    df = read(spark, sf, "lineitem")
    return df.select("l_orderkey", "l_linenumber", M.psum(F.when(F.col("l_quantity") > 25, F.col("l_quantity")), F.when(F.col("l_tax") > 0.04, F.col("l_linenumber"))).cast("double").alias("total"))


@query("agg12_all_true", "SELECT c_mktsegment, bool_and(coalesce(c_acctbal > -999, false)) AS sound FROM customer GROUP BY 1")
def agg12(spark, sf):
    return read(spark, sf, "customer").groupBy("c_mktsegment").agg(M.all_true(F.col("c_acctbal") > -999).alias("sound"))


def _codes(spark, sf):
    return read(spark, sf, "nation").select(F.upper(F.substring("n_name", 1, 3)).alias("iso3"), F.upper(F.substring("n_name", 1, 2)).alias("iso2"), F.col("n_name").alias("name"))


_CODED = "SELECT c_custkey, CASE WHEN c_custkey % 50 = 0 THEN 'ZZZ' ELSE upper(substr(n_name, 1, 3)) END AS id FROM customer JOIN nation ON c_nationkey = n_nationkey"


def _coded(spark, sf):
    c = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    return c.select("c_custkey", F.when(F.col("c_custkey") % 50 == 0, "ZZZ").otherwise(F.upper(F.substring("n_name", 1, 3))).alias("id"))


@query("agg13_match_rate", f"WITH i AS (SELECT DISTINCT id FROM ({_CODED})) SELECT round(avg((id IN (SELECT upper(substr(n_name, 1, 3)) FROM nation))::INT::DOUBLE), 6) AS iso3, round(avg((id IN (SELECT upper(substr(n_name, 1, 2)) FROM nation))::INT::DOUBLE), 6) AS iso2, round(avg((id IN (SELECT n_name FROM nation))::INT::DOUBLE), 6) AS name FROM i")
def agg13(spark, sf):
    return I.iso3_rates(_coded(spark, sf), "id", _codes(spark, sf), ("iso3", "iso2", "name")).select(_r("iso3"), _r("iso2"), _r("name"))


# scans, projections, filters


@query("src1_cube_scan", sql("SELECT t AS obs_date, year(t)::INT AS year, strftime(t, '%m-%d') AS md, ix, iy, v AS value FROM cube", "cube"))
def src1(spark, sf):
    return cube(spark, sf)


@query("src2_monthly_request", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE year(t) IN (1997, 1998) AND month(t) IN (7, 8) AND ix BETWEEN 1 AND 3 AND iy BETWEEN 1 AND 2", "cube"))
def src2(spark, sf):
    return Q.scan(cube(spark, sf), Q.Request(years=(1997, 1998), months=(7, 8), extent=(49.9, 6.1, 48.1, 8.9)), GRID).select("obs_date", "ix", "iy", "value")


@query("src3_daily_request", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE year(t) = 1998 AND month(t) IN (7, 8) AND day(t) IN (1, 31)", "cube"))
def src3(spark, sf):
    return Q.scan(cube(spark, sf), Q.Request(years=(1998,), months=(7, 8), days=(1, 31)), GRID).select("obs_date", "ix", "iy", "value")


@query("src4_request_reuse", sql("SELECT t AS obs_date, year(t)::INT AS year, strftime(t, '%m-%d') AS md, ix, iy, v AS value FROM cube WHERE year(t) = 1998 AND month(t) = 7", "cube"))
def src4(spark, sf):
    """Materialise a request's cube once, then read it again from the stash."""
    request = Q.Request("2m_temperature", C.DAILY[0], years=(1998,), months=(7,))
    stash = Stash(spark, f"{shared_dir(spark)}/stash-{uuid.uuid4().hex}", "cube")
    key = {"request": request.canonical()}
    stash.materialise(Q.scan(cube(spark, sf), request), key)
    return stash.materialise(spark.createDataFrame([], "obs_date date, year int, md string, ix int, iy int, value double"), key)


@query("src5_wkt_points", sql("SELECT id, lon, lat FROM obs", "obs"))
def src5(spark, sf):
    text = A.to_wkt(observations(spark, sf)).select("id", "wkt")
    return A.from_wkt(text, "wkt").select("id", "lon", "lat")


@query("src6_read_json", "SELECT c_name AS indicator, c_mktsegment AS category, c_nationkey::BIGINT AS id, 'land' AS first_subset, c_mktsegment AS zone FROM customer")
def src6_json(spark, sf):
    """Catalogue objects of JSON text, one indicator for each customer, read to rows."""
    item = F.struct(F.col("c_mktsegment").alias("category"), F.col("c_nationkey").alias("id"), F.array(F.lit("land")).alias("subsets"), F.create_map(F.lit("time_zone"), F.col("c_mktsegment")).alias("arguments"))
    text = read(spark, sf, "customer").select(F.to_json(F.create_map("c_name", item)).alias("json"))
    return C.parse_indicators(text, "json").select("indicator", "category", "id", F.col("subsets")[0].alias("first_subset"), F.col("arguments")["time_zone"].alias("zone"))


@query("src7_reference_areas", "SELECT n_nationkey, n_name, r_name FROM nation JOIN region ON n_regionkey = r_regionkey WHERE r_name IN ('EUROPE', 'ASIA')")
def src7(spark, sf):
    n, r = read(spark, sf, "nation"), read(spark, sf, "region").where(F.col("r_name").isin("EUROPE", "ASIA"))
    return n.join(r, F.col("n_regionkey") == F.col("r_regionkey")).select("n_nationkey", "n_name", "r_name")


@query("prj6_deviation", "SELECT l_orderkey, l_linenumber, linked - baseline AS deviation FROM (SELECT l_orderkey, l_linenumber, l_quantity AS linked, CASE WHEN l_linenumber > 1 THEN l_tax END AS baseline FROM lineitem)")
def prj6(spark, sf):
    df = read(spark, sf, "lineitem").select("l_orderkey", "l_linenumber", F.col("l_quantity").alias("linked"), F.when(F.col("l_linenumber") > 1, F.col("l_tax")).alias("baseline"))
    return X.deviation(df).drop("linked", "baseline")


@query("prj3_geometry_last", sql("SELECT id, lon, lat, d + 1 AS link_date, d FROM obs", "obs"))
def prj3(spark, sf):
    return A.move_to_back(observations(spark, sf).withColumn("link_date", D.link_date(F.col("d"), -1)), "d")


@query("flt1_exact_date", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE t = DATE '1998-08-01'", "cube"))
def flt1(spark, sf):
    return cube(spark, sf).where(F.col("obs_date") == F.to_date(F.lit("1998-08-01"))).select("obs_date", "ix", "iy", "value")


@query("flt2_date_set", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE t IN (DATE '1998-08-01', DATE '1998-07-31', DATE '1998-07-30')", "cube"))
def flt2(spark, sf):
    wanted = Q.Request(dates=(datetime.date(1998, 7, 30), datetime.date(1998, 8, 1)))
    return Q.scan(cube(spark, sf), wanted).select("obs_date", "ix", "iy", "value")


@query("flt3_month_day", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE strftime(t, '%m-%d') IN ('02-29', '08-01')", "cube"))
def flt3(spark, sf):
    return cube(spark, sf).where(F.col("md").isin("02-29", "08-01")).select("obs_date", "ix", "iy", "value")


@query("flt4_year_range", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube WHERE year(t) BETWEEN 1996 AND 1997", "cube"))
def flt4(spark, sf):
    first, last = C.check_baseline(("1996", "1997"))
    return cube(spark, sf).where(F.col("year").between(first, last)).select("obs_date", "ix", "iy", "value")


@query("flt5_level", "SELECT n_nationkey, n_nationkey % 4 AS level FROM nation WHERE n_nationkey % 4 IN (1, 3)")
def flt5(spark, sf):
    return read(spark, sf, "nation").select("n_nationkey", (F.col("n_nationkey") % 4).alias("level")).where(F.col("level").isin(1, 3))


@query("flt6_clean_tags", "SELECT event_id, event_type AS kind FROM events WHERE regexp_matches(event_type, '^[A-Za-z0-9._-]*$')")
def flt6(spark, sf):
    tags = read(spark, sf, "events").select("event_id", F.create_map(F.lit("kind"), F.col("event_type"), F.lit("props"), F.concat(F.col("props"), F.lit(" {}"))).alias("tags"))
    kept = tags.select("event_id", T.clean_tags(F.col("tags")).alias("tags"))
    return kept.where(~F.map_contains_key("tags", "props") & F.map_contains_key("tags", "kind")).select("event_id", F.col("tags")["kind"].alias("kind"))


# dates

@query("dt2_lag", sql("SELECT id, d - 10 AS back, d + 5 AS ahead, (date_trunc('month', d) - INTERVAL 2 MONTH)::DATE AS months_back FROM obs", "obs"))
def dt2(spark, sf):
    d = F.col("d")
    return observations(spark, sf).select("id", D.link_date(d, 10).alias("back"), D.link_date(d, -5).alias("ahead"), D.link_date(d, 2, "month").alias("months_back"))


@query("dt4_sequence", sql("SELECT id, (d - k.range::INT) AS day FROM obs, range(4) AS k", "obs"))
def dt4(spark, sf):
    return observations(spark, sf).select("id", F.explode(D.span_dates(F.col("d"), 3)).alias("day"))


@query("dt4_month_sequence", sql("SELECT id, (date_trunc('month', d) - to_months(k.range::INT))::DATE AS month FROM obs, range(3) AS k", "obs"))
def dt4_months(spark, sf):
    return observations(spark, sf).select("id", F.explode(D.span_dates(D.link_date(F.col("d"), 0, "month"), 2, "month")).alias("month"))


@query("dt5_parts", sql("SELECT id, year(d)::INT AS year, month(d)::INT AS month, day(d)::INT AS day, strftime(d, '%m-%d') AS md FROM obs", "obs"))
def dt5(spark, sf):
    return observations(spark, sf).select("id", F.year("d").alias("year"), F.month("d").alias("month"), F.dayofmonth("d").alias("day"), D.month_day(F.col("d")).alias("md"))


@query("dt7_days_in_month", sql("SELECT DISTINCT year(d)::INT AS year, month(d)::INT AS month, day(last_day(d))::INT AS days FROM obs", "obs"))
def dt7(spark, sf):
    return observations(spark, sf).select(F.year("d").alias("year"), F.month("d").alias("month")).distinct().withColumn("days", D.days_in_month(F.col("year"), F.col("month")))


@query("dt10_format", sql("SELECT id, strftime(d, '%Y-%m-%d') AS day, strftime(d, '%Y') AS year, strftime(d, '%d') AS dom FROM obs", "obs"))
def dt10(spark, sf):
    return observations(spark, sf).select("id", F.date_format("d", "yyyy-MM-dd").alias("day"), F.date_format("d", "yyyy").alias("year"), F.date_format("d", "dd").alias("dom"))


# sets


@query("set1_distinct", "SELECT DISTINCT c_nationkey FROM customer")
def set1(spark, sf):
    return read(spark, sf, "customer").select("c_nationkey").distinct()


@query("set2_union", "SELECT c_nationkey AS k FROM customer UNION SELECT s_nationkey FROM supplier")
def set2(spark, sf):
    return read(spark, sf, "customer").select(F.col("c_nationkey").alias("k")).union(read(spark, sf, "supplier").select("s_nationkey")).distinct()


@query("set3_except", "SELECT n_nationkey AS k FROM nation EXCEPT SELECT s_nationkey FROM supplier WHERE s_acctbal > 8000")
def set3(spark, sf):
    return read(spark, sf, "nation").select(F.col("n_nationkey").alias("k")).subtract(read(spark, sf, "supplier").where("s_acctbal > 8000").select("s_nationkey"))


# ids

@query("str6_parse_gadm", "SELECT n_nationkey, 'ABC' || repeat('.' || n_nationkey, n_nationkey % 4 + 1) || '_1' AS id, 'ABC' AS country, n_nationkey % 4 + 1 AS level FROM nation")
def str6(spark, sf):
    k = F.col("n_nationkey")
    df = read(spark, sf, "nation").select("n_nationkey", F.concat(F.lit("ABC"), F.expr("repeat(concat('.', n_nationkey), n_nationkey % 4 + 1)"), F.lit("_1")).alias("id"))
    return df.select("n_nationkey", "id", I.gadm_country(F.col("id")).alias("country"), I.gadm_level(F.col("id")).alias("level"))


_AGS = "SELECT c_custkey AS k, CASE c_custkey % 6 WHEN 0 THEN lpad((c_custkey % 16 + 1)::VARCHAR, 2, '0') WHEN 1 THEN lpad((c_custkey % 16 + 1)::VARCHAR, 2, '0') || '1' WHEN 5 THEN '00000000' ELSE lpad((c_custkey % 16 + 1)::VARCHAR, 2, '0') || '0' || lpad((c_custkey % 50 + 1)::VARCHAR, 2, '0') || CASE WHEN c_custkey % 6 = 2 THEN '001' ELSE '' END END AS ags FROM customer"


@query("str9_parse_ags", f"""WITH a AS ({_AGS}), o AS (SELECT k, ags, rpad(ags, 8, '0') AS p FROM a),
l AS (SELECT *, CASE WHEN substr(p, 1, 2) IN ('02', '11') THEN 'gem' WHEN substr(p, 6, 3) > '000' THEN 'gem' WHEN substr(p, 4, 2) > '00' THEN 'krs' WHEN substr(p, 3, 1) > '0' THEN 'rbz' WHEN substr(p, 1, 2) > '00' THEN 'lan' ELSE 'sta' END AS own FROM o)
SELECT k, ags, 'DEU' AS country, CASE WHEN substr(p, 1, 2) IN ('02', '11') THEN (SELECT own FROM l GROUP BY own ORDER BY count(*) DESC, own LIMIT 1) ELSE own END AS level FROM l""")
def str9(spark, sf):
    k = F.col("c_custkey")
    land = F.lpad((k % 16 + 1).cast("string"), 2, "0")
    district = F.concat(land, F.lit("0"), F.lpad((k % 50 + 1).cast("string"), 2, "0"), F.when(k % 6 == 2, "001").otherwise(""))
    ags = F.when(k % 6 == 0, land).when(k % 6 == 1, F.concat(land, F.lit("1"))).when(k % 6 == 5, "00000000").otherwise(district)
    return I.parse_ags(read(spark, sf, "customer").select(k.alias("k"), ags.alias("ags")), "ags")


_TYPED = """SELECT c_nationkey, CASE c_nationkey % 7 WHEN 0 THEN 'DE' || c_custkey % 10 WHEN 1 THEN 'DEU.' || c_custkey % 9 || '_1' WHEN 2 THEN 'CRS3035RES1000mN' || c_custkey || 'E1' WHEN 3 THEN 'DE_' || c_custkey
 WHEN 4 THEN '0' || c_custkey WHEN 5 THEN '1kmN' || c_custkey || 'E43' ELSE '?' || c_custkey END AS id FROM customer"""


@query("str10_guess_type", f"SELECT c_nationkey, CASE c_nationkey % 7 WHEN 0 THEN 'nuts' WHEN 1 THEN 'gadm' WHEN 2 THEN 'long_inspire' WHEN 3 THEN 'lau' WHEN 4 THEN 'ags' WHEN 5 THEN 'short_inspire' END AS kind FROM ({_TYPED}) GROUP BY 1, 2")
def str10(spark, sf):
    """The id type of each nation's ids, six types and none."""
    k, n = F.col("c_custkey").cast("string"), F.col("c_nationkey") % 7
    id_ = F.when(n == 0, F.concat(F.lit("DE"), (F.col("c_custkey") % 10).cast("string"))).when(n == 1, F.concat(F.lit("DEU."), (F.col("c_custkey") % 9).cast("string"), F.lit("_1")))
    id_ = id_.when(n == 2, F.concat(F.lit("CRS3035RES1000mN"), k, F.lit("E1"))).when(n == 3, F.concat(F.lit("DE_"), k)).when(n == 4, F.concat(F.lit("0"), k)).when(n == 5, F.concat(F.lit("1kmN"), k, F.lit("E43")))
    return I.guess_id_types(read(spark, sf, "customer").select("c_nationkey", id_.otherwise(F.concat(F.lit("?"), k)).alias("id")), "id", "c_nationkey")


@query("str11_to_iso3", "WITH c AS (SELECT n_name AS name, min(upper(substr(n_name, 1, 3))) AS iso3 FROM nation GROUP BY 1) SELECT c_custkey, iso3 AS id FROM customer JOIN nation ON c_nationkey = n_nationkey LEFT JOIN c ON c.name = n_name")
def str11(spark, sf):
    named = read(spark, sf, "customer").join(read(spark, sf, "nation"), F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", F.col("n_name").alias("id"))
    out, _ = I.convert_to_iso3(named, "id", _codes(spark, sf), ("iso3", "iso2", "name"))
    return out.select("c_custkey", "id")


# math, maps, hashes


@query("mth3_haversine", sql("SELECT id, round(2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(49 - lat) / 2), 2) + cos(radians(lat)) * cos(radians(49)) * pow(sin(radians(7.5 - lon) / 2), 2)))), 6) AS km FROM obs", "obs"))
def mth3(spark, sf):
    return observations(spark, sf).select("id", F.round(G.haversine_km(F.col("lon"), F.col("lat"), F.lit(7.5), F.lit(49.0)), 6).alias("km"))


@query("map1_lookup", "SELECT s_suppkey, CASE s_nationkey % 3 WHEN 0 THEN 'a' WHEN 1 THEN 'b' END AS code FROM supplier")
def map1(spark, sf):
    names = F.map_concat(F.create_map(F.lit(0), F.lit("a")), F.create_map(F.lit(1), F.lit("b")))
    return read(spark, sf, "supplier").select("s_suppkey", F.try_element_at(names, F.col("s_nationkey") % 3).alias("code"))


@query("jsn1_props", "SELECT event_id, CAST(props::JSON ->> 'k' AS BIGINT) AS k FROM events")
def jsn1(spark, sf):
    return read(spark, sf, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


_KEY = "sha256('{\"a\":\"' || c_name || '\",\"b\":\"' || c_mktsegment || '\",\"service\":\"cube\"}')"


@query("hsh1_request_key", f"SELECT c_custkey, {_KEY} AS key FROM customer")
def hsh1(spark, sf):
    return read(spark, sf, "customer").select("c_custkey", key_column({"b": F.col("c_mktsegment"), "a": F.col("c_name"), "service": F.lit("cube")}).alias("key"))


@query("sta3_pop", "WITH i AS (SELECT c_custkey AS seq, c_mktsegment || (c_custkey % 7) AS key, c_name AS path FROM customer) SELECT * FROM i WHERE key NOT IN (SELECT key FROM i ORDER BY seq DESC LIMIT 3)")
def sta3(spark, sf):
    index = read(spark, sf, "customer").select(F.col("c_custkey").alias("seq"), F.concat("c_mktsegment", (F.col("c_custkey") % 7).cast("string")).alias("key"), F.col("c_name").alias("path"))
    return pop_last(index, 3)


_LOG = "SELECT 'k' || o_custkey % 50 AS key, 'p' || o_orderkey AS path, o_orderkey AS seq FROM orders WHERE o_orderkey % 3 <> 0"


def _stash_log(spark, sf) -> DataFrame:
    """A log of one entry for each order, of which every third has a tombstone."""
    orders = read(spark, sf, "orders")
    entry = F.concat(F.lit("k"), (F.col("o_custkey") % 50).cast("string")).alias("key"), F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"), F.col("o_orderkey").alias("seq"), F.col("o_orderkey").cast("string").alias("entry")
    return orders.select(*entry, F.lit(False).alias("dead")).unionByName(orders.where("o_orderkey % 3 = 0").select(*entry, F.lit(True).alias("dead")))


@query("sta1_stash_cycle", f"SELECT key, path, seq FROM ({_LOG})")
def sta1(spark, sf):
    """The entries of a log that stand."""
    return live(_stash_log(spark, sf)).select("key", "path", "seq")


@query("sta2_restore", f"SELECT c_custkey, path FROM customer LEFT JOIN (SELECT key, arg_min(path, seq) AS path FROM ({_LOG}) GROUP BY 1) ON key = 'k' || c_custkey % 60")
def sta2(spark, sf):
    """The oldest entry of each request's key, if any."""
    requests = read(spark, sf, "customer").select("c_custkey", F.concat(F.lit("k"), (F.col("c_custkey") % 60).cast("string")).alias("key"))
    return restore_all(live(_stash_log(spark, sf)), requests).select("c_custkey", "path")


@query("sta4_clean", f"SELECT key, path, seq FROM ({_LOG}) WHERE seq % 4 <> 0")
def sta4(spark, sf):
    """Entries whose file is gone leave the index."""
    files = read(spark, sf, "orders").where("o_orderkey % 4 <> 0").select(F.concat(F.lit("p"), F.col("o_orderkey").cast("string")).alias("path"))
    return clean_index(live(_stash_log(spark, sf)), files).select("key", "path", "seq")


# grids

_T = "floor(lon - 5)::INT AS ix, floor(51 - lat)::INT AS iy"


@query("geo1_cells", sql("SELECT id, ix, iy FROM cells", "obs", "cells"))
def geo1(spark, sf):
    return observations(spark, sf).select("id", GRID.cell(F.col("lon"), F.col("lat")).alias("c")).select("id", "c.ix", "c.iy")


@query("geo3_laea_round_trip", sql("SELECT id, round(lon, 6) AS lon, round(lat, 6) AS lat FROM obs", "obs"))
def geo3(spark, sf):
    east, north = G.to_laea(F.col("lon"), F.col("lat"))
    there = observations(spark, sf).select("id", east.alias("e"), north.alias("n"))
    lon, lat = G.from_laea(F.col("e"), F.col("n"))
    return there.select("id", F.round(lon, 6).alias("lon"), F.round(lat, 6).alias("lat"))


_LAYER = "SELECT ix, iy, avg(v) AS v FROM cube WHERE t BETWEEN DATE '1998-07-29' AND DATE '1998-08-01' GROUP BY ALL"
_BLAYER = "SELECT ix, iy, avg(v) AS v FROM cube WHERE year(t) BETWEEN 1995 AND 1996 AND strftime(t, '%m-%d') IN ('07-29', '07-30', '07-31', '08-01') GROUP BY ALL"


def _resample_sql(method: str, layer: str) -> str:
    if method == "near":
        return f"SELECT tx, ty, v AS x FROM targets LEFT JOIN {layer} ON ix = floor(lon - 5) AND iy = floor(51 - lat)"
    offsets = {"bilinear": "(VALUES (0), (1))", "lanczos": "(VALUES (-2), (-1), (0), (1), (2), (3))"}.get(method, "(VALUES (-1), (0), (1), (2))")
    w = {
        "bilinear": lambda d: f"(1 - abs({d}))",
        "cubic": lambda d: f"(CASE WHEN abs({d}) <= 1 THEN (1.5 * abs({d}) - 2.5) * abs({d}) * abs({d}) + 1 WHEN abs({d}) < 2 THEN ((-0.5 * abs({d}) + 2.5) * abs({d}) - 4) * abs({d}) + 2 ELSE 0 END)",
        "cubicspline": lambda d: f"(CASE WHEN abs({d}) <= 1 THEN 2 / 3 - {d} * {d} + pow(abs({d}), 3) / 2 WHEN abs({d}) < 2 THEN pow(2 - abs({d}), 3) / 6 ELSE 0 END)",
        "lanczos": lambda d: f"(CASE WHEN abs({d}) < 1e-9 THEN 1 WHEN abs({d}) < 3 THEN sin(pi() * {d}) / (pi() * {d}) * sin(pi() * {d} / 3) / (pi() * {d} / 3) ELSE 0 END)",
    }[method]
    return (
        f"SELECT tx, ty, CASE WHEN abs(sum(w)) > 1e-9 THEN sum(w * v) / sum(w) END AS x FROM (SELECT tx, ty, greatest(0, least(4, i0 + a)) AS ix, greatest(0, least(3, j0 + b)) AS iy, {w('(u - i0 - a)')} * {w('(q - j0 - b)')} AS w"
        f" FROM (SELECT tx, ty, lon - 5.5::DOUBLE AS u, 50.5::DOUBLE - lat AS q, floor(lon - 5.5::DOUBLE)::INT AS i0, floor(50.5::DOUBLE - lat)::INT AS j0 FROM targets), {offsets} AS o1(a), {offsets} AS o2(b)) JOIN {layer} USING (ix, iy) GROUP BY tx, ty"
    )


def _grid_sql(method: str) -> str:
    return sql("SELECT t.tx, t.ty, round(l.x, 9) AS linked FROM targets t LEFT JOIN l USING (tx, ty)", "targets", "cube", layer=_LAYER, l=_resample_sql(method, "layer"))


def _grid_query(method: str):
    def run(spark, sf):
        return R.grid_link(targets(spark), cube(spark, sf), GRID, "1998-08-01", span=3, method=method).select("tx", "ty", _r("linked", 9))

    return run


for _m in ("near", "bilinear", "cubic", "cubicspline", "lanczos"):
    query(f"grd2_{_m}", _grid_sql(_m))(_grid_query(_m))


def _grid_api_sql(method: str, layer: str, blayer: str) -> str:
    return sql("SELECT t.tx, t.ty, round(l.x, 9) AS linked, round(b.x, 9) AS baseline, round(l.x - b.x, 9) + 0.0::DOUBLE AS deviation FROM targets t LEFT JOIN l USING (tx, ty) LEFT JOIN b USING (tx, ty)",
        "targets", "cube", layer=layer, blayer=blayer, l=_resample_sql(method, "layer"), b=_resample_sql(method, "blayer"))


@query("api2_daily_grid", _grid_api_sql("bilinear", _LAYER, _BLAYER))
def api2(spark, sf):
    t = targets(spark).withColumn("date", F.to_date(F.lit("1998-08-01")))
    return api.link_daily_grid(t, cube(spark, sf), GRID, "2m_temperature", time_span=3, baseline=(1995, 1996)).select("tx", "ty", _r("linked", 9), _r("baseline", 9), _r("deviation", 9))


@query("api4_monthly_grid", _grid_api_sql("near", "SELECT ix, iy, avg(v) AS v FROM cube WHERE t BETWEEN DATE '1998-07-01' AND DATE '1998-07-31' GROUP BY ALL", "SELECT ix, iy, avg(v) AS v FROM cube WHERE year(t) BETWEEN 1995 AND 1996 AND month(t) = 7 GROUP BY ALL"))
def api4(spark, sf):
    t = targets(spark).withColumn("date", F.to_date(F.lit("1998-08-15")))
    return api.link_monthly_grid(t, cube(spark, sf), GRID, "2m_temperature", time_lag=1, baseline=(1995, 1996), method="near").select("tx", "ty", _r("linked", 9), _r("baseline", 9), _r("deviation", 9))


@query("api3_monthly_link", sql(
    "SELECT o.id, round(s.v, 6) AS linked, round(b.v, 6) AS baseline FROM o LEFT JOIN (SELECT o.id, avg(c.v) AS v FROM o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND date_trunc('month', c.t) BETWEEN date_trunc('month', o.d) - INTERVAL 2 MONTH AND date_trunc('month', o.d) - INTERVAL 1 MONTH GROUP BY o.id) s USING (id)"
    " LEFT JOIN (SELECT o.id, avg(c.v) AS v FROM o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND year(c.t) BETWEEN 1995 AND 1996 AND month(c.t) IN (month(o.d - INTERVAL 1 MONTH), month(o.d - INTERVAL 2 MONTH)) GROUP BY o.id) b USING (id)",
    "obs", "cells", "cube", o=_OBS))
def api3(spark, sf):
    out = api.link_monthly(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", time_lag=1, time_span=1, baseline=("1995", "1996"))
    return out.select("id", _r("linked"), _r("baseline"))


@query("api1_hourly_source", sql(
    "SELECT id, round(m, 6) AS linked FROM p LEFT JOIN (SELECT (ts + INTERVAL 2 HOUR)::DATE AS t, ix, iy, max(value) AS m FROM hourly GROUP BY ALL) h ON h.t = p.d AND h.ix = p.ix AND h.iy = p.iy",
    "hourly", p="SELECT event_id AS id, ts::DATE AS d, (event_id % 5)::INT AS ix, (user_id % 4)::INT AS iy FROM events"))
def api1_hourly(spark, sf):
    lon, lat = GRID.centre(F.col("event_id") % 5, F.col("user_id") % 4)
    points = read(spark, sf, "events").select(F.col("event_id").alias("id"), F.col("ts").cast("date").alias("date"), lon.alias("lon"), lat.alias("lat"))
    return api.link_daily(points, hourly(spark, sf), GRID, "2m_temperature", statistic="daily_maximum", time_zone="utc+02:00").select("id", _r("linked"))


@query("top1_first_layer", sql("SELECT ix, iy, min(t) AS obs_date, arg_min(v, t) AS value FROM cube GROUP BY ALL", "cube"))
def top1(spark, sf):
    return cube(spark, sf).groupBy("ix", "iy").agg(F.min("obs_date").alias("obs_date"), F.min_by("value", "obs_date").alias("value"))


@query("stream_point_link", _JN1)
def stream(spark, sf):
    """The point link over orders arriving as a stream, written by micro-batches and read back."""
    source = read(spark, sf, "orders")
    arriving = spark.readStream.schema(source.schema).parquet(f"{sf}/orders.parquet*")
    lon = F.lit(5) + (F.col("o_custkey") % 50) / F.lit(10.0) + F.lit(0.05)
    lat = F.lit(47) + (F.expr("o_custkey div 50") % 40) / F.lit(10.0) + F.lit(0.05)
    obs = arriving.select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), lon.alias("lon"), lat.alias("lat"))
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    linked = link_stream(obs, cube(spark, sf), GRID).select("id", "d", "linked")
    run = linked.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.parquet(f"{where}/out")


# further lines of the inventory, each through the library's own function


@query("agg1_temporal_mean", sql("SELECT ix, iy, round(v, 9) AS value FROM layer", "cube", layer=_LAYER))
def agg1(spark, sf):
    return R.span_layer(cube(spark, sf), F.to_date(F.lit("1998-08-01")), 3).select("ix", "iy", _r("value", 9))


@query("agg2_zonal_mean", sql(
    "SELECT pd.id, round(m, 6) AS linked FROM pd LEFT JOIN (SELECT pd.id, avg(v) AS m FROM pd JOIN pc USING (p) JOIN cube c ON c.ix = pc.ix AND c.iy = pc.iy AND c.t = pd.d GROUP BY pd.id) AS a USING (id)",
    "edges", "grid", "cube", **_POLY))
def agg2(spark, sf):
    return api.link_daily(polygons(spark), cube(spark, sf), GRID, "2m_temperature", date_var="d", rings="rings").select("id", _r("linked"))


@query("dt3_span_bounds", sql("SELECT id, d - 13 AS first, d - 10 AS last FROM obs", "obs"))
def dt3(spark, sf):
    last = D.link_date(F.col("d"), 10)
    return observations(spark, sf).select("id", D.span_start(last, 3).alias("first"), last.alias("last"))


@query("dt6_make_dates", "SELECT y, unnest(generate_series(make_date(y, 1, 1), make_date(y, 12, 31), INTERVAL 1 DAY))::DATE AS date FROM (SELECT DISTINCT year(l_shipdate)::INT AS y FROM lineitem)")
def dt6(spark, sf):
    """All months and all days of every year: impossible combinations go."""
    years = read(spark, sf, "lineitem").select(F.year("l_shipdate").alias("y")).distinct()
    every = lambda n: F.sequence(F.lit(1), F.lit(n))
    return D.make_dates(years.select("y", F.array("y").alias("ys"), every(12).alias("ms"), every(31).alias("ds")), "ys", "ms", "ds").select("y", "date")


@query("dt9_month_day", sql("SELECT strftime(d, '%m-%d') AS md, count(*) AS n FROM obs GROUP BY 1", "obs"))
def dt9(spark, sf):
    return observations(spark, sf).groupBy(D.month_day(F.col("d")).alias("md")).agg(F.count(F.lit(1)).alias("n"))


@query("prj1_link_date", sql("SELECT id, d, lon, lat, d AS link_date FROM obs", "obs"))
def prj1(spark, sf):
    return observations(spark, sf).withColumn("link_date", D.link_date(F.col("d")))


@query("geo2_buffer_cells", sql("SELECT id, ix, iy FROM bc", "obs", "cells", "grid", o=_OBS, **_buffer(60)))
def geo2(spark, sf):
    return observations(spark, sf).select("id", F.explode(GRID.buffer(F.col("lon"), F.col("lat"), 60.0)).alias("c")).select("id", "c.ix", "c.iy")


@query("geo4_projected_targets", sql("SELECT tx, ty, v AS linked FROM targets LEFT JOIN layer ON ix = floor(lon - 5) AND iy = floor(51 - lat)", "targets", "cube", layer="SELECT ix, iy, v FROM cube WHERE t = DATE '1998-08-01'"))
def geo4(spark, sf):
    """Target cells in EPSG:3035: each centre is brought back to the cube's system, then sampled."""
    east, north = G.to_laea(F.col("lon"), F.col("lat"))
    projected = targets(spark).select("tx", "ty", east.alias("e"), north.alias("n"))
    lon, lat = G.from_laea(F.col("e"), F.col("n"))
    centres = projected.select("tx", "ty", lon.alias("lon"), lat.alias("lat"))
    return R.resample(centres, R.span_layer(cube(spark, sf), F.to_date(F.lit("1998-08-01"))), GRID, "near").select("tx", "ty", "linked")


@query("geo5_geometry_kept", sql("SELECT o.id, o.lon, o.lat, c.v AS linked FROM cells o LEFT JOIN cube c ON c.t = o.d AND c.ix = o.ix AND c.iy = o.iy", "obs", "cells", "cube"))
def geo5(spark, sf):
    return api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d").select("id", "lon", "lat", "linked")


@query("grd1_single_date", sql("SELECT t.tx, t.ty, round(l.x, 9) AS linked FROM targets t LEFT JOIN l USING (tx, ty)", "targets", "cube", layer="SELECT ix, iy, v FROM cube WHERE t = DATE '1998-03-03'", l=_resample_sql("bilinear", "layer")))
def grd1(spark, sf):
    return R.grid_link(targets(spark), cube(spark, sf), GRID, "1998-03-03").select("tx", "ty", _r("linked", 9))


@query("grd3_baseline_method", _grid_api_sql("cubic", _LAYER, _BLAYER))
def grd3(spark, sf):
    """The method asked for resamples the baseline too; ``deviation`` is the two layers' difference."""
    return R.grid_link(targets(spark), cube(spark, sf), GRID, "1998-08-01", span=3, baseline=(1995, 1996), method="cubic").select("tx", "ty", _r("linked", 9), _r("baseline", 9), _r("deviation", 9))


@query("map2_request_defaults", "SELECT c_custkey, 'area=' || c_nationkey || ',format=grib,variable=' || c_mktsegment AS request FROM customer")
def map2(spark, sf):
    """Defaults overlaid with a row's own fields; the target's name is no part of a request."""
    text = F.col("c_nationkey").cast("string")
    own = F.create_map(F.lit("variable"), F.col("c_mktsegment"), F.lit("area"), text, F.lit("target"), F.col("c_name"))
    defaults = F.create_map(F.lit("format"), F.lit("grib"), F.lit("variable"), F.lit("none"))
    merged = F.map_concat(F.map_filter(defaults, lambda k, v: ~F.map_contains_key(own, k)), F.map_filter(own, lambda k, v: k != "target"))
    parts = F.transform(F.array_sort(F.map_entries(merged)), lambda e: F.concat(e["key"], F.lit("="), e["value"]))
    return read(spark, sf, "customer").select("c_custkey", F.array_join(parts, ",").alias("request"))


_ARGUMENTS = """SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN 'derived-era5-land-daily-statistics' WHEN 1 THEN 'derived-era5-single-levels-daily-statistics' ELSE 'reanalysis-era5-land-monthly-means' END AS catalogue,
 CASE o_custkey % 4 WHEN 0 THEN '2m_temperature' WHEN 1 THEN 'k_index' WHEN 2 THEN 'snow_cover' END AS indicator, lpad((o_custkey % 26)::VARCHAR, 2, '0') || ':00' AS by_hour,
 'daily_' || CASE o_orderkey % 4 WHEN 0 THEN 'mean' WHEN 1 THEN 'maximum' WHEN 2 THEN 'minimum' ELSE 'median' END AS statistic, 'utc+' || lpad((o_orderkey % 17)::VARCHAR, 2, '0') || ':00' AS time_zone,
 1990 + o_custkey % 5 AS first, 1990 + o_orderkey % 5 AS last FROM orders"""


@query("val_arguments", f"""SELECT o_orderkey, o_orderkey % 3 <> 2 AS ok_catalogue, coalesce(CASE indicator WHEN '2m_temperature' THEN true WHEN 'k_index' THEN o_orderkey % 3 = 1 WHEN 'snow_cover' THEN o_orderkey % 3 <> 1 END, false) AS ok_indicator,
 by_hour < '24' AS ok_by_hour, statistic <> 'daily_median' AS ok_statistic, time_zone <= 'utc+14:00' AS ok_time_zone, first <= last AS ok_last FROM ({_ARGUMENTS})""")
def val_arguments(spark, sf):
    """A table of requests, sound and unsound, and what the argument checks say of each."""
    k, c = F.col("o_orderkey"), F.col("o_custkey")
    two = lambda n: F.concat(F.lpad(n.cast("string"), 2, "0"), F.lit(":00"))
    pick = lambda n, *names: F.get(F.array(*map(F.lit, names)), n.cast("int"))
    rows = read(spark, sf, "orders").select(
        "o_orderkey", pick(k % 3, *C.DAILY, C.MONTHLY[0]).alias("catalogue"), pick(c % 4, "2m_temperature", "k_index", "snow_cover").alias("indicator"), two(c % 26).alias("by_hour"),
        F.concat(F.lit("daily_"), pick(k % 4, "mean", "maximum", "minimum", "median")).alias("statistic"), F.concat(F.lit("utc+"), two(k % 17)).alias("time_zone"), (1990 + c % 5).alias("first"), (1990 + k % 5).alias("last"),
    )
    return C.valid_arguments(rows).select("o_orderkey", "ok_catalogue", "ok_indicator", "ok_by_hour", "ok_statistic", "ok_time_zone", "ok_last")


# rules of linking that the inventory's lines leave open


@query("api1_null_and_repeated_ids", sql(
    "SELECT CASE WHEN id % 5 = 0 THEN NULL ELSE id % 7 END AS id, o.d, o.lon, o.lat, round(linked, 6) AS linked FROM o LEFT JOIN s USING (id)", "obs", "cells", "cube", o=_OBS, s=_SPAN))
def api1_ids(spark, sf):
    """A panel: ids repeat or are missing; every row gets its own value."""
    obs = observations(spark, sf).withColumn("id", F.when(F.col("id") % 5 != 0, F.col("id") % 7))
    return api.link_daily(obs, cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3).select("id", "d", "lon", "lat", _r("linked"))


@query("api1_many_rows_a_cell", sql(
    "SELECT o.id, round(v, 6) AS linked FROM o LEFT JOIN (SELECT l_shipdate::DATE AS t, (l_suppkey % 5)::INT AS ix, (l_partkey % 4)::INT AS iy, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) c ON c.t = o.d AND c.ix = o.ix AND c.iy = o.iy",
    "obs", "cells", o=_OBS))
def api1_many(spark, sf):
    """A cube with several rows for a cell and date: their mean counts, no row multiplies."""
    rows = read(spark, sf, "lineitem").select(F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") % 5).alias("ix"), (F.col("l_partkey") % 4).alias("iy"), F.col("l_quantity").alias("value"))
    return api.link_daily(observations(spark, sf), Q.ingest(rows), GRID, "2m_temperature", date_var="d").select("id", _r("linked"))


@query("api3_monthly_of_daily", sql(
    "SELECT o.id, round(v, 6) AS linked FROM o LEFT JOIN (SELECT date_trunc('month', t)::DATE AS t, ix, iy, avg(v) AS v FROM cube GROUP BY ALL) c ON c.t = date_trunc('month', o.d)::DATE AND c.ix = o.ix AND c.iy = o.iy", "obs", "cells", "cube", o=_OBS))
def api3_daily(spark, sf):
    """A month without a span over a daily cube: the month's mean, one row for each observation."""
    return api.link_monthly(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d").select("id", _r("linked"))


@query("api1_long_span", sql(
    "SELECT o.id, round(linked + 1e-9::DOUBLE, 6) AS linked FROM o LEFT JOIN (SELECT o.id, avg(c.v) AS linked FROM o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 365 AND o.d GROUP BY o.id) USING (id)", "obs", "cells", "cube", o=_OBS))
def api1_long(spark, sf):
    """A span of a year; means that end in a half of the last digit are moved off it before both sides round."""
    out = api.link_daily(observations(spark, sf), cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=365)
    return out.select("id", F.round(F.col("linked") + 1e-9, 6).alias("linked"))


@query("api1_projected_points", sql("SELECT o.id, round(linked, 6) AS linked FROM o LEFT JOIN s USING (id)", "obs", "cells", "cube", o=_OBS, s=_SPAN))
def api1_projected(spark, sf):
    """Observations in EPSG:3035."""
    east, north = G.to_laea(F.col("lon"), F.col("lat"))
    obs = observations(spark, sf).select("id", "d", east.alias("lon"), north.alias("lat"))
    return api.link_daily(obs, cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3, crs=3035).select("id", _r("linked"))


_EDGE = "radians(1) * 6371.0088"
_NEAR_POLY = dict(
    flat=f"SELECT p, ix, iy, (ax - clon) * cos(radians(clat)) * {_EDGE} AS ax, (ay - clat) * {_EDGE} AS ay, (bx - ax) * cos(radians(clat)) * {_EDGE} AS dx, (\"by\" - ay) * {_EDGE} AS dy FROM edges, grid",
    dist="SELECT p, ix, iy, min(sqrt(pow(ax + t * dx, 2) + pow(ay + t * dy, 2))) AS km FROM (SELECT *, greatest(0, least(1, coalesce(-(ax * dx + ay * dy) / nullif(dx * dx + dy * dy, 0), 0))) AS t FROM flat) GROUP BY ALL",
    nearby="SELECT p, ix, iy FROM cover UNION SELECT p, ix, iy FROM dist WHERE km <= 40",
    npc="SELECT * FROM nearby UNION ALL SELECT * FROM mid WHERE p NOT IN (SELECT p FROM nearby) AND ix BETWEEN 0 AND 4 AND iy BETWEEN 0 AND 3",
)


@query("api1_polygon_buffer", sql(
    "SELECT pd.id, round(m, 6) AS linked FROM pd LEFT JOIN (SELECT id, avg(cm) AS m FROM (SELECT pd.id, npc.ix, npc.iy, avg(v) AS cm FROM pd JOIN npc USING (p) JOIN cube c ON c.ix = npc.ix AND c.iy = npc.iy AND c.t BETWEEN pd.d - 6 AND pd.d GROUP BY ALL) GROUP BY id) AS a USING (id)",
    "edges", "grid", "cube", **_POLY, **_NEAR_POLY))
def api1_polygon_buffer(spark, sf):
    """Polygons with 40 km round them."""
    return api.link_daily(polygons(spark), cube(spark, sf), GRID, "2m_temperature", date_var="d", rings="rings", time_span=6, buffer_km=40.0).select("id", _r("linked"))


_GLOBE = dict(
    g="SELECT x.range::INT AS ix, y.range::INT AS iy, -180 + (x.range + 0.5::DOUBLE) * 10 AS clon, 90 - (y.range + 0.5::DOUBLE) * 10 AS clat FROM range(36) AS x, range(18) AS y",
    q="SELECT l_shipdate::DATE AS t, (l_suppkey % 36)::INT AS ix, (l_partkey % 18)::INT AS iy, avg(l_quantity) AS v FROM lineitem GROUP BY ALL",
    p="SELECT o_orderkey AS id, o_orderdate::DATE AS d, (o_custkey * 7 % 720)::DOUBLE + 0.3::DOUBLE AS lon, (o_custkey * 11 % 179) - 89 + 0.2::DOUBLE AS lat FROM orders",
    near="SELECT p.id, p.d, g.ix, g.iy FROM p, g WHERE 2 * 6371.0088 * asin(least(1.0, sqrt(pow(sin(radians(clat - lat) / 2), 2) + cos(radians(lat)) * cos(radians(clat)) * pow(sin(radians(clon - lon) / 2), 2)))) <= 900",
    bc="SELECT * FROM near UNION ALL SELECT id, d, (floor((lon + 180) / 10)::INT % 36) AS ix, floor((90 - lat) / 10)::INT AS iy FROM p WHERE id NOT IN (SELECT id FROM near)",
)


@query("api1_round_the_globe", sql(
    "SELECT p.id, round(m, 6) AS linked FROM p LEFT JOIN (SELECT bc.id, avg(v) AS m FROM bc JOIN q ON q.t = bc.d AND q.ix = bc.ix AND q.iy = bc.iy GROUP BY bc.id) AS a USING (id)", **_GLOBE))
def api1_globe(spark, sf):
    """A global grid: longitudes of any name, buffers across the edge of the map and round the poles."""
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") % 36).alias("ix"), (F.col("l_partkey") % 18).alias("iy"))
    q = Q.ingest(rows.agg(F.avg("l_quantity").alias("value")))
    at = (F.col("o_custkey") * 7 % 720).cast("double") + 0.3, (F.col("o_custkey") * 11 % 179) - 89 + F.lit(0.2)
    obs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), at[0].alias("lon"), at[1].alias("lat"))
    return api.link_daily(obs, q, Grid(-180.0, 90.0, 10.0, 10.0, 36, 18), "2m_temperature", date_var="d", buffer_km=900.0).select("id", _r("linked"))


@query("src5_wkt_polygons", "SELECT s_suppkey, 2::BIGINT AS n_rings, 9::BIGINT AS n_points, (s_suppkey % 50)::DOUBLE AS xmin, s_suppkey % 50 + 4.5::DOUBLE AS xmax, (s_suppkey % 30)::DOUBLE AS ymin, s_suppkey % 30 + 4.0::DOUBLE AS ymax FROM supplier")
def src5_polygons(spark, sf):
    """A polygon with a hole as text for each supplier, read to rings."""
    x, y = F.col("s_suppkey") % 50, F.col("s_suppkey") % 30
    outer = F.format_string("(%d %d, %d.5 %d, %d.5 %d, %d %d, %d %d)", x, y, x + 4, y, x + 4, y + 4, x, y + 4, x, y)
    hole = F.format_string("(%d.5 %d.25, %d %d, %d %d.75, %d.5 %d.25)", x + 1, y + 1, x + 2, y + 1, x + 2, y + 2, x + 1, y + 1)
    rows = read(spark, sf, "supplier").select("s_suppkey", F.concat(F.lit("POLYGON ("), outer, F.lit(", "), hole, F.lit(")")).alias("wkt"))
    b = G.bounds(F.col("rings"))
    sizes = F.size("rings").cast("long").alias("n_rings"), F.size(F.flatten("rings")).cast("long").alias("n_points")
    return A.from_wkt(rows, "wkt").select("s_suppkey", *sizes, *[b[k].alias(k) for k in ("xmin", "xmax", "ymin", "ymax")])


def _area_query(kind: str, of, sql_id: str, level: str, country: str):
    """Register the enrichment of one id type: areas named after nations, ids from customers."""
    reference = f"SELECT {sql_id.format(k='n_nationkey')} AS area_id, min(n_name) AS n_name FROM nation GROUP BY 1"

    @query(f"jn8_enrich_{kind}", f"WITH ref AS ({reference}) SELECT c_custkey, id, {country} AS country, {level} AS level, n_name FROM (SELECT c_custkey, {sql_id.format(k='c_nationkey')} AS id FROM customer) LEFT JOIN ref ON area_id = id")
    def run(spark, sf):
        rows = read(spark, sf, "customer").select("c_custkey", of(F.col("c_nationkey")).alias("id"))
        areas = read(spark, sf, "nation").select(F.lit(kind).alias("source"), of(F.col("n_nationkey")).alias("area_id"), "n_name")
        named = E.parse_ids(areas, "area_id", kind).drop("country")
        return E.enrich(rows, named.select("source", "level", "area_id", "n_name"), "id", type=kind)


_s = lambda k: k.cast("string")
_area_query("gadm", lambda k: F.concat(F.lit("DEU."), _s(k % 5), F.when(k % 2 == 0, F.concat(F.lit("."), _s(k))).otherwise(""), F.lit("_1")),
    "'DEU.' || {k} % 5 || CASE WHEN {k} % 2 = 0 THEN '.' || {k} ELSE '' END || '_1'", "(length(id) - length(replace(id, '.', '')))::VARCHAR", "'DEU'")
_area_query("lau", lambda k: F.concat(F.lit("FR_"), F.lpad(_s(k), 5, "0")), "'FR_' || lpad({k}::VARCHAR, 5, '0')", "NULL::VARCHAR", "'FR'")
_area_query("ags", lambda k: F.concat(F.lit("0"), _s(k % 9 + 1), F.when(k % 2 == 0, F.concat(F.lit("0"), F.lpad(_s(k + 1), 2, "0"))).otherwise("")),
    "'0' || ({k} % 9 + 1) || CASE WHEN {k} % 2 = 0 THEN '0' || lpad(({k} + 1)::VARCHAR, 2, '0') ELSE '' END",
    "CASE WHEN id LIKE '02%' THEN (SELECT l FROM (SELECT CASE WHEN i LIKE '02%' THEN 'gem' WHEN length(i) > 2 THEN 'krs' ELSE 'lan' END AS l FROM (SELECT '0' || (c_nationkey % 9 + 1) || CASE WHEN c_nationkey % 2 = 0 THEN '001' ELSE '' END AS i FROM customer)) GROUP BY l ORDER BY count(*) DESC, l LIMIT 1) WHEN length(id) > 2 THEN 'krs' ELSE 'lan' END", "'DEU'")
_area_query("postcode", lambda k: F.lpad(_s(k * 37 + 1000), 5, "0"), "lpad(({k} * 37 + 1000)::VARCHAR, 5, '0')", "NULL::VARCHAR", "NULL::VARCHAR")


@query("geo3_laea_forward", sql("""SELECT id, round(4321000 + b * dd * cos(beta) * sin(dl), 2) AS east, round(3210000 + b / dd * (cb * sin(beta) - sb * cos(beta) * cos(dl)), 2) AS north
 FROM (SELECT *, rq * sqrt(2 / (1 + sb * sin(beta) + cb * cos(beta) * cos(dl))) AS b, 6378137 * cos(radians(52)) / sqrt(1 - e2 * pow(sin(radians(52)), 2)) / (rq * cb) AS dd
 FROM (SELECT *, sin(asin(q0 / qp)) AS sb, cos(asin(q0 / qp)) AS cb, asin(q / qp) AS beta, 6378137 * sqrt(qp / 2) AS rq, radians(lon - 10) AS dl
 FROM (SELECT *, (1 - e2) * (s / (1 - e2 * s * s) - ln((1 - e * s) / (1 + e * s)) / (2 * e)) AS q, (1 - e2) * (1 / (1 - e2) - ln((1 - e) / (1 + e)) / (2 * e)) AS qp,
 (1 - e2) * (s0 / (1 - e2 * s0 * s0) - ln((1 - e * s0) / (1 + e * s0)) / (2 * e)) AS q0
 FROM (SELECT id, lon, lat, sin(radians(lat)) AS s, sin(radians(52)) AS s0, sqrt(0.00669438002290079::DOUBLE) AS e, 0.00669438002290079::DOUBLE AS e2 FROM obs))))""", "obs"))  # fmt: skip
def geo3_forward(spark, sf):
    """Points to EPSG:3035; tests compare the published example of the projection too."""
    east, north = G.to_laea(F.col("lon"), F.col("lat"))
    return observations(spark, sf).select("id", F.round(east, 2).alias("east"), F.round(north, 2).alias("north"))


@query("snk2_temporary_cube", sql("SELECT year(t)::INT AS year, count(*) AS n, round(sum(v), 6) AS total FROM cube GROUP BY 1", "cube"))
def snk2(spark, sf):
    """A cube written for the time of a block, read again and deleted; what was made of it stays."""
    kept = f"{shared_dir(spark)}/totals-{uuid.uuid4().hex}"
    with temporary_cube(cube(spark, sf)) as written:
        written.groupBy("year").agg(F.count(F.lit(1)).alias("n"), F.round(F.sum("value"), 6).alias("total")).write.parquet(kept)
    return spark.read.parquet(kept)


from geolink.plans import area_queries, catalogue_queries, cube_queries, rule_queries  # noqa: E402, F401  they register themselves
