"""Queries on rules of linking: bad coordinates, clashing names, month stamps."""

from __future__ import annotations

from pyspark.sql import functions as F

from geolink.functions.projections import projection
from geolink.plans import api
from geolink.plans.datasets import GRID, cube, observations, read, sql
from geolink.plans.registry import query, rounded
from geolink.sources.cube import ingest
from geolink.sources.grid import Grid, target_grid


@query("api1_bad_coordinates", sql(
    "SELECT o.id AS _x, o.id % 3 AS _d, o.id % 5 AS _c, o.id % 7 AS _k0, o.id % 2 AS ix, o.id % 13 AS link_date, 'mine' AS \"row\", CASE WHEN o.id % 11 < 5 THEN NULL ELSE round(linked, 6) END AS linked FROM cells o LEFT JOIN s USING (id)",
    "obs", "cells", "cube", s="SELECT o.id, avg(c.v) AS linked FROM cells o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 3 AND o.d GROUP BY o.id"))
def api1_bad(spark, sf):
    """Coordinates that are none (NaN, infinite, beyond the pole, NULL) link with nothing; the caller's columns have names of helpers."""
    k, bad = F.col("id"), F.col("id") % 11
    lon = F.when(bad == 0, float("nan")).when(bad == 1, float("inf")).when(bad == 4, F.lit(None)).otherwise(F.col("lon"))
    lat = F.when(bad == 2, float("-inf")).when(bad == 3, -1e12).otherwise(F.col("lat"))
    obs = observations(spark, sf).select(
        k.alias("_x"), (k % 3).alias("_d"), (k % 5).alias("_c"), (k % 7).alias("_k0"), (k % 2).alias("ix"), (k % 13).alias("link_date"), F.lit("mine").alias("row"),
        F.lit(-1.0).alias("linked"), F.col("d"), lon.alias("lon"), lat.alias("lat"),
    )
    return api.link_daily(obs, cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3).drop("d", "lon", "lat").withColumn("linked", rounded("linked"))


_MONTHS = "SELECT date_trunc('month', l_shipdate)::DATE AS t, (l_suppkey % 5)::INT AS ix, (l_partkey % 4)::INT AS iy, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"
_BY_MONTH = "SELECT o.id, round(c.v, 6) AS linked, round(b.v, 6) AS baseline FROM cells o LEFT JOIN m c ON c.t = date_trunc('month', o.d) AND c.ix = o.ix AND c.iy = o.iy LEFT JOIN (SELECT month(t) AS k, ix, iy, avg(v) AS v FROM m WHERE year(t) BETWEEN 1995 AND 1997 GROUP BY ALL) b ON b.k = month(o.d) AND b.ix = o.ix AND b.iy = o.iy"
#: Indicators of each stamp rule; how their layers of a month are stamped.
_RULES = {"total_precipitation": lambda month: F.date_sub(month, 1), "k_index": F.last_day, "2m_temperature": lambda month: month}


def _stamped(indicator: str):
    @query(f"api3_stamp_{indicator}", sql(_BY_MONTH, "obs", "cells", m=_MONTHS))
    def run(spark, sf):
        """Layers stamped by the indicator's rule: before its month, at its end, at its beginning."""
        rows = read(spark, sf, "lineitem").groupBy(F.trunc(F.col("l_shipdate").cast("date"), "month").alias("month"), (F.col("l_suppkey") % 5).alias("ix"), (F.col("l_partkey") % 4).alias("iy"))
        layers = ingest(rows.agg(F.sum("l_quantity").alias("value")).withColumn("obs_date", _RULES[indicator](F.col("month"))))
        out = api.link_monthly(observations(spark, sf), layers, GRID, indicator, date_var="d", catalogue="reanalysis-era5-single-levels-monthly-means", baseline=(1995, 1997))
        return out.select("id", rounded("linked"), rounded("baseline"))


for _i in _RULES:
    _stamped(_i)


_SPAN_OF_4 = "SELECT o.id, avg(c.v) AS linked FROM cells o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 3 AND o.d GROUP BY o.id"


@query("api1_utm_points", sql("SELECT o.id, round(linked, 6) AS linked FROM cells o LEFT JOIN s USING (id)", "obs", "cells", "cube", s=_SPAN_OF_4))
def api1_utm(spark, sf):
    """Observations in UTM zone 32."""
    east, north = projection(32632).forward(F.col("lon"), F.col("lat"))
    obs = observations(spark, sf).select("id", "d", east.alias("lon"), north.alias("lat"))
    return api.link_daily(obs, cube(spark, sf), GRID, "2m_temperature", date_var="d", time_span=3, crs=32632).select("id", rounded("linked"))


@query("geo3_round_trips", sql("SELECT id, code, round(lon, 7) AS lon, round(lat, 7) AS lat FROM obs, (VALUES (3035), (32632), (25831), (3995), (3413), (32661)) AS t(code)", "obs"))
def geo3_trips(spark, sf):
    """Every point to six projected systems and back."""
    each = []
    for code in (3035, 32632, 25831, 3995, 3413, 32661):
        east, north = projection(code).forward(F.col("lon"), F.col("lat"))
        there = observations(spark, sf).select("id", east.alias("e"), north.alias("n"))
        lon, lat = projection(code).inverse(F.col("e"), F.col("n"))
        each.append(there.select("id", F.lit(code).alias("code"), F.round(lon, 7).alias("lon"), F.round(lat, 7).alias("lat")))
    out = each[0]
    for more in each[1:]:
        out = out.unionByName(more)
    return out


#: A target whose cells lie across the cube's and beyond it.
ACROSS = Grid(4.7, 51.2, 0.8, 0.7, 7, 7)


_AREA_SQL = {"average": "sum(w * v) / sum(w)", "sum": "sum(w * v)", "min": "min(v)", "max": "max(v)", "rms": "sqrt(sum(w * v * v) / sum(w))"}


def _by_area(method: str):
    @query(f"grd2_{method}", f"""
WITH q AS (SELECT ix, iy, avg(v) AS v FROM (SELECT l_shipdate::DATE AS t, (l_suppkey % 5)::INT AS ix, (l_partkey % 4)::INT AS iy, avg(l_quantity) AS v FROM lineitem GROUP BY ALL) WHERE t BETWEEN DATE '1998-07-29' AND DATE '1998-08-01' GROUP BY ALL),
t AS (SELECT x.range::INT AS tx, y.range::INT AS ty, 4.7::DOUBLE + x.range * 0.8::DOUBLE AS x0, 51.2::DOUBLE - y.range * 0.7::DOUBLE AS y1 FROM range(7) AS x, range(7) AS y),
w AS (SELECT tx, ty, v, greatest(0, least(x0 + 0.8::DOUBLE, 6 + ix) - greatest(x0, 5 + ix)) * greatest(0, least(y1, 51 - iy) - greatest(y1 - 0.7::DOUBLE, 50 - iy)) AS w FROM t, q)
SELECT t.tx, t.ty, round(x, 9) AS linked FROM t LEFT JOIN (SELECT tx, ty, {_AREA_SQL[method]} AS x FROM w WHERE w > 1e-9 GROUP BY ALL) USING (tx, ty)
""")
    def run(spark, sf):
        """By the cells of the cube that a target's cell lies across, and their shares."""
        t = target_grid(spark, ACROSS).withColumn("date", F.to_date(F.lit("1998-08-01")))
        return api.link_daily_grid(t, cube(spark, sf), GRID, "2m_temperature", time_span=3, method=method, cell=(ACROSS.dx, ACROSS.dy)).select("tx", "ty", rounded("linked", 9))


for _m in _AREA_SQL:
    _by_area(_m)
