"""Queries over polygons that are derived from whole tables, and their DuckDB oracles."""

from __future__ import annotations

import math

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.functions.geometry import normal_lon
from geolink.operators import cover
from geolink.plans import api
from geolink.plans.datasets import dealt, read
from geolink.plans.registry import query, rounded
from geolink.sources.cube import ingest
from geolink.sources.geometry_codec import from_geojson, from_wkb, to_wkb
from geolink.sources.grid import Grid

FINE = Grid(5.0, 51.0, 0.1, 0.1, 50, 40)
GLOBE = Grid(-180.0, 90.0, 1.0, 1.0, 360, 180)
#: Line items whose groups one task holds.
FINE_ROWS = 200_000


def _ring(n: Column, radius, x: Column, y: Column, squeeze: Column) -> Column:
    """``n`` corners round (x, y); ``radius`` gives the distance of corner j."""
    turn = lambda j: j * (2 * math.pi) / n
    return F.transform(F.sequence(F.lit(0), n - 1), lambda j: F.struct((x + F.cos(turn(j)) * radius(j) * squeeze).alias("x"), (y + F.sin(turn(j)) * radius(j)).alias("y")))


def customer_areas(spark, sf: str) -> DataFrame:
    """A star for each customer, of 3 to 42 or 10,000 corners; every third has a hole, every eleventh is a sliver."""
    k = F.col("c_custkey")
    corners = F.when(k % 500 == 7, 10_000).otherwise((3 + k % 40).cast("int"))
    middle = (F.lit(5.503) + (k % 37) * F.lit(0.1137)).alias("_x"), (F.lit(47.4043) + (k % 29) * F.lit(0.1139)).alias("_y")
    rows = read(spark, sf, "customer").select("c_custkey", corners.alias("_n"), *middle, F.when(k % 11 == 0, 0.01).otherwise(F.lit(1.0)).alias("_squeeze"))
    rows, n, x, y, squeeze = dealt(rows, "c_custkey"), *map(F.col, ("_n", "_x", "_y", "_squeeze"))
    star = _ring(n, lambda j: F.lit(0.1) + F.lit(0.9) * ((k * 7 + j.cast("long") * j * 13) % 17) / F.lit(17.0), x, y, squeeze)
    hole = _ring(F.lit(12), lambda j: F.lit(0.15), x, y, squeeze)
    rings = F.when(k % 3 == 0, F.array(star, hole)).otherwise(F.array(star))
    return rows.select("c_custkey", F.date_add(F.to_date(F.lit("1997-01-01")), (k % 300).cast("int")).alias("d"), rings.alias("shape"))


_AREAS = """
WITH RECURSIVE c AS (
  SELECT c_custkey AS k, CASE WHEN c_custkey % 500 = 7 THEN 10000 ELSE 3 + c_custkey % 40 END AS n, 5.503::DOUBLE + (c_custkey % 37) * 0.1137::DOUBLE AS x, 47.4043::DOUBLE + (c_custkey % 29) * 0.1139::DOUBLE AS y,
    CASE WHEN c_custkey % 11 = 0 THEN 0.01::DOUBLE ELSE 1.0::DOUBLE END AS q, DATE '1997-01-01' + (c_custkey % 300)::INT AS d
  FROM customer
), r AS (
  SELECT k, 0 AS ring, n, x, y, q, unnest(range(n)) AS j FROM c UNION ALL SELECT k, 1, 12, x, y, q, unnest(range(12)) FROM c WHERE k % 3 = 0
), v AS MATERIALIZED (
  SELECT k, ring, n, j, x + cos(j * 6.283185307179586::DOUBLE / n) * s * q AS x, y + sin(j * 6.283185307179586::DOUBLE / n) * s AS y
  FROM (SELECT *, CASE ring WHEN 0 THEN 0.1::DOUBLE + 0.9::DOUBLE * ((k * 7 + j * j * 13) % 17) / 17.0::DOUBLE ELSE 0.15::DOUBLE END AS s FROM r)
), e AS MATERIALIZED (
  SELECT a.k, a.x AS ax, a.y AS ay, b.x AS bx, b.y AS "by" FROM v a JOIN v b ON a.k = b.k AND a.ring = b.ring AND b.j = (a.j + 1) % a.n
), m AS MATERIALIZED (
  SELECT k, iy, (bx - ax) * (clat - ay) / ("by" - ay) + ax AS x FROM e JOIN (SELECT range::INT AS iy, 51 - (range + 0.5::DOUBLE) * 0.1::DOUBLE AS clat FROM range(40)) ON (ay > clat) <> ("by" > clat)
), cell AS MATERIALIZED (
  SELECT k, iy, ix FROM m JOIN (SELECT range::INT AS ix, 5 + (range + 0.5::DOUBLE) * 0.1::DOUBLE AS clon FROM range(50)) ON clon < x GROUP BY ALL HAVING count(*) % 2 = 1
), own AS (
  SELECT k, floor(((min(x) + max(x)) / 2 - 5) / 0.1::DOUBLE)::INT AS ix, floor((51 - (min(y) + max(y)) / 2) / 0.1::DOUBLE)::INT AS iy FROM v GROUP BY k
)
"""


@query("jn5_customer_runs", _AREAS + "SELECT k AS c_custkey, iy, min(ix) AS i0, max(ix) AS i1, false AS own FROM (SELECT *, ix - row_number() OVER (PARTITION BY k, iy ORDER BY ix) AS g FROM cell) GROUP BY k, iy, g UNION ALL SELECT k, iy, ix, ix, true FROM own")
def jn5_runs(spark, sf):
    """Polygons of every customer as runs of cells, by scanlines."""
    return cover.polygon_runs(customer_areas(spark, sf), ["c_custkey"], FINE).select("c_custkey", "iy", "i0", "i1", "own")


@query("jn5_polygon_cells", _AREAS + "SELECT k AS c_custkey, iy, ix FROM cell UNION ALL SELECT k, iy, ix FROM own WHERE k NOT IN (SELECT k FROM cell)")
def jn5_cells(spark, sf):
    """The same written out; a polygon without a cell has that of its box's centre."""
    place = ["c_custkey"]
    return cover.covered_cells(cover.polygon_runs(customer_areas(spark, sf), place, FINE), place).select("c_custkey", "iy", "ix")


def fine_cube(spark, sf: str) -> DataFrame:
    """Mean quantity a day, of 50 x 40 cells."""
    cells = [F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") * 7 % 50).cast("int").alias("ix"), (F.col("l_partkey") % 40).cast("int").alias("iy")]
    key = ["obs_date", "ix", "iy"]
    rows = dealt(read(spark, sf, "lineitem").select(*cells, "l_quantity"), *key, each=FINE_ROWS).groupBy(*key)
    return ingest(rows.agg(F.avg("l_quantity").alias("value")))


_FINE = "SELECT l_shipdate::DATE AS t, (l_suppkey * 7 % 50)::INT AS ix, (l_partkey % 40)::INT AS iy, avg(l_quantity) AS v FROM lineitem GROUP BY ALL"
_CELLS = "SELECT * FROM cell UNION ALL SELECT k, iy, ix FROM own WHERE k NOT IN (SELECT k FROM cell)"


@query("jn5_customer_link", _AREAS + f""", q AS ({_FINE}), pc AS ({_CELLS})
SELECT c.k AS c_custkey, round(m, 6) AS linked FROM c LEFT JOIN (SELECT k, avg(cm) AS m FROM (SELECT c.k, pc.ix, pc.iy, avg(v) AS cm FROM c JOIN pc USING (k) JOIN q ON q.ix = pc.ix AND q.iy = pc.iy AND q.t BETWEEN c.d - 20 AND c.d GROUP BY ALL) GROUP BY k) USING (k)""")
def jn5_link(spark, sf):
    """Three weeks' means over every customer's polygon."""
    areas = customer_areas(spark, sf)
    return api.link_daily(areas, fine_cube(spark, sf), FINE, "2m_temperature", date_var="d", rings="shape", time_span=20).select("c_custkey", rounded("linked"))


@query("geo2_date_line_runs", """
WITH s AS (SELECT s_suppkey AS k, 174.37::DOUBLE + s_suppkey % 11 AS x, (s_suppkey * 7 % 120) - 60 + 0.21::DOUBLE AS y, 1.13::DOUBLE + s_suppkey % 5 AS w, 75.3::DOUBLE + s_suppkey % 10 AS cap FROM supplier),
cells AS (SELECT x.range::INT AS ix, y.range::INT AS iy, -180 + (x.range + 0.5::DOUBLE) AS clon, 90 - (y.range + 0.5::DOUBLE) AS clat FROM range(360) AS x, range(180) AS y),
hit AS (
  SELECT DISTINCT k, iy, ix FROM s JOIN cells ON abs(clat - y) < w JOIN (VALUES (0), (360)) AS t(turn) ON abs(clon + turn - x) < w - abs(clat - y) WHERE k % 7 <> 0
  UNION ALL SELECT k, iy, ix FROM s JOIN cells ON CASE WHEN k % 2 = 0 THEN clat > cap ELSE clat < -cap END WHERE k % 7 = 0
)
SELECT k AS s_suppkey, iy, min(ix) AS i0, max(ix) AS i1 FROM (SELECT *, ix - row_number() OVER (PARTITION BY k, iy ORDER BY ix) AS g FROM hit) GROUP BY k, iy, g
""")
def geo2_date_line(spark, sf):
    """A diamond over the 180th meridian for each supplier, and rings round either pole."""
    k = F.col("s_suppkey")
    x, y, w, cap = F.lit(174.37) + k % 11, (k * 7 % 120) - 60 + F.lit(0.21), F.lit(1.13) + k % 5, (F.lit(75.3) + k % 10) * F.when(k % 2 == 0, 1).otherwise(-1)
    corner = lambda a, b: F.struct(normal_lon(x + a).alias("x"), (y + b).alias("y"))
    zero = F.lit(0.0)
    diamond = F.array(corner(w, zero), corner(zero, w), corner(-w, zero), corner(zero, -w))
    ring = F.transform(F.sequence(F.lit(0), F.lit(11)), lambda j: F.struct((j * F.lit(30.0) - 165).alias("x"), cap.alias("y")))
    rows = dealt(read(spark, sf, "supplier").select("s_suppkey"), "s_suppkey").select("s_suppkey", F.array(F.when(k % 7 == 0, ring).otherwise(diamond)).alias("shape"))
    return cover.polygon_runs(rows, ["s_suppkey"], GLOBE).where("not own").select("s_suppkey", "iy", "i0", "i1")


_ARC = """
WITH c AS (SELECT c_custkey AS k, 5.31::DOUBLE + (c_custkey % 31) * 0.117::DOUBLE AS ax, 47.23::DOUBLE + (c_custkey % 23) * 0.131::DOUBLE AS ay FROM customer),
e AS (SELECT k, ax, ay, ax + 0.71::DOUBLE AS bx, ay + 0.43::DOUBLE AS "by" FROM c UNION ALL SELECT k, ax + 0.71::DOUBLE, ay + 0.43::DOUBLE, ax, ay FROM c),
cells AS (SELECT x.range::INT AS ix, y.range::INT AS iy, radians(5 + (x.range + 0.5::DOUBLE) * 0.1::DOUBLE) AS l3, radians(51 - (y.range + 0.5::DOUBLE) * 0.1::DOUBLE) AS p3 FROM range(50) AS x, range(40) AS y),
a AS (SELECT k, ix, iy, radians(ax) AS l1, radians(ay) AS p1, radians(bx) AS l2, radians("by") AS p2, l3, p3 FROM e JOIN cells ON abs(degrees(p3) - (ay + "by") / 2) < 0.6 AND abs(degrees(l3) - (ax + bx) / 2) < 0.9),
b AS (SELECT k, ix, iy, HAV13 AS d13, HAV12 AS d12, HAV23 AS d23, atan2(sin(l3 - l1) * cos(p3), cos(p1) * sin(p3) - sin(p1) * cos(p3) * cos(l3 - l1)) - atan2(sin(l2 - l1) * cos(p2), cos(p1) * sin(p2) - sin(p1) * cos(p2) * cos(l2 - l1)) AS t FROM a),
x AS (SELECT *, asin(sin(d13) * sin(t)) AS off FROM b)
SELECT DISTINCT k AS c_custkey, iy, ix FROM x WHERE 6371.0088 * CASE WHEN cos(t) >= 0 AND acos(least(1, cos(d13) / cos(off))) <= d12 THEN abs(off) ELSE least(d13, d23) END <= 15
"""
for _a, _b in ("13", "12", "23"):
    _ARC = _ARC.replace(f"HAV{_a}{_b}", f"2 * asin(least(1.0, sqrt(pow(sin((p{_b} - p{_a}) / 2), 2) + cos(p{_a}) * cos(p{_b}) * pow(sin((l{_b} - l{_a}) / 2), 2))))")


@query("geo2_arc_cells", _ARC)
def geo2_arc(spark, sf):
    """Cells within 15 km of a line for each customer: distance across the track or to an end."""
    k = F.col("c_custkey")
    x, y = F.lit(5.31) + (k % 31) * F.lit(0.117), F.lit(47.23) + (k % 23) * F.lit(0.131)
    line = F.array(F.struct(x.alias("x"), y.alias("y")), F.struct((x + 0.71).alias("x"), (y + 0.43).alias("y")))
    rows = dealt(read(spark, sf, "customer").select("c_custkey"), "c_custkey").select("c_custkey", F.array(line).alias("shape"))
    return cover.near_cells(cover.edges(rows, ["c_custkey"], "shape"), ["c_custkey"], FINE, 15.0).select("c_custkey", "iy", "ix")


def _shapes(spark, sf):
    """A square with a triangular hole for each customer, at whole and half degrees."""
    x, y = (F.col("c_custkey") % 50).cast("double"), (F.col("c_custkey") % 30).cast("double")
    corner = lambda a, b: F.struct((x + a).alias("x"), (y + b).alias("y"))
    rings = F.array(F.array(corner(0, 0), corner(4.5, 0), corner(4.5, 4), corner(0, 4)), F.array(corner(1, 1), corner(2, 1.25), corner(1.5, 2)))
    return read(spark, sf, "customer").select("c_custkey", rings.alias("shape"))


_SUMS = "SELECT c_custkey, 2 AS n_rings, 7 AS n_points, 7.0::DOUBLE * (c_custkey % 50) + 13.5::DOUBLE AS sx, 7.0::DOUBLE * (c_custkey % 30) + 12.25::DOUBLE AS sy FROM customer"


def _summed(df) -> DataFrame:
    points = F.flatten("rings")
    total = lambda k: F.aggregate(points, F.lit(0.0), lambda a, p: a + p[k])
    return df.select("c_custkey", F.size("rings").alias("n_rings"), F.size(points).alias("n_points"), total("x").alias("sx"), total("y").alias("sy"))


@query("src7_wkb_areas", _SUMS)
def src7_wkb(spark, sf):
    """Shapes through well-known binary: even ones with the most significant byte first, with a system's number."""
    shapes = _shapes(spark, sf)
    big, small = to_wkb(shapes.where("c_custkey % 2 = 0"), "shape", big=True, srid=4326), to_wkb(shapes.where("c_custkey % 2 = 1"), "shape")
    return _summed(from_wkb(big.unionByName(small).drop("shape"), "wkb"))


@query("src7_geojson_areas", _SUMS)
def src7_geojson(spark, sf):
    """Shapes through GeoJSON, every third as a feature."""
    pairs = F.to_json(F.transform("shape", lambda r: F.transform(r, lambda p: F.array(p["x"], p["y"]))))
    geometry = F.concat(F.lit('{"type":"Polygon","coordinates":'), pairs, F.lit("}"))
    text = F.when(F.col("c_custkey") % 3 == 0, F.concat(F.lit('{"type":"Feature","properties":{"a":1},"geometry":'), geometry, F.lit("}"))).otherwise(geometry)
    return _summed(from_geojson(_shapes(spark, sf).select("c_custkey", text.alias("json")), "json"))
