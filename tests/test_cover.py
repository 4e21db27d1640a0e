"""Covers of points and polygons, bad coordinates, clashing names, stamps and options."""

import math
import time

import pytest
from pyspark.sql import functions as F

from geolink.functions.geometry import RINGS, arc, arc_km, haversine_km
from geolink.operators import cover
from geolink.plans import api
from geolink.sources.cube import ingest
from geolink.sources.grid import Grid

GLOBE = Grid(-180.0, 90.0, 1.0, 1.0, 360, 180)
SMALL = Grid(0.0, 2.0, 1.0, 1.0, 2, 2)
IND = "2m_temperature"


def shapes(spark, **rings):
    rows = [(k, None if v is None else [[{"x": None if x is None else float(x), "y": float(y)} for x, y in r] for r in v]) for k, v in rings.items()]
    return spark.createDataFrame(rows, f"p string, shape {RINGS}")


def cells(spark, grid=GLOBE, km=0.0, **rings):
    out = {k: set() for k in rings}
    got = cover.covered_cells(cover.polygon_runs(shapes(spark, **rings), ["p"], grid, km), ["p"]).collect()
    for r in got:
        assert (r.ix, r.iy) not in out[r.p]
        out[r.p].add((r.ix, r.iy))
    return out


def cube(spark, rows, ddl="obs_date string, ix int, iy int, value double"):
    return ingest(spark.createDataFrame(rows, ddl))


def points(spark, rows):
    return spark.createDataFrame(rows, "id long, date string, lon double, lat double")


def box(x0, y0, x1, y1):
    return [(x0, y0), (x1, y0), (x1, y1), (x0, y1)]


def test_polygons_on_the_globe(spark):
    nan = float("nan")
    got = cells(
        spark, line=[box(179, 0, -179, 2)], hole=[box(170, 0, -170, 10), box(178, 3, -178, 6)], parts=[box(170, 0, 180, 10), box(-180, 0, -175, 10)], world=[box(-180, -90, 180, 90)],
        south=[[(x, -70) for x in range(-180, 180, 10)]], north=[[(x, 80) for x in range(170, -190, -10)]], sliver=[[(179.9, 0.1), (-179.9, 0.1), (-179.9, 0.2)]], edge=[box(-180, 0, -178, 1)],
        none=None, empty=[], hollow=[[]], bad=[[(0, 0), (nan, 1), (1, 1)]], nulls=[[(0, 0), (None, 1), (1, 1)]], beyond=[[(0, 0), (1, 95), (1, 1)]], dot=[[(3.5, 3.5)]],
    )
    assert got["line"] == {(359, 88), (359, 89), (0, 88), (0, 89)}
    assert len(got["hole"]) == 200 - 12 and (350, 85) in got["hole"] and (9, 85) in got["hole"] and (358, 85) not in got["hole"] and (0, 85) not in got["hole"]
    assert len(got["parts"]) == 150 and len(got["world"]) == 64_800
    assert got["south"] == {(i, j) for i in range(360) for j in range(160, 180)} and got["north"] == {(i, j) for i in range(360) for j in range(10)}
    assert got["sliver"] == {(0, 89)} and got["edge"] == {(0, 89), (1, 89)} and got["dot"] == {(183, 86)}
    assert not any(got[k] for k in ("none", "empty", "hollow", "bad", "nulls", "beyond"))


def test_names_of_longitudes_do_not_matter(spark):
    east = Grid(0.0, 90.0, 1.0, 1.0, 360, 180)
    a, b = (cells(spark, grid=g, line=[box(179, 0, -179, 2)], back=[box(-5, 40, 5, 45)], cap=[[(x, 80) for x in range(-180, 180, 10)]]) for g in (GLOBE, east))
    for k in a:
        assert {((i + 180) % 360, j) for i, j in a[k]} == b[k]


def test_cover_equals_even_odd_cell_by_cell(spark):
    ring = [(5 + 4 * math.cos(k) * (0.3 + k % 7 / 7), 5 + 4 * math.sin(k) * (0.3 + k % 5 / 5)) for k in range(60)]
    grid = Grid(0.0, 10.0, 0.25, 0.25, 40, 40)
    inside = set()
    for i in range(40):
        for j in range(40):
            x, y = (i + 0.5) * 0.25, 10 - (j + 0.5) * 0.25
            crossings = sum((ay > y) != (by > y) and x < (bx - ax) * (y - ay) / (by - ay) + ax for (ax, ay), (bx, by) in zip(ring, ring[1:] + ring[:1], strict=True))
            if crossings % 2:
                inside.add((i, j))
    assert cells(spark, grid=grid, star=[ring])["star"] == inside


def test_work_grows_with_vertices_not_with_cells(spark):
    grid, took = Grid(0.0, 10.0, 0.1, 0.1, 100, 100), {}
    for n in (500, 2_000, 32_000):
        ring = [(5 + 4.7 * math.cos(2 * math.pi * k / n), 5 + 4.7 * math.sin(2 * math.pi * k / n)) for k in range(n)]
        df = shapes(spark, p=[ring]).repartition(1).cache()
        df.count()
        began = time.perf_counter()
        assert cover.polygon_runs(df, ["p"], grid).where("not own").agg(F.sum(F.expr("i1 - i0 + 1"))).first()[0] == pytest.approx(6940, rel=0.01)
        took[n] = time.perf_counter() - began
    assert took[32_000] < took[500] + 5


def test_the_middle_of_a_polygon_may_lie_outside_the_grid(spark):
    df = shapes(spark, half=[box(0.2, 0.2, 4.4, 1.8)], off=[box(-5.4, 7.2, -5.2, 7.4)])
    runs = {(r.p, r.iy, r.i0, r.i1, r.own) for r in cover.polygon_runs(df, ["p"], SMALL).collect()}
    assert runs == {("half", 0, 0, 1, False), ("half", 1, 0, 1, False), ("half", 1, 2, 2, True), ("off", -6, -6, -6, True)}
    areas = df.withColumns({"date": F.lit("1999-01-01")})
    q = cube(spark, [("1999-01-01", i, j, float(10 * i + j)) for i in range(2) for j in range(2)])
    assert {r.p: r.linked for r in api.link_daily(areas, q, SMALL, IND, rings="shape").collect()} == {"half": 5.5, "off": None}


def test_derived_polygons_spread_over_tasks(spark, tmp_path):
    """One small file isn't one task, and a polygon's formula is computed once for edges, crossings and middle each."""
    from geolink.plans.area_queries import FINE, customer_areas

    spark.range(5_000).select(F.col("id").alias("c_custkey")).coalesce(1).write.parquet(f"{tmp_path}/customer.parquet")
    areas = customer_areas(spark, str(tmp_path))
    assert areas.rdd.getNumPartitions() == 3
    plan = cover.polygon_runs(areas, ["c_custkey"], FINE)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("COS(") == 3 * 3  # star, star and hole


def test_cells_of_arcs_are_told_apart_beside_their_line(spark, sf):
    """Lines are shuffled, dealt by key before they become cells; no shuffle carries cells."""
    from geolink.plans.area_queries import geo2_arc

    plan = geo2_arc(spark, sf)._jdf.queryExecution().executedPlan().toString()
    dealt = [line for line in plan.splitlines() if "Exchange" in line]
    assert len(dealt) == 1 and "REPARTITION_BY_NUM" in dealt[0] and "iy" not in dealt[0]


def test_buffers_of_polygons_follow_the_sphere(spark):
    got = cells(spark, km=120.0, line=[box(179, 0, -179, 2)], polar=[[(-60, 88.5), (0, 88.5), (120, 88.5)]])
    assert len(got["line"]) == 16 and (358, 90) in got["line"]
    assert len({i for i, j in got["polar"] if j == 0}) == 360
    at = [F.lit(v) for v in (0.0, 60.0, 90.0, 60.0)]
    # half way, the arc is far north of the parallel of its ends
    km = spark.range(1).select(arc_km(arc(*at), *at, F.lit(45.0), F.lit(67.7923457)), arc_km(arc(*at), *at, F.lit(45.0), F.lit(60.0)), arc_km(arc(*at), *at, F.lit(-10.0), F.lit(60.0)), haversine_km(*[F.lit(v) for v in (0.0, 60.0, -10.0, 60.0)])).first()
    assert km[0] < 0.01 and km[1] == pytest.approx(866.4, abs=1) and km[2] == km[3]


def test_point_runs_equal_distances(spark):
    places = [(0.2, 51.7), (-179.6, 10.0), (179.9, -3.2), (12.0, 89.2), (700.3, -88.0), (3.0, 0.0)]
    df = spark.createDataFrame([(k, x, y) for k, (x, y) in enumerate(places)], "k int, x double, y double")
    for km in (0.5, 80.0, 300.0, 2_000.0):
        got = {}
        for r in cover.covered_cells(cover.point_runs(df, ["k"], GLOBE, km), ["k"]).collect():
            got.setdefault(r.k, set()).add((r.ix, r.iy))
        for k, (x, y) in enumerate(places):
            near = set()
            for i in range(360):
                for j in range(180):
                    cx, cy = math.radians(-179.5 + i), math.radians(89.5 - j)
                    a = math.sin((cy - math.radians(y)) / 2) ** 2 + math.cos(cy) * math.cos(math.radians(y)) * math.sin((cx - math.radians(x)) / 2) ** 2
                    if 2 * 6371.0088 * math.asin(min(1, math.sqrt(a))) <= km:
                        near.add((i, j))
            assert got[k] == (near or {(int((x + 180) % 360), int(90 - y))}), (km, k)


def test_bad_coordinates_link_with_nothing(spark):
    nan, inf = float("nan"), float("inf")
    q = cube(spark, [("1999-01-01", 0, 0, 7.0)])
    rows = [(1, "1999-01-01", 0.5, 1.5), (2, "1999-01-01", nan, 1.5), (3, "1999-01-01", inf, 1.5), (4, "1999-01-01", 0.5, -1e12), (5, "1999-01-01", 0.5, nan), (6, "1999-01-01", None, None), (7, "1999-01-01", 0.5, -inf)]
    for km in (0.0, 50.0):
        out = api.link_daily(points(spark, rows), q, SMALL, IND, buffer_km=km, baseline=(1999, 1999)).collect()
        assert {r.id: r.linked for r in out} == {1: 7.0, 2: None, 3: None, 4: None, 5: None, 6: None, 7: None}
    alone = api.link_daily(points(spark, rows[1:2]), q, SMALL, IND).collect()
    assert len(alone) == 1 and alone[0].linked is None


def test_names_of_columns_do_not_matter(spark):
    names = ("_x", "_y", "_d", "_c", "_k0", "_shape", "row", "date", "ix", "iy", "link_date", "x", "y", "p", "q", "own", "cell", "a.b")
    obs = points(spark, [(1, "1999-01-01", 0.5, 1.5)]).withColumnsRenamed({"date": "when"}).select("*", *[F.lit(n).alias(n) for n in names], F.lit(5.0).alias("linked"))
    q = cube(spark, [("1999-01-01", 0, 0, 7.0)])
    for options in ({}, {"buffer_km": 20.0, "time_span": 2}):
        out = api.link_daily(obs, q, SMALL, IND, date_var="when", **options)
        row = out.first()
        assert out.columns == ["id", "when", "lon", "lat", *names, "linked"] and row.linked == 7.0 and all(row[n] == n for n in names)


def test_stamps_and_options_that_need_hours(spark):
    single = "reanalysis-era5-single-levels-monthly-means"
    q = cube(spark, [("2014-07-31", 0, 0, 8.0), ("2014-08-31", 0, 0, 9.0), ("2013-07-31", 0, 0, 4.0)])
    august = points(spark, [(1, "2014-08-17", 0.5, 1.5)])
    value = lambda **o: api.link_monthly(august, q, SMALL, o.pop("indicator", IND), catalogue=single, **o).first()
    assert value(indicator="total_precipitation").linked == 8.0 and value(indicator="k_index").linked == 9.0 and value().linked == 9.0
    assert value(stamp="last_of_previous").linked == 8.0 and value(indicator="total_precipitation", stamp="last").linked == 9.0
    assert value(indicator="total_precipitation", baseline=(2013, 2013)).baseline == 4.0
    snow = cube(spark, [("2014-09-01", 0, 0, 3.0), ("2014-08-01", 0, 0, 2.0)])
    assert api.link_monthly(august, snow, SMALL, "snow_cover").first().linked == 3.0
    for call, bad in ((api.link_monthly, {"by_hour": "13:00"}), (api.link_daily, {"statistic": "daily_maximum"}), (api.link_daily, {"time_zone": "utc+02:00"}), (api.link_monthly, {"stamp": "never"})):
        with pytest.raises(ValueError):
            call(august, q, SMALL, IND, **bad)
    both = cube(spark, [("2014-08-17", 0, 0, 1.0)]).withColumn("statistic", F.lit("daily_mean")).unionByName(cube(spark, [("2014-08-17", 0, 0, 5.0)]).withColumn("statistic", F.lit("daily_maximum")))
    assert api.link_daily(august, both, SMALL, IND, statistic="daily_maximum").first().linked == 5.0 and api.link_daily(august, both, SMALL, IND).first().linked == 1.0


def test_a_run_asks_for_two_rows(spark, sf):
    """A buffer's plan has no table of (date, place, cell): the ends of runs are what is joined."""
    grid = Grid(5.0, 51.0, 0.1, 0.1, 50, 40)
    obs = spark.range(300).select("id", F.lit("1999-01-01").alias("date"), (F.lit(6.0) + F.col("id") % 20 * 0.1).alias("lon"), (F.lit(48.0) + F.col("id") % 17 * 0.1).alias("lat"))
    at = obs.select(F.col("lon").alias("x"), F.col("lat").alias("y")).distinct()
    runs = cover.point_runs(at, ["x", "y"], grid, 90.0)
    ends, each = 2 * runs.count(), cover.covered_cells(runs, ["x", "y"]).count()
    assert each > 5 * ends
    q = ingest(spark.range(2000).select(F.lit("1999-01-01").alias("obs_date"), (F.col("id") % 50).cast("int").alias("ix"), F.expr("cast(id div 50 as int)").alias("iy"), F.col("id").cast("double").alias("value")))
    got = {r.id: r.linked for r in api.link_daily(obs, q, grid, IND, buffer_km=90.0).collect()}
    value = {(i, j): float(j * 50 + i) for i in range(50) for j in range(40)}
    want = {}
    for r in cover.covered_cells(runs, ["x", "y"]).collect():
        want.setdefault((r.x, r.y), []).append(value[r.ix, r.iy])
    for r in obs.collect():
        assert got[r.id] == pytest.approx(sum(want[r.lon, r.lat]) / len(want[r.lon, r.lat]), abs=1e-9)


def test_pairs_are_dealt_before_they_are_gathered(spark):
    """No task gathers the pairs of a whole split: both aggregates by (date, place) come after their shuffle."""
    obs = spark.range(40).select("id", F.lit("1999-01-01").alias("date"), (F.col("id") % 4 * 0.5).alias("lon"), (F.col("id") % 3 * 0.5).alias("lat"))
    q = cube(spark, [("1999-01-01", i, j, float(10 * i + j)) for i in range(2) for j in range(2)])
    out = api.link_daily(obs, q, SMALL, IND, buffer_km=90.0, prune=False)
    plan = out._jdf.queryExecution().executedPlan().toString().splitlines()
    dealt = [k for k, line in enumerate(plan) if "REPARTITION_BY_COL" in line]
    assert len(dealt) >= 2 and all("partial_" not in plan[k + 1] and "Aggregate" not in plan[k + 1] for k in dealt)
    assert out.count() == 40


def test_projections_meet_published_examples(spark):
    from geolink.functions.projections import PolarStereographic, TransverseMercator, projection

    airy = TransverseMercator(6377563.396, 1 / 299.32496, 49.0, -2.0, 0.9996012717, 400_000.0, -100_000.0)
    cases = [(airy, 0.5, 50.5, 577274.99, 69740.50), (projection(32661), 44.0, 73.0, 3320416.75, 632668.43), (projection(3032), 120.0, -75.0, 7255380.79, 7053389.56)]
    assert isinstance(projection(32661), PolarStereographic)
    one = spark.range(1)
    for system, lon, lat, east, north in cases:
        e, n = system.forward(F.lit(lon), F.lit(lat))
        x, y = system.inverse(F.lit(east), F.lit(north))
        r = one.select(e.alias("e"), n.alias("n"), x.alias("x"), y.alias("y")).first()
        assert (r.e, r.n) == (pytest.approx(east, abs=0.01), pytest.approx(north, abs=0.01)) and (r.x, r.y) == (pytest.approx(lon, abs=1e-6), pytest.approx(lat, abs=1e-6))
    # on the central meridian a northing is the meridian's arc
    a, e2 = 6378137.0, (2 - 1 / 298.257223563) / 298.257223563
    arc_m = sum(a * (1 - e2) / (1 - e2 * math.sin(math.radians(47 * (k + 0.5) / 20000)) ** 2) ** 1.5 * math.radians(47 / 20000) for k in range(20000))
    e, n = projection(32633).forward(F.lit(15.0), F.lit(47.0))
    r = one.select(e.alias("e"), n.alias("n")).first()
    assert r.e == pytest.approx(500_000, abs=1e-6) and r.n == pytest.approx(0.9996 * arc_m, abs=0.001)
    south = projection(32733).forward(F.lit(15.0), F.lit(-47.0))[1]
    assert one.select(south.alias("n")).first().n == pytest.approx(10_000_000 - r.n, abs=1e-6)
    for bad in (1, 32600, 32800, 27700):
        with pytest.raises(ValueError):
            projection(bad)


def test_projected_polygons_link(spark):
    from geolink.functions.projections import projection

    grid = Grid(12.0, 50.0, 1.0, 1.0, 4, 4)
    e, n = projection(32633).forward(F.col("x"), F.col("y"))
    corners = spark.createDataFrame([(0, 13.0, 47.0), (1, 15.0, 47.0), (2, 15.0, 48.0), (3, 13.0, 48.0)], "k int, x double, y double")
    ring = [{"x": r.e, "y": r.n} for r in corners.select("k", e.alias("e"), n.alias("n")).orderBy("k").collect()]
    areas = spark.createDataFrame([(1, "1999-01-01", [ring])], f"id long, date string, rings {RINGS}")
    q = cube(spark, [("1999-01-01", i, j, float(10 * i + j)) for i in range(4) for j in range(4)])
    assert api.link_daily(areas, q, grid, IND, rings="rings", crs=32633).first().linked == 17.0


def test_geometry_codec(spark):
    import struct

    from geolink.sources.geometry_codec import from_geojson, from_wkb

    point = lambda o, kind, *v: struct.pack(f"{o}BI", o == "<", kind) + struct.pack(f"{o}{len(v)}d", *v)
    ring = lambda o, *v: struct.pack(f"{o}I", len(v)) + b"".join(struct.pack(f"{o}{len(p)}d", *p) for p in v)
    area = lambda o, kind, *rings: struct.pack(f"{o}BII", o == "<", kind, len(rings)) + b"".join(rings)
    several = struct.pack(">BII", 0, 6, 2) + area("<", 3, ring("<", (0, 0), (1, 0), (1, 1))) + area(">", 1003, ring(">", (5, 5, 9), (6, 5, 9), (6, 6, 9)))
    cases = {
        "point": point("<", 1, 3.0, 4.0), "z": point(">", 1001, 3.0, 4.0, 5.0), "zm": point("<", 0xC0000001, 3.0, 4.0, 5.0, 6.0), "srid": struct.pack("<BII", 1, 0x20000001, 4326) + struct.pack("<2d", 3.0, 4.0),
        "several": several, "void": point("<", 1, float("nan"), float("nan")), "line": struct.pack("<BII", 1, 2, 0), "cut": several[:-3], "none": None, "blank": b"", "noise": b"\x07abc",
    }
    df = spark.createDataFrame(list(cases.items()), "k string, lon binary").withColumn("rings", F.lit(1))
    got = {r.k: r for r in from_wkb(df.withColumnRenamed("lon", "w"), "w").collect()}
    assert all((got[k].lon, got[k].lat, got[k].rings) == (3.0, 4.0, None) for k in ("point", "z", "zm", "srid"))
    assert [[tuple(p) for p in r] for r in got["several"].rings] == [[(0, 0), (1, 0), (1, 1)], [(5, 5), (6, 5), (6, 6)]] and got["void"].rings == []
    assert all(got[k].lon is None and got[k].rings is None for k in ("line", "cut", "none", "blank", "noise"))
    text = {"p": '{"type":"Point","coordinates":[1.5,2]}', "m": '{"type":"Feature","geometry":{"type":"MultiPolygon","coordinates":[[[[0,0],[1,0,7],[1,1]]],[[[2,2],[3,2],[3,3]]]]}}', "bad": "{", "null": None, "line": '{"type":"LineString","coordinates":[[0,0],[1,1]]}'}
    got = {r.k: r for r in from_geojson(spark.createDataFrame(list(text.items()), "k string, j string"), "j").collect()}
    assert (got["p"].lon, got["p"].lat) == (1.5, 2.0) and [[tuple(p) for p in r] for r in got["m"].rings] == [[(0, 0), (1, 0), (1, 1)], [(2, 2), (3, 2), (3, 3)]]
    assert all(got[k].lon is None and got[k].rings is None for k in ("bad", "null", "line"))


def test_line_items_are_dealt_by_cell_before_they_are_averaged(spark, sf, monkeypatch):
    """A task holds its share of the fine cube's groups, not those of a whole split."""
    from geolink.plans import area_queries

    monkeypatch.setattr(area_queries, "FINE_ROWS", 500, raising=False)
    cube, rows = area_queries.fine_cube(spark, sf), spark.read.parquet(f"{sf}/lineitem.parquet").count()
    held = [r["count"] for r in cube.groupBy(F.spark_partition_id()).count().collect()]
    assert len(held) >= rows // 500 and max(held) < 2 * 500
    assert "partial_avg" not in cube._jdf.queryExecution().executedPlan().toString().split("REPARTITION_BY_NUM")[1]
