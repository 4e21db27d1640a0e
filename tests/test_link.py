"""Rules of linking on hand-built cubes."""

import datetime

import pytest
from pyspark.sql import functions as F

from geolink.functions import dates as D
from geolink.functions import ids as I
from geolink.functions.geometry import RINGS, contains, normal_lon
from geolink.operators import cover as V
from geolink.operators import gridlink as R
from geolink.operators import merge as M
from geolink.plans import api
from geolink.sources import catalogue as C
from geolink.sources.cube import Request, extent, ingest, scan
from geolink.sources.grid import Grid, target_grid
from geolink.sources.stash import Stash, request_key

G = Grid(0.0, 2.0, 1.0, 1.0, 2, 2)
IND = "2m_temperature"


def cube(spark, rows):
    return ingest(spark.createDataFrame(rows, "obs_date string, ix int, iy int, value double"))


def obs(spark, rows):
    return spark.createDataFrame(rows, "id long, date string, lon double, lat double")


def linked(df):
    return {r["id"]: r["linked"] for r in df.collect()}


def test_span_skips_null_and_nan_and_crosses_years(spark):
    q = cube(spark, [("1998-12-31", 0, 0, 1.0), ("1999-01-01", 0, 0, float("nan")), ("1999-01-02", 0, 0, 3.0), ("1999-01-03", 0, 0, None)])
    out = api.link_daily(obs(spark, [(1, "1999-01-03", 0.5, 1.5)]), q, G, IND, time_span=3)
    assert linked(out) == {1: 2.0}


def test_unmatched_and_outside_rows_stay(spark):
    q = cube(spark, [("1999-01-01", 0, 0, 1.0)])
    out = api.link_daily(obs(spark, [(1, "1999-01-01", 0.5, 1.5), (2, "1999-01-02", 0.5, 1.5), (3, "1999-01-01", 9.0, 9.0), (4, None, 0.5, 1.5)]), q, G, IND)
    assert linked(out) == {1: 1.0, 2: None, 3: None, 4: None}
    assert out.columns == ["id", "date", "lon", "lat", "linked"]


def test_cells_are_half_open(spark):
    q = cube(spark, [("1999-01-01", 0, 0, 1.0), ("1999-01-01", 1, 0, 2.0), ("1999-01-01", 1, 1, 4.0)])
    out = api.link_daily(obs(spark, [(1, "1999-01-01", 1.0, 1.5), (2, "1999-01-01", 1.0, 1.0), (3, "1999-01-01", 2.0, 1.5)]), q, G, IND)
    assert linked(out) == {1: 2.0, 2: 4.0, 3: None}


def test_mean_over_time_then_space(spark):
    rings = [[{"x": 0.0, "y": 1.0}, {"x": 2.0, "y": 1.0}, {"x": 2.0, "y": 2.0}, {"x": 0.0, "y": 2.0}]]
    q = cube(spark, [("1999-01-01", 0, 0, 1.0), ("1999-01-02", 0, 0, 3.0), ("1999-01-02", 1, 0, 10.0)])
    areas = spark.createDataFrame([(1, "1999-01-02", rings)], f"id long, date string, rings {RINGS}")
    assert linked(api.link_daily(areas, q, G, IND, rings="rings", time_span=1)) == {1: 6.0}


def test_polygon_hole_and_sliver(spark):
    box = [[(0.0, 0.0), (4.0, 0.0), (4.0, 4.0), (0.0, 4.0)], [(1.0, 1.0), (3.0, 1.0), (3.0, 3.0), (1.0, 3.0)]]
    df = spark.createDataFrame([([[{"x": x, "y": y} for x, y in r] for r in box],)], f"rings {RINGS}")
    at = lambda x, y: df.select(contains(F.col("rings"), F.lit(x), F.lit(y))).first()[0]
    assert at(0.5, 0.5) and not at(2.0, 2.0) and not at(5.0, 2.0)
    sliver = spark.createDataFrame([(1, [[{"x": 0.1, "y": 1.1}, {"x": 0.2, "y": 1.1}, {"x": 0.2, "y": 1.2}]])], f"p int, shape {RINGS}")
    assert [tuple(c) for c in V.covered_cells(V.polygon_runs(sliver, ["p"], G), ["p"]).collect()] == [(1, 0, 0)]


def test_buffer_zero_is_the_cell_and_small_falls_back(spark):
    q = cube(spark, [("1999-01-01", 0, 0, 5.0), ("1999-01-01", 1, 0, 7.0)])
    points = obs(spark, [(1, "1999-01-01", 0.9, 1.9)])
    for km in (0.0, 1.0):
        assert linked(api.link_daily(points, q, G, IND, buffer_km=km)) == {1: 5.0}
    assert linked(api.link_daily(points, q, G, IND, buffer_km=100.0)) == {1: 6.0}


def test_baseline_leap_day_and_deviation(spark):
    q = cube(spark, [("2000-02-29", 0, 0, 9.0), ("1996-02-29", 0, 0, 1.0), ("1997-03-01", 0, 0, 100.0)])
    out = api.link_daily(obs(spark, [(1, "2000-02-29", 0.5, 1.5)]), q, G, IND, baseline=(1995, 1997)).first()
    assert (out["linked"], out["baseline"], out["deviation"]) == (9.0, 1.0, 8.0)
    none = api.link_daily(obs(spark, [(1, "2000-02-29", 0.5, 1.5)]), q, G, IND, baseline=(1997, 1997)).first()
    assert none["baseline"] is None and none["deviation"] is None


def test_monthly_takes_any_day_of_the_month(spark):
    q = cube(spark, [("2014-07-01", 0, 0, 1.0), ("2014-08-01", 0, 0, 3.0)])
    points = obs(spark, [(1, "2014-08-17", 0.5, 1.5)])
    assert linked(api.link_monthly(points, q, G, IND)) == {1: 3.0}
    assert linked(api.link_monthly(points, q, G, IND, time_lag=1)) == {1: 1.0}
    assert linked(api.link_monthly(points, q, G, IND, time_span=1)) == {1: 2.0}


def test_negative_lag_looks_ahead_and_rows_get_ids(spark):
    q = cube(spark, [("1999-01-02", 0, 0, 4.0)])
    out = api.link_daily(obs(spark, [(1, "1999-01-01", 0.5, 1.5), (1, "1999-01-01", 0.5, 1.5)]), q, G, IND, time_lag=-1)
    assert [r["linked"] for r in out.collect()] == [4.0, 4.0] and "_obs_id" not in out.columns


def test_golden_span_algebra(spark):
    q = cube(spark, [("2014-08-01", 0, 0, 290.51), ("2014-08-02", 0, 0, 292.51)])
    out = api.link_daily(obs(spark, [(1, "2014-08-02", 0.5, 1.5)]), q, G, IND, time_span=1)
    assert linked(out)[1] == pytest.approx(291.51)


def test_validation():
    for bad in (dict(time_span=-1), dict(baseline=(2000,)), dict(baseline=(2001, 2000)), dict(statistic="median"), dict(time_zone="utc+15:00"), dict(by_hour="25:00"), dict(buffer_km=-1)):
        with pytest.raises(ValueError):
            api.LinkSpec.of("daily", IND, C.DAILY[0], **bad)
    with pytest.raises(ValueError):
        api.LinkSpec.of("daily", IND, C.MONTHLY[0])
    with pytest.raises(ValueError):
        api.LinkSpec.of("daily", "k_index", C.DAILY[0])
    assert C.check_baseline(("1995", "1996")) == (1995, 1996)
    assert (len(C.HOURS), len(C.ZONES), C.ZONES[0], C.ZONES[-1]) == (24, 27, "utc-12:00", "utc+14:00")


def test_missing_column_and_mixed_grid_dates(spark):
    with pytest.raises(ValueError):
        api.link_daily(spark.range(1), cube(spark, []), G, IND)
    t = target_grid(spark, G).withColumn("date", F.when(F.col("tx") == 0, "1999-01-01").otherwise("1999-01-02"))
    with pytest.raises(ValueError):
        api.link_daily_grid(t, cube(spark, []), G, IND)


def test_empty_observations(spark):
    assert api.link_daily(obs(spark, []), cube(spark, []), G, IND, time_span=2, baseline=(1995, 1996)).collect() == []


def test_near_resample_onto_itself_is_identity_and_bilinear_renormalises(spark):
    layer = spark.createDataFrame([(0, 0, 1.0), (1, 0, 2.0), (0, 1, None), (1, 1, 4.0)], "ix int, iy int, value double")
    same = {(r.tx, r.ty): r.linked for r in R.resample(target_grid(spark, G), layer, G, "near").collect()}
    assert same == {(0, 0): 1.0, (1, 0): 2.0, (0, 1): None, (1, 1): 4.0}
    middle = spark.createDataFrame([(0, 0, 1.0, 1.0), (1, 0, 9.0, 9.0)], "tx int, ty int, lon double, lat double")
    got = {r.tx: r.linked for r in R.resample(middle, layer, G, "bilinear").collect()}
    assert got[0] == pytest.approx(7 / 3) and got[1] is None
    flat = layer.withColumn("value", F.lit(5.0))
    assert R.resample(middle.where("tx = 0"), flat, G, "cubic").first()["linked"] == pytest.approx(5.0)
    with pytest.raises(ValueError):
        R.resample(middle, layer, G, "spline")


def test_left_merge_first_left_last_right_and_null_keys(spark):
    x = spark.createDataFrame([(1, "a", 0), (2, "a", 0), (3, None, 0), (4, "b", 0)], "o int, k string, v int")
    y = spark.createDataFrame([(1, "a", 10), (2, "a", 20), (3, None, 30)], "p int, j string, v int")
    got = {r.o: r.v for r in M.left_merge(x, y, "k", "j", "o", "p").collect()}
    assert got == {1: 20, 2: None, 3: 30, 4: None}


def test_id_types(spark):
    guess = lambda *s: I.guess_id_type(spark.createDataFrame([(x,) for x in s], "id string"), "id")
    assert guess("CRS3035RES1000mN2690000E4341000") == "long_inspire" and guess("1kmN2690E4341") == "short_inspire"
    with pytest.raises(ValueError):
        guess("DE1", None)
    ags = spark.createDataFrame([(x,) for x in ("01", "01001", "01002", "02000000", "11000000", "00000000")], "id string")
    assert {r.id: r.level for r in I.parse_ags(ags, "id").collect()} == {"01": "lan", "01001": "krs", "01002": "krs", "02000000": "gem", "11000000": "gem", "00000000": "sta"}
    gadm = spark.createDataFrame([("DEU.1.2.3_1",), ("DEU.1_",), ("x",)], "id string").select(I.gadm_level(F.col("id"))).collect()
    assert [r[0] for r in gadm] == [3, None, None]


def test_dates(spark):
    df = spark.createDataFrame([(1, None), (2, "07/08/2014"), (3, "31/12/2014"), (4, "12/31/2014")], "k int, s string")
    got = {r.k: r.date for r in D.parse_date_column(df, "s", "k").collect()}
    assert got == {1: None, 2: datetime.date(2014, 7, 8), 3: None, 4: datetime.date(2014, 12, 31)}
    with pytest.raises(ValueError):
        D.date_format_of(spark.createDataFrame([(1, "soon")], "k int, s string"), "s", "k")
    with pytest.raises(ValueError):
        D.span_dates(F.col("d"), -1)
    assert spark.range(1).select(normal_lon(F.lit(190.0))).first()[0] == -170.0


def test_stash(spark, tmp_path):
    s = Stash(spark, f"file://{tmp_path}", "svc")
    for n in "abc":
        spark.range(1).write.parquet(f"file://{tmp_path}/{n}")
        assert s.store(f"file://{tmp_path}/{n}", {n: "test", "target": n}) == request_key({n: "test"}, "svc")
    assert s.restore({"a": "test"}) == f"file://{tmp_path}/a" and s.restore({"z": 1}) is None
    s.pop()
    assert s.get().count() == 2 and s.restore({"c": "test"}) is None
    import shutil

    shutil.rmtree(tmp_path / "a")
    s.clean()
    assert s.get().count() == 1
    s.destroy()
    assert s.get().count() == 0


def test_request_scan_and_extent(spark):
    q = cube(spark, [("1999-01-01", 0, 0, 1.0), ("1999-02-01", 1, 1, 2.0), ("2000-01-01", 0, 0, 3.0)])
    assert {r.value for r in scan(q, Request(years=(1999,), months=(1, 2), days=(1,), extent=(2.0, 0.0, 1.5, 0.9)), G).collect()} == {1.0}
    assert tuple(extent(obs(spark, [(1, "x", 0.2, 1.2), (2, "x", 1.7, 0.4)])).first()) == (2.0, 0.0, 0.0, 2.0)


def test_plans_have_no_cross_join_and_no_python(spark, sf):
    from geolink.plans.queries import QUERIES

    for name in ("flagship_link", "jn1_point_link", "jn3_span_link", "jn6_buffer_link", "jn5_polygon_link", "grd2_bilinear", "jn7_left_merge"):
        df = QUERIES[name](spark, sf)
        plan = df._jdf.queryExecution().executedPlan().toString()
        assert not any(x in plan for x in ("CartesianProduct", "BroadcastNestedLoopJoin", "Python", "ArrowEval")), name


def test_daily_statistics_stream(spark, tmp_path):
    from geolink.streaming.stream_link import daily_statistics_stream

    rows = [(f"2024-01-0{d} {h:02d}:00:00", 0, 0, float(h)) for d in (1, 2, 5) for h in (1, 3)]
    spark.createDataFrame(rows, "ts string, ix int, iy int, value double").withColumn("ts", F.to_timestamp("ts")).write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema("ts timestamp, ix int, iy int, value double").parquet(f"{tmp_path}/in")
    run = daily_statistics_stream(stream).writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {str(r.obs_date): (r["mean"], r.maximum, r.minimum) for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    assert got == {"2024-01-01": (2.0, 3.0, 1.0), "2024-01-02": (2.0, 3.0, 1.0)}


def test_projection_meets_the_published_example(spark):
    from geolink.functions.geometry import from_laea, to_laea

    east, north = to_laea(F.lit(5.0), F.lit(50.0))
    row = spark.range(1).select(east.alias("e"), north.alias("n"), *[c.alias(k) for k, c in zip(("lon", "lat"), from_laea(F.lit(3962799.45), F.lit(2999718.85)), strict=True)]).first()
    assert (row.e, row.n) == (pytest.approx(3962799.45, abs=0.01), pytest.approx(2999718.85, abs=0.01))
    assert (row.lon, row.lat) == (pytest.approx(5.0, abs=1e-7), pytest.approx(50.0, abs=1e-7))


def test_conditions_reach_the_cubes_scan(spark, tmp_path):
    from geolink.sources.cube import write_cube

    big = Grid(0.0, 64.0, 1.0, 1.0, 64, 64)
    rows = spark.range(64 * 64 * 6).select(F.expr("date_add(date'1998-07-01', cast(id % 6 as int) * 40)").alias("obs_date"), F.expr("cast(id div 6 % 64 as int)").alias("ix"), F.expr("cast(id div 384 as int)").alias("iy"), F.rand(1).alias("value"))
    write_cube(ingest(rows), f"{tmp_path}/cube")
    points = obs(spark, [(1, "1998-07-01", 3.5, 60.5), (2, "1998-08-10", 4.5, 61.5)])
    out = api.link_daily(points, spark.read.parquet(f"{tmp_path}/cube"), big, IND, time_span=2, baseline=(1998, 1999))
    spark.conf.set("spark.sql.maxMetadataStringLength", "2000")
    scans = [line for line in out._jdf.queryExecution().executedPlan().toString().split("\n") if "FileScan parquet" in line]
    assert scans and all("GreaterThanOrEqual(ix" in x and "LessThanOrEqual(iy" in x and "In(md" in x and "PartitionFilters: [" in x for x in scans)
    assert any("GreaterThanOrEqual(obs_date" in x for x in scans)
    assert out.where("linked is not null and baseline is not null").count() == 2


def test_days_before_a_span():
    assert api._days_before({"03-01"}, 1) == {"03-01", "02-28", "02-29"} and api._days_before({"01-01"}, 400) is None
    assert api._days_before({"02-29"}, 0) == {"02-29"}


def test_ids_grain_and_edges_keep_rows(spark):
    q = cube(spark, [("1999-01-01", 0, 0, 1.0), ("1999-01-01", 0, 0, 3.0), ("1999-01-20", 0, 0, 8.0)])
    points = obs(spark, [(None, "1999-01-01", 0.5, 1.5), (None, "1999-01-20", 0.5, 1.5), (1, "1999-01-01", 0.5, 1.5), (1, "1999-01-20", 0.5, 1.5), (2, "1999-01-20", None, 1.5)])
    daily = sorted((str(r.date), r.linked) for r in api.link_daily(points, q, G, IND, time_span=0).collect() if r.lon)
    assert daily == [("1999-01-01", 2.0)] * 2 + [("1999-01-20", 8.0)] * 2
    monthly = api.link_monthly(points, q, G, IND).collect()
    assert len(monthly) == 5 and {r.linked for r in monthly if r.lon} == {4.0}
    east = obs(spark, [(1, "1999-01-01", 360.5, 1.5)])
    assert linked(api.link_daily(east, q, G, IND, buffer_km=1.0)) == {1: 2.0}


def test_two_writers_lose_no_entry(spark, tmp_path):
    one, two = (Stash(spark, f"file://{tmp_path}", "svc") for _ in range(2))
    one.store("p1", {"a": 'with "quotes" \\ and é'})
    two.store("p2", {"b": 1})
    assert one.get().count() == 2
    from geolink.sources.stash import key_column

    key = spark.range(1).select(key_column({"a": F.lit('with "quotes" \\ and é'), "service": F.lit("svc")})).first()[0]
    assert key == request_key({"a": 'with "quotes" \\ and é'}, "svc")


def test_library_without_the_training_operators(tmp_path):
    import shutil
    import subprocess
    import sys
    from pathlib import Path

    root = Path(__file__).resolve().parent.parent
    shutil.copytree(root / "geolink", tmp_path / "geolink", ignore=shutil.ignore_patterns("llm", "__pycache__"))
    for name in ("__spark_entry__.py", "corpus_pipeline.py"):
        if (root / name).exists():
            shutil.copy(root / name, tmp_path)
    code = "import __spark_entry__ as e; assert set(e.oracle_sql()) <= set(e.queries()) and 'flagship_link' in e.queries() and 'pipeline' not in e.queries()"
    subprocess.run([sys.executable, "-c", code], cwd=tmp_path, check=True)
