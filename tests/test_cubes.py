"""Cubes that are written: tiles, running totals, raster files; claims on the stash."""

import datetime
import json
import multiprocessing
import os
import random
import struct
import threading

import numpy as np
import pytest
from pyspark.sql import functions as F

from geolink.operators import extract
from geolink.plans import api
from geolink.sources import netcdf, raster
from geolink.sources.cube import Request, ingest, scan, tile, tile_ranges, write_cube
from geolink.sources.cumulative import accumulate
from geolink.sources.grid import Grid
from geolink.sources.stash import Stash

IND = "2m_temperature"
SMALL = Grid(0.0, 2.0, 1.0, 1.0, 2, 2)


def _rows_read(df) -> int:
    """Rows that a plan's scans hand on, after whole row groups are skipped."""
    df.collect()
    plan = df._jdf.queryExecution().executedPlan()
    leaves = plan.collectLeaves()
    return sum(leaves.apply(i).metrics().apply("numOutputRows").value() for i in range(leaves.size()))


# --- tiles


def test_tiles_keep_neighbours_together(spark):
    got = {(r.ix, r.iy): r.t for r in spark.range(64 * 64 * 4).select((F.col("id") % 128).cast("int").alias("ix"), F.expr("cast(id div 128 as int)").alias("iy")).select("ix", "iy", tile(F.col("ix"), F.col("iy")).alias("t")).collect()}
    for (i, j), t in got.items():
        a, b = i // 32, j // 32
        assert t == sum((a >> k & 1) << 2 * k | (b >> k & 1) << 2 * k + 1 for k in range(8))


def test_tile_ranges():
    assert tile_ranges([]) == () and tile_ranges([5]) == ((5, 5),) and tile_ranges([1, 2, 3, 9, 9, 20]) == ((1, 3), (9, 9), (20, 20))
    assert tile_ranges([1, 5, 100, 104, 9000], 2) == ((1, 104), (9000, 9000))
    pick = random.Random(1)
    tiles = [pick.randrange(10_000) for _ in range(500)]
    ranges = tile_ranges(tiles)
    assert len(ranges) <= 64 and all(any(a <= t <= b for a, b in ranges) for t in tiles)


def test_scattered_points_read_their_own_tiles(spark, tmp_path):
    grid = Grid(0.0, 512.0 / 8, 1.0 / 8, 1.0 / 8, 512, 512)
    rows = spark.range(512 * 512).select(F.lit("1999-01-01").alias("obs_date"), (F.col("id") % 512).cast("int").alias("ix"), F.expr("cast(id div 512 as int)").alias("iy"), F.col("id").cast("double").alias("value"))
    spark.conf.set("parquet.block.row.count.limit", "1024")
    try:
        write_cube(ingest(rows), f"{tmp_path}/c", grid)
    finally:
        spark.conf.unset("parquet.block.row.count.limit")
    q = spark.read.parquet(f"{tmp_path}/c")
    corners = spark.createDataFrame([(1, "1999-01-01", 0.06, 63.9), (2, "1999-01-01", 63.9, 0.06), (3, "1999-01-01", 30.0, 30.0)], "id long, date string, lon double, lat double")
    out = {r.id: r.linked for r in api.link_daily(corners, q, grid, IND).collect()}
    assert out == {1: 0.0, 2: 512.0 * 512 - 1, 3: (512 - 240 - 1 + 1) * 512.0 + 240.0}
    tiles = api._tiles(corners.select(F.col("lon").alias("xmin"), F.col("lon").alias("xmax"), F.col("lat").alias("ymin"), F.col("lat").alias("ymax")), grid, 0.0, 0.0)
    assert len(tiles) == 3
    near = scan(q, Request(tiles=tiles), grid)
    assert near.count() == 3 * 1024
    assert _rows_read(near) <= 16 * 1024 < 512 * 512
    for km in (30.0, 400.0):
        # a buffer's reach is in the tiles
        a, b = ({r.id: r.linked for r in api.link_daily(corners, c, grid, IND, buffer_km=km).collect()} for c in (q, q.drop("tile")))
        assert a == pytest.approx(b)


# --- running totals


def _daily(spark, seed=3, cells=6, days=900):
    pick = random.Random(seed)
    start = datetime.date(1996, 12, 20)
    rows = [(str(start + datetime.timedelta(d)), c % 2, c // 2, float(pick.randrange(100))) for c in range(cells) for d in range(days) if pick.random() < (0.05 if c == 1 else 0.5) and not (c == 2 and 100 < d < 400)]
    return rows, ingest(spark.createDataFrame(rows, "obs_date string, ix int, iy int, value double"))


def test_running_totals_equal_sums(spark):
    rows, q = _daily(spark)
    running = accumulate(q)
    pick = random.Random(4)
    obs = [(k, str(datetime.date(1996, 11, 1) + datetime.timedelta(pick.randrange(1100))), pick.random() * 2.2, pick.random() * 3.2) for k in range(400)]
    grid = Grid(0.0, 3.0, 1.0, 1.0, 2, 3)
    df = spark.createDataFrame(obs, "id long, date string, lon double, lat double")
    for span in (0, 1, 30, 400, 5000):
        got = {r.id: r.linked for r in api.link_daily(df, running, grid, IND, time_span=span).collect()}
        for k, day, x, y in obs:
            end = datetime.date.fromisoformat(day)
            start = end - datetime.timedelta(span)
            own = [v for d, i, j, v in rows if (i, j) == (int(x), 2 - int(y) if y < 3 else -1) and x < 2 and str(start) <= d <= day and y > 0 and 3 - y >= 0]
            own = [v for d, i, j, v in rows if x < 2 and y < 3 and (i, j) == (int(x), int(3 - y)) and str(start) <= d <= day]
            assert got[k] == (sum(own) / len(own) if own else None), (span, k)
    both = api.link_daily(df, running, grid, IND, time_span=9, baseline=(1997, 1998)).select("id", "baseline")
    plain = api.link_daily(df, q, grid, IND, time_span=9, baseline=(1997, 1998)).select("id", "baseline")
    assert sorted(map(tuple, both.collect()), key=str) == sorted(map(tuple, plain.collect()), key=str)
    with pytest.raises(ValueError):
        api.link_monthly(df, running, grid, IND)


def test_baselines_from_running_totals(spark):
    """Ends on and round 29 February and New Year, spans up to and beyond a year, a cell with gaps and one without values."""
    pick = random.Random(12)
    start = datetime.date(1995, 6, 10)
    rows = [(str(start + datetime.timedelta(d)), c, 0, float(pick.randrange(100))) for c in range(2) for d in range(2000) if pick.random() < (0.9, 0.1)[c]]
    q = ingest(spark.createDataFrame(rows, "obs_date string, ix int, iy int, value double"))
    running = accumulate(q)
    days = [f"{y}-{md}" for y in (1990, 1995, 1996, 1997, 2000, 2001, 2004) for md in ("01-01", "01-02", "02-27", "02-28", "03-01", "03-02", "06-15", "12-30", "12-31")] + ["1996-02-29", "2000-02-29", "2004-02-29"]
    keys = spark.createDataFrame([(d, c, 0) for d in days for c in range(3)], "d string, ix int, iy int").select(F.to_date("d").alias("link_date"), "ix", "iy")
    for span in (0, 1, 3, 59, 60, 300, 364, 365, 366, 800):
        for years in ((1995, 2000), (1996, 1996), (1997, 1997)):
            got = running.baseline_means(keys, *years, span)
            want = extract.baseline_means(keys, q, *years, span).where("baseline is not null")
            assert sorted(map(tuple, got.collect()), key=str) == sorted(map(tuple, want.collect()), key=str), (span, years)


@pytest.mark.parametrize("means", [lambda running, keys: running.span_means(keys, 40), lambda running, keys: running.baseline_means(keys, 1996, 1998, 40)])
def test_the_cube_is_not_shuffled(spark, means):
    _, q = _daily(spark)
    running = accumulate(q)
    keys = q.select(F.col("obs_date").alias("link_date"), "ix", "iy").distinct()
    out = means(running, keys)
    out.count()
    lines = out._jdf.queryExecution().executedPlan().toString().split("\n")
    at = next(i for i, line in enumerate(lines) if "FileScan parquet" in line and running.table in line)
    # from the scan up to the join there is no exchange
    depth = lambda line: len(line) - len(line.lstrip(" :+-*()0123456789"))
    above, level = [], depth(lines[at])
    for line in reversed(lines[:at]):
        if depth(line) < level:
            above.append(line)
            level = depth(line)
        if "Join" in line and above and above[-1] is line:
            break
    assert "Join" in above[-1] and not any("Exchange" in x for x in above[:-1]) and "Bucketed: true" in lines[at]


def test_running_totals_of_nothing(spark):
    none = accumulate(ingest(spark.createDataFrame([], "obs_date string, ix int, iy int, value double")))
    obs = spark.createDataFrame([(1, "1999-01-01", 0.5, 1.5)], "id long, date string, lon double, lat double")
    assert api.link_daily(obs, none, SMALL, IND, time_span=3).first().linked is None


# --- raster files


def _cube(spark, n=40):
    rows = [(str(datetime.date(2000, 2, 20) + datetime.timedelta(k % n)), k % 3, k % 4, float(k)) for k in range(n * 7)] + [("2000-02-20", 0, 0, None), ("2000-02-20", 1, 1, float("nan"))]
    return spark.createDataFrame(rows, "obs_date string, ix int, iy int, value double")


GRID = Grid(-3.0, 12.0, 1.5, 0.5, 3, 4)


def test_raster_round_trip_prunes(spark, tmp_path):
    path = f"file://{tmp_path}/r"
    q = _cube(spark)
    raster.write_raster(q, path, GRID, "level", units="m", tags={"source": "test", "spoken": "two words"})
    assert raster.grid_of(path) == GRID
    want = q.where("value is not null and not isnan(value)").groupBy(F.col("obs_date").cast("date").alias("obs_date"), "ix", "iy").agg(F.avg("value").alias("value"))
    back = raster.read_raster(spark, path, "level")
    assert sorted(map(tuple, back.collect())) == sorted(map(tuple, want.collect()))
    some = "obs_date >= '2000-03-01' and obs_date < '2000-03-04' and iy > 2"
    assert sorted(map(tuple, back.where(some).collect())) == sorted(map(tuple, want.where(some).collect()))
    among = "obs_date in ('2000-02-21', '2000-03-05')"
    assert back.where(among).count() == want.where(among).count() > 0
    first = raster.files(path)[0]
    read = {}
    for name, dates, rows in (("all", (None, None, None), (0, 9)), ("days", (datetime.date(2000, 3, 1), datetime.date(2000, 3, 2), None), (0, 9)), ("rows", (None, None, None), (3, 3))):
        file = raster.RangedFile(first)
        header = netcdf.read_header(file.read, file.size)
        before = file.bytes_read
        list(raster.read_slab(file, None, 0, header.records - 1, dates, rows))
        read[name] = file.bytes_read - before
    assert read["days"] < read["all"] and read["rows"] < read["all"]
    assert header.attributes == {"source": "test"} and header.variables["level"].attributes["units"] == "m"
    raster.write_raster(q.limit(0), f"file://{tmp_path}/none", GRID, "level")
    with pytest.raises(Exception, match="outside the grid"):
        raster.write_raster(q.withColumn("ix", F.lit(7)), f"file://{tmp_path}/bad", GRID, "level")


def test_a_failed_task_leaves_nothing_that_is_read(spark, tmp_path):
    writer = raster.RasterWriter(f"file://{tmp_path}/w", True, {"variable": "v", "grid": json.dumps([0.0, 2.0, 1.0, 1.0, 2, 2])})
    import pyarrow as pa

    def batch(day, value):
        return pa.RecordBatch.from_arrays([pa.array([datetime.date(2000, 1, day)], pa.date32()), pa.array([0], pa.int32()), pa.array([1], pa.int32()), pa.array([value])], names=["obs_date", "ix", "iy", "value"])

    def lost():
        yield batch(1, 5.0)
        raise RuntimeError("the executor is gone")

    with pytest.raises(RuntimeError):
        writer.write(lost())
    assert [f for f in os.listdir(tmp_path / "w") if f.endswith(".nc")] == []
    good, repeated = writer.write(iter([batch(1, 5.0), batch(2, 6.0)])), writer.write(iter([batch(1, 5.0)]))
    writer.commit([good, None])  # the repeated attempt's message does not come
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".nc")]) == 2 and len(raster.files(f"file://{tmp_path}/w")) == 1
    rows = raster.read_raster(spark, f"file://{tmp_path}/w").collect()
    assert sorted((r.obs_date.day, r.ix, r.iy, r.value) for r in rows) == [(1, 0, 1, 5.0), (2, 0, 1, 6.0)]
    writer.abort([repeated])
    assert len([f for f in os.listdir(tmp_path / "w") if f.endswith(".nc")]) == 1
    with pytest.raises(ValueError):
        writer.write(iter([batch(2, 1.0), batch(1, 1.0)]))
    with raster.temporary_raster(_cube(spark), GRID, "level") as path:
        assert raster.read_raster(spark, path).count() > 0
    with pytest.raises(ValueError):
        raster.files(path)


def test_files_of_others(spark, tmp_path):
    """Packed shorts, hours since 1900, the south first, fixed time: as such files often are."""
    name = lambda s: struct.pack(">I", len(s)) + s.encode() + b"\0" * (-len(s) % 4)
    number = lambda k, v: name(k) + (struct.pack(">IIh", 3, 1, v) + b"\0\0" if isinstance(v, int) else struct.pack(">IId", 6, 1, v))
    text = lambda k, v: name(k) + struct.pack(">II", 2, len(v)) + v.encode() + b"\0" * (-len(v) % 4)
    dims = struct.pack(">II", 10, 3) + name("time") + struct.pack(">I", 2) + name("lat") + struct.pack(">I", 3) + name("lon") + struct.pack(">I", 2)
    unit = struct.pack(">II", 12, 1) + text("units", "hours since 1900-01-01 00:00:0.0")
    packed = struct.pack(">II", 12, 3) + number("scale_factor", 0.5) + number("add_offset", 10.0) + number("_FillValue", -32767)
    none = struct.pack(">II", 0, 0)
    parts = [("lon", [2], none, 5, 8), ("lat", [1], none, 5, 12), ("time", [0], unit, 4, 8), ("t2m", [0, 1, 2], packed, 3, 24)]

    def header(begins):
        out = b"CDF\x01" + struct.pack(">I", 0) + dims + none + struct.pack(">II", 11, 4)
        for (n, on, attributes, kind, size), b in zip(parts, begins, strict=True):
            out += name(n) + struct.pack(f">I{len(on)}I", len(on), *on) + attributes + struct.pack(">III", kind, size, b)
        return out

    at = len(header([0] * 4))
    begins = [at, at + 8, at + 20, at + 28]
    hours = [(datetime.datetime(2001, 5, d, 6) - datetime.datetime(1900, 1, 1)).total_seconds() / 3600 for d in (3, 4)]
    data = np.array([5.0, 6.0], ">f4").tobytes() + np.array([40.0, 41.0, 42.0], ">f4").tobytes() + np.array(hours, ">i4").tobytes()
    data += np.array([[[0, 1], [2, 3], [4, -32767]], [[10, 11], [12, 13], [14, 15]]], ">i2").tobytes()
    (tmp_path / "a.nc").write_bytes(header(begins) + data)
    assert raster.grid_of(f"file://{tmp_path}/a.nc") == Grid(4.5, 42.5, 1.0, 1.0, 2, 3)
    rows = raster.read_raster(spark, f"file://{tmp_path}", hourly=True).collect()
    got = {(r.obs_date.day, r.ts.hour, r.ix, r.iy): r.value for r in rows}
    assert len(got) == 11 and got[3, 6, 0, 2] == 10.0 and got[3, 6, 0, 0] == 12.0 and (3, 6, 1, 0) not in got and got[4, 6, 1, 0] == 17.5
    (tmp_path / "b.nc").write_bytes(b"\x89HDF....")
    with pytest.raises(Exception, match="classic"):
        raster.read_raster(spark, f"file://{tmp_path}/b.nc").count()


# --- resampling by area


def test_averages_keep_the_sum(spark):
    from geolink.operators import gridlink
    from geolink.sources.grid import target_grid

    source, to = Grid(0.0, 6.0, 1.0, 1.0, 8, 6), Grid(0.0, 6.0, 1.6, 0.75, 5, 8)
    pick = random.Random(6)
    layer = [(i, j, pick.random() * 100) for i in range(8) for j in range(6)]
    df = spark.createDataFrame(layer, "ix int, iy int, value double")
    out = gridlink.resample(target_grid(spark, to), df, source, "average", cell=(to.dx, to.dy)).collect()
    assert sum(r.linked for r in out) * to.dx * to.dy == pytest.approx(sum(v for _, _, v in layer), abs=1e-9)
    hole = gridlink.resample(target_grid(spark, to), df.where("ix <> 0 or iy <> 0"), source, "average", cell=(to.dx, to.dy)).collect()
    assert all(r.linked is not None for r in hole if (r.tx, r.ty) != (0, 0))
    with pytest.raises(ValueError):
        gridlink.resample(target_grid(spark, to), df, source, "average")
    sums = gridlink.resample(target_grid(spark, to), df, source, "sum", cell=(to.dx, to.dy)).collect()
    assert sum(r.linked for r in sums) == pytest.approx(sum(v for _, _, v in layer), abs=1e-9)


@pytest.mark.parametrize("method", ["bilinear", "cubic", "cubicspline", "lanczos"])
def test_kernels_keep_a_constant(spark, method):
    from geolink.operators import gridlink
    from geolink.sources.grid import target_grid

    source, to = Grid(0.0, 6.0, 1.0, 1.0, 8, 6), Grid(0.0, 6.0, 0.4, 0.3, 20, 20)
    df = spark.createDataFrame([(i, j, 7.0) for i in range(8) for j in range(6)], "ix int, iy int, value double")
    assert all(r.linked == pytest.approx(7.0) for r in gridlink.resample(target_grid(spark, to), df, source, method).collect())


# --- two streams


def test_late_layers_and_points_without_one(spark, tmp_path):
    from geolink.streaming.stream_link import link_streams

    stamp = lambda s: datetime.datetime.fromisoformat(s)
    points = [[(1, stamp("2024-01-01 10:30:00"), 0.5, 1.5), (2, stamp("2024-01-01 11:30:00"), 0.5, 1.5), (3, stamp("2024-01-01 10:30:00"), float("nan"), 1.5)], [(4, stamp("2024-01-09 00:00:00"), 0.5, 1.5)], [(5, stamp("2024-01-30 00:00:00"), 0.5, 1.5)], [(6, stamp("2024-02-20 00:00:00"), 0.5, 1.5)]]
    layers = [[(stamp("2024-01-01 01:00:00"), 0, 0, 9.0)], [(stamp("2024-01-01 10:00:00"), 0, 0, 7.0), (stamp("2024-01-09 00:00:00"), 0, 0, 4.0)], [(stamp("2024-01-30 00:00:00"), 1, 1, 1.0)], [(stamp("2024-01-01 11:00:00"), 0, 0, 8.0), (stamp("2024-02-20 00:00:00"), 1, 1, 1.0)]]
    for k, (p, q) in enumerate(zip(points, layers, strict=True)):
        spark.createDataFrame(p, "id long, ts timestamp, lon double, lat double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/p")
        spark.createDataFrame(q, "ts timestamp, ix int, iy int, value double").coalesce(1).write.mode("append").parquet(f"{tmp_path}/q")
    read = lambda ddl, d: spark.readStream.schema(ddl).option("maxFilesPerTrigger", 1).parquet(f"{tmp_path}/{d}")
    out = link_streams(read("id long, ts timestamp, lon double, lat double", "p"), read("ts timestamp, ix int, iy int, value double", "q"), SMALL)
    run = out.writeStream.format("parquet").option("path", f"{tmp_path}/out").option("checkpointLocation", f"{tmp_path}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    got = {r.id: r.linked for r in spark.read.parquet(f"{tmp_path}/out").collect()}
    # 1: its layer came a file later; 2: after the watermark had passed; 3: no cell
    assert got[1] == 7.0 and got[2] is None and got[3] is None and got[4] == 4.0 and 6 not in got


# --- claims


def test_one_of_two_callers_computes(spark, tmp_path):
    root, made = f"file://{tmp_path}", spark.sparkContext.accumulator(0)

    def count(it):
        for x in it:
            made.add(1)
            yield x

    def ask(out, k):
        df = spark.createDataFrame(spark.sparkContext.parallelize([(1,), (2,)], 1).mapPartitions(count), "v int")
        out[k] = sorted(r.v for r in Stash(spark, root, "svc").materialise(df, {"a": 1}, wait=0.05).collect())

    out: dict = {}
    callers = [threading.Thread(target=ask, args=(out, k)) for k in range(3)]
    [c.start() for c in callers]
    [c.join(120) for c in callers]
    assert out == {k: [1, 2] for k in range(3)}
    assert made.value == 2 and Stash(spark, root, "svc").get().count() == 1 and len(os.listdir(tmp_path / "svc" / "data")) == 1
    assert [f for f in os.listdir(tmp_path / "svc" / "claims") if not f.startswith(".")] == []


def _hold(path):
    os.makedirs(os.path.dirname(path), exist_ok=True)
    os.close(os.open(path, os.O_CREAT | os.O_EXCL))


def test_a_dead_process_claim_is_taken_over(spark, tmp_path):
    from geolink.sources.stash import request_key

    claim = f"{tmp_path}/svc/claims/{request_key({'a': 2}, 'svc')}"
    other = multiprocessing.get_context("spawn").Process(target=_hold, args=(claim,))
    other.start()
    other.join()
    assert os.path.exists(claim)
    stash = Stash(spark, f"file://{tmp_path}", "svc")
    assert stash._claim(request_key({"a": 2}, "svc"), 3600) is None
    assert stash.materialise(spark.range(3), {"a": 2}, lease=1.0, wait=0.2).count() == 3
    assert not os.path.exists(claim)
    with pytest.raises(Exception):
        stash.materialise(spark.range(3).select(F.raise_error(F.lit("no")).alias("x")), {"a": 3}, lease=5.0)
    assert stash.materialise(spark.range(4), {"a": 3}).count() == 4


def test_compaction_keeps_what_stands(spark, tmp_path):
    stash = Stash(spark, f"file://{tmp_path}", "svc")
    stash.compact()
    for n in range(4):
        spark.range(1).write.parquet(f"file://{tmp_path}/f{n}")
        stash.store(f"file://{tmp_path}/f{n}", {"n": n})
    stash.pop()
    before = sorted(map(tuple, stash.get().collect()))
    stash.compact()
    assert sorted(map(tuple, stash.get().collect())) == before and len(before) == 3
    assert len([f for f in os.listdir(tmp_path / "svc" / "index") if f.startswith("part-")]) == 1
