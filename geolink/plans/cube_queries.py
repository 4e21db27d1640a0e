"""Queries over cubes that were written first: raster files, running totals, tiles."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from geolink.plans import api
from geolink.plans.datasets import GRID, cube, observations, read, sql
from geolink.plans.registry import query, rounded
from geolink.session import shared_dir
from geolink.sources import raster
from geolink.sources.cube import ingest, write_cube
from geolink.sources.cumulative import accumulate
from geolink.sources.grid import Grid
from geolink.streaming.stream_link import daily_statistics_stream, link_streams


def _raster(spark, sf) -> str:
    path = f"{shared_dir(spark)}/raster-{uuid.uuid4().hex}"
    raster.write_raster(cube(spark, sf), path, GRID, "quantity", units="pieces", tags={"origin": "lineitem", "note": "not a plain word!"})
    return path


@query("src1_raster_file", sql("SELECT t AS obs_date, ix, iy, v AS value FROM cube", "cube"))
def src1_raster(spark, sf):
    """The cube written to raster files by tasks and read back by slabs."""
    return raster.read_raster(spark, _raster(spark, sf), "quantity").select("obs_date", "ix", "iy", "value")


@query("snk2_raster_link", sql("SELECT o.id, round(linked, 6) AS linked FROM o LEFT JOIN s USING (id)", "obs", "cells", "cube", o="SELECT * FROM cells",
    s="SELECT o.id, avg(c.v) AS linked FROM o JOIN cube c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 3 AND o.d GROUP BY o.id"))
def snk2_raster(spark, sf):
    """Orders linked to raster files, on the grid that the files tell."""
    path = _raster(spark, sf)
    return api.link_daily(observations(spark, sf), ingest(raster.read_raster(spark, path)), raster.grid_of(path), "2m_temperature", date_var="d", time_span=3).select("id", rounded("linked"))


def whole_cube(spark, sf):
    """Daily sums of quantities: whole numbers, so sums and means are exact in any order."""
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") % 5).cast("int").alias("ix"), (F.col("l_partkey") % 4).cast("int").alias("iy"))
    return ingest(rows.agg(F.sum("l_quantity").alias("value")))


_WHOLE = "SELECT l_shipdate::DATE AS t, (l_suppkey % 5)::INT AS ix, (l_partkey % 4)::INT AS iy, sum(l_quantity) AS v FROM lineitem GROUP BY ALL"


@query("jn3_cumulative_span", sql(
    "SELECT o.id, linked FROM cells o LEFT JOIN (SELECT o.id, sum(c.v) / count(*) AS linked FROM cells o JOIN w c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 400 AND o.d - 35 GROUP BY o.id) USING (id)", "obs", "cells", w=_WHOLE))
def jn3_cumulative(spark, sf):
    """A span of a year, a month back, from two running totals a key; exact, without rounding."""
    return api.link_daily(observations(spark, sf), accumulate(whole_cube(spark, sf)), GRID, "2m_temperature", date_var="d", time_span=365, time_lag=35).select("id", "linked")


@query("jn4_cumulative_baseline", sql(
    "SELECT o.id, linked, baseline, linked - baseline AS deviation FROM cells o LEFT JOIN (SELECT o.id, sum(c.v) / count(*) AS linked FROM cells o JOIN w c ON c.ix = o.ix AND c.iy = o.iy AND c.t BETWEEN o.d - 60 AND o.d GROUP BY o.id) USING (id)"
    " LEFT JOIN (SELECT id, sum(s) / sum(n) AS baseline FROM (SELECT DISTINCT o.id, o.ix, o.iy, strftime(o.d - k.range::INT, '%m-%d') AS md FROM cells o, range(61) AS k) JOIN clim USING (md, ix, iy) GROUP BY id) USING (id)",
    "obs", "cells", w=_WHOLE, clim="SELECT strftime(t, '%m-%d') AS md, ix, iy, sum(v) AS s, count(*) AS n FROM w WHERE year(t) BETWEEN 1995 AND 1997 GROUP BY ALL"))
def jn4_cumulative(spark, sf):
    """Two months and their anniversaries in three years, 29 February among them, all from running totals."""
    return api.link_daily(observations(spark, sf), accumulate(whole_cube(spark, sf)), GRID, "2m_temperature", date_var="d", time_span=60, baseline=(1995, 1997)).select("id", "linked", "baseline", "deviation")


WIDE = Grid(0.0, 60.0, 0.1, 0.1, 600, 600)


@query("src2_tiles", """
WITH p AS (SELECT o_orderkey AS id, o_orderdate::DATE AS d, CASE WHEN o_custkey % 2 = 0 THEN 0.05::DOUBLE + (o_custkey % 40) * 0.1::DOUBLE ELSE 55.05::DOUBLE + (o_custkey % 40) * 0.1::DOUBLE END AS lon, CASE WHEN o_custkey % 2 = 0 THEN 0.05::DOUBLE ELSE 59.95::DOUBLE END AS lat FROM orders),
q AS (SELECT l_shipdate::DATE AS t, (l_suppkey * 131 % 600)::INT AS ix, CASE l_partkey % 3 WHEN 0 THEN 0 WHEN 1 THEN 599 ELSE (l_partkey * 17 % 600)::INT END AS iy, sum(l_quantity) AS v FROM lineitem GROUP BY ALL)
SELECT p.id, avg(q.v) AS linked FROM p LEFT JOIN q ON q.t BETWEEN p.d - 60 AND p.d AND q.ix = floor(p.lon / 0.1::DOUBLE)::INT AND q.iy = floor((60 - p.lat) / 0.1::DOUBLE)::INT GROUP BY p.id
""")
def src2_tiles(spark, sf):
    """Points in opposite corners of a written cube: their tiles, not the box round them, are what the scan reads."""
    rows = read(spark, sf, "lineitem").groupBy(
        F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") * 131 % 600).cast("int").alias("ix"),
        F.when(F.col("l_partkey") % 3 == 0, 0).when(F.col("l_partkey") % 3 == 1, 599).otherwise(F.col("l_partkey") * 17 % 600).cast("int").alias("iy"),
    )
    path = f"{shared_dir(spark)}/cube-{uuid.uuid4().hex}"
    write_cube(ingest(rows.agg(F.sum("l_quantity").alias("value"))), path, WIDE)
    k = F.col("o_custkey")
    lon, lat = F.when(k % 2 == 0, F.lit(0.05)).otherwise(F.lit(55.05)) + (k % 40) * F.lit(0.1), F.when(k % 2 == 0, F.lit(0.05)).otherwise(F.lit(59.95))
    obs = read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), lon.alias("lon"), lat.alias("lat"))
    return api.link_daily(obs, spark.read.parquet(path), WIDE, "2m_temperature", date_var="d", time_span=60).select("id", "linked")


def _written(spark, stream) -> object:
    """What a stream has to say of all that is there, written by micro-batches and read back."""
    where = f"{shared_dir(spark)}/stream-{uuid.uuid4().hex}"
    run = stream.writeStream.format("parquet").option("path", f"{where}/out").option("checkpointLocation", f"{where}/log").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(stream.schema).parquet(f"{where}/out")


def _events(spark, sf):
    """Events as a stream, and a last one years later (for each side), so that every watermark passes them all."""
    source = read(spark, sf, "events")
    where = f"{shared_dir(spark)}/events-{uuid.uuid4().hex}"
    end = source.limit(1).select(*[F.lit("2030-01-01").cast("timestamp_ntz").alias("ts") if c == "ts" else F.lit(None).cast(source.schema[c].dataType).alias(c) for c in source.columns])
    source.unionByName(end).write.parquet(where)
    return spark.readStream.schema(source.schema).parquet(where)


@query("stream_event_time_link", """
WITH h AS (SELECT date_trunc('hour', ts) AS t, (user_id % 5)::INT AS ix, (user_id % 4)::INT AS iy, avg(value) AS v FROM events WHERE event_type <> 'purchase' GROUP BY ALL)
SELECT event_id, round(v, 6) AS linked FROM events LEFT JOIN h ON h.t = date_trunc('hour', ts) AND ix = event_id % 5 AND iy = event_id % 4
""")
def stream_links(spark, sf):
    """Events as points against hourly layers of other events, both arriving; those without a layer come out with NULL once it can't come any more."""
    arriving = _events(spark, sf).withColumn("ts", F.col("ts").cast("timestamp"))
    lon, lat = GRID.centre(F.col("event_id") % 5, F.col("event_id") % 4)
    points = arriving.select("event_id", "ts", F.coalesce(lon, F.lit(-1.0)).alias("lon"), F.coalesce(lat, F.lit(-1.0)).alias("lat"))
    # layers are made once and arrive as files do
    made = read(spark, sf, "events").where("event_type <> 'purchase'").groupBy(F.date_trunc("hour", F.col("ts").cast("timestamp")).alias("ts"), (F.col("user_id") % 5).cast("int").alias("ix"), (F.col("user_id") % 4).cast("int").alias("iy")).agg(F.avg("value").alias("value"))
    last = made.limit(1).select(F.lit("2030-01-01").cast("timestamp").alias("ts"), F.lit(0).alias("ix"), F.lit(0).alias("iy"), F.lit(None).cast("double").alias("value"))
    where = f"{shared_dir(spark)}/layers-{uuid.uuid4().hex}"
    made.unionByName(last).write.parquet(where)
    layers = spark.readStream.schema(made.schema).parquet(where)
    return _written(spark, link_streams(points, layers, GRID)).where("event_id is not null").select("event_id", rounded("linked"))


@query("stream_daily_statistics", "SELECT ts::DATE AS obs_date, (user_id % 5)::INT AS ix, (event_id % 4)::INT AS iy, round(avg(value), 6) AS mean, max(value) AS maximum, min(value) AS minimum FROM events GROUP BY ALL")
def stream_daily(spark, sf):
    """Daily statistics of a stream, each day written when the watermark has passed it."""
    hourly = _events(spark, sf).select(F.col("ts").cast("timestamp").alias("ts"), (F.col("user_id") % 5).cast("int").alias("ix"), (F.col("event_id") % 4).cast("int").alias("iy"), "value")
    return _written(spark, daily_statistics_stream(hourly)).where("ix is not null").select("obs_date", "ix", "iy", rounded("mean"), "maximum", "minimum")
