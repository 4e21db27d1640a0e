"""Observations, cube and grids derived from the driver's tables, with the same in SQL."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from geolink.functions.geometry import RINGS
from geolink.sources.cube import ingest
from geolink.sources.grid import Grid, target_grid

GRID = Grid(5.0, 51.0, 1.0, 1.0, 5, 4)
TARGET = Grid(5.0, 51.0, 0.5, 0.5, 10, 8)


def read(spark: SparkSession, sf: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf}/{name}.parquet")


def dealt(rows: DataFrame, *key: str, each: int = 2_000) -> DataFrame:
    """Rows of a few bytes that become thousands each, dealt over tasks by ``key`` before they do.

    A split of the file holds millions of them, and a partial aggregate as many groups where few repeat in it.  About ``each`` go to one task, so its
    memory does not grow with the table.
    """
    return rows.repartition(max(1, -(-rows.count() // each)), *key)


def observations(spark: SparkSession, sf: str) -> DataFrame:
    """One point per order: id, d, lon, lat."""
    k = F.col("o_custkey")
    lon = F.lit(5) + (k % 50) / F.lit(10.0) + F.lit(0.05)
    lat = F.lit(47) + (F.expr("o_custkey div 50") % 40) / F.lit(10.0) + F.lit(0.05)
    return read(spark, sf, "orders").select(F.col("o_orderkey").alias("id"), F.col("o_orderdate").cast("date").alias("d"), lon.alias("lon"), lat.alias("lat"))


def cube(spark: SparkSession, sf: str) -> DataFrame:
    """A sparse daily 5 x 4 cube: mean quantity by ship date, supplier and part."""
    rows = read(spark, sf, "lineitem").groupBy(F.col("l_shipdate").cast("date").alias("obs_date"), (F.col("l_suppkey") % 5).alias("ix"), (F.col("l_partkey") % 4).alias("iy"))
    return ingest(rows.agg(F.avg("l_quantity").alias("value")))


def hourly(spark: SparkSession, sf: str) -> DataFrame:
    return read(spark, sf, "events").select("ts", (F.col("user_id") % 5).cast("int").alias("ix"), (F.col("event_id") % 4).cast("int").alias("iy"), "value")


#: Test polygons: a box with a hole, two boxes as one multipolygon, a triangle, a sliver between centres, one outside.
POLYGONS = [
    (1, [[(5.1, 47.1), (9.9, 47.1), (9.9, 50.9), (5.1, 50.9)], [(6.2, 48.2), (8.8, 48.2), (8.8, 49.8), (6.2, 49.8)]]),
    (2, [[(5.2, 50.2), (6.8, 50.2), (6.8, 50.8), (5.2, 50.8)], [(8.2, 47.2), (9.8, 47.2), (9.8, 48.8), (8.2, 48.8)]]),
    (3, [[(5.0, 47.0), (10.0, 47.0), (7.5, 51.0)]]),
    (4, [[(7.6, 48.6), (7.9, 48.6), (7.9, 48.9), (7.6, 48.9)]]),
    (5, [[(20.0, 60.0), (21.0, 60.0), (21.0, 61.0), (20.0, 61.0)]]),
]


def polygons(spark: SparkSession) -> DataFrame:
    """Five polygons on each of three dates."""
    rows = [(10 * p + k, [[{"x": x, "y": y} for x, y in r] for r in rings], d) for p, rings in POLYGONS for k, d in enumerate(("1997-03-01", "1998-07-15", "1999-12-31"))]
    return spark.createDataFrame(rows, f"id long, rings {RINGS}, d string").withColumn("d", F.to_date("d"))


def targets(spark: SparkSession) -> DataFrame:
    return target_grid(spark, TARGET)


def _edges() -> str:
    rows = []
    for p, rings in POLYGONS:
        for r in rings:
            for (ax, ay), (bx, by) in zip(r, r[1:] + r[:1], strict=True):
                rows.append(f"({p}, {ax}::DOUBLE, {ay}::DOUBLE, {bx}::DOUBLE, {by}::DOUBLE)")
    return ", ".join(rows)


#: The same data sets as SQL: common table expressions by name.
SQL = {
    "obs": "SELECT o_orderkey AS id, o_orderdate::DATE AS d, 5 + (o_custkey % 50) / 10.0::DOUBLE + 0.05::DOUBLE AS lon, 47 + ((o_custkey // 50) % 40) / 10.0::DOUBLE + 0.05::DOUBLE AS lat FROM orders",
    "cells": "SELECT id, d, lon, lat, floor(lon - 5)::INT AS ix, floor(51 - lat)::INT AS iy FROM obs",
    "cube": "SELECT l_shipdate::DATE AS t, (l_suppkey % 5)::INT AS ix, (l_partkey % 4)::INT AS iy, avg(l_quantity) AS v FROM lineitem GROUP BY ALL",
    "grid": "SELECT x.range::INT AS ix, y.range::INT AS iy, 5 + x.range + 0.5::DOUBLE AS clon, 51 - (y.range + 0.5::DOUBLE) AS clat FROM range(5) AS x, range(4) AS y",
    "hourly": "SELECT ts, (user_id % 5)::INT AS ix, (event_id % 4)::INT AS iy, value FROM events",
    "edges": f"SELECT * FROM (VALUES {_edges()}) AS e(p, ax, ay, bx, \"by\")",
    "targets": "SELECT x.range::INT AS tx, y.range::INT AS ty, 5 + (x.range + 0.5::DOUBLE) * 0.5 AS lon, 51 - (y.range + 0.5::DOUBLE) * 0.5 AS lat FROM range(10) AS x, range(8) AS y",
}


def sql(body: str, *names: str, **more: str) -> str:
    """``body`` with the named data sets, and further ones, as common table expressions."""
    parts = [f"{n} AS ({SQL[n]})" for n in names] + [f"{n} AS ({q})" for n, q in more.items()]
    return f"WITH {', '.join(parts)} {body}" if parts else body
