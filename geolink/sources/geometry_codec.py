"""Geometries of other systems: well-known binary (with its extension) and GeoJSON, to and from points and rings.

Binary is decoded in Arrow batches: either byte order, in every part anew; Z, M and the
system's number are read over; polygons and multipolygons become rings, points a
coordinate, collections of them the rings of all their parts.  GeoJSON is read by schema.

Defined results
    null, empty or broken input   NULL coordinates and rings
    empty geometries              NULL coordinates, no rings
    lines                         NULL: nothing to link
    extra columns                 kept; of the names ``lon``, ``lat``, ``rings`` the new ones stay
"""

from __future__ import annotations

import struct

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from geolink.functions.geometry import RINGS

#: Fixed values of the format: kinds of geometry, flags of the extended form, steps of the kinds with Z, M or both.
POINT, POLYGON, MULTIPOINT, MULTIPOLYGON, COLLECTION = 1, 3, 4, 6, 7
HAS_Z, HAS_M, HAS_SRID, STEP = 0x80000000, 0x40000000, 0x20000000, 1000


class _Reader:
    def __init__(self, raw: bytes):
        self.raw, self.at = raw, 0
        self.rings: list[np.ndarray] = []
        self.points: list[np.ndarray] = []

    def number(self, order: str) -> int:
        out = struct.unpack_from(f"{order}I", self.raw, self.at)[0]
        self.at += 4
        return out

    def vertices(self, order: str, n: int, width: int) -> np.ndarray:
        out = np.frombuffer(self.raw, f"{order}f8", n * width, self.at).reshape(n, width)
        self.at += 8 * n * width
        return out[:, :2].astype(np.float64)

    def geometry(self, depth: int = 0) -> None:
        order = "<" if self.raw[self.at] else ">"
        self.at += 1
        kind = self.number(order)
        width = 2 + bool(kind & HAS_Z) + bool(kind & HAS_M)
        if kind & HAS_SRID:
            self.number(order)
        kind &= 0x0FFFFFFF
        width, kind = max(width, (2, 3, 3, 4)[kind // STEP]), kind % STEP
        if kind == POINT:
            p = self.vertices(order, 1, width)
            if not np.isnan(p).any():
                self.points.append(p[0])
        elif kind == POLYGON:
            self.rings += [self.vertices(order, self.number(order), width) for _ in range(self.number(order))]
        elif kind in (MULTIPOINT, MULTIPOLYGON, COLLECTION) and depth < 32:
            for _ in range(self.number(order)):
                self.geometry(depth + 1)
        else:
            raise ValueError("a geometry that is neither point nor polygon")


def _decoded(raw: bytes | None) -> tuple:
    """(lon, lat, rings) of one geometry."""
    if not raw:
        return None, None, None
    r = _Reader(raw)
    try:
        r.geometry()
    except (ValueError, IndexError, struct.error):
        return None, None, None
    lon, lat = map(float, r.points[0]) if len(r.points) == 1 and not r.rings else (None, None)
    return lon, lat, r.rings if r.rings or lon is None else None


_RING_TYPE = pa.list_(pa.list_(pa.struct([("x", pa.float64()), ("y", pa.float64())])))


def _rings(several: list) -> pa.Array:
    """Lists of rings as an Arrow array, made from flat numbers."""
    rings = [r for one in several if one is not None for r in one]
    flat = np.concatenate(rings) if rings else np.zeros((0, 2))
    points = pa.StructArray.from_arrays([pa.array(flat[:, 0].copy()), pa.array(flat[:, 1].copy())], names=["x", "y"])
    inner = pa.ListArray.from_arrays(pa.array(np.r_[0, np.cumsum([len(r) for r in rings])].astype(np.int32)), points)
    ends = np.r_[0, np.cumsum([0 if one is None else len(one) for one in several])].astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), inner, mask=pa.array([one is None for one in several])) if len(several) else pa.array([], _RING_TYPE)


def from_wkb(df: DataFrame, col: str) -> DataFrame:
    """Add ``lon``, ``lat`` (points) and ``rings`` (polygons) from a column of well-known binary."""
    rows = df.drop(*({"lon", "lat", "rings"} - {col}))
    fields = [f for f in rows.schema.fields if f.name not in ("lon", "lat", "rings")]
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"lon double, lat double, rings {RINGS}"])

    def run(batches):
        for batch in batches:
            lon, lat, rings = zip(*map(_decoded, batch.column(col).to_pylist()), strict=True) if batch.num_rows else ((), (), ())
            made = [pa.array(lon, pa.float64()), pa.array(lat, pa.float64()), _rings(list(rings))]
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), *made], names=[*(f.name for f in fields), "lon", "lat", "rings"])

    return rows.mapInArrow(run, schema)


def to_wkb(df: DataFrame, rings: str, out: str = "wkb", big: bool = False, srid: int | None = None) -> DataFrame:
    """Rings as a polygon in well-known binary (``big``: most significant byte first; with ``srid`` the extended form)."""
    order = ">" if big else "<"
    fields = df.schema.fields
    schema = ", ".join([*(f"`{f.name}` {f.dataType.simpleString()}" for f in fields), f"`{out}` binary"])

    def encoded(several) -> bytes | None:
        if several is None:
            return None
        head = struct.pack(f"{order}BI", not big, POLYGON | (HAS_SRID if srid else 0)) + (struct.pack(f"{order}I", srid) if srid else b"")
        body = [np.array([(p["x"], p["y"]) for p in r], f"{order}f8").tobytes() for r in several]
        return head + struct.pack(f"{order}I", len(body)) + b"".join(struct.pack(f"{order}I", len(b) // 16) + b for b in body)

    def run(batches):
        for batch in batches:
            made = pa.array([encoded(x) for x in batch.column(rings).to_pylist()], pa.binary())
            yield pa.RecordBatch.from_arrays([*(batch.column(f.name) for f in fields), made], names=[*(f.name for f in fields), out])

    return df.mapInArrow(run, schema)


def from_geojson(df: DataFrame, col: str) -> DataFrame:
    """Add ``lon``, ``lat`` and ``rings`` from GeoJSON text: a geometry, or a feature that holds one."""
    head = F.from_json(F.col(f"`{col}`"), "type string, coordinates string, geometry struct<type: string, coordinates: string>")
    at = F.when(head["type"] == "Feature", head["geometry"]).otherwise(F.struct(head["type"].alias("type"), head["coordinates"].alias("coordinates")))
    kind, text = at["type"], at["coordinates"]
    point = F.from_json(text, "array<double>")
    ring: Column = lambda r: F.transform(r, lambda p: F.struct(p[0].alias("x"), p[1].alias("y")))
    one = F.transform(F.from_json(text, "array<array<array<double>>>"), ring)
    several = F.transform(F.flatten(F.from_json(text, "array<array<array<array<double>>>>")), ring)
    is_point = kind == "Point"
    return df.drop(*({"lon", "lat", "rings"} - {col})).withColumns({
        "lon": F.when(is_point, F.get(point, F.lit(0))), "lat": F.when(is_point, F.get(point, F.lit(1))), "rings": F.when(kind == "Polygon", one).when(kind == "MultiPolygon", several).cast(RINGS),
    })
