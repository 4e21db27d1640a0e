"""Raster files (classic NetCDF) as a Spark data source, read by slabs and written with a commit.

Reading plans one partition a block of time steps from the files' headers; a task reads
the time coordinate, then only the rows of the layers whose date is wanted.  Conditions
on ``obs_date`` and ``iy`` reach the reader (``spark.sql.python.filterPushdown.enabled``).

Writing gives every task files of its own, one day after another; they become part of the
raster when the driver has put their names into the manifest, in one step at the end.  What a
lost or repeated task leaves is in no manifest, is not read, and is deleted on abort.

Paths are URIs of a store that driver and executors share (``file://`` for a mounted folder).
"""

from __future__ import annotations

import contextlib
import datetime
import json
import uuid
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.datasource import (
    DataSource, DataSourceReader, DataSourceArrowWriter, EqualTo, GreaterThan, GreaterThanOrEqual, In, InputPartition, LessThan, LessThanOrEqual, WriterCommitMessage,
)

from geolink.functions.text import clean_tags
from geolink.session import shared_dir
from geolink.sources import netcdf
from geolink.sources.grid import Grid

FORMAT = "classic_raster"
SCHEMA = "obs_date date, ts timestamp_ntz, ix int, iy int, value double"
#: Bytes of layers that a reading task takes, about.
SLAB_BYTES = 64 << 20
MANIFEST = "_manifest.json"


def _store(path: str):
    return pafs.FileSystem.from_uri(path if "://" in path else path.replace("file:/", "file:///", 1) if path.startswith("file:/") else f"file://{path}")


class RangedFile:
    """A file read by byte ranges; ``bytes_read`` counts them."""

    def __init__(self, path: str):
        fs, at = _store(path)
        self.file, self.bytes_read = fs.open_input_file(at), 0
        self.size = self.file.size()

    def read(self, offset: int, length: int) -> bytes:
        out = self.file.read_at(max(0, min(length, self.size - offset)), offset)
        self.bytes_read += len(out)
        return out


def files(path: str) -> list[str]:
    """The files of a raster: those of its manifest, else all ``.nc`` files of the folder, or the one file."""
    fs, at = _store(path)
    info = fs.get_file_info(at)
    if info.type == pafs.FileType.File:
        return [path]
    if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File:
        with fs.open_input_stream(f"{at}/{MANIFEST}") as f:
            return [f"{path}/{name}" for name in json.loads(f.read())["files"]]
    if info.type == pafs.FileType.NotFound:
        raise ValueError(f"no raster at {path}")
    return [f"{path}/{f.base_name}" for f in sorted(fs.get_file_info(pafs.FileSelector(at)), key=lambda f: f.path) if f.base_name.endswith(".nc")]


_ROLES = {"t": ("time", "valid_time"), "y": ("latitude", "lat", "y"), "x": ("longitude", "lon", "x")}


def _layers(header: netcdf.Header, variable: str | None) -> netcdf.Variable:
    """The variable over (time, latitude, longitude), named or the only one."""
    roles = [next((r for r, names in _ROLES.items() if name.lower() in names), "?") for name, _ in header.dims]
    found = [v for v in header.variables.values() if [roles[d] for d in v.dims] == ["t", "y", "x"] and variable in (None, v.name)]
    if len(found) != 1:
        raise ValueError(f"{len(found)} variables over (time, latitude, longitude) match {variable!r}")
    return found[0]


def _coordinate(file: RangedFile, header: netcdf.Header, dim: int) -> np.ndarray:
    v = header.variables[header.dims[dim][0]]
    if not header.is_record(v):
        return netcdf.unpacked(file.read(v.begin, header.shape(v)[0] * np.dtype(v.kind).itemsize), v)
    return np.array([netcdf.unpacked(file.read(*header.place(v, r)), v)[0] for r in range(header.records)])


def grid_of(path: str, variable: str | None = None) -> Grid:
    """The grid of a raster's first file: equal steps, the north first in cell numbers whatever the file's order."""
    file = RangedFile(files(path)[0])
    header = netcdf.read_header(file.read, file.size)
    v = _layers(header, variable)
    lat, lon = _coordinate(file, header, v.dims[1]), _coordinate(file, header, v.dims[2])
    step = lambda c: abs(float(c[-1] - c[0])) / (len(c) - 1) if len(c) > 1 else 1.0
    for c in (lat, lon):
        if len(c) > 2 and not np.allclose(np.abs(np.diff(c)), step(c), rtol=1e-3):
            raise ValueError("coordinates are not in equal steps")
    dx, dy = step(lon), step(lat)
    return Grid(round(float(lon.min()) - dx / 2, 9), round(float(lat.max()) + dy / 2, 9), round(dx, 9), round(dy, 9), len(lon), len(lat))


@dataclass
class Slab(InputPartition):
    path: str
    first: int
    last: int

    def __init__(self, path: str, first: int, last: int):
        self.path, self.first, self.last, self.value = path, first, last, (path, first, last)


def read_slab(file: RangedFile, variable: str | None, first: int, last: int, dates: tuple, rows: tuple[int, int]):
    """(time, rows' first number, values) of the wanted layers among the time steps ``first`` to ``last``."""
    header = netcdf.read_header(file.read, file.size)
    v = _layers(header, variable)
    lat = _coordinate(file, header, v.dims[1])
    t = header.variables[header.dims[v.dims[0]][0]]
    _, ny, nx = header.shape(v)
    south_first = ny > 1 and lat[0] < lat[-1]
    low, high = max(rows[0], 0), min(rows[1], ny - 1)
    if low > high:
        return
    a, b = (ny - 1 - high, ny - 1 - low) if south_first else (low, high)
    row = nx * np.dtype(v.kind).itemsize
    for k in range(first, last + 1):
        when = netcdf.times(netcdf.unpacked(file.read(*header.place(t, k)), t), t.attributes["units"])[0]
        if (dates[0] and when.date() < dates[0]) or (dates[1] and when.date() > dates[1]) or (dates[2] is not None and when.date() not in dates[2]):
            continue
        values = netcdf.unpacked(file.read(header.place(v, k)[0] + a * row, (b - a + 1) * row), v).reshape(b - a + 1, nx)
        yield when, low, values[::-1] if south_first else values


class RasterReader(DataSourceReader):
    def __init__(self, path: str, variable: str | None):
        self.path, self.variable, self.dates, self.rows = path, variable, (None, None, None), (0, 1 << 30)

    def pushFilters(self, filters):
        """Dates and rows are pruned here; Spark keeps every condition and decides exactly."""
        first, last, among = self.dates
        low, high = self.rows
        day = datetime.timedelta(1)
        for f in filters:
            at, v = getattr(f, "attribute", None), getattr(f, "value", None)
            if at == ("obs_date",) and isinstance(v if not isinstance(f, In) else (v or [None])[0], datetime.date):
                if isinstance(f, In):
                    among = set(v) if among is None else among & set(v)
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    first = max(first or v, v + day if isinstance(f, GreaterThan) else v)
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    last = min(last or v, v - day if isinstance(f, LessThan) else v)
            elif at == ("iy",) and isinstance(v, int):
                if isinstance(f, (EqualTo, GreaterThan, GreaterThanOrEqual)):
                    low = max(low, v + isinstance(f, GreaterThan))
                if isinstance(f, (EqualTo, LessThan, LessThanOrEqual)):
                    high = min(high, v - isinstance(f, LessThan))
            yield f
        self.dates, self.rows = (first, last, among), (low, high)

    def partitions(self):
        out = []
        for path in files(self.path):
            file = RangedFile(path)
            header = netcdf.read_header(file.read, file.size)
            v = _layers(header, self.variable)
            steps = max(1, SLAB_BYTES // max(1, header.place(v, 0)[1]))
            n = header.shape(v)[0]
            out += [Slab(path, a, min(a + steps, n) - 1) for a in range(0, n, steps)]
        return out or [Slab("", 0, -1)]

    def read(self, partition):
        if not partition.path:
            return
        for when, low, values in read_slab(RangedFile(partition.path), self.variable, partition.first, partition.last, self.dates, self.rows):
            j, i = np.nonzero(~np.isnan(values))
            n = len(i)
            yield pa.RecordBatch.from_arrays(
                [pa.array([when.date()] * n, pa.date32()), pa.array([when] * n, pa.timestamp("us")), pa.array(i, pa.int32()), pa.array(j + low, pa.int32()), pa.array(values[j, i])],
                names=["obs_date", "ts", "ix", "iy", "value"],
            )


@dataclass
class Written(WriterCommitMessage):
    files: list


class RasterWriter(DataSourceArrowWriter):
    """Rows (obs_date, iy, ix, value) in the order of dates; every task a file, listed in the manifest on commit."""

    def __init__(self, path: str, overwrite: bool, options: dict):
        self.path, self.overwrite = path, overwrite
        self.variable, self.units = options["variable"], options.get("units")
        self.grid, self.tags = Grid(*json.loads(options["grid"])), json.loads(options.get("tags", "{}"))

    def write(self, iterator):
        g, fill = self.grid, np.full(self.grid.nx * self.grid.ny, netcdf.FILL)
        lon, lat = g.xmin + (np.arange(g.nx) + 0.5) * g.dx, g.ymax - (np.arange(g.ny) + 0.5) * g.dy
        fs, at = _store(self.path)
        name, out, now, slab = f"part-{uuid.uuid4().hex}.nc", None, None, None

        def flush():
            out.write(np.array([now], ">f8").tobytes() + slab.astype(">f8").tobytes())

        try:
            for batch in iterator:
                days = batch.column("obs_date").cast(pa.int32()).to_numpy(zero_copy_only=False)
                cell = batch.column("iy").to_numpy(zero_copy_only=False).astype(np.int64) * g.nx + batch.column("ix").to_numpy(zero_copy_only=False)
                value = batch.column("value").to_numpy(zero_copy_only=False)
                cuts = [0, *(np.nonzero(np.diff(days))[0] + 1).tolist(), len(days)]
                for a, b in zip(cuts, cuts[1:], strict=False):
                    if a == b:
                        continue
                    if now is not None and days[a] < now:
                        raise ValueError("rows do not come in the order of dates")
                    if out is None:
                        fs.create_dir(at, recursive=True)
                        out = fs.open_output_stream(f"{at}/{name}")
                        out.write(netcdf.header_bytes(self.variable, lon, lat, self.tags, self.units))
                    if now != days[a]:
                        if now is not None:
                            flush()
                        now, slab = days[a], fill.copy()
                    slab[cell[a:b]] = value[a:b]
            if out is not None:
                flush()
                out.close()
        except BaseException:
            if out is not None:
                out.close()
                fs.delete_file(f"{at}/{name}")
            raise
        return Written([name] if out is not None else [])

    def commit(self, messages):
        fs, at = _store(self.path)
        names = sorted(n for m in messages if m for n in m.files)
        before = [] if self.overwrite else [f.rsplit("/", 1)[1] for f in (files(self.path) if fs.get_file_info(f"{at}/{MANIFEST}").type == pafs.FileType.File else [])]
        fs.create_dir(at, recursive=True)
        part = f"{at}/.{MANIFEST}-{uuid.uuid4().hex}"
        with fs.open_output_stream(part) as f:
            f.write(json.dumps({"files": before + names}).encode())
        fs.move(part, f"{at}/{MANIFEST}")

    def abort(self, messages):
        fs, at = _store(self.path)
        for m in messages:
            for name in m.files if m else []:
                with contextlib.suppress(FileNotFoundError):
                    fs.delete_file(f"{at}/{name}")


class RasterSource(DataSource):
    @classmethod
    def name(cls):
        return FORMAT

    def schema(self):
        return SCHEMA

    def reader(self, schema):
        return RasterReader(self.options["path"], self.options.get("variable"))

    def writer(self, schema, overwrite):
        return RasterWriter(self.options["path"], overwrite, self.options)


def read_raster(spark: SparkSession, path: str, variable: str | None = None, hourly: bool = False) -> DataFrame:
    """(obs_date, ix, iy, value) of a raster's cells with a value; with ``hourly`` also ``ts``."""
    spark.conf.set("spark.sql.python.filterPushdown.enabled", "true")
    spark.dataSource.register(RasterSource)
    source = spark.read.format(FORMAT)
    rows = (source.option("variable", variable) if variable else source).load(path)
    return rows if hourly else rows.drop("ts")


def write_raster(cube: DataFrame, path: str, grid: Grid, variable: str, *, units: str | None = None, tags: dict[str, str] | None = None, mode: str = "overwrite") -> None:
    """Write (obs_date, ix, iy, value); several rows of a cell and date become their mean, rows outside the grid are refused.

    ``tags`` become attributes of the files, those of plain words only.
    """
    spark = cube.sparkSession
    spark.dataSource.register(RasterSource)
    plain = spark.range(1).select(clean_tags(F.create_map(*[F.lit(x) for kv in tags.items() for x in kv])).alias("t")).first()["t"] if tags else {}
    inside = F.col("ix").between(0, grid.nx - 1) & F.col("iy").between(0, grid.ny - 1)
    # a day is one task's, so a layer is written whole; NULL and NaN are what a raster leaves out
    value = F.nullif(F.col("value").cast("double"), F.lit(float("nan")))
    rows = cube.select(F.col("obs_date").cast("date").alias("obs_date"), F.when(inside, F.col("ix").cast("int")).otherwise(F.raise_error(F.lit("a cell is outside the grid")).cast("int")).alias("ix"), F.col("iy").cast("int").alias("iy"), value.alias("value"))
    rows = rows.where("value is not null").groupBy("obs_date", "iy", "ix").agg(F.avg("value").alias("value"))
    rows = rows.repartitionByRange("obs_date").sortWithinPartitions("obs_date", "iy", "ix")
    out = rows.write.format(FORMAT).mode(mode).option("variable", variable).option("grid", json.dumps([grid.xmin, grid.ymax, grid.dx, grid.dy, grid.nx, grid.ny])).option("tags", json.dumps(plain))
    (out.option("units", units) if units else out).save(path)


@contextlib.contextmanager
def temporary_raster(cube: DataFrame, grid: Grid, variable: str, **options):
    """Write a raster for the time of a block, then delete it; yields its path."""
    path = f"{shared_dir(cube.sparkSession)}/raster-{uuid.uuid4().hex}"
    write_raster(cube, path, grid, variable, **options)
    try:
        yield path
    finally:
        fs, at = _store(path)
        fs.delete_dir(at)
