"""The classic NetCDF layout (64-bit offsets): header, places of values, and a writer of slabs in order.

Only what gridded series need: dimensions (time, latitude, longitude), coordinate
variables and one value for each time and cell.  Files are read by byte ranges and written
front to back, so any store that offers both will do.
"""

from __future__ import annotations

import datetime
import re
import struct
from dataclasses import dataclass, field

import numpy as np

#: Fixed values of the format: tags of the header's lists, value types by number, the number of records of a file written as a stream.
DIMENSIONS, VARIABLES, ATTRIBUTES = 10, 11, 12
TYPES = {1: ">i1", 2: "S1", 3: ">i2", 4: ">i4", 5: ">f4", 6: ">f8", 7: ">u1", 8: ">u2", 9: ">u4", 10: ">i8", 11: ">u8"}
STREAMED = 0xFFFFFFFF
FILL = 9.969209968386869e36
#: Seconds of a time unit.
UNITS = {"second": 1, "minute": 60, "hour": 3600, "day": 86400}


@dataclass
class Variable:
    name: str
    dims: tuple[int, ...]
    attributes: dict
    kind: str
    size: int
    begin: int


@dataclass
class Header:
    """Dimensions (name, length; the record dimension has length 0), attributes, variables, records."""

    dims: list[tuple[str, int]]
    attributes: dict
    variables: dict[str, Variable]
    records: int
    record_bytes: int = field(default=0)

    def is_record(self, v: Variable) -> bool:
        return bool(v.dims) and self.dims[v.dims[0]][1] == 0

    def shape(self, v: Variable) -> tuple[int, ...]:
        return tuple(self.dims[d][1] or self.records for d in v.dims)

    def place(self, v: Variable, record: int) -> tuple[int, int]:
        """Where a variable's ``record``-th step along its first dimension begins, and its bytes."""
        step = int(np.prod([self.dims[d][1] for d in v.dims[1:]], dtype=np.int64)) * np.dtype(v.kind).itemsize
        return v.begin + record * (self.record_bytes if self.is_record(v) else step), step


class _Cursor:
    """Numbers and names read one after another; more of the file is fetched when needed."""

    def __init__(self, read, first: int = 1 << 16):
        self.read, self.at, self.data = read, 0, read(0, first)

    def take(self, n: int) -> bytes:
        while self.at + n > len(self.data):
            more = self.read(len(self.data), max(n, len(self.data)))
            if not more:
                raise ValueError("the header ends early")
            self.data += more
        self.at += n
        return self.data[self.at - n : self.at]

    def number(self, form: str = ">I") -> int:
        return struct.unpack(form, self.take(struct.calcsize(form)))[0]


def read_header(read, size: int) -> Header:
    """The header of a file; ``read(offset, length)`` gives its bytes, ``size`` is its length."""
    c = _Cursor(read)
    if (magic := c.take(4))[:3] != b"CDF" or magic[3] not in (1, 2, 5):
        raise ValueError("not a classic NetCDF file")
    count = ">Q" if magic[3] == 5 else ">I"
    offset = ">I" if magic[3] == 1 else ">Q"
    records = c.number(count)

    def name() -> str:
        n = c.number(count)
        return c.take(n + -n % 4)[:n].decode()

    def several(tag: int, one) -> list:
        found, n = c.number(), c.number(count)
        if found not in (0, tag):
            raise ValueError("a list of the header has an unknown tag")
        return [one() for _ in range(n)]

    def attribute() -> tuple:
        key, kind, n = name(), TYPES[c.number()], c.number(count)
        size = n * np.dtype(kind).itemsize
        raw = c.take(size + -size % 4)[:size]
        return key, raw.decode() if kind == "S1" else np.frombuffer(raw, kind).tolist()

    dims = several(DIMENSIONS, lambda: (name(), c.number(count)))
    attributes = dict(several(ATTRIBUTES, attribute))

    def variable() -> Variable:
        key, shape = name(), tuple(c.number(count) for _ in range(c.number(count)))
        own = dict(several(ATTRIBUTES, attribute))
        return Variable(key, shape, own, TYPES[c.number()], c.number(count), c.number(offset))

    out = Header(dims, attributes, {v.name: v for v in several(VARIABLES, variable)}, records)
    in_records = [v for v in out.variables.values() if out.is_record(v)]
    sizes = [out.place(v, 0)[1] for v in in_records]
    out.record_bytes = sizes[0] if len(sizes) == 1 else sum(n + -n % 4 for n in sizes)
    if records in (STREAMED, 2**64 - 1):
        out.records = (size - min(v.begin for v in in_records)) // out.record_bytes if in_records else 0
    return out


def times(values: np.ndarray, units: str) -> list[datetime.datetime]:
    """Numbers of ``units`` ("days since 1970-01-01 ...") as times."""
    m = re.match(r"\s*(second|minute|hour|day)s?\s+since\s+(\d+)-(\d+)-(\d+)(?:[T ]+(\d+):(\d+)(?::(\d+))?)?", units)
    if not m:
        raise ValueError(f"time unit {units!r} is none of {', '.join(UNITS)} since a date")
    start = datetime.datetime(*(int(x or 0) for x in m.groups()[1:]))
    return [start + datetime.timedelta(seconds=round(float(v) * UNITS[m[1]])) for v in values]


def unpacked(raw: bytes, v: Variable) -> np.ndarray:
    """A variable's values as doubles, missing ones NaN, by its fill value, scale and offset."""
    stored = np.frombuffer(raw, v.kind)
    value = stored.astype(np.float64)
    missing = np.isnan(value)
    for key in ("_FillValue", "missing_value"):
        for fill in v.attributes.get(key, []):
            missing |= stored == np.asarray(fill).astype(stored.dtype)
    scale, offset = (v.attributes.get(k, [d])[0] for k, d in (("scale_factor", 1.0), ("add_offset", 0.0)))
    return np.where(missing, np.nan, value * scale + offset if (scale, offset) != (1.0, 0.0) else value)


def _name(text: str) -> bytes:
    raw = text.encode()
    return struct.pack(">I", len(raw)) + raw + b"\0" * (-len(raw) % 4)


def _attributes(values: dict) -> bytes:
    out = struct.pack(">II", ATTRIBUTES if values else 0, len(values))
    for k, v in values.items():
        if isinstance(v, str):
            raw = v.encode()
            out += _name(k) + struct.pack(">II", 2, len(raw)) + raw + b"\0" * (-len(raw) % 4)
        else:
            out += _name(k) + struct.pack(">IId", 6, 1, v)
    return out


def header_bytes(variable: str, lon: np.ndarray, lat: np.ndarray, tags: dict[str, str], units: str | None) -> bytes:
    """Header and coordinates of a file of daily layers; records (day, slab of doubles) follow until its end."""
    dims = struct.pack(">II", DIMENSIONS, 3) + b"".join(_name(n) + struct.pack(">I", k) for n, k in (("time", 0), ("latitude", len(lat)), ("longitude", len(lon))))
    own = {"_FillValue": FILL} | ({"units": units} if units else {})
    shapes = [("latitude", (1,), {"units": "degrees_north"}, 8 * len(lat)), ("longitude", (2,), {"units": "degrees_east"}, 8 * len(lon)), ("time", (0,), {"units": "days since 1970-01-01"}, 8), (variable, (0, 1, 2), own, 8 * len(lat) * len(lon))]

    def made(begins: list[int]) -> bytes:
        out = b"CDF\x02" + struct.pack(">I", STREAMED) + dims + _attributes(tags) + struct.pack(">II", VARIABLES, len(shapes))
        for (name, on, attributes, size), begin in zip(shapes, begins, strict=True):
            out += _name(name) + struct.pack(f">I{len(on)}I", len(on), *on) + _attributes(attributes) + struct.pack(">IIQ", 6, min(size, STREAMED), begin)
        return out

    at = len(made([0] * 4))
    begins = [at, at + 8 * len(lat), at + 8 * (len(lat) + len(lon)), at + 8 * (len(lat) + len(lon)) + 8]
    return made(begins) + lat.astype(">f8").tobytes() + lon.astype(">f8").tobytes()
