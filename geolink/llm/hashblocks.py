"""Hashes on their way to the reducers, packed: (hash, document, position) triples in byte planes.

One row for each bucket of hashes and flush of a task replaces a row for each
hash: sorted by document, ids and positions become small differences, which compress
to a byte or two.
"""

from __future__ import annotations

import numpy as np
import zstandard


def bucket_of(hashes: np.ndarray, buckets: int) -> np.ndarray:
    """The bucket of each hash: equal ranges of hashes, in order."""
    return (((hashes >> np.uint64(32)) * np.uint64(buckets)) >> np.uint64(32)).astype(np.int64)


def _planes(x: np.ndarray) -> bytes:
    return x.view(np.uint8).reshape(len(x), x.itemsize).T.tobytes()


def _unplanes(raw: bytes, n: int, dtype: type) -> np.ndarray:
    size = np.dtype(dtype).itemsize
    return np.ascontiguousarray(np.frombuffer(raw, np.uint8).reshape(size, n).T).reshape(-1).view(dtype)


#: From so many buckets on, two hashes of one bucket that agree in their lowest seven bytes agree in the eighth.
SHORT = 256


def _width(buckets: int) -> int:
    return 7 if buckets >= SHORT else 8


def pack(hashes: np.ndarray, docs: np.ndarray, places: np.ndarray | None = None, checks: np.ndarray | None = None, buckets: int = 0) -> bytes:
    """``docs`` should come in runs; ``places`` should rise within a run; ``checks`` keep 32 bits.

    Hashes and checks are as random as they look and stay as they are, less the byte
    that their bucket (one of ``buckets``) says already; the small differences of ids
    and positions go through zstd.
    """
    small = [_planes(np.diff(docs, prepend=0).astype("<i8"))]
    if places is not None:
        small.append(_planes(np.diff(places, prepend=0).astype("<i4")))
    body = hashes.astype("<u8").view(np.uint8).reshape(len(hashes), 8)[:, : _width(buckets)].T.tobytes() + (b"" if checks is None else checks.astype("<u4").tobytes())
    return len(hashes).to_bytes(4, "little") + body + zstandard.compress(b"".join(small), 1)


def unpack(raw: bytes, places: bool = True, checks: bool = False, buckets: int = 0) -> tuple[np.ndarray, ...]:
    """(hashes, docs), then places and checks as packed; hashes are comparable within their bucket."""
    n, width = int.from_bytes(raw[:4], "little"), _width(buckets)
    at = 4 + width * n
    tail = at + (4 * n if checks else 0)
    hashes = np.zeros((n, 8), dtype=np.uint8)
    hashes[:, :width] = np.frombuffer(raw[4:at], np.uint8).reshape(width, n).T
    small = zstandard.decompress(raw[tail:])
    out = [hashes.reshape(-1).view("<u8"), np.cumsum(_unplanes(small[: 8 * n], n, "<i8"))]
    if places:
        out.append(np.cumsum(_unplanes(small[8 * n :], n, "<i4")))
    if checks:
        out.append(np.frombuffer(raw[at:tail], "<u4"))
    return tuple(out)


def pack_places(docs: np.ndarray, places: np.ndarray) -> bytes:
    """Documents and positions alone, sorted by both, as differences through zstd."""
    order = np.lexsort((places, docs))
    small = [_planes(np.diff(docs[order], prepend=0).astype("<i8")), _planes(np.diff(places[order], prepend=0).astype("<i4"))]
    return len(docs).to_bytes(4, "little") + zstandard.compress(b"".join(small), 1)


def unpack_places(raw: bytes) -> tuple[np.ndarray, np.ndarray]:
    n, small = int.from_bytes(raw[:4], "little"), zstandard.decompress(raw[4:])
    return np.cumsum(_unplanes(small[: 8 * n], n, "<i8")), np.cumsum(_unplanes(small[8 * n :], n, "<i4")).astype(np.int32)


def by_bucket(hashes: np.ndarray, buckets: int):
    """Yield (bucket, indices in their old order) for every bucket that has hashes."""
    b = bucket_of(hashes, buckets)
    order = np.argsort(b.astype(np.uint16) if buckets <= 1 << 16 else b, kind="stable")
    b = b[order]
    cuts = np.flatnonzero(np.r_[True, b[1:] != b[:-1]]) if len(b) else np.zeros(0, np.int64)
    for lo, hi in zip(cuts, np.r_[cuts[1:], len(b)].astype(np.int64), strict=True):
        yield int(b[lo]), order[lo:hi]


def runs(values: np.ndarray):
    """Yield (value, start, stop) for each run of equal values."""
    if len(values):
        cuts = np.r_[0, np.flatnonzero(values[1:] != values[:-1]) + 1]
        yield from zip(values[cuts].tolist(), cuts.tolist(), np.r_[cuts[1:], len(values)].tolist(), strict=True)
