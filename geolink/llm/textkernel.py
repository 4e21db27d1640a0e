"""Vectorised word and window hashing over the UTF-8 bytes of many texts at once.

A word is ``[^\\x20\\x09-\\x0D]+``.  All functions work on one *chunk*: the
concatenated bytes of a few texts plus their offsets, about ``CHUNK_BYTES``
long, so memory per task stays small whatever a batch or a text holds.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa

#: Bytes of text that are turned into arrays at once.
CHUNK_BYTES = 1 << 20

_SPACE = np.zeros(256, dtype=bool)
_SPACE[[0x20, *range(0x09, 0x0E)]] = True
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[ord("A") : ord("Z") + 1] += 32

#: Rabin-Karp hashes are polynomials over the field of this prime; its size bounds chance collisions, its field structured ones.
PRIME = (1 << 61) - 1
_P = np.uint64(PRIME)
_GRAM_BASE = 0x11E3779B97F4A7C5 % PRIME
#: Words of more bytes are hashed one by one.
LONG_WORD = 64


def mix(x: np.ndarray) -> np.ndarray:
    """Finalise 64-bit values so that every input bit moves every output bit."""
    x = x ^ (x >> np.uint64(30))
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def fold(x: np.ndarray) -> np.ndarray:
    """Values below 2**64 modulo the prime."""
    x = (x & _P) + (x >> np.uint64(61))
    return np.where(x >= _P, x - _P, x)


def times(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Products modulo the prime, from 31-bit halves; both sides are below it."""
    low, half, m30 = np.uint64((1 << 31) - 1), np.uint64(31), np.uint64((1 << 30) - 1)
    a1, a0, b1, b0 = a >> half, a & low, b >> half, b & low
    middle = a1 * b0 + a0 * b1
    # 2**62 is 2 and 2**61 is 1 modulo the prime
    return fold(fold(a1 * b1 * np.uint64(2) + (middle >> np.uint64(30)) + ((middle & m30) << half)) + fold(a0 * b0))


class _Powers:
    """Powers of the base and of its inverse modulo the prime, grown on demand by doubling."""

    def __init__(self, base: int):
        self.base = (base, pow(base, -1, PRIME))
        self.held = [np.ones(1, dtype=np.uint64), np.ones(1, dtype=np.uint64)]

    def __call__(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        while len(self.held[0]) < n:
            for i, base in enumerate(self.base):
                have = self.held[i]
                step = np.full(len(have), pow(base, len(have), PRIME), dtype=np.uint64)
                self.held[i] = np.concatenate([have, times(have, step)])
        return self.held[0][:n], self.held[1][:n]


_gram_powers = _Powers(_GRAM_BASE)


@dataclass
class Words:
    """The words of one chunk: byte spans, the text each belongs to, and first word per text."""

    data: np.ndarray  # uint8, the chunk's bytes
    offsets: np.ndarray  # int64, text i is data[offsets[i]:offsets[i + 1]]
    starts: np.ndarray  # int64, first byte of each word
    ends: np.ndarray  # int64, byte after each word
    first: np.ndarray  # int64, text i has words first[i]:first[i + 1]

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def text_of(self) -> np.ndarray:
        return np.repeat(np.arange(len(self.first) - 1), self.counts)


def chunks(column: pa.Array, size: int = 0) -> Iterator[tuple[int, int, np.ndarray, np.ndarray]]:
    """Split a string column into (first row, last row, bytes, offsets) of about ``size`` or ``CHUNK_BYTES``; nulls are empty texts."""
    size = size or CHUNK_BYTES
    column = column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column
    column = column.cast(pa.large_string()).fill_null("")
    if not len(column):
        return
    _, where, body = column.buffers()
    offsets = np.frombuffer(where, dtype=np.int64)[column.offset : column.offset + len(column) + 1]
    data = np.frombuffer(body, dtype=np.uint8) if body is not None else np.zeros(0, np.uint8)
    at = 0
    while at < len(column):
        upto = int(np.searchsorted(offsets, offsets[at] + size, side="right")) - 1
        upto = min(max(upto, at + 1), len(column))
        yield at, upto, data[offsets[at] : offsets[upto]], offsets[at : upto + 1] - offsets[at]
        at = upto


def words(data: np.ndarray, offsets: np.ndarray) -> Words:
    """Find the words of a chunk; a text boundary always ends a word."""
    n = len(data)
    if not n:
        none = np.zeros(0, dtype=np.int64)
        return Words(data, offsets, none, none, np.zeros(len(offsets), dtype=np.int64))
    space = _SPACE[data]
    before = np.empty(n, dtype=bool)
    before[0], before[1:] = True, space[:-1]
    after = np.empty(n, dtype=bool)
    after[-1], after[:-1] = True, space[1:]
    inner = offsets[:-1][offsets[:-1] < n]
    before[inner] = True
    after[inner[inner > 0] - 1] = True
    solid = ~space
    starts = np.flatnonzero(solid & before)
    ends = np.flatnonzero(solid & after) + 1
    return Words(data, offsets, starts, ends, np.searchsorted(starts, offsets).astype(np.int64))


def word_hashes(w: Words, lower: bool = False) -> np.ndarray:
    """A 64-bit hash of each word's bytes (A-Z lower-cased first if asked).

    Blocks of eight bytes are mixed one after the other, so words of up to eight
    bytes collide only across lengths; long words go through BLAKE2.
    """
    data = _LOWER[w.data] if lower else w.data
    size = w.ends - w.starts
    out = mix((size.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15))
    padded = np.concatenate([data, np.zeros(8, np.uint8)])
    # all eight-byte blocks of the data, wherever they begin
    blocks = np.lib.stride_tricks.as_strided(padded, shape=(len(data) + 1, 8), strides=(1, 1))
    going = np.flatnonzero(size <= LONG_WORD)
    at = 0
    while len(going):
        left = np.minimum(size[going] - at, 8)
        block = np.ascontiguousarray(blocks[w.starts[going] + at]).view("<u8").ravel()
        block &= np.uint64(0xFFFFFFFFFFFFFFFF) >> ((8 - left) * 8).astype(np.uint64)
        out[going] = mix(out[going] ^ block)
        at += 8
        going = going[size[going] > at]
    raw = None
    for i in np.flatnonzero(size > LONG_WORD):
        raw = data.tobytes() if raw is None else raw
        out[i] = int.from_bytes(hashlib.blake2b(raw[w.starts[i] : w.ends[i]], digest_size=8).digest(), "little")
    return out


def _prefix(hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Prefix sums of the values times powers of the base, modulo the prime, and inverse powers."""
    up, down = _gram_powers(len(hashes) + 1)
    terms = times(fold(hashes), up[: len(hashes)])
    total = np.zeros(len(hashes) + 1, dtype=np.uint64)
    # halves add up without overflow
    high, low = np.cumsum(terms >> np.uint64(31)), np.cumsum(terms & np.uint64((1 << 31) - 1))
    total[1:] = fold(times(fold(high), np.full(len(high), 1 << 31, np.uint64)) + fold(low))
    return total, down


def _between(total: np.ndarray, first: np.ndarray, last: np.ndarray, down: np.ndarray) -> np.ndarray:
    return mix(times(fold(total[last] + (_P - total[first])), down[first]))


def window_hashes(hashes: np.ndarray, length: int) -> np.ndarray:
    """Rabin-Karp hash of every run of ``length`` consecutive values (none if there are fewer)."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint64)
    total, down = _prefix(hashes)
    at = np.arange(n)
    return _between(total, at, at + length, down)


def window_checks(hashes: np.ndarray, length: int) -> np.ndarray:
    """A second, unrelated 32-bit hash of every run: halves are joined by mixing until they cover it."""
    n = len(hashes) - length + 1
    if n <= 0:
        return np.zeros(0, dtype=np.uint32)
    have, size = mix(hashes ^ np.uint64(0xC2B2AE3D27D4EB4F)), 1
    while size < length:
        step = min(size, length - size)
        have = mix(have[: len(have) - step] * np.uint64(0x9E3779B97F4A7C15) + have[step:])
        size += step
    return (have[:n] >> np.uint64(32)).astype(np.uint32)


def run_hashes(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Hash of each text's whole word sequence."""
    total, down = _prefix(hashes)
    return _between(total, first[:-1], first[1:], down)


def joined(w: Words, keep: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each text's kept words joined by one space: (bytes, offsets)."""
    n = len(w.data)
    # +1 where a kept word starts, -1 after it
    edge = np.zeros(n + 1, dtype=np.int32)
    np.add.at(edge, w.starts[keep], 1)
    np.add.at(edge, w.ends[keep], -1)
    inside = np.cumsum(edge[:n]) > 0
    kept = np.flatnonzero(keep)
    text = w.text_of[kept]
    followed = kept[:-1][text[1:] == text[:-1]]  # kept words with another kept word of the same text after them
    gap = w.ends[followed]
    inside[gap] = True
    data = w.data.copy()
    data[gap] = 0x20
    total = np.zeros(n + 1, dtype=np.int64)
    np.cumsum(inside, out=total[1:])
    return data[inside], total[w.offsets]
