"""Words and hashes of whole Arrow string columns with numpy, a bounded slice of text at a time.

A word is a maximal run of bytes other than 0x20 and 0x09-0x0D. UTF-8 never uses these
bytes inside a longer character, so the byte scan equals the scan by code points.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash

BASE = 0x9E3779B97F4A7C15 | 1
MASK = (1 << 64) - 1


def mix(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A finaliser over 64 bits (shift, multiply); distinct salts give unrelated hashes."""
    x = x ^ np.uint64((salt * 0xD6E8FEB86659FD93) & MASK)
    x = (x ^ (x >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    x = (x ^ (x >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F)
    return x ^ (x >> np.uint64(32))


class Powers:
    """Powers of an odd base and of its inverse modulo 2**64, grown on demand."""

    def __init__(self, base: int = BASE):
        self.base, self.inverse = base, pow(base, -1, 1 << 64)
        self.up = self.down = np.ones(1, np.uint64)

    def to(self, n: int) -> tuple[np.ndarray, np.ndarray]:
        if n > len(self.up):
            size = 1 << (n - 1).bit_length()
            for name, base in (("up", self.base), ("down", self.inverse)):
                steps = np.full(size, base, np.uint64)
                steps[0] = 1
                setattr(self, name, np.multiply.accumulate(steps))
        return self.up, self.down


@dataclass
class Slice:
    """Some rows of a batch: ``data`` their bytes, ``off`` the rows' places in them."""

    first: int
    rows: int
    data: np.ndarray
    off: np.ndarray


def string_buffers(column: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Offsets and bytes of a string column without copying; nulls are empty."""
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    if column.null_count:
        column = column.fill_null("")
    wide = pa.types.is_large_string(column.type)
    _, offsets, data = column.buffers()
    off = np.frombuffer(offsets, np.int64 if wide else np.int32)[column.offset : column.offset + len(column) + 1].astype(np.int64)
    return off, np.frombuffer(data, np.uint8) if data is not None and data.size else np.zeros(0, np.uint8)


def slices(column: pa.Array, most: int = 1 << 20) -> Iterator[Slice]:
    """Rows in order, at most about ``most`` bytes at a time (a longer row comes alone)."""
    if not len(column):
        return
    off, data = string_buffers(column)
    first = 0
    while first < len(off) - 1:
        last = max(first + 1, int(np.searchsorted(off, off[first] + most, "right")) - 1)
        yield Slice(first, last - first, data[off[first] : off[last]], off[first : last + 1] - off[first])
        first = last


#: Runs of more bytes are hashed one by one.
LONG = 64
#: Masks of the first n bytes of eight, by n.
FIRST = np.array([(1 << (8 * n)) - 1 for n in range(9)], np.uint64)
SPACE = np.zeros(256, bool)
SPACE[[0x20, 0x09, 0x0A, 0x0B, 0x0C, 0x0D]] = True


def word_bounds(part: Slice) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """First byte, end and, per row, the range of words: ``off[i]:off[i+1]``."""
    n = len(part.data)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(part.rows + 1, np.int64)
    solid = ~SPACE[part.data]
    edge = np.zeros(n + 1, bool)  # a row begins here
    edge[part.off] = True
    before = np.empty(n, bool)
    before[0] = False
    before[1:] = solid[:-1]
    starts = np.flatnonzero(solid & (~before | edge[:-1]))
    after = np.empty(n, bool)
    after[-1] = False
    after[:-1] = solid[1:]
    ends = np.flatnonzero(solid & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(starts, part.off)


def word_hashes(part: Slice, starts: np.ndarray, ends: np.ndarray, salt: int = 0) -> np.ndarray:
    """64 bits for each run of bytes; distinct salts give unrelated hashes.

    Eight bytes at a time are mixed into the hash before the next come, so no two runs meet for
    reasons of form, as they do in a polynomial modulo 2**64. Runs over ``LONG`` bytes go one by one.
    """
    size = ends - starts
    data = np.concatenate([part.data, np.zeros(8, np.uint8)])
    eight = np.ndarray(len(part.data) + 1, "<u8", data, strides=(1,))
    out = mix(size.astype(np.uint64), salt + 101)
    at, live = starts, np.flatnonzero(size <= LONG)
    while len(live):
        left = np.minimum(ends[live] - at[live], 8)
        block = eight[at[live]] & FIRST[left]
        out[live] = mix(out[live] ^ mix(block, salt + 103)) * np.uint64(0xA0761D6478BD642F)
        live = live[left == 8]
        at = at + 8
        live = live[at[live] < ends[live]]
    body = None
    for i in np.flatnonzero(size > LONG).tolist():
        body = memoryview(part.data) if body is None else body
        out[i] = xxhash.xxh3_64_intdigest(body[starts[i] : ends[i]], salt)
    return mix(out, salt + 107)


def rolling(values: np.ndarray, width: int, powers: Powers, salt: int = 0) -> np.ndarray:
    """A hash of every ``width`` consecutive values (rows' borders are the caller's)."""
    n = len(values)
    if n < width:
        return np.zeros(0, np.uint64)
    up, down = powers.to(n + 1)
    run = np.zeros(n + 1, np.uint64)
    np.cumsum(mix(values, salt + 1) * up[:n], out=run[1:])
    return mix((run[width:] - run[:-width]) * down[: n - width + 1], salt + 2)


def sliding_min(values: np.ndarray, width: int) -> np.ndarray:
    """Least of every ``width`` consecutive values, by doubling."""
    span, out = 1, values
    while span * 2 <= width:
        out = np.minimum(out[:-span], out[span:]) if len(out) > span else out[:0]
        span *= 2
    if span < width:
        rest = width - span
        out = np.minimum(out[:-rest], out[rest:]) if len(out) > rest else out[:0]
    return out
