"""Which anchors of sliding windows are repeated, as a filter of a fixed size.

A window of ``width`` values holds ``width - gram + 1`` grams; its anchor is the one of least
hash (the leftmost on ties). Equal windows have equal anchors at equal distances, so a
window occurs at most as often as its anchor's gram is an anchor: counting anchors
overestimates windows too, and never loses a repeated one, with far fewer keys.
"""

from __future__ import annotations

import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame

from .scratch import forget, partitions, written
from .textscan import Powers, mix, rolling, sliding_min

DEPTH = 2
BLOCK = 20  # cells of a block, as a power of two
REST = 40  # bits by which anchors of one block are told apart
LOW = np.uint64(0xFFFFFFFF)


class Anchors:
    """Windows of a sequence of hashed values cut into rows at ``off``."""

    def __init__(self, values: np.ndarray, off: np.ndarray, width: int, gram: int, powers: Powers):
        grams = rolling(values, gram, powers, 50)
        n = max(0, len(values) - width + 1)
        ends = np.repeat(off[1:], np.diff(off))[:n]
        #: starts of whole windows, and the place of each one's anchor
        self.starts = np.flatnonzero(np.arange(n) + width <= ends)
        packed = (grams & ~LOW) | np.arange(len(grams), dtype=np.uint64)
        self.anchor = (sliding_min(packed, width - gram + 1)[self.starts] & LOW).astype(np.int64)
        #: first window of each run that shares an anchor
        self.first = np.flatnonzero(np.diff(self.anchor, prepend=-1)) if len(self.anchor) else np.zeros(0, np.int64)
        self.keys = grams[self.anchor[self.first]]

    def hot(self, bits: int, maps: np.ndarray) -> np.ndarray:
        """For each run whether the filter says that its anchor is repeated."""
        out = np.ones(len(self.keys), bool)
        block, rest = _named(self.keys, bits)
        for d in range(DEPTH):
            cell = (block << np.uint64(min(BLOCK, bits))) | _cell(rest, d, bits)
            out &= (maps[d][(cell >> np.uint64(3)).astype(np.int64)] >> (7 - (cell & np.uint64(7))).astype(np.uint8)) & 1 > 0
        return out


def _named(keys: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Block of each key, and the ``REST`` bits that stand for it there."""
    mixed = mix(keys, 60)
    high = max(0, bits - BLOCK)
    return mixed >> np.uint64(64 - high) if high else np.zeros_like(mixed), mixed & np.uint64((1 << REST) - 1)


def _cell(rest: np.ndarray, d: int, bits: int) -> np.ndarray:
    """A key's cell within its block, another part of its bits in each row."""
    return (rest >> np.uint64(d * REST // DEPTH)) & np.uint64((1 << min(BLOCK, bits)) - 1)


def repeated_cells(texts: DataFrame, scan: Callable[[], Callable[[pa.Array], Iterator[Anchors]]], bits: int, flush: int = 2_000_000) -> np.ndarray:
    """Bit maps (DEPTH x 2**bits) that hold the anchors which all partitions together meet twice.

    ``texts`` has one string column. A task sends the bits that tell its anchors apart in blocks
    whenever it holds ``flush`` of them, none more than twice. Where a block meets, its anchors are
    put in order, and those met twice alone take a cell in each row: what is met once, most
    of any text, fills no cell. The maps are DEPTH * 2**bits / 8 bytes for the driver and each worker,
    whatever the input. Two anchors count as one if ``bits - BLOCK + REST`` bits agree.
    """

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        read = scan()
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            block, rest = _named(np.concatenate(held), bits)
            both = np.sort((block << np.uint64(REST)) | rest)
            both = both[np.concatenate([[True] * min(2, len(both)), both[2:] != both[:-2]])]
            block = (both >> np.uint64(REST)).astype(np.int32)
            edge = np.flatnonzero(np.diff(block, prepend=-1))
            rests = both.astype("<u8", copy=False).view(np.uint8).reshape(-1, 8)[:, : REST // 8]
            own = [rests[a:b].tobytes() for a, b in zip(edge, np.append(edge[1:], len(both)), strict=True)]
            return pa.RecordBatch.from_arrays([pa.array(block[edge]), pa.array(own, pa.binary())], ["block", "anchors"])

        for batch in batches:
            for found in read(batch.column(0)):
                held.append(found.keys)
                size += len(found.keys)
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        met: dict[int, list[bytes]] = {}
        for batch in batches:
            for block, anchors in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                met.setdefault(block, []).append(anchors)
        while met:
            block, parts = met.popitem()
            rests = np.frombuffer(b"".join(parts), np.uint8).reshape(-1, REST // 8)
            wide = np.zeros((len(rests), 8), np.uint8)
            wide[:, : REST // 8] = rests
            own = np.sort(wide.view("<u8").ravel())
            twice = own[1:][own[1:] == own[:-1]]
            if len(twice):
                row = np.zeros((DEPTH, 1 << min(BLOCK, bits)), bool)
                for d in range(DEPTH):
                    row[d, _cell(twice, d, bits).astype(np.int64)] = True
                yield pa.RecordBatch.from_arrays([pa.array([block], pa.int32()), pa.array([zlib.compress(np.packbits(row).tobytes(), 1)], pa.binary())], ["block", "bits"])

    sent = texts.mapInArrow(send, "block int, anchors binary")
    met = written(sent.repartition(partitions(texts.sparkSession), "block").mapInArrow(merge, "block int, bits binary"), "sketch-bits")
    maps = np.zeros((DEPTH, (1 << bits) // 8), np.uint8)
    size = (1 << min(BLOCK, bits)) // 8
    for r in met.toLocalIterator():
        k = r["block"] * size
        maps[:, k : k + size] = np.frombuffer(zlib.decompress(r["bits"]), np.uint8).reshape(DEPTH, size)
    forget(met)
    return maps


def levels(batches_of: DataFrame, read: Callable[[], Callable[[pa.RecordBatch], Iterator[np.ndarray]]], bits: int, flush: int = 2_000_000) -> np.ndarray:
    """How often each of 2**bits cells is met by the hashes that ``read`` draws from all batches:
    0 never, 1 once, else 2 and more, growing with the logarithm of the count.

    Tasks send distinct cells with their counts, in blocks; a block is summed where it meets, and
    comes back as a byte a cell: 2**bits bytes for the driver and each worker, whatever the input.
    """
    width = min(BLOCK, bits)

    def send(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        draw = read()
        held: list[np.ndarray] = []
        size = 0

        def out() -> pa.RecordBatch:
            cell, n = np.unique((np.concatenate(held) >> np.uint64(64 - bits)).astype(np.int64), return_counts=True)
            edge = np.flatnonzero(np.diff(cell >> width, prepend=-1))
            spans = list(zip(edge, np.append(edge[1:], len(cell)), strict=True))
            return pa.RecordBatch.from_arrays([
                pa.array([int(cell[a] >> width) for a, _ in spans], pa.int32()),
                pa.array([(cell[a:b] & ((1 << width) - 1)).astype("<u4").tobytes() for a, b in spans], pa.binary()),
                pa.array([n[a:b].astype("<u4").tobytes() for a, b in spans], pa.binary()),
            ], ["block", "cells", "n"])

        for batch in batches:
            for keys in draw(batch):
                held.append(keys)
                size += len(keys)
                if size >= flush:
                    yield out()
                    held, size = [], 0
        if size:
            yield out()

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[int, np.ndarray] = {}
        for batch in batches:
            for block, cells, n in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                own = sums.setdefault(block, np.zeros(1 << width, np.int64))
                own[np.frombuffer(cells, "<u4")] += np.frombuffer(n, "<u4")
        if sums:
            level = [np.where(x > 1, 2 + 4 * np.log2(np.maximum(x, 2)) - 4, x).astype(np.uint8) for x in sums.values()]
            yield pa.RecordBatch.from_arrays([pa.array(list(sums), pa.int32()), pa.array([zlib.compress(x.tobytes(), 1) for x in level], pa.binary())], ["block", "level"])

    sent = batches_of.mapInArrow(send, "block int, cells binary, n binary")
    met = written(sent.repartition(partitions(batches_of.sparkSession), "block").mapInArrow(merge, "block int, level binary"), "sketch-levels")
    out = np.zeros(1 << bits, np.uint8)
    for r in met.toLocalIterator():
        out[r["block"] << width : (r["block"] + 1) << width] = np.frombuffer(zlib.decompress(r["level"]), np.uint8)
    forget(met)
    return out
