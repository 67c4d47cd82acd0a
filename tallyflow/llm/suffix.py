"""Repeated byte strings across documents by suffix sorting."""

from __future__ import annotations

from collections import Counter
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import forget, free, partitions, text_id, written
from .sketch import Anchors, repeated_cells
from .textscan import Powers, rolling, slices

LAST = (1 << 63) - 1


def suffix_array(text: list[int]) -> list[int]:
    """Suffixes in order, by linear grouping construction. ``text`` ends with its only least value.

    First, groups of suffixes that start alike are taken in descending order. Each member points
    to the nearest earlier suffix in a lower group; those pointed to move, most often pointed to
    first, to a new group right above their own. In the end a group holds the suffixes with one
    Lyndon prefix. Then each group's order comes out from left to right: the suffix before
    the one just placed is the next of its group, and so are those its pointers lead to.
    """
    n = len(text)
    place = sorted(range(n), key=text.__getitem__)
    at = [0] * n
    group = [0] * n  # first place of a suffix's group
    size = [0] * n  # by first place
    start = 0
    for i, s in enumerate(place):
        if i and text[s] != text[place[i - 1]]:
            start = i
        at[s] = i
        group[s] = start
        size[start] += 1
    before = [-1] * n
    end = n
    while end > 0:
        start = group[place[end - 1]]
        members = place[start:end]
        if len(members) > 1:
            members.sort()
        aims: list[int] = []
        for s in members:
            p = s - 1
            while p >= 0 and group[p] >= start:
                p = before[p]
            before[s] = p
            if p >= 0:
                aims.append(p)
        if len(aims) == 1:
            rounds = [aims]
        else:
            times = Counter(aims)
            by: dict[int, list[int]] = {}
            for p, k in times.items():
                by.setdefault(k, []).append(p)
            rounds = [by[k] for k in sorted(by, reverse=True)]
        for chosen in rounds:
            sets: dict[int, list[int]] = {}
            for p in chosen:
                sets.setdefault(group[p], []).append(p)
            for g, own in sets.items():
                if len(own) == size[g]:
                    continue
                size[g] -= len(own)
                new = g + size[g]
                size[new] = len(own)
                to = new
                for p in own:
                    group[p] = new
                # those of the set that stand below the new group change places with others in it
                inside = {p for p in own if at[p] >= new}
                for p in own:
                    if p in inside:
                        continue
                    while place[to] in inside:
                        to += 1
                    q, i = place[to], at[p]
                    place[to], place[i] = p, q
                    at[p], at[q] = to, i
                    to += 1
        end = start
    front = list(range(n))
    done = [False] * n
    done[n - 1] = True
    place[0] = n - 1
    for i in range(n):
        s = place[i] - 1
        while s >= 0 and not done[s]:
            g = group[s]
            place[front[g]] = s
            front[g] += 1
            done[s] = True
            s = before[s]
    return place


def least_owner(segments: list[bytes], owners: list[int], width: int) -> list[list[int]]:
    """For each window of ``width`` bytes of each segment the least owner of any segment that
    holds the same window, read off runs of the suffix array of all segments."""
    text: list[int] = []
    offset, who, left = [], [], []
    for k, s in enumerate(segments):
        offset.append(len(text))
        text.extend([b + 2 for b in s])
        text.append(1)
        who += [k] * (len(s) + 1)
        left += range(len(s), -1, -1)
    text.append(0)
    body = b"\n".join(segments)
    out = [[0] * max(0, len(s) - width + 1) for s in segments]
    run: list[int] = []
    window = None

    def settle() -> None:
        least = min(owners[who[p]] for p in run)
        for p in run:
            out[who[p]][p - offset[who[p]]] = least

    for p in suffix_array(text)[1:]:
        if left[p] < width:
            continue
        own = body[p : p + width]
        if own != window:
            if run:
                settle()
            run, window = [], own
        run.append(p)
    if run:
        settle()
    return out


def maybe_shared(segments: list[bytes], width: int, powers: Powers) -> list[list[tuple[int, int]]]:
    """For each segment the runs of windows, [first, last], whose hash is met twice or more; the
    windows elsewhere have no equal."""
    off = np.zeros(len(segments) + 1, np.int64)
    np.cumsum([len(s) for s in segments], out=off[1:])
    flat = np.frombuffer(b"".join(segments), np.uint8).astype(np.uint64)
    n = max(0, len(flat) - width + 1)
    start = np.flatnonzero(np.arange(n) + width <= np.repeat(off[1:], np.diff(off))[:n])
    _, which, times = np.unique(rolling(flat, width, powers, 30)[start], return_inverse=True, return_counts=True)
    start = start[times[which] > 1]
    row = np.searchsorted(off, start, "right") - 1
    edge = np.flatnonzero((np.diff(start, prepend=-2) != 1) | (np.diff(row, prepend=-1) != 0))
    out: list[list[tuple[int, int]]] = [[] for _ in segments]
    for lo, hi in zip(edge.tolist(), [*edge[1:].tolist(), len(start)] if len(edge) else [], strict=True):
        r = int(row[lo])
        out[r].append((int(start[lo] - off[r]), int(start[hi - 1] - off[r])))
    return out


def owned_runs(anchors: list[int], segments: list[bytes], leasts: list[int], mosts: list[int], width: int, powers: Powers) -> list[tuple[int, int, int, int]]:
    """(segment, first byte, end, least owner) of the runs of windows that some row of the
    segment may lose: those whose least owner lies below ``mosts``.

    Windows met in no other segment are the segment's own. The rest are cut out; cuts of equal
    bytes under one anchor are one, and those that stand beside others are sorted.
    """
    cuts: dict[tuple[int, bytes], list] = {}
    out = []
    for i, runs in enumerate(maybe_shared(segments, width, powers)):
        end, here = len(segments[i]) - width, 0
        for lo, hi in runs:
            if lo > here:
                out.append((i, here, lo - 1 + width, leasts[i]))
            here = hi + 1
            own = cuts.setdefault((anchors[i], segments[i][lo : hi + width]), [leasts[i], []])
            own[0] = min(own[0], leasts[i])
            own[1].append((i, lo))
        if here <= end:
            out.append((i, here, end + width, leasts[i]))
    many = Counter(a for a, _ in cuts)
    mixed = [(body, own) for (a, body), own in cuts.items() if many[a] > 1]
    found = least_owner([body for body, _ in mixed], [own[0] for _, own in mixed], width) if mixed else []
    placed = [(own[1], least) for (_, own), least in zip(mixed, found, strict=True)]
    placed += [(own[1], [own[0]] * (len(body) - width + 1)) for (a, body), own in cuts.items() if many[a] == 1]
    for places, least in placed:
        steps = [k for k in range(len(least)) if k == 0 or least[k] != least[k - 1]]
        for k, last in zip(steps, [*steps[1:], len(least)], strict=True):
            out += [(i, lo + k, lo + last - 1 + width, least[k]) for i, lo in places]
    return [x for x in out if x[3] < mosts[x[0]]]


def byte_windows(width: int, gram: int) -> Callable[[], Callable]:
    def scan() -> Callable[[pa.Array], Iterator[Anchors]]:
        powers = Powers()

        def read(column: pa.Array) -> Iterator[Anchors]:
            for part in slices(column):
                yield Anchors(part.data.astype(np.uint64), part.off, width, gram, powers)

        return read

    return scan


def dealt_anew(anchor: int, seg: bytes, width: int, gram: int, powers: Powers) -> list[tuple[int, int, bytes]]:
    """(key, first byte, bytes): parts of a segment that together hold all its windows, each under a
    key that says more of the window than the anchor does.

    A window's place relative to its anchor falls in one of a few ranges (0, 1, 2-3, 4-7, ...). All
    windows of a range hold the same bytes left and right of the anchor, as many as its least and
    greatest place allow: they make the key. Equal windows have one place, so one key.
    """
    here = np.flatnonzero(rolling(np.frombuffer(seg, np.uint8).astype(np.uint64), gram, powers, 50) == np.uint64(anchor & ((1 << 64) - 1)))
    p = int(here[0])
    out, lo = [], 0
    while lo <= width - gram:
        hi = min(max(lo, 2 * lo - 1), width - gram)
        least, most = max(lo, p - (len(seg) - width)), min(hi, p)
        if least <= most:
            core = seg[p - lo : p + gram + width - gram - hi]
            out.append((xxhash.xxh3_64_intdigest(core, lo + 1) - (1 << 63), p - most, seg[p - most : p - least + width]))
        lo = hi + 1
    return out


def remove_repeated_bytes(docs: DataFrame, width: int = 50, bits: int = 28, shard: int = 1 << 18, crowd: int = 4096) -> DataFrame:
    """Drop every byte covered by a string of ``width`` bytes that also starts in a document with
    a smaller doc_id; strings are judged on the input and lie within one document.

    Adds n_bytes, n_removed, n_spans (maximal removed runs) and kept (binary), replacing columns
    of these names; ``text`` stays. Null texts are empty; a null doc_id counts as larger than all
    others; rows of one doc_id don't remove each other's bytes. An empty table gives none.

    Rows of equal text are one class, for which a row of the least doc_id speaks; the others
    lose all (from ``width`` bytes on). The sketch marks strings that may be repeated. Strings
    with one anchor stand side by side in segments of at most 2 * width bytes, so equal
    strings meet where their anchor's distinct segments do; there a suffix array groups those
    whose hash is met twice. An anchor of more than ``crowd`` segments is split: its segments are cut
    into parts by what stands left and right of the anchor (``dealt_anew``), which meet by that too. A
    segment is named by its anchor and a hash, 128 bits, afterwards.
    """
    gram = max(1, width - 26)
    plain = docs.drop("n_bytes", "n_removed", "n_spans", "kept")
    id_, at_, all_, first_ = free(plain, "_id", "_at", "_all", "_first")
    plain = plain.withColumn(id_, text_id("text"))
    owner = F.coalesce(F.col("doc_id"), F.lit(LAST))
    sure = plain.filter(F.col("text").isNotNull()).select(F.col(id_).alias("_node"), owner.alias("_d"), "text")
    copies = written(sure.groupBy("_node").agg(F.count("*").alias("_n"), F.min("_d").alias("_first")).filter("_n > 1").select("_node", "_first"), "byte-copies")
    spoken = sure.join(copies, "_node", "left").filter(F.col("_first").isNull() | (F.col("_d") == F.col("_first")))
    maps = repeated_cells(spoken.select("text"), byte_windows(width, gram), bits)
    shared = docs.sparkSession.sparkContext.broadcast(maps)

    def segments(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Segments by the number of their row; each numbered row also comes with its text's name."""
        powers, maps = Powers(), shared.value
        number = TaskContext.get().partitionId() << 33
        names = ["anchor", "seg", "row", "_d", "at", "_node"]
        for batch in batches:
            d = batch.column(1).to_numpy()
            for part in slices(batch.column(2)):
                found = Anchors(part.data.astype(np.uint64), part.off, width, gram, powers)
                hot = found.hot(bits, maps)
                lo = found.starts[found.first[hot]]
                hi = found.starts[np.append(found.first[1:], len(found.starts))[hot] - 1] + width if len(lo) else lo
                if len(lo):
                    row = np.searchsorted(part.off, lo, "right") - 1
                    body = part.data.tobytes()
                    some = np.unique(row)
                    none = pa.nulls(len(some), pa.int64())
                    yield pa.RecordBatch.from_arrays([none, pa.nulls(len(some), pa.binary()), pa.array(number + part.first + some), none, pa.nulls(len(some), pa.int32()), batch.column(0).take(pa.array(part.first + some))], names)
                    segs = pa.array([body[a:b] for a, b in zip(lo.tolist(), hi.tolist(), strict=True)], pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(found.keys[hot].view(np.int64)), segs, pa.array(number + part.first + row), pa.array(d[part.first + row]), pa.array((lo - part.off[row]).astype(np.int32)), pa.nulls(len(row), pa.binary())], names)
            number += batch.num_rows

    held = written(spoken.select("_node", "_d", "text").mapInArrow(segments, "anchor long, seg binary, row long, _d long, at int, _node binary"), "byte-segments")
    found = held.filter("_node IS NULL")
    distinct = written(found.groupBy("anchor", "seg").agg(F.min("_d").alias("least"), F.max("_d").alias("most")), "byte-distinct")

    def owners(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come sorted by anchor; anchors are sorted together up to ``shard`` bytes."""
        powers = Powers()
        rows: list[tuple[int, bytes, int, int]] = []
        size, last = 0, None

        def out() -> pa.RecordBatch:
            found = owned_runs([r[0] for r in rows], [r[1] for r in rows], [r[2] for r in rows], [r[3] for r in rows], width, powers)
            at, lo, hi, least = [pa.array([f[c] for f in found], pa.int64()) for c in range(4)]
            of = [rows[f[0]] for f in found]
            return pa.RecordBatch.from_arrays([pa.array([r[0] for r in of], pa.int64()), pa.array([r[1] for r in of], pa.binary()), lo, hi, least], ["anchor", "seg", "lo", "hi", "owner"])

        for batch in batches:
            for row in zip(*[c.to_pylist() for c in batch.columns], strict=True):
                if size >= shard and row[0] != last:
                    yield out()
                    rows, size = [], 0
                rows.append(row)
                size += len(row[1])
                last = row[0]
        if rows:
            yield out()

    def placed(found: DataFrame, name: str) -> DataFrame:
        found = found.repartition(partitions(docs.sparkSession), "anchor").sortWithinPartitions("anchor")
        found = found.mapInArrow(owners, "anchor long, seg binary, lo long, hi long, owner long")
        return written(found.select("anchor", F.xxhash64("seg").alias("h"), "lo", "hi", "owner"), name)

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers = Powers()
        for batch in batches:
            rows = [(i, *part) for i, (anchor, seg) in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True)) for part in dealt_anew(anchor, seg, width, gram, powers)]
            own = batch.take(pa.array([r[0] for r in rows], pa.int64()))
            kinds = (pa.int64(), pa.int64(), pa.binary())
            yield pa.RecordBatch.from_arrays([own.column(0), own.column(2), own.column(3), own.column(4), *[pa.array([r[k + 1] for r in rows], t) for k, t in enumerate(kinds)]], ["old", "h", "least", "most", "anchor", "shift", "seg"])

    crowded = written(distinct.groupBy("anchor").count().filter(F.col("count") > crowd).select("anchor"), "byte-crowded")
    if crowded.limit(1).count():
        parts = distinct.join(crowded, "anchor").select("anchor", "seg", F.xxhash64("seg").alias("h"), "least", "most")
        parts = written(parts.mapInArrow(split, "old long, h long, least long, most long, anchor long, shift long, seg binary"), "byte-parts")
        alike = parts.groupBy("anchor", "seg").agg(F.min("least").alias("least"), F.max("most").alias("most"))
        known = placed(alike, "byte-part-owners").withColumnRenamed("h", "k")
        known = parts.withColumn("k", F.xxhash64("seg")).join(known, ["anchor", "k"]).filter(F.col("owner") < F.col("most"))
        known = known.select(F.col("old").alias("anchor"), "h", (F.col("lo") + F.col("shift")).alias("lo"), (F.col("hi") + F.col("shift")).alias("hi"), "owner")
        owned = placed(distinct.join(crowded, "anchor", "left_anti"), "byte-owners").unionByName(known)
    else:
        owned = placed(distinct, "byte-owners")

    forget(distinct, crowded)

    def removed() -> DataFrame:
        own = found.select("anchor", F.xxhash64("seg").alias("h"), "row", "_d", "at")
        hits = own.join(owned, ["anchor", "h"]).filter(F.col("owner") < F.col("_d"))
        hits = hits.select("row", F.struct((F.col("at") + F.col("lo")).alias("lo"), (F.col("at") + F.col("hi")).alias("hi")).alias("_at"))
        named = hits.groupBy("row").agg(F.collect_list("_at").alias("_at")).join(held.filter("_node IS NOT NULL").select("row", "_node"), "row")
        # rows of one text and one doc_id speak alike
        return named.groupBy("_node").agg(F.first("_at").alias("_at")).join(copies, "_node", "full")

    spans = written(removed(), "byte-spans")
    forget(held)
    mine = [c for c in plain.columns if c != id_]
    spans = spans.select(F.col("_node").alias(id_), F.col("_at").alias(at_), F.col("_first").alias(first_))
    tagged = plain.join(spans, id_, "left").withColumn(all_, F.coalesce(F.col(first_) < owner, F.lit(False))).select(*mine, at_, all_)
    text = mine.index("text")
    names = ["n_bytes", "n_removed", "n_spans", "kept"]

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = batch.column(-2), batch.column(-1).to_pylist()
            batch = batch.select(range(batch.num_columns - 2))
            for part in slices(batch.column(text)):
                out: list[list] = [[] for _ in names]
                for i, (lo, hi) in enumerate(zip(part.off[:-1], part.off[1:], strict=True)):
                    data, n = part.data[lo:hi], int(hi - lo)
                    gone = np.zeros(n, bool)
                    if whole[part.first + i]:
                        gone[:] = n >= width
                    elif (own := at[part.first + i]).is_valid:
                        step = np.zeros(n + 1, np.int64)
                        np.add.at(step, np.asarray(own.values.field("lo")), 1)
                        np.add.at(step, np.asarray(own.values.field("hi")), -1)
                        gone = np.cumsum(step)[:-1] > 0
                    for column, value in zip(out, (n, int(gone.sum()), int((np.diff(gone.astype(np.int8), prepend=0) > 0).sum()), data[~gone].tobytes()), strict=True):
                        column.append(value)
                own = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(x, pa.int64()) for x in out[:3]], pa.array(out[3], pa.binary())], [*own.schema.names, *names])

    kinds = T.StructType([*tagged.schema[:-2], *[T.StructField(n, T.LongType()) for n in names[:3]], T.StructField("kept", T.BinaryType())])
    return tagged.mapInArrow(cut, kinds)
