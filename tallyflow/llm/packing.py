"""Best-fit packing by bin completion.

Only the number of pieces of each length matters to the packing, and there are at most
``capacity`` lengths. The search therefore runs on that histogram (a proven bound, whatever
the corpus) and yields patterns with repeat counts; pieces then take their places in
parallel by their rank among the pieces of their length.
"""

from __future__ import annotations

import os
import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import partitions, written
from .textscan import slices

BLANKS = "\t\n\x0b\x0c\r"
MARKS = ".,*&%$#:;!?()|-"


def _spaced(text: str) -> str:
    for blank in BLANKS:
        text = text.replace(blank, " ")
    return text


class ChunkTokenizer:
    """Ids of whole texts. The vocabulary drops white space and no token spans it, so the ids
    of a text are those of its chunks between blanks. Letters and the marks after them are
    tokens of their own and case doesn't count, so a chunk's ids are those of its lower-cased
    letters and of its marks. What is known stays for the worker's later tasks, up to about
    2 * ``keep`` chunks and as many parts, those met last."""

    def __init__(self, path: str, keep: int = 350_000):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        import tokenizers

        self.tokenizer, self.keep = tokenizers.Tokenizer.from_file(path), keep
        to_bytes = tokenizers.pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)
        self.spelled = {k: to_bytes.pre_tokenize_str(chr(k))[0][0] for k in [*range(33, 127), *range(0xC0, 0x250)]}
        held = tokenizers.__dict__.setdefault("_tallyflow_known", {})
        if path not in held:
            # the shortcuts hold for lower-casing byte-level vocabularies that drop white space
            probe = "Abc,  def\nGhi!! x"
            apart = self._whole(probe) == b"".join(self._part(x) for x in ("abc", ",", "def", "ghi", "!!", "x"))
            letters = "".join(c for c in map(chr, [*range(65, 91), *range(97, 123), *range(0xC0, 0x250)]) if self._plain(c))
            pattern = re.compile(f"([{letters}]+)([{re.escape(MARKS)}]*)") if letters else None
            held[path] = [[{"": b""}, {}], [{"": b""}, {}], apart and pattern is not None, pattern]
        self.chunks, self.parts, self.apart, self.letters_marks = held[path]

    def _whole(self, text: str) -> bytes:
        return np.asarray(self.tokenizer.encode(text, add_special_tokens=False).ids, "<u4").tobytes()

    def _plain(self, c: str) -> bool:
        """Whether a letter goes by its lower case alone: by itself, within a word and before a mark."""
        low = c.lower()
        return c.isalpha() and all(ord(x) in self.spelled for x in low) and all(
            self._whole(before + c + after + mark) == self._part((before + c + after).lower()) + (self._part(mark) if mark else b"")
            for before, after, mark in (("", "", ""), ("a", "", ""), ("", "a", ""), ("ab", "cd", ""), ("", "", "."), ("a", "", "(!"))
        )

    def _part(self, part: str) -> bytes:
        """A token's ids without the steps before the merges: it is normal and one piece already."""
        return np.asarray([t.id for t in self.tokenizer.model.tokenize(part.translate(self.spelled))], "<u4").tobytes()

    def encode(self, texts: list[str]) -> list[bytes]:
        """Little-endian unsigned 32-bit ids of each text."""
        if not self.apart:
            return [self._whole(t) for t in texts]
        split = [_spaced(t).split(" ") for t in texts]
        for held in (self.chunks, self.parts):
            if len(held[0]) > self.keep:  # what is met again comes back from the old ones
                held[:] = {"": b""}, held[0]
        (known, old), (parts, old_parts) = self.chunks, self.parts
        for c in set().union(*split).difference(known):
            ids = old.get(c)
            if ids is None:
                m = self.letters_marks.fullmatch(c)
                if m:
                    letters, marks = m[1].lower(), m[2]
                    for x in (letters, marks):
                        if x not in parts:
                            parts[x] = old_parts.get(x) or self._part(x)
                    ids = parts[letters] + parts[marks]
                else:
                    ids = self._whole(c)
            known[c] = ids
        return [b"".join(map(known.__getitem__, chunks)) for chunks in split]


def pieces(docs: DataFrame, tokenizer: str, capacity: int, eos: int, with_ids: bool = False, keep: int = 350_000) -> DataFrame:
    """Every document's ids, then ``eos``, cut at ``capacity``; null text counts as empty."""
    kinds = "doc_id long, piece int, start long, length long, ids_crc32 long" + (", ids array<long>" if with_ids else "")
    schema = pa.schema([("doc_id", pa.int64()), ("piece", pa.int32()), ("start", pa.int64()), ("length", pa.int64()), ("ids_crc32", pa.int64())] + ([("ids", pa.list_(pa.int64()))] if with_ids else []))
    tail = np.asarray([eos], "<u4").tobytes()

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tok = ChunkTokenizer(tokenizer, keep)
        for batch in batches:
            for few in slices(batch.column(1)):
                part = batch.slice(few.first, few.rows)
                out: list[list] = [[] for _ in schema]
                texts = [t or "" for t in part.column(1).to_pylist()]
                for doc, ids in zip(part.column(0).to_pylist(), tok.encode(texts), strict=True):
                    ids += tail
                    for k, p in enumerate(range(0, len(ids), 4 * capacity)):
                        own = ids[p : p + 4 * capacity]
                        row = [doc, k, p // 4, len(own) // 4, zlib.crc32(own)] + ([np.frombuffer(own, "<u4").tolist()] if with_ids else [])
                        for column, value in zip(out, row, strict=True):
                            column.append(value)
                yield pa.record_batch([pa.array(x, f.type) for x, f in zip(out, schema, strict=True)], schema=schema)

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(cut, kinds)


def best_fit_decreasing(counts: dict[int, int], capacity: int) -> list[tuple[tuple[int, ...], int]]:
    """Best-fit decreasing on the histogram: equal pieces and equal bins move together."""
    open_: dict[int, list[list]] = {}
    rooms: list[int] = []

    def put(room: int, items: tuple[int, ...], n: int) -> None:
        if n:
            if room not in open_:
                insort(rooms, room)
                open_[room] = []
            open_[room].append([items, n])

    for length in sorted(counts, reverse=True):
        left = counts[length]
        while left:
            i = bisect_left(rooms, length)
            if i == len(rooms):
                fit = capacity // length
                full, rest = divmod(left, fit)
                put(capacity - fit * length, (length,) * fit, full)
                if rest:
                    put(capacity - rest * length, (length,) * rest, 1)
                break
            room = rooms[i]
            group = open_[room]
            items, n = group.pop()
            if not group:
                del open_[room], rooms[i]
            fit = room // length
            if left < fit:
                put(room, items, n - 1)
                put(room - left * length, items + (length,) * left, 1)
                left = 0
            else:
                use = min(n, left // fit)
                put(room, items, n - use)
                put(room - fit * length, items + (length,) * fit, use)
                left -= use * fit
    return [(items, n) for groups in open_.values() for items, n in groups]


def dominated(count: np.ndarray, fill: tuple[int, ...], waste: int) -> bool:
    """Whether a remaining piece still fits in the filling's waste, one of its pieces can give way
    to a longer remaining one within the waste, or two can give way to one."""
    free = count.copy()
    for t in fill:
        free[t] -= 1
    if free[1 : waste + 1].any() or any(free[t + 1 : t + waste + 1].any() for t in set(fill)):
        return True
    return any(free[a + b : a + b + waste + 1].any() for i, a in enumerate(fill) for b in fill[i + 1 :])


def all_fillings(count: np.ndarray, room: int, most: int) -> Iterator[tuple[int, ...]]:
    """Every undominated filling of ``room`` that wastes at most ``most``, one at a time: pieces are
    taken in falling order, the longest first. Between two fillings nothing but the pieces taken is kept,
    as a search holds thousands of these; ``count`` must then be what it was before."""
    if room and count[room]:  # dominates every other
        yield (room,)
        return
    fill: list[int] = []

    def longest(end: int) -> int:
        """The longest piece left of at most ``end``; 0 if there is none."""
        while end > 0:
            end -= int((count[end::-1] > 0).argmax())
            if end <= 0 or count[end] <= 0:
                return 0
            if count[end] > fill.count(end):
                return end
            end -= 1
        return 0

    space = end = room
    while True:
        while piece := longest(min(space, end)):
            fill.append(piece)
            space, end = space - piece, piece
        own = tuple(fill)
        if space <= most and not dominated(count, own, space):
            yield own
        if not fill:
            return
        end = fill.pop()
        space, end = space + end, end - 1


def fillings(count: np.ndarray, room: int, width: int) -> list[tuple[int, ...]]:
    """The most promising undominated fillings of ``room``, least waste first, at most ``width``:
    completions by best pairs around several first pieces."""
    here = np.flatnonzero(count[: room + 1])
    if not len(here):
        return [()]
    if here[-1] == room:
        return [(int(room),)]
    found: set[tuple[int, ...]] = set()
    least = int(here[0])

    def pair(space: int, taken: tuple[int, ...]) -> tuple[int, ...]:
        """The two pieces (or the one) that leave least of ``space``."""
        free = count[: space + 1].copy()
        for t in taken:
            if t <= space:
                free[t] -= 1
        own = np.flatnonzero(free > 0)
        if not len(own):
            return ()
        best = (int(own[-1]),)
        if space - best[0] == 0:
            return best
        partner = np.searchsorted(own, space - own, "right") - 1
        ok = partner >= 0
        x, y = own[ok], own[np.maximum(partner[ok], 0)]
        twin = (x == y) & (free[x] < 2)
        idx = partner[ok]
        y = np.where(twin & (idx > 0), own[np.maximum(idx - 1, 0)], y)
        good = ~(twin & (idx == 0))
        if good.any():
            total = np.where(good, x + y, 0)
            k = int(len(total) - 1 - np.argmax(total[::-1]))
            if total[k] > best[0]:
                best = tuple(sorted((int(x[k]), int(y[k])), reverse=True))
        return best

    heads: list[tuple[int, ...]] = [()] + [(int(x),) for x in here[::-1][: 2 * width]]
    if len(here) > 2 * width:
        heads += [(int(x),) for x in here[:: max(1, len(here) // width)]]
    for head in heads:
        fill, space = head, room - sum(head)
        while space >= least:
            more = pair(space, fill)
            if not more:
                break
            fill += more
            space -= sum(more)
        found.add(tuple(sorted(fill, reverse=True)))

    kept = [f for f in found if not dominated(count, f, room - sum(f))] or [max(found, key=sum)]
    return sorted(kept, key=lambda f: (room - sum(f), len(f), tuple(-x for x in f)))[:width]


def plan(counts: dict[int, int], capacity: int, nodes: int | None = None, width: int = 4) -> list[tuple[tuple[int, ...], int]]:
    """Patterns of lengths with their repeat counts; together they use every piece once.

    Depth-first bin completion: each node completes a bin around the largest remaining piece, as
    often as the counts allow. A branch ends when its waste exceeds what the best packing so far
    leaves to gain. The first incumbent is best-fit decreasing. A first search tries the ``width``
    most promising fillings of each node; if that ends without reaching the lower bound, a second
    one enumerates all undominated fillings. ``nodes`` (unset: 6000 and 8 for each length)
    bounds the two together; beyond it the best packing found stands.
    """
    counts = {int(k): int(n) for k, n in counts.items() if n}
    if not counts:
        return []
    total = sum(k * n for k, n in counts.items())
    big = sum(n for k, n in counts.items() if 2 * k > capacity)
    floor = max(-(-total // capacity), big)
    best = best_fit_decreasing(counts, capacity)
    fewest = sum(n for _, n in best)
    count = np.zeros(capacity + 1, np.int64)
    for k, n in counts.items():
        count[k] = n
    left = nodes if nodes is not None else 6000 + 8 * len(counts)
    for wide in (False, True):
        if fewest <= floor or left <= 0:
            break
        best, fewest, left = _search(count.copy(), capacity, total, floor, best, fewest, left, width, wide)
    return best


def _search(count: np.ndarray, capacity: int, total: int, floor: int, best: list, fewest: int, nodes: int, width: int, wide: bool) -> tuple[list, int, int]:
    """A better packing than ``best``, if there is one within ``nodes``; and the nodes left."""
    path: list[tuple[tuple[int, ...], int]] = []
    stack: list[list] = []  # of levels: fillings still to try, the piece, whether one is in place
    waste = bins = 0
    spare = fewest * capacity - total - capacity  # waste that still saves a sequence

    def level() -> list:
        top = int(np.flatnonzero(count)[-1])
        rest = count.copy()
        rest[top] -= 1
        tries = without(top, max(0, spare - waste)) if wide else iter(fillings(rest, capacity - top, width))
        return [tries, top, False]

    def without(top: int, most: int) -> Iterator[tuple[int, ...]]:
        """Fillings beside a piece that is out of the counts only while the next one is sought."""
        tries = all_fillings(count, capacity - top, most)
        while True:
            count[top] -= 1
            fill = next(tries, None)
            count[top] += 1
            if fill is None:
                return
            yield fill

    stack.append(level())
    while stack and nodes:
        now = stack[-1]
        if now[2]:  # undo
            items, n = path.pop()
            for x in items:
                count[x] += n
            waste -= n * (capacity - sum(items))
            bins -= n
            now[2] = False
        fill = next(now[0], None)
        if fill is None:
            stack.pop()
            continue
        nodes -= 1
        items = (now[1], *fill)
        need: dict[int, int] = {}
        for x in items:
            need[x] = need.get(x, 0) + 1
        n = 1 if wide else min(int(count[x]) // k for x, k in need.items())
        lost = capacity - sum(items)
        if waste + n * lost > spare:
            n = 1 if waste + lost <= spare else 0
        if not n:
            continue
        for x in items:
            count[x] -= n
        waste, bins, now[2] = waste + n * lost, bins + n, True
        path.append((items, n))
        if not count.any():
            if bins < fewest:
                best, fewest = list(path), bins
                spare = fewest * capacity - total - capacity
                if fewest <= floor:
                    break
        else:
            stack.append(level())
    return best, fewest, nodes


def pack(docs: DataFrame, tokenizer: str, capacity: int = 4096, eos: int = 1, with_ids: bool = False, keep: int = 350_000) -> DataFrame:
    """Place every document's pieces in sequences of at most ``capacity`` ids, as few as found.

    Takes ``doc_id`` and ``text``; other columns are left out. Null text is empty (one id, the
    end mark); ``keep`` bounds each worker's memory of chunks already split; a null doc_id stays null; repeated rows are packed each; an empty table gives no
    rows. Returns doc_id, piece, start, length, ids_crc32, sequence_id, offset (and ids).
    """
    spark = docs.sparkSession
    cut = written(pieces(docs, tokenizer, capacity, eos, with_ids, keep), "pieces")
    counts = {r["length"]: r["n"] for r in cut.groupBy("length").agg(F.count("*").alias("n")).collect()}  # at most `capacity` rows
    rows, first, sequence = [], dict.fromkeys(counts, 0), 0
    for items, n in plan(counts, capacity):
        place, spots = 0, {}
        for x in items:
            spots.setdefault(x, []).append(place)
            place += x
        for x, offsets in spots.items():
            rows.append((x, first[x], first[x] + n * len(offsets), sequence, offsets))
            first[x] += n * len(offsets)
        sequence += n
    segments = spark.createDataFrame(rows, T.StructType.fromDDL("length long, lo long, hi long, base long, offsets array<long>"))
    # Rank of a piece among those of its length: hot lengths are split over buckets, whose totals are summed.
    dealt = cut.withColumn("bucket", F.pmod(F.xxhash64("doc_id", "piece", "ids_crc32"), F.lit(4 * partitions(spark))))
    totals = dealt.groupBy("length", "bucket").agg(F.count("*").alias("n"))
    before = F.sum("n").over(Window.partitionBy("length").orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1))
    totals = totals.select("length", "bucket", F.coalesce(before, F.lit(0)).alias("before"))
    own = F.row_number().over(Window.partitionBy("length", "bucket").orderBy("doc_id", "piece", "ids_crc32"))
    ranked = dealt.withColumn("own", own).join(totals, ["length", "bucket"]).withColumn("rank", F.col("before") + F.col("own") - 1)
    at = F.col("rank") - F.col("lo")
    placed = ranked.join(F.broadcast(segments), (ranked["length"] == segments["length"]) & F.col("rank").between(F.col("lo"), F.col("hi") - 1)).drop(segments["length"])
    return placed.select(
        "doc_id", "piece", "start", "length", "ids_crc32",
        (F.col("base") + F.floor(at / F.size("offsets"))).cast("long").alias("sequence_id"),
        F.element_at("offsets", (F.pmod(at, F.size("offsets")) + 1).cast("int")).alias("offset"),
        *(["ids"] if with_ids else []),
    )
