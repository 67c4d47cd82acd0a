"""Cross-entropy difference of matched target and background word-pair models."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute
from pyspark import TaskContext
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import free, written
from .textscan import Powers, mix, slices, string_buffers, word_bounds, word_hashes

CHUNK = 1 << 24  # bytes of text that are counted and scored together
SENT = "part int, _chunk long, keys binary, n_target binary, n_all binary"


def _chunked(docs: DataFrame, name: str) -> DataFrame:
    """Add column ``name``, a number shared by rows of about CHUNK bytes (64 for a row besides its text)."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        first, size = TaskContext.get().partitionId() << 32, 0
        for batch in batches:
            if not batch.num_rows:
                continue
            begin = size + np.concatenate([[0], np.cumsum(np.diff(string_buffers(batch.column(at))[0]) + 64)])
            size = int(begin[-1])
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(first + begin[:-1] // CHUNK, pa.int64())], [*batch.schema.names, name])

    return docs.mapInArrow(run, T.StructType([*docs.schema, T.StructField(name, T.LongType())]))


def _words(column: pa.ChunkedArray) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the rows' words in order, and how many each row has."""
    powers = Powers()
    hashes, n = [np.zeros(0, np.uint64)], [np.zeros(0, np.int64)]
    for part in slices(column):
        starts, ends, words = word_bounds(part)
        hashes.append(word_hashes(part, starts, ends))
        n.append(np.diff(words))
    return np.concatenate(hashes), np.concatenate(n)


def _pairs(hashes: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Which words have a predecessor in their row, and the hash of each such word with it."""
    inner = np.ones(len(hashes), bool)
    inner[(np.cumsum(n) - n)[n > 0]] = False
    at = np.flatnonzero(inner)
    return inner, mix(mix(hashes[at - 1], 41) + hashes[at], 40)


def _sent(chunk: int, keys: np.ndarray, mark: np.ndarray, bits: int) -> dict[str, list]:
    """A chunk's distinct keys in order with their counts, one row for each value of the leading bits."""
    both, back = np.unique(keys, return_inverse=True)
    n_target, n_all = (np.bincount(back, w, len(both)).astype("<u4") for w in (mark, None))
    part = (both >> np.uint64(64 - bits)).astype(np.int64)
    edge = np.flatnonzero(np.diff(part, prepend=-1))
    spans = list(zip(edge, np.append(edge[1:], len(both)), strict=True)) if len(edge) else []
    return {
        "part": [int(part[a]) for a, _ in spans], "_chunk": [chunk] * len(spans), "keys": [both[a:b].astype("<u8").tobytes() for a, b in spans],
        "n_target": [zlib.compress(n_target[a:b].tobytes(), 1) for a, b in spans], "n_all": [zlib.compress(n_all[a:b].tobytes(), 1) for a, b in spans],
    }


def _totals(sent: DataFrame, least: int = 0) -> DataFrame:
    """Answers to what chunks sent: the whole table's counts (target, all) of the same keys in the
    same order. Where ``least`` is set, chunk -1 holds each part's sums: the keys found that often in
    target rows, their counts (target, all), and all keys' counts."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        names = ["_chunk", "part", "n"]
        held: list[tuple[int, np.ndarray, np.ndarray]] = []
        now = -1

        def out() -> Iterator[pa.RecordBatch]:
            both, back = np.unique(np.concatenate([k for _, k, _ in held]), return_inverse=True)
            n = np.concatenate([c for _, _, c in held], 1)
            total = np.stack([np.bincount(back, x, len(both)) for x in n]).astype("<i8")
            at = 0
            for chunk, keys, _ in held:
                answer = total[:, back[at : at + len(keys)]]
                at += len(keys)
                yield pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([now], pa.int32()), pa.array([zlib.compress(answer.tobytes(), 1)], pa.binary())], names)
            if least:
                known = total[:, total[0] >= least]
                sums = np.array([known.shape[1], *known.sum(1), *total.sum(1)], "<i8")
                yield pa.RecordBatch.from_arrays([pa.array([-1], pa.int64()), pa.array([now], pa.int32()), pa.array([sums.tobytes()], pa.binary())], names)

        for batch in batches:
            for i in range(batch.num_rows):
                part, chunk, keys, n_target, n_all = (c[i].as_py() for c in batch.columns)
                if part != now and held:
                    yield from out()
                    held = []
                now = part
                held.append((chunk, np.frombuffer(keys, "<u8"), np.stack([np.frombuffer(zlib.decompress(x), "<u4") for x in (n_target, n_all)])))
        if held:
            yield from out()

    return sent.repartition("part").sortWithinPartitions("part").mapInArrow(merge, "_chunk long, part int, n binary")


def _answer(rows: pa.Table) -> np.ndarray:
    """The counts (target, all) of a chunk's distinct keys in order."""
    found = sorted(zip(rows["part"].to_pylist(), rows["n"].to_pylist(), strict=True))
    return np.concatenate([np.zeros((2, 0), np.int64), *[np.frombuffer(zlib.decompress(n), "<i8").reshape(2, -1) for _, n in found]], 1)


def _own(keys: np.ndarray, row: np.ndarray) -> np.ndarray:
    """How often each key (small numbers) occurs in its own row."""
    _, back, n = np.unique(keys + row * (int(keys.max(initial=0)) + 1), return_inverse=True, return_counts=True)
    return n[back].astype(float)


def score(docs: DataFrame, target: Column, bits: int | None = None, least: int = 2, share: float = 0.7, add: float = 0.1) -> DataFrame:
    """Add n_tokens, target_loss, background_loss and loss_diff (nats a token) to every row.

    The target model counts the rows where ``target`` holds (null: not), the background model all
    rows; both over the whole table, with one vocabulary (the words found at least ``least``
    times in target rows; all others are one word), one order and one smoothing: ``share`` of the
    pair's relative frequency, the rest of the word's, with ``add`` added to each count. A row's
    own words are taken out of the counts that score it. A low loss_diff means closer to the target.
    Rows without words have 0 tokens and null losses; columns of these names are replaced; an empty
    table gives none.

    Words and pairs are counted by their full 64-bit hashes. Chunks of rows send their distinct keys,
    dealt by the leading bits, to where they are summed, and get the sums back in the same order; no
    table of all words or pairs is held anywhere. There are 2**bits parts; unset, as many as the text
    needs for a part to hold a few chunks' worth.
    """
    names = ["n_tokens", "target_loss", "background_loss", "loss_diff"]
    plain = docs.drop(*names)
    mark_, chunk_ = free(plain, "_target", "_chunk")
    kinds = T.StructType([*plain.schema, T.StructField("n_tokens", T.LongType()), *[T.StructField(n, T.DoubleType()) for n in names[1:]]])
    chunks = written(_chunked(plain.withColumn(mark_, F.coalesce(target, F.lit(False))), chunk_), "lm_chunks")
    if bits is None:
        size = chunks.agg(F.sum(F.octet_length("text"))).first()[0] or 0
        bits = max(4, (size // (4 * CHUNK)).bit_length())
    texts = chunks.select(F.col(chunk_).alias("_chunk"), "text", F.col(mark_).alias("_target"))

    def words(key: tuple, rows: pa.Table) -> pa.Table:
        hashes, n = _words(rows["text"])
        return pa.table(_sent(key[0].as_py(), hashes, np.repeat(_marks(rows), n), bits), kind)

    def pairs(key: tuple, rows: pa.Table, counted: pa.Table) -> pa.Table:
        hashes, n = _words(rows["text"])
        both, back = np.unique(hashes, return_inverse=True)
        if len(both):
            both[_answer(counted)[0] < least] = 0
        inner, keys = _pairs(both[back], n)
        return pa.table(_sent(key[0].as_py(), keys, np.repeat(_marks(rows), n)[inner], bits), kind)

    kind = pa.schema([("part", pa.int32()), ("_chunk", pa.int64()), ("keys", pa.binary()), ("n_target", pa.binary()), ("n_all", pa.binary())])
    counted = written(_totals(texts.groupBy("_chunk").applyInArrow(words, SENT), least), "lm_words")
    sums = sum((np.frombuffer(r.n, "<i8") for r in counted.filter("_chunk = -1").select("n").collect()), np.zeros(5, np.int64))
    vocabulary, known, total = int(sums[0]) + 1, sums[1:3], sums[3:].astype(float)
    single = counted.filter("_chunk >= 0")
    paired = written(_totals(texts.groupBy("_chunk").cogroup(single.groupBy("_chunk")).applyInArrow(pairs, SENT)), "lm_pairs")

    def run(_: tuple, rows: pa.Table, found: pa.Table) -> pa.Table:
        mark = rows[mark_].to_numpy().astype(float)
        hashes, n = _words(rows["text"])
        row = np.repeat(np.arange(len(n)), n)
        both, back = np.unique(hashes, return_inverse=True)
        of = _answer(found.filter(pa.compute.equal(found["kind"], 0)))
        often = of[0] >= least
        cells = (np.cumsum(often) * often)[back]  # 0: the unknown word
        words = np.concatenate([(total - known)[:, None], of[:, often]], 1)
        both[~often] = 0
        inner, keys = _pairs(both[back], n)
        _, pair = np.unique(keys, return_inverse=True)
        after = _answer(found.filter(pa.compute.equal(found["kind"], 1)))
        own_word, own_pair = _own(cells, row), _own(pair, row[inner])
        at = np.flatnonzero(inner) - 1
        begin = np.concatenate([[0], np.cumsum(n)])
        loss = []
        for k, mine in ((0, mark[row]), (1, np.ones(len(row)))):
            p = (words[k, cells] - mine * own_word + add) / (total[k] - mine * n[row] + add * vocabulary)
            seen = words[k, cells[at]] - mine[at] * own_word[at]
            p[inner] = share * (after[k, pair] - mine[inner] * own_pair) / np.maximum(seen, 1) + (1 - share) * p[inner]  # a first word has no predecessor
            run_ = np.concatenate([[0], np.cumsum(-np.log(p))])
            loss.append((run_[begin[1:]] - run_[begin[:-1]]) / np.maximum(n, 1))
        out = rows.drop_columns([mark_, chunk_])
        for name, x in zip(names, (n, loss[0], loss[1], loss[0] - loss[1]), strict=True):
            out = out.append_column(name, pa.array(x, mask=None if name == "n_tokens" else n == 0))
        return out

    found = single.withColumn("kind", F.lit(0)).unionByName(paired.withColumn("kind", F.lit(1)))
    return chunks.groupBy(chunk_).cogroup(found.groupBy("_chunk")).applyInArrow(run, kinds)


def _marks(rows: pa.Table) -> np.ndarray:
    return rows["_target"].to_numpy().astype(float)
