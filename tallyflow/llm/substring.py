"""Repeated word windows: a count-min prefilter, then exact groups of what it leaves."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import forget, free, text_id, written
from .sketch import Anchors, repeated_cells
from .textscan import Powers, rolling, slices, word_bounds, word_hashes


def word_windows(width: int, gram: int) -> Callable[[], Callable]:
    def scan() -> Callable[[pa.Array], Iterator[Anchors]]:
        powers = Powers()

        def read(column: pa.Array) -> Iterator[Anchors]:
            for part in slices(column):
                starts, ends, words = word_bounds(part)
                yield Anchors(word_hashes(part, starts, ends), words, width, gram, powers)

        return read

    return scan


def _covered(n: int, starts: np.ndarray, width: int) -> np.ndarray:
    step = np.zeros(n + 1, np.int64)
    np.add.at(step, starts, 1)
    np.add.at(step, np.minimum(starts + width, n), -1)
    return np.cumsum(step)[:-1] > 0


def remove_repeated_windows(docs: DataFrame, width: int = 35, bits: int = 27) -> DataFrame:
    """Drop every word covered by a window of ``width`` words that starts anywhere else too.

    Adds n_words, n_removed and kept (the words left, joined by one space), replacing columns of
    these names; ``text`` stays. Windows are judged on the input, within one document and
    across all. A document is a row, also when its doc_id is null or repeated; null and empty
    texts have no words; an empty table gives none.

    Rows of equal text are one class: with two rows or more all its windows are repeated, so one
    row speaks for it, with weight 2. The sketch (2**bits cells a row, a fixed size) marks
    windows that may be repeated; those are counted exactly and joined back by two hashes of 64 bits
    each, made of two unrelated hashes of every word.
    """
    gram = max(1, width - 15)
    plain = docs.drop("n_words", "n_removed", "kept")
    id_, at_, all_ = free(plain, "_id", "_at", "_all")
    plain = plain.withColumn(id_, text_id("text"))
    sure = plain.filter(F.col("text").isNotNull()).select(F.col(id_).alias("_node"), "doc_id", "text")
    copies = written(sure.groupBy("_node").agg(F.count("*").alias("_n"), F.min("doc_id").alias("_first")).filter("_n > 1"), "window-copies")
    scan = word_windows(width, gram)
    maps = repeated_cells(sure.select("text"), scan, bits)
    shared = docs.sparkSession.sparkContext.broadcast(maps)
    spoken = sure.select("_node", "doc_id", "text").join(copies, "_node", "left").filter(F.col("_n").isNull() | F.col("_first").isNull() | (F.col("doc_id") == F.col("_first")))

    def windows(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        powers, maps = Powers(), shared.value
        for batch in batches:
            node = batch.column(0)
            weight = np.where(np.asarray(batch.column(2).is_null()), 1, 2).astype(np.int32)
            for part in slices(batch.column(1)):
                starts, ends, words = word_bounds(part)
                hashes = word_hashes(part, starts, ends)
                other = word_hashes(part, starts, ends, 1)
                found = Anchors(hashes, words, width, gram, powers)
                hot = np.repeat(found.hot(bits, maps), np.diff(np.append(found.first, len(found.starts))))
                at = found.starts[hot]
                if len(at):
                    row = np.searchsorted(words, at, "right") - 1
                    yield pa.RecordBatch.from_arrays(
                        [pa.array(rolling(x, width, powers, s)[at].view(np.int64)) for x, s in ((hashes, 70), (other, 80))] + [node.take(pa.array(part.first + row)), pa.array((at - words[row]).astype(np.int32)), pa.array(weight[part.first + row])], ["a", "b", "_node", "at", "w"])

    held = written(spoken.select("_node", "text", "_n").mapInArrow(windows, "a long, b long, _node binary, at int, w int"), "windows")
    twice = written(held.groupBy("a", "b").agg(F.sum("w").alias("n")).filter("n > 1").select("a", "b"), "windows-twice")

    def repeated() -> DataFrame:
        hits = held.join(twice, ["a", "b"]).groupBy("_node").agg(F.collect_list("at").alias("_at"))
        spans = hits.join(copies.select("_node", F.lit(True).alias("_all")), "_node", "full")
        return spans.select("_node", F.when(F.col("_all"), F.lit(None)).otherwise(F.col("_at")).alias("_at"), "_all")

    spans = written(repeated(), "window-spans")
    forget(held, twice)
    names = ["n_words", "n_removed", "kept"]
    mine = [c for c in plain.columns if c != id_]
    tagged = plain.join(spans.select(F.col("_node").alias(id_), F.col("_at").alias(at_), F.col("_all").alias(all_)), id_, "left").select(*mine, at_, all_)
    text = mine.index("text")

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            at, whole = batch.column(-2), batch.column(-1).to_pylist()
            batch = batch.select(range(batch.num_columns - 2))
            for part in slices(batch.column(text)):
                starts, ends, words = word_bounds(part)
                keep = np.ones(len(starts), bool)
                for i, (lo, hi) in enumerate(zip(words[:-1], words[1:], strict=True)):
                    if whole[part.first + i]:
                        keep[lo:hi] = hi - lo < width
                    elif (own := at[part.first + i]).is_valid:
                        keep[lo:hi] = ~_covered(hi - lo, np.asarray(own.values), width)
                # each kept word and one space after it, gathered in one pass
                body = bytes(part.data)
                kept = [b" ".join([body[s:e] for s, e in zip(starts[lo:hi][keep[lo:hi]], ends[lo:hi][keep[lo:hi]], strict=True)]).decode() for lo, hi in zip(words[:-1], words[1:], strict=True)]
                n = np.diff(words)
                gone = np.concatenate([[0], np.cumsum(~keep)])
                own = batch.slice(part.first, part.rows)
                yield pa.RecordBatch.from_arrays([*own.columns, pa.array(n.astype(np.int64)), pa.array((gone[words[1:]] - gone[words[:-1]]).astype(np.int64)), pa.array(kept, pa.string())], [*own.schema.names, *names])

    kinds = T.StructType([*tagged.schema[:-2], T.StructField("n_words", T.LongType()), T.StructField("n_removed", T.LongType()), T.StructField("kept", T.StringType())])
    return tagged.mapInArrow(cut, kinds)


