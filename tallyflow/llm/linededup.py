"""Line dedup over levelled sorted runs of line hashes."""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .scratch import fingerprint, forget, free, written
from .textscan import slices

#: The blanks stripped from a line's ends.
BLANK = " \t\n\x0b\x0c\r"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
FOLD = bytes.maketrans(UPPER.encode(), LOWER.encode())


def line_key(line: Column) -> Column:
    return F.translate(F.btrim(line, F.lit(BLANK)), UPPER, LOWER)


def _hashed(line: Column) -> Column:
    """128 bits of a line's key, as text (distinct values of an array of text are found by hash);
    null for an empty key."""
    key = line_key(line)
    return F.when(F.length(key) >= 1, F.md5(key.cast("binary")))


def _kept(text: bytes, drop: set[bytes]) -> tuple[bytes, int, int]:
    """The text without the lines whose keys' hashes are in ``drop``, its lines, and those dropped."""
    lines = text.split(b"\n")
    stay = [x for x in lines if not (key := x.strip(BLANK.encode()).translate(FOLD)) or hashlib.md5(key).digest() not in drop]
    return b"\n".join(stay), len(lines), len(lines) - len(stay)


class LineRuns:
    """Runs of (key, n): a line's hash and the documents that hold it, sorted by hash.

    A run enters level 0. When a level holds ``fanout`` runs they are merged into one run of the
    next level, so a key is rewritten once a level. A batch is merge-anti-joined with the
    settled keys of the runs, those that a run alone shows in ``settled`` documents: they need
    no further counting. ``settled=1`` keeps first occurrences only.
    """

    def __init__(self, settled: int, fanout: int = 4):
        self.settled, self.fanout, self.levels = settled, fanout, [[]]

    def runs(self) -> list[DataFrame]:
        return [run for level in self.levels for run in level]

    def _run(self, keys: DataFrame) -> DataFrame:
        return written(keys.groupBy("key").agg(F.sum("n").alias("n")).sortWithinPartitions("key"), "line-run")

    def add(self, batch: DataFrame) -> None:
        """``batch``: (key), one row for each document and distinct key."""
        keys = batch.groupBy("key").agg(F.count("*").alias("n"))
        for run in self.runs():
            done = run.filter(F.col("n") >= self.settled).select("key")
            keys = keys.join(done.hint("merge"), "key", "left_anti")
        self.levels[0].append(self._run(keys))
        for k, level in enumerate(self.levels):
            if len(level) >= self.fanout:
                merged = level[0]
                for other in level[1:]:
                    merged = merged.unionByName(other)
                if k + 1 == len(self.levels):
                    self.levels.append([])
                self.levels[k + 1].append(self._run(merged))
                forget(*level)
                self.levels[k] = []

    def frequent(self) -> DataFrame:
        """Keys that all runs together show in at least ``settled`` documents."""
        runs = self.runs()
        merged = runs[0]
        for other in runs[1:]:
            merged = merged.unionByName(other)
        return merged.groupBy("key").agg(F.sum("n").alias("n")).filter(F.col("n") >= self.settled).select("key")


def drop_frequent_lines(docs: DataFrame, min_docs: int = 10, batches: int = 4) -> DataFrame:
    """Drop from every document the lines whose key is in at least ``min_docs`` documents.

    Every column stays; ``text`` holds the kept lines; ``n_lines``, ``n_dropped`` and
    ``line_hit`` (a line went) are added, replacing columns of these names. A row is a document,
    also when its doc_id is null or repeated. Null and empty texts are one empty line, and
    become the empty string. Lines with an empty key always stay. An empty table gives none.
    """
    names = ["n_lines", "n_dropped", "line_hit"]
    plain = docs.drop(*names)
    u, v, drop = free(plain, "_u", "_v", "_drop")
    one, two = fingerprint(F.col("doc_id").cast("string"), "text")
    marked = plain.withColumns({u: one, v: two})
    lines = F.split(F.coalesce("text", F.lit("")), "\n", -1)
    keys = F.array_distinct(F.transform(lines, _hashed))
    held = marked.select(F.col(u).alias("u"), F.col(v).alias("v"), F.explode(keys).alias("key")).filter("key IS NOT NULL")
    held = written(held.select("u", "v", F.unhex("key").alias("key"), F.pmod("u", F.lit(batches)).alias("batch")), "line-keys", partition_by="batch")
    store = LineRuns(min_docs)
    for k in range(batches):
        store.add(held.filter(F.col("batch") == k).select("key"))
    frequent = written(store.frequent(), "line-frequent")
    forget(*store.runs())
    hits = held.select("u", "v", "key").join(frequent, "key")
    gone = written(hits.groupBy("u", "v").agg(F.collect_set("key").alias("drop")), "line-hits")
    forget(held, frequent)
    gone = gone.select(F.col("u").alias(u), F.col("v").alias(v), F.col("drop").alias(drop))
    tagged = marked.join(gone, [u, v], "left").select(*plain.columns, drop)
    text = plain.columns.index("text")
    kinds = T.StructType([*tagged.schema[:-1], T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())])

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            drops = batch.column(batch.num_columns - 1)
            for part in slices(batch.column(text)):
                body = part.data.tobytes()
                breaks = np.concatenate([[0], np.cumsum(part.data == 10)])
                n = breaks[part.off[1:]] - breaks[part.off[:-1]] + 1
                gone = np.zeros(part.rows, np.int64)
                kept = []
                for i, (lo, hi) in enumerate(zip(part.off[:-1].tolist(), part.off[1:].tolist(), strict=True)):
                    own = drops[part.first + i]
                    if own.is_valid:
                        stay, _, gone[i] = _kept(body[lo:hi], set(own.as_py()))
                        kept.append(stay.decode())
                    else:
                        kept.append(body[lo:hi].decode())
                own = batch.slice(part.first, part.rows)
                columns = [*own.columns[:-1], pa.array(n.astype(np.int64)), pa.array(gone)]
                columns[text] = pa.array(kept, pa.string())
                yield pa.RecordBatch.from_arrays(columns, kinds.names)

    return tagged.mapInArrow(cut, kinds).withColumn("line_hit", F.col("n_dropped") > 0)
