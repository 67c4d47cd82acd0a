"""Quality rules: a calibrated logistic regression over hashed word and character n-grams,
beside counts of the text that need no model."""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import SPACE, Powers, Slice, mix, rolling, slices, word_bounds, word_hashes

BITS = 16
#: Families of features: single words, word pairs, runs of four bytes.
FAMILIES = 3
SYMBOL = np.zeros(256, bool)
SYMBOL[list(b"#*$%&|<>")] = True


def per_row(flags: np.ndarray, off: np.ndarray) -> np.ndarray:
    run = np.zeros(len(flags) + 1, np.int64 if flags.dtype.kind in "bi" else float)
    np.cumsum(flags, out=run[1:])
    return run[off[1:]] - run[off[:-1]]


def repeated(keys: np.ndarray) -> np.ndarray:
    """True for every key found twice or more."""
    order = np.argsort(keys, kind="stable")
    k = keys[order]
    same = np.zeros(len(k) + 1, bool)
    same[1:-1] = k[1:] == k[:-1]
    out = np.zeros(len(k), bool)
    out[order] = same[1:] | same[:-1]
    return out


class Counter:
    """Counts and feature cells of a slice of texts."""

    def __init__(self) -> None:
        self.powers = Powers()

    def scan(self, part: Slice) -> tuple[dict[str, np.ndarray], list[tuple[np.ndarray, np.ndarray]]]:
        data, off, powers = part.data, part.off, self.powers
        starts, ends, words = word_bounds(part)
        hashes = word_hashes(part, starts, ends)
        row = np.repeat(np.arange(part.rows), np.diff(words)).astype(np.uint64)
        out = {"n_words": np.diff(words)}
        out["word_chars"] = per_row(~SPACE[data] & ((data & 0xC0) != 0x80), off)
        out["n_symbols"] = per_row(SYMBOL[data], off)
        # lines with a word that equal an earlier one
        cut = np.zeros(len(data) + 1, bool)
        cut[:-1] = data == 10
        first = np.unique(np.concatenate([off[:-1], np.flatnonzero(cut) + 1]))
        first = first[first < len(data)]
        line_row = np.searchsorted(off, first, "right") - 1
        stop = np.minimum(np.append(first[1:], len(data)), off[line_row + 1]) if len(first) else first
        stop = np.where((stop > first) & cut[np.maximum(stop - 1, 0)], stop - 1, stop)
        solid = np.zeros(len(data) + 1, np.int64)
        np.cumsum(~SPACE[data], out=solid[1:])
        full = solid[stop] > solid[first]
        line = mix(word_hashes(part, first[full], stop[full]) + line_row[full].astype(np.uint64), 9)
        fresh = np.zeros(len(line), bool)
        fresh[np.unique(line, return_index=True)[1]] = True
        out["n_dup_lines"] = np.bincount(line_row[full][~fresh], minlength=part.rows)
        # words in three-word windows found twice or more
        hit = np.zeros(len(starts) + 1, np.int64)
        if len(starts) >= 3:
            inside = row[2:] == row[:-2]
            own = np.flatnonzero(inside)
            again = own[repeated(mix(rolling(hashes, 3, powers)[own] + row[own], 4))]
            np.add.at(hit, again, 1)
            np.add.at(hit, again + 3, -1)
        out["n_repeat_words"] = per_row(np.cumsum(hit)[:-1] > 0, words)
        shift = np.uint64(64 - BITS)
        cells = [((mix(hashes, 21) >> shift).astype(np.int64), words)]
        pairs = rolling(hashes, 2, powers, 30)
        inside = row[1:] == row[:-1]
        cells.append(((pairs[inside] >> shift).astype(np.int64), np.concatenate([[0], np.cumsum(np.bincount(row[1:][inside].astype(np.int64), minlength=part.rows))])))
        n = max(0, len(data) - 3)
        four = data[:n].astype(np.uint64)
        for k in (1, 2, 3):
            four |= data[k : n + k].astype(np.uint64) << np.uint64(8 * k)
        # runs over a row's border count with neither row
        until = np.maximum(off[1:] - 3, off[:-1])
        grams = (((four * np.uint64(0x9E3779B97F4A7C15)) >> shift)).astype(np.int64)
        keep = np.zeros(n + 1, np.int64)
        low, high = off[:-1][until > off[:-1]], until[until > off[:-1]]
        np.add.at(keep, low, 1)
        np.add.at(keep, high, -1)
        inside = np.cumsum(keep)[:-1] > 0
        cells.append((grams[inside], np.concatenate([[0], np.cumsum(np.maximum(off[1:] - 3 - off[:-1], 0))])))
        return out, cells


class QualityModel:
    """A logit is a bias and, for each family, the mean weight of the text's features; ``slope``
    and ``shift`` calibrate it to a probability."""

    def __init__(self, weights: np.ndarray, bias: float, slope: float, shift: float):
        self.weights, self.bias, self.slope, self.shift = weights, bias, slope, shift

    def logits(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        total = self.bias
        for w, (own, off) in zip(self.weights, cells, strict=True):
            total = total + per_row(w[own].astype(float), off) / np.maximum(np.diff(off), 1)
        return total

    def probability(self, cells: list[tuple[np.ndarray, np.ndarray]]) -> np.ndarray:
        return 1 / (1 + np.exp(-np.clip(self.slope * self.logits(cells) + self.shift, -30, 30)))

    @classmethod
    def fit(cls, texts: list[str], good: list[int], rounds: int = 80, rate: float = 0.5, decay: float = 1e-4) -> QualityModel:
        """Adam on the log loss of four fifths of the rows, classes weighing the same; Platt
        scaling on the last fifth, by Newton steps, with the classes as frequent as they are."""
        counter, sparse = Counter(), []
        y = np.asarray(good, float)
        for part in slices(pa.array(texts, pa.string())):
            _, cells = counter.scan(part)
            for i in range(part.rows):
                sparse.append([np.unique(own[off[i] : off[i + 1]], return_counts=True) for own, off in cells])
        test = np.arange(len(y)) % 5 == 4

        def table(rows: np.ndarray, family: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            own = [sparse[i][family] for i in rows]
            who = np.repeat(np.arange(len(rows)), [len(c) for c, _ in own])
            return who, np.concatenate([c for c, _ in own]), np.concatenate([n / max(1, n.sum()) for _, n in own])

        rows = np.flatnonzero(~test)
        tables = [table(rows, f) for f in range(FAMILIES)]
        t = y[rows]
        even = np.where(t > 0, 0.5 / max(t.sum(), 1), 0.5 / max((1 - t).sum(), 1))
        size = FAMILIES << BITS
        w, m, v, bias, bm, bv = np.zeros(size), np.zeros(size), np.zeros(size), 0.0, 0.0, 0.0
        for step in range(1, rounds + 1):
            f = bias + sum(np.bincount(who, x * w[(k << BITS) + c], minlength=len(rows)) for k, (who, c, x) in enumerate(tables))
            r = even * (1 / (1 + np.exp(-np.clip(f, -30, 30))) - t)
            g = np.concatenate([np.bincount(c, x * r[who], minlength=1 << BITS) for who, c, x in tables]) + decay * w / len(rows)
            m, v = 0.9 * m + 0.1 * g, 0.99 * v + 0.01 * g * g
            bm, bv = 0.9 * bm + 0.1 * r.sum(), 0.99 * bv + 0.01 * r.sum() ** 2
            w -= rate * (m / (1 - 0.9**step)) / (np.sqrt(v / (1 - 0.99**step)) + 1e-6)
            bias -= rate * (bm / (1 - 0.9**step)) / (np.sqrt(bv / (1 - 0.99**step)) + 1e-6)
        model = cls(w.reshape(FAMILIES, -1).astype(np.float32), float(bias), 1.0, 0.0)
        rows = np.flatnonzero(test)
        if len(set(y[rows])) < 2:
            return model
        tables = [table(rows, f) for f in range(FAMILIES)]
        f = bias + sum(np.bincount(who, x * w[(k << BITS) + c], minlength=len(rows)) for k, (who, c, x) in enumerate(tables))
        pos = y[rows].sum()
        goal = np.where(y[rows] > 0, (pos + 1) / (pos + 2), 1 / (len(rows) - pos + 2))
        theta = np.array([1.0, 0.0])
        a = np.stack([f, np.ones_like(f)], 1)
        for _ in range(50):
            p = 1 / (1 + np.exp(-np.clip(a @ theta, -30, 30)))
            h = a.T @ (a * (p * (1 - p))[:, None]) + 1e-6 * np.eye(2)
            move = np.linalg.solve(h, a.T @ (p - goal))
            theta = theta - move / max(1.0, np.abs(move).max())
        model.slope, model.shift = (float(theta[0]), float(theta[1])) if theta[0] > 0 else (1.0, 0.0)
        return model


def fit(docs: DataFrame, labels: DataFrame, rows: int = 4000) -> QualityModel | None:
    """Fit on at most ``rows`` labelled texts, those of the doc_ids of least hash; of a repeated
    doc_id the least text counts. None unless both labels are there."""
    known = labels.filter(F.col("quality").isin(0, 1) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("quality").alias("_q"), F.max("quality").alias("_p"))
    known = known.filter(F.col("_q") == F.col("_p")).withColumn("_h", F.xxhash64("doc_id"))
    known = known.orderBy("_h", "doc_id").limit(rows).select("doc_id", "_q")
    found = docs.select("doc_id", "text").filter(F.col("text").isNotNull()).join(F.broadcast(known), "doc_id").groupBy("doc_id", "_q").agg(F.min("text").alias("text"))
    out = sorted(found.collect(), key=lambda r: (zlib.crc32(str(r["doc_id"]).encode()), r["doc_id"]))
    return QualityModel.fit([r["text"] for r in out], [r["_q"] for r in out]) if len({r["_q"] for r in out}) == 2 else None


def assess(docs: DataFrame, labels: DataFrame, keep: float = 0.5, fewest_words: int = 50, most_repeated: int = 50, model: QualityModel | None = None) -> DataFrame:
    """Add the counts, base_failed, quality (a probability) and kept to every row.

    Columns of these names are replaced. kept is false where base_failed, else quality >=
    ``keep``. Null texts have no words; a null or unlabelled doc_id is scored as any other;
    repeated labels count once, contradicting ones not at all. Without labelled rows of both
    kinds quality is null and only the base decides. An empty table gives none.
    """
    names = ["n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words"]
    plain = docs.drop(*names, "base_failed", "quality", "kept")
    model = model or fit(docs, labels)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # a fixed number of cells
    kinds = T.StructType([*plain.schema, *[T.StructField(n, T.LongType()) for n in names], T.StructField("quality", T.DoubleType())])
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known, counter = shared.value, Counter()
        for batch in batches:
            for part in slices(batch.column(at)):
                counts, cells = counter.scan(part)
                own = batch.slice(part.first, part.rows)
                quality = pa.array(known.probability(cells)) if known else pa.nulls(part.rows, pa.float64())
                yield pa.RecordBatch.from_arrays([*own.columns, *[pa.array(counts[n].astype(np.int64)) for n in names], quality], [*own.schema.names, *names, "quality"])

    out = plain.mapInArrow(run, kinds)
    failed = (F.col("n_words") < fewest_words) | (100 * F.col("n_repeat_words") > most_repeated * F.col("n_words"))
    return out.withColumn("base_failed", failed).withColumn("kept", ~failed & F.coalesce(F.col("quality") >= keep, F.lit(True)))
