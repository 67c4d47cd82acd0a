"""Language identification with string kernels.

The kernel of two texts is the number of character 1- to 3-grams that both hold (a blended
spectrum presence kernel, n-grams hashed to ``CELLS`` cells), divided by the root of the
product of their own numbers. Nyström landmarks give each text m kernel values; one-versus-rest
ridge regression in the space they span gives a score for each language.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .textscan import slices

CELLS = 1 << 16
ORDERS = (1, 2, 3)
PARTS = 64


def has_letter(text: str | None) -> bool:
    return text is not None and any(map(str.isalpha, text))


def gram_cells(texts: list[str]) -> tuple[list[np.ndarray], np.ndarray]:
    """For each order the cells of all n-grams of the joined texts, and the texts' places in them."""
    codes = [np.frombuffer(t.lower().encode("utf-32-le", "surrogatepass"), "<u4") for t in texts]
    off = np.zeros(len(codes) + 1, np.int64)
    np.cumsum([len(c) for c in codes], out=off[1:])
    flat = np.concatenate(codes).astype(np.uint64) if len(codes) else np.zeros(0, np.uint64)
    flat = (flat + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)
    out, run = [], flat
    for n in ORDERS:
        if n > 1:
            run = (run[:-1] ^ (run[:-1] >> np.uint64(29))) * np.uint64(0xA0761D6478BD642F) + flat[n - 1 :]
        out.append((((run ^ (run >> np.uint64(31))) * np.uint64(0xD6E8FEB86659FD93)) >> np.uint64(48)).astype(np.int64))
    return out, off


def presence(texts: list[str], into: np.ndarray, most: int = 1 << 18) -> np.ndarray:
    """Rows of 0 and 1: which cells each text's n-grams hold. Texts go in parts of at most ``most``
    characters, each with the last ones of the part before it."""
    rows = into[: len(texts)]
    rows.fill(0)
    parts = [(i, t[at : at + most + ORDERS[-1] - 1]) for i, t in enumerate(texts) for at in range(0, max(1, len(t)), most)]
    while parts:
        size, n = 0, 0
        while n < len(parts) and (not n or size + len(parts[n][1]) <= most):
            size, n = size + len(parts[n][1]), n + 1
        cells, off = gram_cells([t for _, t in parts[:n]])
        for j, (i, _) in enumerate(parts[:n]):
            for k, own in zip(ORDERS, cells, strict=True):
                rows[i, own[off[j] : max(off[j], off[j + 1] - k + 1)]] = 1
        parts = parts[n:]
    return rows


class KernelModel:
    """``weights``: cells by languages, the landmarks' presence times the ridge weights."""

    def __init__(self, languages: list[str], weights: np.ndarray, bias: np.ndarray, sharp: float):
        self.languages, self.weights, self.bias, self.sharp = languages, weights, bias, sharp

    @classmethod
    def fit(cls, texts: list[str], languages: list[str], landmarks: int = 192, ridge: float = 1e-2, sharp: float = 6.0) -> KernelModel:
        names = sorted(set(languages))
        y = np.array([names.index(x) for x in languages])
        # landmarks: the texts that come first in turn over the languages
        turn = np.concatenate([np.arange(n) for n in np.bincount(y, minlength=len(names))]) if len(y) else y
        order = np.argsort(y, kind="stable")
        pick = order[np.argsort(turn, kind="stable")][:landmarks]
        marks = presence([texts[i] for i in pick], np.zeros((len(pick), CELLS), np.float32))
        marks /= np.sqrt(np.maximum(marks.sum(1, keepdims=True), 1))
        k = np.zeros((len(texts), len(pick)))
        room = np.zeros((32, CELLS), np.float32)
        for at in range(0, len(texts), 32):
            x = presence(texts[at : at + 32], room)
            k[at : at + 32] = (x @ marks.T) / np.sqrt(np.maximum(x.sum(1, keepdims=True), 1))
        inner = (marks @ marks.T).astype(float)
        value, vector = np.linalg.eigh(inner)
        keep = value > 1e-6 * value[-1]
        root = vector[:, keep] / np.sqrt(value[keep])  # inverse square root of the landmarks' kernel
        z = np.hstack([k @ root, np.ones((len(texts), 1))])
        goal = np.where(y[:, None] == np.arange(len(names)), 1.0, -1.0)
        even = 1.0 / np.bincount(y, minlength=len(names))[y]  # languages weigh the same
        a = z.T @ (z * even[:, None]) + ridge * np.eye(z.shape[1]) * even.sum() / len(y)
        w = np.linalg.solve(a, z.T @ (goal * even[:, None]))
        return cls(names, np.hstack([marks.T @ (root @ w[:-1]), np.ones((CELLS, 1))]).astype(np.float32), w[-1], sharp)

    def predict(self, texts: list[str], room: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Index of the best language and its share of the soft maximum, for up to len(room) texts."""
        both = presence(texts, room) @ self.weights  # one product: scores and each text's own number
        f = both[:, :-1] / np.sqrt(np.maximum(both[:, -1:], 1)) + self.bias
        e = np.exp(self.sharp * (f - f.max(1, keepdims=True)))
        best = f.argmax(1)
        return best, e[np.arange(len(best)), best] / e.sum(1)


def held_out():
    """crc32 of doc_id as text, modulo 4, is 2; a null doc_id is not held out."""
    return F.coalesce(F.pmod(F.crc32(F.col("doc_id").cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def fit(docs: DataFrame, per_language: int = 300) -> KernelModel | None:
    """Fit on the labelled texts of at most ``per_language`` hashes of doc_id for each language, the
    least ones, none of them held out; of repeated ids the least text counts. None without
    labelled texts."""
    able = docs.filter(F.col("lang").isNotNull() & F.col("doc_id").isNotNull() & ~held_out()).select("doc_id", "lang", "text", F.xxhash64("doc_id").alias("_h"))
    # first among the hashes of a part, then among what the parts leave, so that no language is one task
    least = able.select("lang", "_h", F.pmod("_h", F.lit(PARTS)).alias("_p")).distinct()
    for by in (["lang", "_p"], ["lang"]):
        rank = F.row_number().over(Window.partitionBy(*by).orderBy("_h"))
        least = least.withColumn("_r", rank).filter(F.col("_r") <= per_language)
    cut = least.groupBy("lang").agg(F.max("_h").alias("_cut"))
    cuts = {r["lang"]: r["_cut"] for r in cut.collect()}  # one row for each language
    if not cuts:
        return None
    chosen = F.lit(False)
    for lang, most in cuts.items():
        chosen |= (F.col("lang") == lang) & (F.col("_h") <= most)
    rows = able.filter(chosen & F.col("text").isNotNull()).groupBy("doc_id", "lang").agg(F.min("text").alias("text")).collect()
    rows = sorted((r for r in rows if has_letter(r["text"])), key=lambda r: (r["doc_id"], r["lang"]))
    return KernelModel.fit([r["text"] for r in rows], [r["lang"] for r in rows]) if rows else None


def identify(docs: DataFrame, per_language: int = 300, model: KernelModel | None = None) -> DataFrame:
    """Add held_out, lang_pred and score (0 to 1) to every row, replacing columns of these names.

    Null texts and texts without a letter get ``und`` and score 0, as does every row when there
    is nothing to learn from. Predictions see the text alone. An empty table gives none.
    """
    plain = docs.drop("held_out", "lang_pred", "score").withColumn("held_out", held_out())
    model = model or fit(docs, per_language)
    shared = docs.sparkSession.sparkContext.broadcast(model)  # cells x languages floats
    kinds = T.StructType([*plain.schema, T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known = shared.value
        room = np.zeros((32, CELLS), np.float32)
        for batch in batches:
            names, scores = ["und"] * batch.num_rows, np.zeros(batch.num_rows)
            blocks = [(first, min(32, part.first + part.rows - first)) for part in slices(batch.column(at)) for first in range(part.first, part.first + part.rows, 32)] if known else []
            for first, n in blocks:
                texts = batch.column(at).slice(first, n).to_pylist()
                own = [i for i, t in enumerate(texts) if has_letter(t)]
                if own:
                    best, share = known.predict([texts[i] for i in own], room)
                    for i, b, s in zip(own, best, share, strict=True):
                        names[first + i], scores[first + i] = known.languages[b], s
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(names, pa.string()), pa.array(scores)], [*batch.schema.names, "lang_pred", "score"])

    return plain.mapInArrow(run, kinds)
