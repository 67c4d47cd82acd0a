"""Exact top-k search by the threshold algorithm over sorted per-dimension lists."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Row, Window
from pyspark.sql import functions as F

from .scratch import forget, written

#: Sums below it are exact in a double; below the other in a 64-bit integer.
DOUBLE, LONG = 2.0**53, 2.0**62


def scaled(vector: Column, scale: int = 256) -> Column:
    """floor(scale * x) of each component, x as double; an error from 2**62 on."""

    def one(x: Column) -> Column:
        y = F.lit(scale) * x.cast("double")
        return F.when(F.abs(y) >= LONG, F.raise_error("a scaled component does not fit a long").cast("long")).otherwise(F.floor(y))

    return F.transform(vector, one)


def _packed(rows: DataFrame, block: int, name: str) -> DataFrame:
    """Blocks of at most ``block`` vectors as one row each: ids, width and the matrix's bytes (64 or,
    if that is enough, 32 bits a component)."""

    def pack(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        ids: list[int] = []
        vectors: list[np.ndarray] = []

        def out() -> pd.DataFrame:
            width = max(len(v) for v in vectors)
            m = np.zeros((len(vectors), width), "<i8")
            for row, v in zip(m, vectors, strict=True):
                row[: len(v)] = v
            small = m.astype("<i4")
            return pd.DataFrame({"ids": [np.asarray(ids, "<i8").tobytes()], "width": [width], "m": [(small if (small == m).all() else m).tobytes()]})

        for frame in frames:
            for i, v in zip(frame["id"], frame["v"], strict=True):
                ids.append(i)
                vectors.append(v)
                if len(ids) == block:
                    yield out()
                    ids, vectors = [], []
        if ids:
            yield out()

    return written(rows.mapInPandas(pack, "ids binary, width int, m binary"), name)


def _unpacked(block: Row) -> tuple[np.ndarray, np.ndarray]:
    ids = np.frombuffer(block.ids, "<i8")
    each = len(block.m) // max(1, len(ids) * block.width) if block.width else 4
    return ids, np.frombuffer(block.m, f"<i{each}").reshape(len(ids), block.width).astype(np.int64)


def _first(ids: np.ndarray, scores: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """The k best: by falling score, then by rising id."""
    if scores.dtype == object:
        at = np.array(sorted(range(len(ids)), key=lambda i: (-scores[i], ids[i]))[:k], np.int64)
    else:
        at = np.arange(len(ids))
        if len(ids) > 4 * k:
            at = np.flatnonzero(scores >= np.partition(scores, len(ids) - k)[len(ids) - k])
        at = at[np.lexsort((ids[at], -scores[at]))[:k]]
    return ids[at], scores[at]


class Lists:
    """A shard with its sorted list for each dimension."""

    def __init__(self, ids: np.ndarray, m: np.ndarray):
        order = np.argsort(ids, kind="stable")
        self.ids, m = ids[order], m[order]
        self.up = np.argsort(m, axis=0, kind="stable")
        self.kinds = {np.int64: (m, np.take_along_axis(m, self.up, 0))}
        self.most = float(np.abs(m).max(initial=0))

    def of(self, kind: type) -> tuple[np.ndarray, np.ndarray]:
        """The vectors and the sorted lists as numbers in which sums are exact."""
        if kind not in self.kinds:
            self.kinds[kind] = tuple(x.astype(kind) for x in self.kinds[np.int64])
        return self.kinds[kind]

    def search(self, q: np.ndarray, own: int, k: int, best: tuple[np.ndarray, np.ndarray] | None = None, first: int = 32) -> tuple[np.ndarray, np.ndarray]:
        """The k best (ids, scores) other than ``own``, of the shard's and those in ``best``; ties to
        the smaller id.

        Lists are read from the end that the query's sign prefers, in rounds of doubling depth.
        Each new vector is scored at once; the round's last entries bound every unseen one, and
        the search ends when that bound is below the kth score.
        """
        n, d = len(self.ids), self.up.shape[1]
        q = np.pad(q, (0, max(0, d - len(q))))[:d]
        at, score = best if best is not None else (np.zeros(0, np.int64), np.zeros(0))
        reach = max(float(np.abs(q).max(initial=0)) * self.most * d, *(abs(float(s)) for s in score), 0.0)
        kind = float if reach < DOUBLE else np.int64 if reach < LONG else object
        m, lists = self.of(kind)
        q, score = q.astype(kind), score.astype(kind)
        live = np.flatnonzero(q)
        down = q[live] > 0
        seen = np.zeros(n, bool)
        depth, step = 0, first
        while depth < n:
            to = min(n, depth + step)
            if len(live):
                rows = np.where(down, n - 1 - np.arange(depth, to)[:, None], np.arange(depth, to)[:, None])
                found = np.zeros(n, bool)
                found[self.up[rows, live].ravel()] = True
                bound = q[live] @ lists[np.where(down, n - to, to - 1), live]
            else:
                found, to, bound = np.ones(n, bool), n, 0
            new = np.flatnonzero(found & ~seen)
            seen |= found
            new = new[self.ids[new] != own]
            at, score = _first(np.concatenate([at, self.ids[new]]), np.concatenate([score, m[new] @ q]), k)
            if len(at) == k and bound < score[-1]:
                break
            depth, step = to, step * 2
        return at, score


def top_k(vectors: DataFrame, queries: Column, k: int = 5, scale: int = 256, shard: int = 16_384, block: int = 256, most: int = 1 << 25, id_col: str = "vec_id", vector_col: str = "embedding") -> DataFrame:
    """Each query's k best rows by integer inner product of the scaled vectors.

    Returns query_id, rank (from 1), vec_id, score; all rows if there are fewer, ties to the
    smaller id, never the query's own id. Rows with a null id, a null vector or null or
    non-finite components take no part. Sums are exact; a component beyond 2**62 after scaling, or
    a score beyond a long among the results, is an error. A shorter vector counts as padded with
    zeros. A repeated id is a candidate each time; as a query it counts once, with the smallest of
    its vectors. An empty table gives none.

    Queries come to the driver ``most`` bytes at a time and go to all tasks; each passes over the
    shards of its partition once, and keeps k rows a query from shard to shard, whose kth score
    is where the next search may stop.
    """
    v = F.col(vector_col)
    sound = F.col(id_col).isNotNull() & v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    rows = vectors.filter(F.coalesce(sound, F.lit(False)))
    rows = rows.select(F.col(id_col).cast("long").alias("id"), scaled(v, scale).alias("v"), F.coalesce(queries, F.lit(False)).alias("is_query"))
    shards = _packed(rows.select("id", "v"), shard, "topk-shards")
    asked = _packed(rows.filter("is_query").groupBy("id").agg(F.min("v").alias("v")), block, "topk-queries")
    context = vectors.sparkSession.sparkContext
    found: DataFrame | None = None

    def run(blocks: list[Row]) -> DataFrame:
        shared = context.broadcast([tuple(b) for b in blocks])

        def search(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
            asked = [(int(i), q) for b in shared.value for i, q in zip(*_unpacked(Row("ids", "width", "m")(*b)), strict=True)]
            best: list[tuple[np.ndarray, np.ndarray] | None] = [None] * len(asked)
            for frame in frames:
                for r in frame.itertuples(index=False):
                    lists = Lists(*_unpacked(r))
                    for i, (own, q) in enumerate(asked):
                        best[i] = lists.search(q, own, k, best[i])
            for at in range(0, len(asked), 10_000):
                some = [(own, *b) for (own, _), b in zip(asked[at : at + 10_000], best[at : at + 10_000], strict=True) if b is not None]
                if some:
                    score = np.concatenate([s for _, _, s in some])
                    if score.dtype != float and any(abs(int(s)) >= 1 << 63 for s in score):
                        raise OverflowError("a score among the results does not fit a long")
                    yield pd.DataFrame({"query_id": np.repeat([o for o, _, _ in some], [len(i) for _, i, _ in some]), "vec_id": np.concatenate([i for _, i, _ in some]), "score": score.astype(np.int64)})

        out = written(shards.mapInPandas(search, "query_id long, vec_id long, score long"), "topk-found")
        shared.unpersist()
        return out

    blocks: list[Row] = []
    size = 0
    for b in asked.toLocalIterator():
        if blocks and size + len(b.m) > most:
            out, blocks, size = run(blocks), [], 0
            found = out if found is None else found.unionByName(out)
        blocks.append(b)
        size += len(b.m)
    out = run(blocks)
    found = out if found is None else found.unionByName(out)
    forget(shards, asked)
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")
