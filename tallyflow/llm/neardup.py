"""Near-duplicates by order MinHash, verified by banded alignment."""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .scratch import fingerprint, forget, free, written
from .sketch import levels
from .textscan import Powers, Slice, mix, rolling, slices, word_bounds, word_hashes


def shingles(hashes: np.ndarray, k: int, powers: Powers) -> np.ndarray:
    """Hash of every k consecutive words; of all words where there are fewer than k."""
    return rolling(hashes, min(k, len(hashes)), powers, 5 + len(hashes) if 0 < len(hashes) < k else 0) if len(hashes) else hashes


def parity(grams: np.ndarray) -> np.ndarray:
    """512 bits of a set of hashes, each bit the parity of the members that fall on it. Two sets'
    bits differ in at most as many places as the sets themselves."""
    n = np.bincount((grams >> np.uint64(55)).astype(np.int64), minlength=512) & 1
    return np.packbits(n.astype(np.uint8)).view("<i8")


def order_sketch(grams: np.ndarray, seeds: np.ndarray, size: int) -> np.ndarray:
    """One key for each seed: the ``size`` k-mers of least hash, k-mers labelled by their
    occurrence in the text, kept in text order."""
    label = np.zeros(len(grams), np.uint64)
    order = np.argsort(grams, kind="stable")
    run = grams[order]
    if (run[1:] == run[:-1]).any():
        new = np.flatnonzero(np.concatenate([[True], run[1:] != run[:-1]]))
        label[order] = np.arange(len(run)) - np.repeat(new, np.diff(np.append(new, len(run))))
    named = mix(grams + label * np.uint64(0x9E3779B97F4A7C15), 90)
    hashed = (named[None, :] ^ seeds[:, None]) * np.uint64(0xD6E8FEB86659FD93)
    if len(grams) > size:
        at = np.sort(np.argpartition(hashed, size, axis=1)[:, :size], axis=1)
    else:
        at = np.broadcast_to(np.arange(len(grams)), (len(seeds), len(grams)))
    key = seeds.copy()
    for column in grams[at].T:
        key = mix(key ^ column, 91) * np.uint64(0xA0761D6478BD642F)
    return key


def edits_within(a: list[int], b: list[int], most: int) -> bool:
    """Whether insertions, deletions and replacements of words, at most ``most``, turn a into b.

    Fills, edit by edit, the furthest row reached on each diagonal of the band |k| <= most.
    """
    n, m = len(a), len(b)
    if abs(n - m) > most:
        return False
    reach: dict[int, int] = {}
    for d in range(most + 1):
        new = {}
        for k in range(-min(d, most), min(d, most) + 1):
            if d == 0:
                i = 0
            else:
                i = max(reach.get(k, -2) + 1, reach.get(k - 1, -2) + 1, reach.get(k + 1, -2))
                if i < 0:
                    continue
            i = min(i, n, m + k)
            j = i - k
            if i < 0 or j < 0:
                continue
            while i < n and j < m and a[i] == b[j]:
                i += 1
                j += 1
            if i == n and j == m:
                return True
            new[k] = i
        reach = new
    return False


def similar(x: np.ndarray, y: np.ndarray, k: int, least: float, powers: Powers) -> bool:
    """Jaccard similarity of the sets of k-word shingles, and word edit similarity, >= least."""
    if not len(x) or not len(y):
        return False
    s, t = np.unique(shingles(x, k, powers)), np.unique(shingles(y, k, powers))
    if min(len(s), len(t)) < least * max(len(s), len(t)):
        return False
    both = len(np.intersect1d(s, t, assume_unique=True))
    if both < least * (len(s) + len(t) - both):
        return False
    head = min(len(x), len(y))
    miss = np.flatnonzero(x[:head] != y[:head])
    lo = int(miss[0]) if len(miss) else head
    miss = np.flatnonzero(x[len(x) - head + lo :][::-1] != y[len(y) - head + lo :][::-1])
    hi = int(miss[0]) if len(miss) else head - lo
    most = int((1 - least) * max(len(x), len(y)) + 1e-9)
    return edits_within(x[lo : len(x) - hi].tolist(), y[lo : len(y) - hi].tolist(), most)


def components(links: DataFrame) -> DataFrame:
    """(node, comp): the least node of each connected component of the links (x, y).

    Each node points to its least neighbour, if that is less, and on to where that leads; the links
    between what then has one label go, the rest link labels. At least half of the labels go each
    round, and the links of a hot node with the first; joins on it are left to skew-aware sort-merge joins.
    """
    edges = written(links.select("x", "y").unionByName(links.select(F.col("y").alias("x"), F.col("x").alias("y"))).filter("x != y").distinct(), "link-edges")
    state = None
    while edges.limit(1).count():
        low = written(edges.groupBy("x").agg(F.min("y").alias("y")).select(F.col("x").alias("node"), F.least("x", "y").alias("comp")), "link-labels")
        while True:
            jump = low.join(low.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp")
            new = written(jump.select("node", F.col("next").alias("comp"), (F.col("next") != F.col("comp")).alias("moved")), "link-labels")
            forget(low)
            low = new
            if not low.filter("moved").limit(1).count():
                break
        kept = edges.join(low.select(F.col("node").alias("x"), F.col("comp").alias("a")), "x").join(low.select(F.col("node").alias("y"), F.col("comp").alias("b")), "y")
        kept = written(kept.filter("a != b").select(F.col("a").alias("x"), F.col("b").alias("y")).distinct(), "link-edges")
        forget(edges)
        edges = kept
        new = low.select("node", "comp") if state is None else written(_led(state, low), "link-labels")
        new._written_at = low._written_at if state is None else new._written_at
        if state is not None:
            forget(state, low)
        state = new
    forget(edges)
    return links.select(F.col("x").alias("node"), F.col("x").alias("comp")).limit(0) if state is None else state


def _led(labels: DataFrame, on: DataFrame) -> DataFrame:
    """Labels, replaced by where ``on`` leads them."""
    return labels.join(on.select(F.col("node").alias("comp"), F.col("comp").alias("next")), "comp", "left").select("node", F.coalesce("next", "comp").alias("comp"))


def with_more(labels: DataFrame, links: DataFrame) -> DataFrame:
    """The components (node, comp) when more links come; the links' ends meet under their labels."""
    x, y = (labels.select(F.col("node").alias(c), F.col("comp").alias(f"_{c}")) for c in ("x", "y"))
    ends = links.join(x, "x", "left").join(y, "y", "left").select(F.coalesce("_x", "x").alias("x"), F.coalesce("_y", "y").alias("y"))
    roots = written(components(written(ends, "link-ends")), "link-roots")
    new = roots.select("node", F.col("node").alias("comp")).join(labels.select("node"), "node", "left_anti")
    return written(_led(labels.unionByName(new), roots), "link-labels")


def _apart_bits(a: str, b: str) -> Column:
    """In how many places two texts' parities differ."""
    return sum((F.bit_count(F.col(a)[i].bitwiseXOR(F.col(b)[i])) for i in range(1, 8)), F.bit_count(F.col(a)[0].bitwiseXOR(F.col(b)[0])))


def _may_be(least: float, n: str, m: str, a: str, b: str) -> Column:
    """Whether sets of n and m shingles with parities a and b may have a Jaccard similarity of
    ``least``: it allows their sets to differ in (n + m) * (1 - least) / (1 + least) members."""
    x, y = F.col(n), F.col(m)
    return (F.least(x, y) >= F.lit(least) * F.greatest(x, y) - 1e-6) & (_apart_bits(a, b) <= (x + y) * F.lit((1 - least) / (1 + least)) + 1e-6)


class Texts:
    """The distinct texts of a table, numbered, with their sketches.

    ``table``: node, the text's fingerprint (f, g), first (its least doc_id), n (its shingles), sig
    (their parity) and keys (its bands); ``words``: texts of the nodes that share a band.
    """

    def __init__(self, sure: DataFrame, f: str, g: str, k: int, bands: int, size: int):
        self.k, self.rows = k, sure.select(F.col(f).alias("f"), F.col(g).alias("g"), "doc_id", "text")
        seeds = mix(np.arange(1, bands + 1, dtype=np.uint64), 95)

        def sketch(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                for part in slices(batch.column(3)):
                    powers = Powers()
                    starts, ends, words = word_bounds(part)
                    hashes = word_hashes(part, starts, ends)
                    grams = rolling(hashes, k, powers)
                    keys, counts, sigs = [], np.zeros(part.rows, np.int32), np.zeros((part.rows, 8), np.int64)
                    for i, (lo, hi) in enumerate(zip(words[:-1], words[1:], strict=True)):
                        if hi > lo:
                            own = grams[lo : hi - k + 1] if hi - lo >= k else shingles(hashes[lo:hi], k, powers)
                            keys.append(order_sketch(own, seeds, size))
                            own = np.unique(own)
                            counts[i], sigs[i] = len(own), parity(own)
                    flat = pa.array(np.concatenate(keys).view(np.int64) if keys else np.zeros(0, np.int64))
                    off = np.concatenate([[0], np.cumsum((counts > 0) * bands)]).astype(np.int32)
                    own = batch.slice(part.first, part.rows)
                    yield pa.RecordBatch.from_arrays([*own.columns[:3], pa.array(counts), pa.FixedSizeListArray.from_arrays(pa.array(sigs.ravel()), 8).cast(pa.list_(pa.int64())), pa.ListArray.from_arrays(pa.array(off), flat)], ["f", "g", "doc_id", "n", "sig", "keys"])

        drawn = self.rows.mapInArrow(sketch, f"f long, g long, doc_id {sure.schema['doc_id'].dataType.simpleString()}, n int, sig array<long>, keys array<long>")
        one = drawn.groupBy("f", "g").agg(F.min("doc_id").alias("first"), *[F.first(c).alias(c) for c in ("n", "sig", "keys")])
        self.table = written(one.withColumn("node", F.monotonically_increasing_id()), "omh-texts")
        self.slim = self.table.select("node", "n", "sig")
        self.words: DataFrame | None = None

    def bands(self) -> DataFrame:
        return self.table.select("node", F.posexplode("keys").alias("band", "key"))

    def fetch(self, nodes: DataFrame) -> None:
        """Write the texts of ``nodes``; one row speaks for its copies."""
        chosen = self.table.join(nodes, "node").select("node", "f", "g", "first")
        found = self.rows.join(chosen, ["f", "g"]).filter(F.col("doc_id").eqNullSafe(F.col("first")))
        self.words = written(found.groupBy("node").agg(F.first("text").alias("text")), "omh-words")

    def near(self, pairs: DataFrame, least: float) -> DataFrame:
        """The distinct pairs (x, y) that sizes and parities allow to be similar."""
        x = self.slim.select(F.col("node").alias("x"), F.col("n").alias("nx"), F.col("sig").alias("sx"))
        y = self.slim.select(F.col("node").alias("y"), F.col("n").alias("ny"), F.col("sig").alias("sy"))
        return pairs.distinct().join(x, "x").join(y, "y").filter(_may_be(least, "nx", "ny", "sx", "sy")).select("x", "y")

    def similar(self, pairs: DataFrame, least: float) -> DataFrame:
        """The pairs of texts (x, y) that are similar."""
        k = self.k

        def check(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            powers = Powers()
            for batch in batches:
                for at in range(0, batch.num_rows, 200):
                    part = batch.slice(at, 200)
                    words = []
                    for column in (2, 3):
                        own = []
                        for piece in slices(part.column(column)):
                            starts, ends, off = word_bounds(piece)
                            hashes = word_hashes(piece, starts, ends)
                            own += [hashes[lo:hi] for lo, hi in zip(off[:-1], off[1:], strict=True)]
                        words.append(own)
                    good = [similar(x, y, k, least, powers) for x, y in zip(*words, strict=True)]
                    yield part.select([0, 1]).filter(pa.array(good))

        both = pairs.join(self.words.select(F.col("node").alias("y"), F.col("text").alias("ty")), "y")
        both = both.join(self.words.select(F.col("node").alias("x"), F.col("text").alias("tx")), "x")
        return both.select("x", "y", "tx", "ty").mapInArrow(check, "x long, y long")


def _classes(sure: DataFrame, f: str, g: str, k: int, least: float, bands: int, size: int, whole: int) -> DataFrame:
    """(f, g, class_id, first, chosen) of each distinct text; one text of each class is chosen."""
    texts = Texts(sure, f, g, k, bands, size)
    full = written(texts.bands().groupBy("band", "key").agg(F.count("*").alias("many")).filter("many > 1"), "omh-buckets")
    held = written(texts.bands().join(full, ["band", "key"]), "omh-members")
    forget(full)
    lead = written(_leaders(held, texts), "omh-leaders")
    texts.fetch(held.select("node").distinct())
    pairs = held.select("band", "key", "node").join(lead, ["band", "key"]).filter("node != leader")
    pairs = written(texts.near(pairs.select(F.least("leader", "node").alias("x"), F.greatest("leader", "node").alias("y")), least), "omh-pairs")
    links = written(texts.similar(pairs, least), "omh-links")
    labels = components(links) if links.limit(1).count() else None
    more = _apart(held, labels, texts, least, whole)
    more = written(texts.near(more, least).join(pairs, ["x", "y"], "left_anti"), "omh-pairs")
    if more.limit(1).count():
        found = written(texts.similar(more, least), "omh-links")
        if found.limit(1).count():
            labels = components(found) if labels is None else with_more(labels, found)
    each = texts.table.select("node", "f", "g", "first")
    if labels is None:
        return each.select("f", "g", F.col("first").alias("class_id"), "first", F.lit(True).alias("chosen"))
    named = each.join(labels, "node")
    head = named.groupBy("comp").agg(F.min(F.struct(F.col("first").isNull().alias("none"), "first", "node")).alias("head"))
    named = named.join(written(head, "omh-heads-of"), "comp").select("node", F.col("head.first").alias("class_id"), F.col("head.node").alias("chosen"))
    each = each.join(named, "node", "left")
    own = F.col("chosen").isNull()
    return written(each.select("f", "g", F.when(own, F.col("first")).otherwise(F.col("class_id")).alias("class_id"), "first", (own | (F.col("chosen") == F.col("node"))).alias("chosen")), "omh-each")


def _leaders(held: DataFrame, texts: Texts) -> DataFrame:
    """(band, key, leader): the member in the middle of each bucket.

    Its own keys are those that most others have. In a large group many texts have all of these, and
    are far from each other where no key looks: of them, the one whose parity is the commonest, by 32 bits.
    """
    own = written(held.groupBy("node").agg(F.sum("many").alias("weight")).join(texts.slim, "node"), "omh-weights")
    halves = F.flatten(F.transform("sig", lambda x: F.array(x.bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(x, 32))))
    bits = own.select("node", F.posexplode(halves).alias("at", "bits")).filter("bits != 0")
    votes = bits.join(bits.groupBy("at", "bits").agg(F.count("*").alias("many")), ["at", "bits"]).groupBy("node").agg(F.sum("many").alias("votes"))
    ranks = own.select("node", "weight").join(votes, "node", "left").select("node", F.struct("weight", F.coalesce("votes", F.lit(0)).alias("votes"), "node").alias("rank"))
    return held.select("band", "key", "node").join(ranks, "node").groupBy("band", "key").agg(F.max_by("node", "rank").alias("leader"))


def near_duplicates(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 12, size: int = 3, whole: int = 50) -> DataFrame:
    """Add class_id to every row, replacing a column of this name.

    Two texts are linked if the Jaccard similarity of their sets of k-word shingles and their
    word edit similarity are both at least ``least``; classes are the connected components, with
    rows of equal text together. class_id is the least doc_id of the class (null if it has none).
    Texts without words are alike only if equal; null texts are alike to none, and have their own
    doc_id as class_id. A text of fewer than k words is one shingle. Repeated rows are copies. An
    empty table gives none.

    Candidates agree on a band: an order MinHash of ``size`` k-mers. In each bucket all members
    meet one leader, the member whose bands are the commonest, and of several such the one whose
    parity is: in a group of near copies that is the text they all stem from, or the one closest to it. Two members near enough to the middle to
    be similar on that account alone are both similar to it. Buckets still in several components
    are then settled (``_apart``): one of at most ``whole`` texts is compared whole, the texts of
    larger ones by their rarest shingles, which loses no link. Pairs whose numbers of shingles or
    whose parities rule out the similarity are never looked at. At similarity 0.8 a pair shares
    no bucket at all with a probability of about (1 - 0.8**size)**bands, 0.0002.
    """
    plain = docs.drop("class_id")
    f, g, f2, g2, none = free(plain, "_f", "_g", "_f2", "_g2", "_none")
    u, v = fingerprint("text")
    plain = plain.withColumns({f: u, g: v, none: F.col("text").isNull()})
    each = _classes(plain.filter(F.col("text").isNotNull()), f, g, k, least, bands, size, whole)
    each = each.select(F.col("f").alias(f2), F.col("g").alias(g2), "class_id")
    out = plain.join(each, (plain[f] == each[f2]) & (plain[g] == each[g2]), "left")
    return out.withColumn("class_id", F.when(F.col(none), F.col("doc_id")).otherwise(F.col("class_id"))).drop(f, g, f2, g2, none)


def one_of_each(docs: DataFrame, k: int = 5, least: float = 0.8, bands: int = 12, size: int = 3, whole: int = 50) -> DataFrame:
    """One row of each class of ``near_duplicates``, the one of the least doc_id (one of them, if
    that is repeated); null texts all stay. No column is added."""
    f, g, f2, g2, first = free(docs, "_f", "_g", "_f2", "_g2", "_first")
    u, v = fingerprint("text")
    sure = docs.filter(F.col("text").isNotNull()).withColumns({f: u, g: v})
    each = _classes(sure, f, g, k, least, bands, size, whole).filter("chosen")
    each = each.select(F.col("f").alias(f2), F.col("g").alias(g2), F.col("first").alias(first))
    kept = sure.join(each, (sure[f] == each[f2]) & (sure[g] == each[g2]) & F.col("doc_id").eqNullSafe(F.col(first)), "left_semi")
    return kept.dropDuplicates([f, g]).drop(f, g).unionByName(docs.filter(F.col("text").isNull()))


def _apart(held: DataFrame, labels: DataFrame | None, texts: Texts, least: float, whole: int) -> DataFrame:
    """Pairs of texts (x, y) in different components that share a bucket and may be similar.

    A bucket of at most ``whole`` texts is compared whole. The texts of larger ones are dealt
    anew, by shingles: in one order of all shingles, the rarest first, two texts that are similar
    share one among the first n - ceil(least * n) + 1 of each. What made the bucket large, a passage
    common to many texts, comes last in that order. How rare a shingle is says a count of the cell it
    falls on (at most 2**25 cells): any order serves that is the same for all texts.
    """
    own = held.select("band", "key", "node")
    if labels is None:
        own = own.withColumn("comp", F.col("node"))
    else:
        own = own.join(labels, "node", "left").withColumn("comp", F.coalesce("comp", "node"))
    own = own.withColumns({"pos": F.lit(0), "near": F.lit(True)})
    own = written(_mixed(written(own, "omh-own"), ["band", "key"]), "omh-mixed")
    few = own.filter(F.col("texts") <= whole).join(texts.slim, "node")
    pairs = _met(few, ["band", "key"], least)
    large = written(own.filter(F.col("texts") > whole).groupBy("node").agg(F.first("comp").alias("comp")).join(texts.slim.select("node", "n"), "node"), "omh-large")
    total = large.agg(F.sum("n")).first()[0]
    if not total:
        return pairs
    k = texts.k
    bits = min(25, max(16, (4 * total).bit_length()))

    def sets(column: pa.Array) -> Iterator[tuple[Slice, list[np.ndarray]]]:
        for part in slices(column):
            powers = Powers()
            starts, ends, words = word_bounds(part)
            hashes = word_hashes(part, starts, ends)
            yield part, [np.unique(shingles(hashes[lo:hi], k, powers)) for lo, hi in zip(words[:-1], words[1:], strict=True)]

    def read() -> Callable[[pa.RecordBatch], Iterator[np.ndarray]]:
        return lambda batch: (np.concatenate(own) for _, own in sets(batch.column(2)))

    def heads(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        times = shared.value
        for batch in batches:
            for part, own in sets(batch.column(2)):
                rows, grams, places, near = [], [], [], []
                for i, s in enumerate(own):
                    n = len(s)
                    stop, fore = (n + 1 - math.ceil(x * n - 1e-9) for x in (least, 2 * least / (1 + least)))
                    t = times[(s >> np.uint64(64 - bits)).astype(np.int64)]
                    order = np.lexsort((s, t))[:stop]
                    order = order[t[order] > 1]  # those met once stand first, and meet nothing
                    rows.append(np.full(len(order), part.first + i))
                    grams.append(s[order])
                    places.append(np.arange(stop - len(order), stop))
                    near.append(places[-1] < fore)
                row, gram, place, first = (np.concatenate(x) for x in (rows, grams, places, near))
                row = pa.array(row.astype(np.int64))
                yield pa.RecordBatch.from_arrays([batch.column(0).take(row), batch.column(1).take(row), pa.array(gram.view(np.int64)), pa.array(place.astype(np.int32)), pa.array(first.astype(bool))], ["node", "comp", "gram", "pos", "near"])

    found = texts.words.join(large, "node").select("node", "comp", "text")
    shared = held.sparkSession.sparkContext.broadcast(levels(found, read, bits))
    head = written(found.mapInArrow(heads, "node long, comp long, gram long, pos int, near boolean"), "omh-heads")
    met = written(_mixed(head, ["gram"], "max(near)"), "omh-met").join(texts.slim, "node")
    return pairs.unionByName(_met(met, ["gram"], least))


def _mixed(own: DataFrame, by: list[str], also: str = "true") -> DataFrame:
    """The rows of groups that hold several components (and fulfil ``also``), with the group's
    number of ``texts`` and ``main``, its largest component."""
    parts = own.groupBy(*by, "comp").agg(F.count("*").alias("m"), F.max("near").alias("near"))
    mixed = parts.groupBy(*by).agg(F.max_by("comp", F.struct("m", "comp")).alias("main"), F.count("*").alias("parts"), F.sum("m").alias("texts"), F.expr(also).alias("also"))
    mixed = written(mixed.filter("parts > 1 AND also").drop("parts", "also"), "omh-groups")
    return own.join(mixed, by).select(*by, *[c for c in own.columns if c not in by], "main", "texts")


def _met(own: DataFrame, by: list[str], least: float) -> DataFrame:
    """Pairs (x, y) in which every text outside its group's largest component meets the texts of all others.

    Left out are those whose numbers of shingles ``n``, whose parities ``sig`` or the place ``pos`` of the
    shared one in their orders rule out a similarity of ``least``: the shingles from there on are all that
    they can still share. The text with fewer shingles must have it among its first (``near``).
    """
    side = [F.col(c).alias(f"_{c}") for c in ("node", "n", "sig", "comp", "pos", "near")]
    out = own.filter("comp != main").select(*by, *side)
    once = (F.col("_comp") != F.col("comp")) & ((F.col("comp") == F.col("main")) | (F.col("_node") < F.col("node")))
    enough = F.least(F.col("_n") - F.col("_pos"), F.col("n") - F.col("pos")) >= F.lit(least / (1 + least)) * (F.col("_n") + F.col("n")) - 1e-6
    may = once & enough & _may_be(least, "_n", "n", "_sig", "sig")
    fewer = out.filter("_near").join(own, by).filter(may & (F.col("_n") <= F.col("n")))
    more = out.join(own.filter("near"), by).filter(may & (F.col("n") < F.col("_n")))
    return fewer.unionByName(more).select(F.least("_node", "node").alias("x"), F.greatest("_node", "node").alias("y"))
