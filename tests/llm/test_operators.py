"""The ten operators on small tables with nulls, empty and long texts, ties and repeated rows, each
against a brute-force version."""

import collections
import hashlib
import itertools
import random
import re
import tracemalloc
import zlib

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from tallyflow.llm import langid, linededup, lmscore, mixing, neardup, packing, quality, substring, suffix, topk
from tallyflow.llm.queries import tokenizer_path
from tallyflow.llm.sketch import Anchors, repeated_cells
from tallyflow.llm.suffix import least_owner, suffix_array
from tallyflow.llm.textscan import Powers

WORD = re.compile(r"[^\x20\x09-\x0D]+")
KINDS = "doc_id long, text string, lang string, source string, n_chars long, size string, score string"


def texts() -> list:
    rnd = random.Random(5)
    bag = ["ab", "cd", "é", "fg.", "hi", "日本", "k", "lm", "no", "pq,", "rs", "tu"]
    passage = " ".join(f"{rnd.choice(bag)}{i}" for i in range(60))
    base = " ".join(f"{rnd.choice(bag)}{rnd.randrange(50)}" for _ in range(200))
    near = base.split()
    near[100] = "other"
    out = [base, base, " ".join(near), passage, "x " + passage + "\ty", None, "", "  \n\t ", "12 34 !!", "a " * 80, "one\nTwo \n two\n\nthree", "Is a <|endoftext|> mark"]
    out += [f"{' '.join(rnd.choice(bag) + str(rnd.randrange(9)) for _ in range(rnd.randrange(1, 90)))}\n  Same LINE\nend {i}" for i in range(24)]
    return [*out, " ".join(f"{rnd.choice(bag)}{rnd.randrange(4000)}" for _ in range(9000))]


@pytest.fixture(scope="module")
def rows():
    langs, sources = ["en", "fr", None], ["b", "a", None, "c"]
    out = [(i, t, langs[i % 3], sources[i % 4], None, "s", None) for i, t in enumerate(texts())]
    return [*out, out[0], (None, "alone of its id", "en", "a", 1, None, None), (None, None, None, None, None, None, None)]


@pytest.fixture(scope="module")
def docs(spark, rows):
    return spark.createDataFrame(rows, KINDS).repartition(3).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], KINDS)


def words(t):
    return WORD.findall(t or "")


def test_packing(docs, rows, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    got = packing.pack(docs, tokenizer_path(), 64, 1).collect()
    want = collections.Counter()
    for r in rows:
        ids = np.asarray([*tok.encode(r[1] or "", add_special_tokens=False).ids, 1], "<u4")
        for k in range(0, len(ids), 64):
            want[r[0], k // 64, k, len(ids[k : k + 64]), zlib.crc32(ids[k : k + 64].tobytes())] += 1
    assert collections.Counter((r.doc_id, r.piece, r.start, r.length, r.ids_crc32) for r in got) == want
    ends = collections.defaultdict(int)
    for r in sorted(got, key=lambda r: (r.sequence_id, r.offset)):
        assert r.offset == ends[r.sequence_id]
        ends[r.sequence_id] += r.length
    assert max(ends.values()) <= 64 and len(ends) <= -(-sum(r.length for r in got) // 64) + 1
    assert packing.pack(empty, tokenizer_path()).count() == 0


@pytest.mark.parametrize("seed", range(6))
def test_plans_use_each_piece_once_and_are_best(seed):
    rnd = random.Random(seed)
    sizes = [rnd.randrange(1, 21) for _ in range(9)]
    counts = collections.Counter(sizes)
    plan = packing.plan(counts, 20)
    used = collections.Counter()
    for items, n in plan:
        assert sum(items) <= 20
        for x in items:
            used[x] += n
    assert used == counts

    def fits(bins):
        def put(i, room):
            if i == len(order):
                return True
            return any(put(i + 1, room[:k] + (room[k] - order[i],) + room[k + 1 :]) for k in dict.fromkeys(range(bins)) if room[k] >= order[i])

        return put(0, (20,) * bins)

    order = sorted(sizes, reverse=True)
    assert sum(n for _, n in plan) == next(b for b in itertools.count(-(-sum(sizes) // 20)) if fits(b))


def test_every_letter_below_u0250_has_its_ids():
    """Alone, within a word, before marks and beside the letters around it."""
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(tokenizer_path())
    texts = [x for c in map(chr, range(0x21, 0x250)) for x in (c, f"ab{c}cd", f"{c}., x", f"Q{c}(", f"{c}{c.upper()}{c.lower()} {c}li", f"{c}\u0301")]
    own = packing.ChunkTokenizer(tokenizer_path()).encode(texts)
    for t, ids in zip(texts, own, strict=True):
        assert np.frombuffer(ids, "<u4").tolist() == tok.encode(t, add_special_tokens=False).ids, t


def test_a_search_of_many_sequences_holds_little():
    """Pairs that leave too little for a third: the bound on sequences is out of reach, all of the nodes are searched."""
    rnd = random.Random(0)
    sizes = [rnd.randrange(1400, 2100) for _ in range(9000)]
    tracemalloc.start()
    try:
        plan = packing.plan(collections.Counter(sizes), 4096, nodes=4000)
        peak = tracemalloc.get_traced_memory()[1]
    finally:
        tracemalloc.stop()
    used = collections.Counter()
    for items, n in plan:
        assert sum(items) <= 4096
        for x in items:
            used[x] += n
    assert used == collections.Counter(sizes) and peak < 40e6  # 165 MB with a copy of the counts for each sequence


@pytest.mark.parametrize("seed", range(8))
def test_all_undominated_fillings_are_enumerated(seed):
    rnd = random.Random(seed)
    count = np.zeros(31, np.int64)
    for _ in range(7):
        count[rnd.randrange(2, 16)] += 1
    pieces = [i for i in range(31) for _ in range(count[i])]
    room = 24
    every = {tuple(sorted(c, reverse=True)) for n in range(len(pieces) + 1) for c in itertools.combinations(pieces, n) if sum(c) <= room}
    want = {c for c in every if not packing.dominated(count, c, room - sum(c))}
    got = list(packing.all_fillings(count, room, room))
    assert len(got) == len(set(got)) and set(got) == want


def test_language(spark, docs, empty):
    rnd = random.Random(2)
    bag = {"en": "the and of with that this have from".split(), "de": "der und mit nicht auf ist ein zu".split()}
    made = spark.createDataFrame([(i, " ".join(rnd.choice(bag[x]) for _ in range(30)), x) for i in range(120) for x in [("en", "de")[i % 2]]], "doc_id long, text string, lang string")
    got = langid.identify(made).collect()
    assert all(r.lang_pred == r.lang and 0 <= r.score <= 1 for r in got)
    assert all(r.held_out == (zlib.crc32(str(r.doc_id).encode()) % 4 == 2) for r in got)
    odd = {r.text: r.lang_pred for r in langid.identify(docs).collect()}
    assert odd[None] == odd[""] == odd["12 34 !!"] == "und"
    signs = spark.createDataFrame([(i, x, "en") for i, x in enumerate(["½ ²", "① Ⅷ", "三", "a½", "x" * 700_000, "_ 4"])], "doc_id long, text string, lang string")
    assert [r.lang_pred for r in langid.identify(signs).orderBy("doc_id").collect()] == ["und", "und", "en", "en", "en", "und"]
    one, two = np.zeros((1, langid.CELLS)), np.zeros((1, langid.CELLS))
    long = " ".join(rnd.choice(bag["en"]) + str(i) for i in range(400))
    assert (langid.presence([long], one) == langid.presence([long], two, most=17)).all()
    assert langid.identify(empty).count() == 0


def test_top_k(spark):
    rng = np.random.default_rng(3)
    m = np.round(rng.normal(size=(90, 6)), 1)
    m[7] = m[8]
    data = [(i, [float(x) for x in m[i]]) for i in range(90)] + [(200, None), (250, [1.0, None, 0.0, 0.0, 0.0, 0.0]), (300, [float("nan"), 1.0]), (None, [1.0] * 6)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<float>").repartition(3)
    got = {(r.query_id, r["rank"]): (r.vec_id, r.score) for r in topk.top_k(df, F.pmod("vec_id", F.lit(10)) == 0, k=4, shard=16, block=3).collect()}
    q = np.floor(256 * m.astype(np.float32).astype(float)).astype(int)
    for i in range(0, 90, 10):
        best = sorted(((-int(q[i] @ q[j]), j) for j in range(90) if j != i))[:4]
        assert [got[i, k + 1] for k in range(4)] == [(j, -s) for s, j in best]
    assert len(got) == 36
    far = spark.createDataFrame([(0, [10000.0, 1.0]), (1, [9000.0, 0.0]), (2, [8500.0, 3.0]), (50, [9999.0, 2.0])], "vec_id long, embedding array<double>")
    for factor in (1.0, 1000.0):
        large = far.select("vec_id", F.transform("embedding", lambda x: x * factor).alias("embedding"))
        m = {r.vec_id: [int(256 * x) for x in r.embedding] for r in large.collect()}
        want = sorted(((-sum(x * y for x, y in zip(m[0], m[j], strict=True)), j) for j in (1, 2, 50)))
        got = topk.top_k(large, F.col("vec_id") == 0, k=3).orderBy("rank").collect()
        assert [(r.vec_id, r.score) for r in got] == [(j, -s) for s, j in want] and [r.vec_id for r in got] == [50, 1, 2]
    with pytest.raises(Exception, match="does not fit a long"):
        topk.top_k(far.select("vec_id", F.transform("embedding", lambda x: x * 1e15).alias("embedding")), F.col("vec_id") == 0).collect()
    assert topk.top_k(df.filter("vec_id = 300"), F.lit(True)).count() == 0


def test_repeated_windows(docs, rows, empty):
    got = collections.Counter((r.doc_id, r.n_words, r.n_removed, r.kept) for r in substring.remove_repeated_windows(docs, 35, 20).collect())
    seen = collections.Counter(tuple(w[i : i + 35]) for r in rows for w in [words(r[1])] for i in range(len(w) - 34))
    want = collections.Counter()
    for r in rows:
        w = words(r[1])
        gone = set().union(*[range(i, i + 35) for i in range(len(w) - 34) if seen[tuple(w[i : i + 35])] > 1])
        want[r[0], len(w), len(gone), " ".join(x for i, x in enumerate(w) if i not in gone)] += 1
    assert got == want
    assert substring.remove_repeated_windows(empty, 35, 20).count() == 0


def test_lines(docs, rows, empty):
    key = lambda x: x.strip(" \t\n\x0b\x0c\r").translate({i: i + 32 for i in range(65, 91)})
    lines = [(r[1] or "").split("\n") for r in rows]
    seen = collections.Counter(k for x in lines for k in {key(y) for y in x} if k)
    want = collections.Counter((r[0], len(x), sum(seen[key(y)] >= 10 for y in x), "\n".join(y for y in x if seen[key(y)] < 10)) for r, x in zip(rows, lines, strict=True))
    one = "\n".join(f"line {i}" for i in range(150_000))
    long = linededup.drop_frequent_lines(docs.select("doc_id", "text").limit(0).unionByName(docs.sparkSession.createDataFrame([(i, one) for i in range(2)], "doc_id long, text string")), 2).collect()
    assert [(r.n_lines, r.n_dropped, r.text) for r in long] == [(150_000, 150_000, "")] * 2
    for batches in (1, 6):
        got = collections.Counter((r.doc_id, r.n_lines, r.n_dropped, r.text) for r in linededup.drop_frequent_lines(docs, 10, batches).collect())
        assert got == want
    assert linededup.drop_frequent_lines(empty).count() == 0


def test_mixture(spark, docs, rows, empty):
    got = mixing.mix(docs).collect()
    assert len(got) == len(rows) and all(r["size"] == len(words(r.text)) for r in got)
    total = sum(r["size"] for r in got)
    by = {r.source: (r.source_size, r.target) for r in got}
    assert abs(sum(t for _, t in by.values()) - total) < 1e-6 * total
    assert all(t <= 3 * s + 1e-9 for s, t in by.values()) and all(r.copies <= 3 for r in got)
    rnd = random.Random(1)
    many = spark.createDataFrame([(i, "w " * rnd.randrange(1, 60), "abcd"[i % 4]) for i in range(2000)], "doc_id long, text string, source string")
    out = mixing.mix(many)
    for r in out.groupBy("source").agg(F.sum(F.col("copies") * F.col("size")).alias("k"), F.first("target").alias("t")).collect():
        assert abs(r.k - r.t) <= 120
    assert sorted(map(str, out.collect())) == sorted(map(str, mixing.mix(many.repartition(5)).collect()))
    assert mixing.mix(empty).count() == 0 and mixing.copied(mixing.mix(docs)).columns == [c for c in docs.columns if c != "size"]


def test_quality(spark, docs, rows, empty):
    rnd = random.Random(4)
    bag = "the quick brown fox jumps over a lazy dog while seven wizards brew tea".split()
    made = spark.createDataFrame([(i, " ".join(rnd.choice(bag) + ("%%%" if i % 3 == 0 else "") for _ in range(80))) for i in range(300)], "doc_id long, text string")
    labels = made.filter("doc_id < 200").select("doc_id", (F.col("doc_id") % 3 != 0).cast("int").alias("quality"))
    rest = quality.assess(made, labels).filter("doc_id >= 200").collect()
    assert np.mean([(r.quality >= 0.5) == (r.doc_id % 3 != 0) for r in rest]) > 0.95
    for r in quality.assess(docs, labels.limit(0)).collect():
        w = words(r.text)
        three = collections.Counter(zip(w, w[1:], w[2:], strict=False))
        again = set().union(*[range(i, i + 3) for i in range(len(w) - 2) if three[tuple(w[i : i + 3])] > 1])
        seen, dup = set(), 0
        for x in (r.text or "").split("\n"):
            if words(x):
                dup += x in seen
                seen.add(x)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == (len(w), sum(map(len, w)), sum((r.text or "").count(c) for c in "#*$%&|<>"), dup, len(again))
        assert r.base_failed == (len(w) < 50 or 100 * len(again) > 50 * len(w)) and r.kept == (not r.base_failed)
    assert quality.assess(empty, labels).count() == 0


def test_suffix_order():
    rnd = random.Random(1)
    for _ in range(400):
        s = [rnd.randint(1, rnd.choice([1, 2, 3, 26])) for _ in range(rnd.randint(1, 60))] + [0]
        assert suffix_array(s) == sorted(range(len(s)), key=lambda i, s=s: s[i:])
    assert least_owner([b"abcabc", b"xabcx"], [4, 2], 3) == [[2, 4, 4, 2], [2, 2, 2]]


@pytest.mark.parametrize("crowd", [4096, 0])
def test_repeated_bytes(docs, rows, empty, crowd):
    last = 1 << 62
    got = collections.Counter((r.doc_id, r.n_bytes, r.n_removed, r.n_spans, hashlib.sha256(r.kept).hexdigest()) for r in suffix.remove_repeated_bytes(docs, 50, 20, crowd=crowd).collect())
    first = {}
    for r in rows:
        b = (r[1] or "").encode()
        for i in range(len(b) - 49):
            first[b[i : i + 50]] = min(first.get(b[i : i + 50], last), last if r[0] is None else r[0])
    want = collections.Counter()
    for r in rows:
        b, own = (r[1] or "").encode(), last if r[0] is None else r[0]
        gone = np.zeros(len(b), bool)
        for i in range(len(b) - 49):
            if first[b[i : i + 50]] < own:
                gone[i : i + 50] = True
        kept = bytes(x for x, g in zip(b, gone, strict=True) if not g)
        want[r[0], len(b), int(gone.sum()), int((np.diff(gone.astype(int), prepend=0) > 0).sum()), hashlib.sha256(kept).hexdigest()] += 1
    assert got == want
    assert suffix.remove_repeated_bytes(empty, 50, 20).count() == 0


def test_components(spark):
    """Chains, stars and single links, all at once and in two parts, against a union by hand."""
    rnd = random.Random(6)
    ids = rnd.sample(range(10_000), 900)
    links = [*itertools.pairwise(ids[:60]), *[(ids[100], i) for i in ids[101:500]], *[(rnd.choice(ids[500:]), rnd.choice(ids[500:])) for _ in range(250)], (ids[5], ids[5])]
    want = {i: i for x in links for i in x}
    for _ in range(len(links)):
        before = dict(want)
        for x, y in links:
            want[x] = want[y] = min(want[x], want[y])
        if want == before:
            break
    own = spark.createDataFrame(links, "x long, y long")
    alone = {x for x, y in links if x == y and sum(x in z for z in links) == 1}
    got = {r.node: r.comp for r in neardup.components(own).collect()}
    assert got == {k: v for k, v in want.items() if k not in alone}
    rnd.shuffle(links)
    first, more = (spark.createDataFrame(x, "x long, y long") for x in (links[:300], links[300:]))
    found = {r.node: r.comp for r in neardup.with_more(neardup.components(first), more).collect()}
    assert found | {k: want[k] for k in alone} == want


def test_the_filter_holds_only_what_is_repeated(spark):
    """More anchors than the filter has cells; a copy of a text, which speaks through the other, repeats nothing."""
    rnd = random.Random(4)
    passage = "".join(rnd.choice("abcdefgh ") for _ in range(300))
    found = ["".join(rnd.choice("abcdefgh ") for _ in range(500)) for _ in range(400)]
    found[7], found[300] = found[7] + passage, passage + found[300]
    made = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    maps = repeated_cells(made.select("text"), suffix.byte_windows(50, 24), 12)
    _, off, data = pa.array([passage, "".join(found[20:60])]).buffers()
    met = [Anchors(np.frombuffer(data, np.uint8)[lo:hi].astype(np.uint64), np.array([0, hi - lo]), 50, 24, Powers()).hot(12, maps).mean() for lo, hi in itertools.pairwise(np.frombuffer(off, np.int32))]
    assert met[0] == 1 and met[1] < 0.02
    copies = spark.createDataFrame([*enumerate(found), (999, found[20])], "doc_id long, text string")
    got = {r.doc_id: r.n_removed for r in suffix.remove_repeated_bytes(copies, 50, 12).collect()}
    assert got == dict.fromkeys(range(400), 0) | {300: 300, 999: 500}


def test_a_crowded_anchor_is_split(spark):
    """Many texts with one line between parts of their own, some of which repeat, against brute force."""
    rnd = random.Random(3)
    ends = ["".join(rnd.choice("abcdef ") for _ in range(40)) for _ in range(30)]
    found = [rnd.choice(ends)[rnd.randrange(20):] + "the line that all of these texts hold" + rnd.choice(ends)[: rnd.randrange(40)] for _ in range(150)]
    seen, want = {}, []
    for i, t in enumerate(found):
        gone = np.zeros(len(t), bool)
        for k in range(len(t) - 49):
            if seen.setdefault(t[k : k + 50], i) < i:
                gone[k : k + 50] = True
        want.append("".join(c for c, g in zip(t, gone, strict=True) if not g))
    made = spark.createDataFrame(list(enumerate(found)), "doc_id long, text string")
    for crowd in (4096, 3):
        got = suffix.remove_repeated_bytes(made, 50, 20, crowd=crowd).orderBy("doc_id").collect()
        assert [r.kept.decode() for r in got] == want


def test_language_model(docs, empty, rows):
    got = lmscore.score(docs, F.col("doc_id") < 5, bits=16).collect()
    assert len(got) == len(rows)
    for r in got:
        assert r.n_tokens == len(words(r.text)) and (r.loss_diff is None) == (not words(r.text))
        if words(r.text):
            assert np.isfinite(r.loss_diff) and abs(r.target_loss - r.background_loss - r.loss_diff) < 1e-9
    assert lmscore.score(empty, F.lit(True), bits=16).count() == 0


@pytest.mark.parametrize("bits", [None, 16])
def test_lm_score_counts_every_pair_apart(docs, rows, bits):
    """The same losses as with counts of the words themselves, however many parts there are."""
    single, pairs = [collections.Counter(), collections.Counter()], [collections.Counter(), collections.Counter()]
    lines = [words(r[1]) for r in rows]
    mine = [[r[0] is not None and r[0] < 5, True] for r in rows]
    found = collections.Counter(w for m, ws in zip(mine, lines, strict=True) if m[0] for w in ws)
    lines = [[w if found[w] >= 2 else None for w in ws] for ws in lines]
    size = sum(n >= 2 for n in found.values()) + 1
    for m, ws in zip(mine, lines, strict=True):
        for k in (0, 1):
            if m[k]:
                single[k].update(ws)
                pairs[k].update(itertools.pairwise(ws))
    total = [sum(c.values()) for c in single]
    want = collections.defaultdict(list)
    for r, m, ws in zip(rows, mine, lines, strict=True):
        for k in (0, 1):
            own, own_pairs = (collections.Counter(ws), collections.Counter(itertools.pairwise(ws))) if m[k] else (collections.Counter(), collections.Counter())
            loss = 0.0
            for i, w in enumerate(ws):
                p = (single[k][w] - own[w] + 0.1) / (total[k] - sum(own.values()) + 0.1 * size)
                if i:
                    p = 0.7 * (pairs[k][ws[i - 1], w] - own_pairs[ws[i - 1], w]) / max(single[k][ws[i - 1]] - own[ws[i - 1]], 1) + 0.3 * p
                loss -= np.log(p)
            want[r[0], r[1], k].append(loss / max(len(ws), 1))
    for r in lmscore.score(docs, F.col("doc_id") < 5, bits=bits).collect():
        if r.n_tokens:
            assert abs(r.target_loss - want[r.doc_id, r.text, 0][0]) < 1e-9 and abs(r.background_loss - want[r.doc_id, r.text, 1][0]) < 1e-9


def test_words_of_one_form_have_hashes_of_their_own():
    """Thue-Morse words and their complements, which meet in any polynomial modulo 2**64."""
    import pyarrow as pa

    from tallyflow.llm import textscan

    turn = str.maketrans("ab", "ba")
    found = []
    word = "a"
    while len(word) <= 4096:
        found += [word, word.translate(turn)]
        word += word.translate(turn)
    (part,) = textscan.slices(pa.array([" ".join(found)]))
    starts, ends, _ = textscan.word_bounds(part)
    assert len(set(textscan.word_hashes(part, starts, ends).tolist())) == len(set(found)) == len(found)


def test_windows_with_words_of_one_form_stay(spark):
    turn = str.maketrans("ab", "ba")
    word = "a"
    while len(word) < 1024:
        word += word.translate(turn)
    common = " ".join(f"w{i}" for i in range(34))
    made = spark.createDataFrame([(0, f"{common} {word}"), (1, f"{common} {word.translate(turn)}")], "doc_id long, text string")
    assert [r.n_removed for r in substring.remove_repeated_windows(made, 35, 20).collect()] == [0, 0]


def test_planted_near_copies_are_caught(spark):
    """Recall on pairs whose similarity lies between 0.8 and 0.9, as measured on the texts."""
    rnd = random.Random(11)
    made, want = [], []
    for i in range(400):
        base = [f"t{rnd.randrange(20_000)}" for _ in range(rnd.randrange(60, 200))]
        other = list(base)
        for _ in range(rnd.randrange(1, 5)):
            other[rnd.randrange(len(other))] = f"z{rnd.randrange(1000)}"
        a, b = ({tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in (base, other))
        share = len(a & b) / len(a | b)
        if 0.8 <= share <= 0.9:
            want.append(2 * i)
        made += [(2 * i, " ".join(base)), (2 * i + 1, " ".join(other))]
    got = {r.doc_id: r.class_id for r in neardup.near_duplicates(spark.createDataFrame(made, "doc_id long, text string")).collect()}
    assert len(want) > 100 and np.mean([got[i] == got[i + 1] for i in want]) >= 0.98


def test_clashing_columns_stay(spark, rows):
    """Columns named like the operators' own helpers come back as they were."""
    names = ["_s", "_run", "_n", "_d", "_k", "_u", "_kept", "_target", "_node", "_U", "_id", "_at", "_all", "_first", "_drop", "_part", "_own", "_f", "_g", "_chunk", "_ahead", "_none"]
    names = [n for i, n in enumerate(names) if n.lower() not in [x.lower() for x in names[:i]]]
    made = spark.createDataFrame([(*r[:5], *[f"{n}{i}" for n in names]) for i, r in enumerate(rows[:16])], "doc_id long, text string, lang string, source string, n_chars long, " + ", ".join(f"`{n}` string" for n in names)).cache()
    labels = spark.createDataFrame([(0, 1, 0), (1, 0, 0)], "doc_id long, quality int, toxic int")
    want = sorted(map(str, made.select(names).collect()))
    for run in (
        langid.identify, linededup.drop_frequent_lines, mixing.mix, neardup.near_duplicates, suffix.remove_repeated_bytes, substring.remove_repeated_windows,
        lambda d: quality.assess(d, labels), lambda d: lmscore.score(d, F.col("doc_id") < 3),
    ):
        assert sorted(map(str, run(made).select(names).collect())) == want, run
    for run in (lambda d: mixing.copied(mixing.mix(d)), neardup.one_of_each):
        assert set(names) <= set(run(made).columns)


def test_near_duplicates(docs, rows, empty):
    got = neardup.near_duplicates(docs).collect()
    assert len(got) == len(rows)
    by = {r.doc_id: r.class_id for r in got if r.doc_id is not None}
    assert by[0] == by[1] == by[2] == 0 and by[5] == 5
    alone = set(by) - {0, 1, 2, 3, 4, 6}
    sets = {i: {tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} for i, t in enumerate(texts()) for w in [words(t)] if w}
    for a, b in itertools.combinations(sorted(alone & set(sets)), 2):
        assert (by[a] == by[b]) == (len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]))
    one = neardup.one_of_each(docs)
    assert one.columns == docs.columns and one.filter("doc_id <= 2").count() == 1
    assert neardup.near_duplicates(empty).count() == 0


@pytest.mark.parametrize("whole", [0, 50, 10_000])
def test_near_duplicates_that_share_a_passage(spark, whole):
    """Buckets of many components: all texts hold one passage, some are near copies besides."""
    rnd = random.Random(7)
    passage = [f"p{i}" for i in range(90)]
    found = []
    for i in range(70):
        own = passage + [f"w{rnd.randrange(3000)}" for _ in range(rnd.choice([15, 30, 60]))]
        found.append(own)
        if i % 3 == 0:
            found.append([("z" if rnd.random() < 0.02 else w) for w in own])
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for w in found]
    least = list(range(len(found)))

    def top(i):
        while least[i] != i:
            i = least[i]
        return i

    def edits(a, b):
        d = list(range(len(b) + 1))
        for i, x in enumerate(a, 1):
            e = [i]
            for j, y in enumerate(b, 1):
                e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
            d = e
        return d[-1]

    for a, b in itertools.combinations(range(len(found)), 2):
        if len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and edits(found[a], found[b]) <= 0.2 * max(len(found[a]), len(found[b])):
            a, b = top(a), top(b)
            least[max(a, b)] = min(a, b)
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, w in enumerate(found)], "doc_id long, text string"), whole=whole)
    assert {r.doc_id: r.class_id for r in got.collect()} == {i: top(i) for i in range(len(found))}


def test_leaders_of_large_groups_stand_in_the_middle(spark, monkeypatch):
    """Many near copies have all keys of the text they stem from, and some are far from it elsewhere:
    led by one of these, a group leaves most of its texts to be compared with all others."""
    rnd = random.Random(3)
    found = []
    for i in range(6):
        base = [f"g{i}w{rnd.randrange(5000)}" for _ in range(150)]
        found += [(i, [w if j not in cut else f"z{rnd.randrange(10**6)}" for j, w in enumerate(base)]) for n in range(160) for cut in [rnd.sample(range(150), min(n, 1 + n % 3))]]
    sets = [{tuple(w[j : j + 5]) for j in range(len(w) - 4)} for _, w in found]
    least = list(range(len(found)))
    for a, b in itertools.combinations(range(len(found)), 2):
        if found[a][0] == found[b][0] and len(sets[a] & sets[b]) >= 0.8 * len(sets[a] | sets[b]) and least[a] != least[b]:
            least = [min(least[a], least[b]) if x in (least[a], least[b]) else x for x in least]
    compared, similar = [], neardup.Texts.similar
    monkeypatch.setattr(neardup.Texts, "similar", lambda self, pairs, share: compared.append(pairs.count()) or similar(self, pairs, share))
    got = neardup.near_duplicates(spark.createDataFrame([(i, " ".join(w)) for i, (_, w) in enumerate(found)], "doc_id long, text string"))
    assert {r.doc_id: r.class_id for r in got.collect()} == dict(enumerate(least))
    assert sum(compared[1:]) < len(found), compared


@pytest.mark.parametrize("seed", range(40))
def test_banded_alignment(seed):
    rnd = random.Random(seed)
    a = [rnd.randrange(4) for _ in range(rnd.randrange(0, 12))]
    b = [rnd.randrange(4) for _ in range(rnd.randrange(0, 12))]
    d = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        e = [i]
        for j, y in enumerate(b, 1):
            e.append(min(d[j] + 1, e[-1] + 1, d[j - 1] + (x != y)))
        d = e
    for most in range(14):
        assert neardup.edits_within(a, b, most) == (d[-1] <= most)


def test_pipeline_stages(spark, docs):
    import corpus_pipeline

    out = docs.select(corpus_pipeline.COLUMNS)
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, out, "")
        assert out.columns == corpus_pipeline.COLUMNS, name
        out = out.cache()
    assert out.filter("text is null").count() == 0
    assert packing.pack(out, tokenizer_path()).count() >= out.count()
