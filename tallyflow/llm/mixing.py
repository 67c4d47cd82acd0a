"""Mixing sources to target weights by entropy balancing, in DataFrame operations only."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .scratch import fingerprint, free, written

#: Parts into which a group of documents of one source and size is dealt; a fixed number, so that
#: copies don't depend on the session.
PARTS = 4096
WORD_BREAKS = r"[\x20\x09-\x0D]+"


def n_words(text):
    """Number of maximal runs of characters other than 0x20 and 0x09-0x0D."""
    solid = F.btrim(F.coalesce(text, F.lit("")), F.lit(" \t\n\x0b\x0c\r"))
    return F.when(F.length(solid) == 0, F.lit(0)).otherwise(F.size(F.split(solid, WORD_BREAKS, -1))).cast("long")


def targets(sizes: DataFrame, weights: list[float], most: float) -> DataFrame:
    """(source, docs, source_size, target) from (source, size, n): one row for each source.

    Sources in code point order, null last, weigh ``weights`` in turn. Targets share all words
    by weight; one above ``most`` times its source's words stops there and the rest is shared
    again. That is a water level: by rising cap over weight, a source stops at its cap when
    the level that the sources before it leave lies above its own.
    """
    by = sizes.groupBy("source").agg(F.sum("n").alias("docs"), F.sum(F.col("n") * F.col("size")).alias("source_size"))
    rank = F.row_number().over(Window.orderBy(F.col("source").isNull(), "source")) - 1
    weight = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.pmod(rank, F.lit(len(weights))) + 1).cast("int"))
    by = by.withColumns({"rank": rank, "weight": weight}).withColumn("cap", F.col("source_size") * F.lit(float(most)))
    order = Window.orderBy(F.col("cap") / F.col("weight"), "rank")
    all_, before = Window.partitionBy(), order.rowsBetween(Window.unboundedPreceding, -1)
    by = by.withColumns({
        "total": F.sum("source_size").over(all_),
        "left": F.sum("weight").over(order.rowsBetween(0, Window.unboundedFollowing)),
        "spent": F.coalesce(F.sum("cap").over(before), F.lit(0.0)),
    })
    by = by.withColumn("stops", (F.col("total") - F.col("spent")) / F.col("left") * F.col("weight") >= F.col("cap"))
    level = (F.max("total").over(all_) - F.coalesce(F.sum(F.when(F.col("stops"), F.col("cap"))).over(all_), F.lit(0.0))) / F.sum(F.when(~F.col("stops"), F.col("weight"))).over(all_)
    return by.withColumn("level", level).select("source", "docs", "source_size", F.when(F.col("stops"), F.col("cap")).otherwise(F.col("level") * F.col("weight")).alias("target"))


def balance(sizes: DataFrame, goals: DataFrame, most: float, steps: int = 40, near: float = 1e-9) -> DataFrame:
    """(source, ..., lam): document rates min(most, exp(lam * size / mean size)) of least
    relative entropy to equal rates that meet every source's target in words.

    Newton steps on the convex dual, all sources at once: one pass over the histogram gives each
    source's gradient and curvature; a step outside the bracket known so far is halved into it.
    Sums are decimals, so the order of tasks can't change them. lam is null where the target is
    the cap itself (every document at ``most``).
    """
    mean = F.col("source_size") / F.col("docs")
    state = goals.withColumns({
        "mean": mean, "lam": F.when((F.col("source_size") == 0) | (F.col("target") >= F.col("source_size") * most), F.lit(None)).otherwise(F.lit(0.0)),
        "lo": F.lit(None).cast("double"), "hi": F.lit(None).cast("double"), "err": F.lit(None).cast("double"),
    })
    state = written(state, "mix-state")
    for _ in range(steps):
        live = state.filter(F.col("lam").isNotNull() & (F.col("err").isNull() | (F.col("err") > near)))
        tilt = F.col("lam") * F.col("size") / F.col("mean")
        rate = F.when(tilt >= F.log(F.lit(most)), F.lit(most)).otherwise(F.exp(tilt))
        words = F.col("n") * F.col("size") * rate
        bent = F.when(tilt < F.log(F.lit(most)), words * F.col("size") / F.col("mean")).otherwise(F.lit(0.0))
        at = sizes.join(live.select(F.col("source").alias("s"), "lam", "mean"), F.col("source").eqNullSafe(F.col("s")))
        at = at.groupBy("s").agg(F.sum(words.cast("decimal(38,6)")).cast("double").alias("g"), F.sum(bent.cast("decimal(38,6)")).cast("double").alias("h"))
        new = state.join(at, F.col("source").eqNullSafe(F.col("s")), "left")
        off = F.col("g") - F.col("target")
        lo = F.when(off <= 0, F.col("lam")).otherwise(F.col("lo"))
        hi = F.when(off >= 0, F.col("lam")).otherwise(F.col("hi"))
        new = new.withColumns({"err2": F.abs(off) / F.greatest(F.col("target"), F.lit(1.0)), "lo2": lo, "hi2": hi, "step": F.col("lam") - F.try_divide(off, F.col("h"))})
        inside = F.col("step").isNotNull() & (F.col("lo2").isNull() | (F.col("step") > F.col("lo2"))) & (F.col("hi2").isNull() | (F.col("step") < F.col("hi2")))
        half = F.when(F.col("lo2").isNull(), F.col("hi2") * 2 - 1).when(F.col("hi2").isNull(), F.col("lo2") * 2 + 1).otherwise((F.col("lo2") + F.col("hi2")) / 2)
        step = F.when(F.col("g").isNull() | (F.col("err2") <= near), F.col("lam")).when(inside, F.col("step")).otherwise(half)
        state = written(new.select("source", "docs", "source_size", "target", "mean", step.alias("lam"), F.coalesce("lo2", "lo").alias("lo"), F.coalesce("hi2", "hi").alias("hi"), F.coalesce("err2", "err").alias("err")), "mix-state")
        if not state.filter(F.col("lam").isNotNull() & (F.col("err") > near)).limit(1).count():
            break
    return state


def mix(docs: DataFrame, weights: tuple[float, ...] = (5.0, 2.0, 1.0), most: float = 3.0) -> DataFrame:
    """Every document with its copies in the mix.

    Adds to the columns of ``docs`` (replacing columns of these names) size, source_size, target,
    rate and copies. Rates become copies in order of size: a document gets the whole numbers
    that the running sum of rates passes on it. So no document exceeds ``most`` copies, a source
    misses its target by about its longest document at most, and reruns agree. Null and empty
    texts have size 0 and no copies; a null source is a source, the last; repeated rows are
    documents; an empty table gives none.
    """
    names = ("size", "source_size", "target", "rate", "copies")
    plain = docs.drop(*names)
    u, v, part, own, s, z, c, ahead, run = free(plain, "_u", "_v", "_part", "_own", "_s", "_z", "_c", "_ahead", "_run")
    one, two = fingerprint(F.col("doc_id").cast("string"), "text")
    sized = plain.withColumn("size", n_words(F.col("text"))).withColumns({u: one, v: two}).withColumn(part, F.pmod(u, F.lit(PARTS)))
    parts = written(sized.groupBy("source", "size", F.col(part).alias("part")).agg(F.count("*").alias("n")), "mix-sizes")
    sizes = written(parts.groupBy("source", "size").agg(F.sum("n").alias("n")), "mix-histogram")
    state = balance(sizes, targets(sizes, list(weights), most), most)
    tilt = F.col("lam") * F.col("size") / F.col("mean")
    rate = F.when(F.col("size") == 0, F.lit(0.0)).when(F.col("lam").isNull(), F.lit(most)).otherwise(F.least(F.lit(most), F.exp(tilt))).cast("decimal(20,12)")
    goal = state.withColumnRenamed("source", "s")
    rated = sizes.join(goal, F.col("source").eqNullSafe(F.col("s"))).withColumn("rate", rate)
    before = F.sum((F.col("n") * F.col("rate")).cast("decimal(38,12)")).over(Window.partitionBy("source").orderBy("size").rowsBetween(Window.unboundedPreceding, -1))
    rated = rated.select(F.col("source").alias("s"), F.col("size").alias("z"), "source_size", "target", "rate", F.coalesce(before, F.lit(0).cast("decimal(38,12)")).alias("run"))
    sooner = F.sum("n").over(Window.partitionBy("source", "size").orderBy("part").rowsBetween(Window.unboundedPreceding, -1))
    places = parts.withColumn("ahead", F.coalesce(sooner, F.lit(0)))
    places = places.join(rated, F.col("source").eqNullSafe(F.col("s")) & (F.col("size") == F.col("z")))
    places = written(places.select(F.col("source").alias(s), F.col("size").alias(z), F.col("part").alias(c), F.col("ahead").alias(ahead), "source_size", "target", "rate", F.col("run").alias(run)), "mix-places")
    rank = F.row_number().over(Window.partitionBy("source", "size", part).orderBy(u, v))
    out = sized.withColumn(own, rank).join(places, F.col("source").eqNullSafe(F.col(s)) & (F.col("size") == F.col(z)) & (F.col(part) == F.col(c)))
    upto = lambda k: F.floor(F.col(run) + (F.col(ahead) + k) * F.col("rate") + F.lit(0.5).cast("decimal(2,1)"))
    out = out.withColumn("copies", (upto(F.col(own)) - upto(F.col(own) - 1)).cast("long"))
    return out.withColumn("rate", F.col("rate").cast("double")).drop(u, v, part, s, z, c, ahead, run, own)


def copied(mixed: DataFrame) -> DataFrame:
    """One row for each copy that a mix takes, without the mix's own columns."""
    (k,) = free(mixed, "_k")
    rows = mixed.filter(F.col("copies") > 0).withColumn(k, F.explode(F.sequence(F.lit(1).cast("long"), F.col("copies"))))
    return rows.drop(k, "size", "source_size", "target", "rate", "copies")
