"""One query for each operator over its whole table, with production parameters."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import langid, linededup, lmscore, mixing, neardup, packing, quality, substring, suffix, topk
from .scratch import sources_of


def tokenizer_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def op1_pack(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack(sources_of(spark, sf_dir, "documents"), tokenizer_path(), capacity=4096, eos=1)


def op2_language(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text", "lang")
    return langid.identify(docs).select("doc_id", "held_out", "lang_pred", "score")


def op3_topk(spark: SparkSession, sf_dir: str) -> DataFrame:
    return topk.top_k(sources_of(spark, sf_dir, "embeddings"), F.pmod("vec_id", F.lit(50)) == 0, k=5)


def op4_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text")
    out = substring.remove_repeated_windows(docs, width=35)
    return out.select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))


def op5_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text")
    out = linededup.drop_frequent_lines(docs, min_docs=10)
    return out.select("doc_id", "n_lines", "n_dropped", F.sha2("text", 256).alias("kept_sha256"))


def op6_mix(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text", "source")
    return mixing.mix(docs).select("doc_id", "size", "source_size", "target", (F.col("copies") * F.col("size")).alias("taken"), "copies", "rate")


def op7_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text")
    out = quality.assess(docs, sources_of(spark, sf_dir, "labels"))
    return out.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept", "quality")


def op8_suffix_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text")
    out = suffix.remove_repeated_bytes(docs, width=50)
    return out.select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))


def op9_lm_score(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Target: documents labelled of quality and not toxic; background: all."""
    labels = sources_of(spark, sf_dir, "labels").filter("quality = 1 and toxic = 0").select("doc_id").distinct().withColumn("good", F.lit(True))
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text").join(labels, "doc_id", "left")
    return lmscore.score(docs, F.col("good")).drop("text", "good")


def op10_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents").select("doc_id", "text")
    return neardup.near_duplicates(docs).drop("text")


def pipeline(spark: SparkSession, sf_dir: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, sf_dir)


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    found = [op1_pack, op2_language, op3_topk, op4_substring_dedup, op5_line_dedup, op6_mix, op7_quality, op8_suffix_dedup, op9_lm_score, op10_near_dup, pipeline]
    return {f.__name__: f for f in found}


def oracle_sql() -> dict[str, str]:
    return {"op3_topk": OP3_SQL, "op4_substring_dedup": OP4_SQL, "op5_line_dedup": OP5_SQL, "op8_suffix_dedup": OP8_SQL}


OP3_SQL = """
WITH q AS (SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(256 * CAST(x AS DOUBLE)) AS BIGINT)) AS v FROM embeddings
           WHERE vec_id IS NOT NULL AND embedding IS NOT NULL AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0),
s AS (SELECT a.vec_id AS query_id, b.vec_id, CAST(list_sum(list_transform(range(1, len(a.v) + 1), lambda i: a.v[i] * b.v[i])) AS BIGINT) AS score
      FROM q a JOIN q b ON a.vec_id % 50 = 0 AND a.vec_id <> b.vec_id),
r AS (SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM s)
SELECT query_id, rank, vec_id, score FROM r WHERE rank <= 5
"""

OP5_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, string_split(coalesce(text, ''), chr(10)) AS lines FROM documents),
l AS (SELECT r, doc_id, unnest(lines) AS line, unnest(range(len(lines))) AS p FROM d),
k AS (SELECT *, translate(trim(line, concat(' ', chr(9), chr(10), chr(11), chr(12), chr(13))), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM l),
f AS (SELECT key FROM k WHERE length(key) >= 1 GROUP BY key HAVING count(DISTINCT r) >= 10),
m AS (SELECT k.*, f.key IS NOT NULL AS gone FROM k LEFT JOIN f USING (key))
SELECT any_value(doc_id) AS doc_id, count(*) AS n_lines, CAST(sum(gone::INT) AS BIGINT) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY p) FILTER (NOT gone), '')) AS kept_sha256
FROM m GROUP BY r
"""

OP4_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS w FROM documents),
x AS (SELECT r, unnest(w) AS word, unnest(range(len(w))) AS q FROM d),
k AS (SELECT r, q, md5(string_agg(word, ' ') OVER (PARTITION BY r ORDER BY q ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING)) AS h, count(*) OVER (PARTITION BY r ORDER BY q ROWS BETWEEN CURRENT ROW AND 34 FOLLOWING) AS n FROM x),
s AS (SELECT h FROM k WHERE n = 35 GROUP BY h HAVING count(*) > 1),
m AS (SELECT k.r, k.q, s.h IS NOT NULL AS again FROM k LEFT JOIN s ON k.h = s.h AND k.n = 35),
c AS (SELECT r, q, bool_or(again) OVER (PARTITION BY r ORDER BY q ROWS BETWEEN 34 PRECEDING AND CURRENT ROW) AS gone FROM m),
t AS (SELECT r, count(*) AS n, count(*) FILTER (gone) AS g, string_agg(word, ' ' ORDER BY q) FILTER (NOT gone) AS kept FROM x JOIN c USING (r, q) GROUP BY r)
SELECT doc_id, CAST(coalesce(n, 0) AS BIGINT) AS n_words, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, sha256(coalesce(kept, '')) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""

OP8_SQL = r"""
WITH d AS (SELECT row_number() OVER () AS r, doc_id, coalesce(doc_id, 9223372036854775807) AS own, hex(coalesce(text, '')) AS hx, octet_length(encode(coalesce(text, ''))) AS n FROM documents),
x AS (SELECT r, own, unnest(regexp_extract_all(hx, '..')) AS b, unnest(range(n)) AS q FROM d),
k AS (SELECT r, own, q, md5(string_agg(b, '') OVER w) AS h, count(*) OVER w AS n FROM x WINDOW w AS (PARTITION BY r ORDER BY q ROWS BETWEEN CURRENT ROW AND 49 FOLLOWING)),
s AS (SELECT h, min(own) AS first FROM k WHERE n = 50 GROUP BY h HAVING count(*) > 1),
m AS (SELECT k.r, k.q, coalesce(s.first < k.own, false) AS again FROM k LEFT JOIN s ON k.h = s.h AND k.n = 50),
c AS (SELECT r, q, bool_or(again) OVER (PARTITION BY r ORDER BY q ROWS BETWEEN 49 PRECEDING AND CURRENT ROW) AS gone FROM m),
e AS (SELECT r, q, gone, gone AND NOT coalesce(lag(gone) OVER (PARTITION BY r ORDER BY q), false) AS opens FROM c),
t AS (SELECT r, count(*) FILTER (gone) AS g, count(*) FILTER (opens) AS spans, string_agg(b, '' ORDER BY q) FILTER (NOT gone) AS kept FROM x JOIN e USING (r, q) GROUP BY r)
SELECT doc_id, CAST(n AS BIGINT) AS n_bytes, CAST(coalesce(g, 0) AS BIGINT) AS n_removed, CAST(coalesce(spans, 0) AS BIGINT) AS n_spans, sha256(unhex(coalesce(kept, ''))) AS kept_sha256 FROM d LEFT JOIN t USING (r)
"""
