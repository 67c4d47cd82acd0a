"""From documents to training sequences: five stages, each on all that the one before it kept.

Each function takes (spark, docs, sf_dir) and returns a DataFrame; all but the last return the
columns of documents.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tallyflow.llm import langid, linededup, mixing, neardup, packing
from tallyflow.llm.queries import tokenizer_path
from tallyflow.llm.scratch import sources_of, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]


def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a language go: null text, or no letter in it. ``lang`` stays as given."""
    return langid.identify(docs).filter(F.col("lang_pred") != "und").select(COLUMNS)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Lines found in ten documents or more go; n_chars follows the text."""
    return linededup.drop_frequent_lines(docs, min_docs=10).withColumn("n_chars", F.length("text").cast("long")).select(COLUMNS)


def near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each class of near copies stays, the one of the least doc_id."""
    return neardup.one_of_each(docs).select(COLUMNS)


def mixture(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """A row for each copy that the mix takes of a document."""
    return mixing.copied(mixing.mix(docs)).select(COLUMNS)


def packing_(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of at most 4096 ids in their sequences; a small memory of chunks, as workers serve all stages."""
    return packing.pack(docs, tokenizer_path(), capacity=4096, eos=1, keep=50_000)


STAGES = [("language", language), ("lines", lines), ("near_copies", near_copies), ("mixture", mixture), ("packing", packing_)]

#: The stages are a trained model, a sketch, a balance and a search: none is an SQL query.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = sources_of(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = written(stage(spark, docs, sf_dir), f"stage-{name}")
    return docs
