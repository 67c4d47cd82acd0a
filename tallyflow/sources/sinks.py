"""Writes: append, keyed upsert, scoped replace, expiry."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F


def append(df: DataFrame, path: str) -> None:
    """SNK1, SNK8."""
    df.write.mode("append").parquet(path)


def upserted(old: DataFrame, new: DataFrame, keys: list[str]) -> DataFrame:
    """SNK2, SNK3: rows of ``new`` replace those of ``old`` with the same keys, null keys included."""
    both = old.withColumn("_turn", F.lit(0)).unionByName(new.withColumn("_turn", F.lit(1)))
    rank = F.row_number().over(Window.partitionBy(*keys).orderBy(F.desc("_turn")))
    return both.withColumn("_rank", rank).filter("_rank = 1").drop("_turn", "_rank")


def claimed(rows: DataFrame, keys: DataFrame, key: str, column: str, expected: str, new: str) -> tuple[DataFrame, DataFrame]:
    """SNK5: compare and set. (all rows, the keys that were won): rows asked for that hold ``expected``
    now hold ``new``; those that another had claimed before stay and are not won."""
    asked = rows.join(keys.select(key).distinct().withColumn("_asked", F.lit(True)), key, "left")
    won = F.coalesce(F.col("_asked") & (F.col(column) == expected), F.lit(False))
    return asked.withColumn(column, F.when(won, F.lit(new)).otherwise(F.col(column))).select(rows.columns), asked.filter(won).select(key)


def decisions(rows: DataFrame, decision: Column, snapshot: list[str], at: Column) -> DataFrame:
    """SNK8: one row a decision for the append-only log, with the columns it was taken on as they were."""
    return rows.select(decision.alias("decision"), at.alias("decided_at"), *[F.col(c).alias(f"seen_{c}") for c in snapshot])


def page_of(rows: DataFrame, order: list[Column], page: int = 1, limit: int = 20, most: int = 100) -> DataFrame:
    """SO2, SO6: one page in a total order; numbers out of range are refused."""
    if not 1 <= limit <= most or page < 1:
        raise ValueError(f"page from 1 on and limit from 1 to {most}, not {page} and {limit}")
    return rows.orderBy(*order).offset((page - 1) * limit).limit(limit)


def scoped_replace(old: DataFrame, new: DataFrame, scope: Column) -> DataFrame:
    """SNK4: rows of ``old`` in the scope go, whatever their keys; ``new`` comes in."""
    return old.filter(~F.coalesce(scope, F.lit(False))).unionByName(new)


def without_children(child: DataFrame, removed: DataFrame, key: str) -> DataFrame:
    """SNK7: cascading delete as an anti-join rewrite of a child table."""
    return child.join(removed.select(key), key, "left_anti")


def expired(rows: DataFrame, since: str, now: Column, days: int = 3) -> DataFrame:
    """SNK9."""
    return rows.filter(F.col(since) <= now - F.expr(f"INTERVAL {days} DAYS"))


def overwrite_months(df: DataFrame, path: str, spark: SparkSession) -> None:
    """Replace only the months that ``df`` holds; running it again changes nothing."""
    df.write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("month").parquet(path)
