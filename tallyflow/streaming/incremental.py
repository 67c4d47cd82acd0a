"""Incremental recompute by micro-batch, and event-time windows over the event stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..sources.shared import shared_folder
from ..sources.sinks import overwrite_months


def month_totals(ledger: DataFrame) -> DataFrame:
    return ledger.groupBy("user_id", "month").agg(F.sum("amount").alias("total"), F.count("*").alias("n"))


def recompute(batch: DataFrame, ledger_path: str, mart_path: str) -> None:
    """SM2, SM3: append the batch, then recompute the months it touches and overwrite just those.

    A replayed batch finds its rows by id and adds none, but recomputes its months all the same: a
    run that ended between the two writes is made good by the next. So at-least-once delivery is enough.
    """
    spark = batch.sparkSession
    own = batch.select("month").distinct().persist()
    if _there(spark, ledger_path):
        batch = batch.join(spark.read.schema("txn_id long, user_id long, amount decimal(18,2), month string").parquet(ledger_path).join(own, "month", "left_semi").select("txn_id"), "txn_id", "left_anti")
    batch = batch.persist()
    if own.count():
        batch.write.mode("append").partitionBy("month").parquet(ledger_path)
        # partition columns read back typed by their values; months stay text
        ledger = spark.read.option("inferSchema", "false").schema("txn_id long, user_id long, amount decimal(18,2), month string").parquet(ledger_path)
        overwrite_months(month_totals(ledger.join(own, "month", "left_semi")), mart_path, spark)
    own.unpersist()
    batch.unpersist()


def _there(spark: SparkSession, path: str) -> bool:
    jvm = spark.sparkContext._jvm
    place = jvm.org.apache.hadoop.fs.Path(path)
    return place.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(place)


def event_schema() -> str:
    return "event_id long, ts timestamp, user_id long, event_type string, value double, props string"


def run_once(stream: DataFrame, sink) -> None:
    """All that is there in micro-batches, then stop; progress is in the checkpoint."""
    stream.writeStream.foreachBatch(sink).option("checkpointLocation", shared_folder(stream.sparkSession, "progress")).trigger(availableNow=True).start().awaitTermination()


def _windowed(spark: SparkSession, sf_dir: str, grouped) -> DataFrame:
    name = f"windows_{uuid.uuid4().hex}"
    stream = spark.readStream.schema(event_schema()).option("pathGlobFilter", "events.parquet").parquet(sf_dir).withWatermark("ts", "1 day")
    query = grouped(stream).writeStream.format("memory").queryName(name).outputMode("complete").option("checkpointLocation", shared_folder(spark, "progress")).trigger(availableNow=True).start()
    query.awaitTermination()
    return spark.table(name)


def sm7_tumbling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Beyond the ledger: six-hour windows by event type, as a stream."""
    out = _windowed(spark, sf_dir, lambda s: s.groupBy(F.window("ts", "6 hours"), "event_type").agg(F.count("*").alias("n")))
    return out.select(F.date_format("window.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "event_type", "n")


def sm7_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of a user that end after twelve quiet hours."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    out = events.groupBy(F.session_window("ts", "12 hours"), "user_id").agg(F.count("*").alias("n"))
    return out.select("user_id", F.date_format("session_window.start", "yyyy-MM-dd HH:mm:ss").alias("starts"), "n")


def sm2_incremental(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The event ledger folded in from a stream, a day a period, twice over: the second run adds nothing."""
    base = shared_folder(spark, "ledger")
    stream = spark.readStream.schema(event_schema()).option("pathGlobFilter", "events.parquet").parquet(sf_dir)
    rows = stream.select(F.col("event_id").alias("txn_id"), "user_id", F.date_format("ts", "yyyy-MM-dd").alias("month"), F.col("value").cast("decimal(18,2)").alias("amount"))
    for _ in range(2):
        run_once(rows, lambda batch, _id: recompute(batch, f"{base}/ledger", f"{base}/mart"))
    mart = spark.read.parquet(f"{base}/mart")
    return mart.select("user_id", F.col("month").cast("string").alias("day"), F.col("total").cast("double").alias("total"), "n")


def queries() -> dict:
    return {f.__name__: f for f in (sm2_incremental, sm7_tumbling, sm7_sessions)}


ORACLES = {
    "sm2_incremental": "SELECT user_id, strftime(ts, '%Y-%m-%d') AS day, CAST(sum(CAST(value AS DECIMAL(18,2))) AS DOUBLE) AS total, count(*) AS n FROM events GROUP BY ALL",
    "sm7_tumbling": "SELECT strftime(time_bucket(INTERVAL 6 HOURS, ts, TIMESTAMP '2000-01-01'), '%Y-%m-%d %H:%M:%S') AS starts, event_type, count(*) AS n FROM events GROUP BY ALL",
    "sm7_sessions": """WITH g AS (SELECT user_id, ts, CASE WHEN ts - lag(ts) OVER (PARTITION BY user_id ORDER BY ts) < INTERVAL 12 HOURS THEN 0 ELSE 1 END AS new FROM events),
s AS (SELECT user_id, ts, sum(new) OVER (PARTITION BY user_id ORDER BY ts ROWS UNBOUNDED PRECEDING) AS k FROM g)
SELECT user_id, strftime(min(ts), '%Y-%m-%d %H:%M:%S') AS starts, count(*) AS n FROM s GROUP BY user_id, k""",
}
