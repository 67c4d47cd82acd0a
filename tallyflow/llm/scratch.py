"""Written tables that cut lineage, in the folder all executors share."""

from __future__ import annotations

import atexit
import shutil
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: Shuffle files of one execution go when it ends, not when the driver next collects garbage.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


_own: list[str] = []


def shared_folder(spark: SparkSession) -> str:
    """``spark.checkpoint.dir``; only where it is unset (tests, one machine) a temporary folder,
    deleted when the process ends."""
    place = spark.conf.get("spark.checkpoint.dir", None)
    if not place:
        if not _own:
            _own.append(tempfile.mkdtemp(prefix="tallyflow-"))
            atexit.register(shutil.rmtree, _own[0], ignore_errors=True)
        place = f"file://{_own[0]}"
    return place.rstrip("/")


def written(df: DataFrame, name: str, partition_by: str | None = None) -> DataFrame:
    """Write a table to the shared folder and read it back; a lost executor costs nothing before it.

    Shuffle files that only this write needed go with it.
    """
    spark, schema = df.sparkSession, df.schema
    path = f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"
    writer = df.write.option("compression", "zstd")
    if partition_by:
        writer = writer.partitionBy(partition_by)
    before = spark.conf.get(CLEANUP, None)
    spark.conf.set(CLEANUP, "true")
    try:
        writer.parquet(path)
    finally:
        spark.conf.unset(CLEANUP) if before is None else spark.conf.set(CLEANUP, before)
    out = spark.read.schema(schema).parquet(path)
    out._written_at = path
    return out


def free(df: DataFrame, *names: str) -> list[str]:
    """Names for helper columns that no column of ``df`` has (case doesn't count), from ``names``."""
    taken = {c.lower() for c in df.columns}
    out = []
    for name in names:
        while name.lower() in taken:
            name += "_"
        taken.add(name.lower())
        out.append(name)
    return out


def forget(*tables: DataFrame) -> None:
    """Delete tables that ``written`` returned and that no later step reads."""
    spark = tables[0].sparkSession
    jvm = spark.sparkContext._jvm
    conf = spark._jsparkSession.sessionState().newHadoopConf()
    for table in tables:
        path = jvm.org.apache.hadoop.fs.Path(table._written_at)
        path.getFileSystem(conf).delete(path, True)


def partitions(spark: SparkSession) -> int:
    """The session's shuffle partitions, the unit in which the operators split hot groups."""
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def fingerprint(*cols: str | Column) -> list[Column]:
    """128 bits over the columns as two longs, in the JVM; nulls and empty strings differ."""
    both = [F.col(c) if isinstance(c, str) else c for c in cols]
    marked = [y for x in both for y in (x, x.isNull())]
    return [F.xxhash64(F.lit(17), *marked), F.xxhash64(*marked, F.lit(91))]


def text_id(column: str) -> Column:
    """16 bytes that stand for a text; null for null."""
    return F.unhex(F.md5(F.col(column).cast("binary")))


def sources_of(spark: SparkSession, sf_dir: str, table: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{table}.parquet")
