"""Tables of log rows by UTC day: appends that can be repeated, and retention that can be interrupted.

Every append has a key of its own and is a folder of its own within each day.  Writing a key again
replaces those folders, so a batch that is repeated leaves the table as it was.

Retention first publishes the time before which rows have expired; from then on readers leave those
rows out.  Only after that are folders of days that have expired whole deleted.  The day in which the
limit lies is not rewritten: its expired rows are hidden at once and go with their day, within a day.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

LIMITS = "_limits"


def append(rows: DataFrame, path: str, key: str) -> None:
    """Appends rows (with ``ts`` in epoch seconds) under a key that is this batch's alone."""
    keyed = rows.withColumns({"day": F.to_date(F.timestamp_seconds("ts")), "batch": F.lit(key)})
    keyed.repartition("day").write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("day", "batch").parquet(path)


def _path(spark: SparkSession, path: str):
    at = spark._jvm.org.apache.hadoop.fs.Path(path)
    return at, at.getFileSystem(spark._jsc.hadoopConfiguration())


def limit(spark: SparkSession, path: str) -> int:
    """The time before which rows have expired; limits only ever move on."""
    at, fs = _path(spark, f"{path}{LIMITS}")
    if not fs.exists(at):
        return 0
    return spark.read.schema("ts bigint").parquet(f"{path}{LIMITS}").agg(F.max("ts")).first()[0] or 0


def read(spark: SparkSession, path: str) -> DataFrame:
    """The rows of a table that have not expired."""
    since = limit(spark, path)
    rows = spark.read.parquet(path).drop("batch")
    return rows.filter((F.col("day") >= F.to_date(F.timestamp_seconds(F.lit(since)))) & (F.col("ts") >= since)) if since else rows


def expire(spark: SparkSession, path: str, before: int) -> None:
    """Rows before a time (epoch seconds) expire."""
    spark.range(1).select(F.lit(before).cast("bigint").alias("ts")).coalesce(1).write.mode("append").parquet(f"{path}{LIMITS}")
    drop_expired(spark, path)


def drop_expired(spark: SparkSession, path: str) -> None:
    """Deletes the days that have expired whole; may be repeated, and left for later."""
    at, fs = _path(spark, path)
    edge = f"day={spark.range(1).select(F.to_date(F.timestamp_seconds(F.lit(limit(spark, path)))).cast('string')).first()[0]}"
    for status in fs.listStatus(at):
        if status.getPath().getName().startswith("day=") and status.getPath().getName() < edge:
            fs.delete(status.getPath(), True)
