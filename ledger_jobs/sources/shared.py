"""Intermediate tables in the folder that the driver and all executors share."""

from __future__ import annotations

import tempfile

from pyspark.sql import DataFrame, SparkSession


def shared_dir(spark: SparkSession) -> None:
    """Sees to a checkpoint folder: ``spark.checkpoint.dir``, which a cluster must set; a local
    session without it gets a temporary folder."""
    sc = spark.sparkContext
    if sc.getCheckpointDir() is None:
        if not sc.master.startswith("local["):
            raise ValueError("set spark.checkpoint.dir to a folder that all executors share")
        sc.setCheckpointDir("file://" + tempfile.mkdtemp(prefix="spark-ledger-"))


def kept(df: DataFrame) -> DataFrame:
    """``df`` written once to the shared folder: what it was made from is not computed again, and a
    lost executor costs a re-read."""
    shared_dir(df.sparkSession)
    return df.checkpoint()


def parallelism(spark: SparkSession) -> int:
    return max(spark.sparkContext.defaultParallelism, int(spark.conf.get("spark.sql.shuffle.partitions")))


def spread(df: DataFrame) -> DataFrame:
    """``df`` over all cores before costly parsing, if its files make fewer tasks than there are cores."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)
