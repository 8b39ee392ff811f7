"""Intermediate tables in the folder that the cluster shares."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession


def shared_folder(spark: SparkSession) -> str:
    """The folder in spark.checkpoint.dir, which driver and executors share; an error where none is set."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not folder:
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    return folder.rstrip("/")


def new_path(spark: SparkSession, name: str) -> str:
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


def stored(df: DataFrame) -> DataFrame:
    """df written as Parquet and read again: what several later steps need is computed once, and lineage ends."""
    path = new_path(df.sparkSession, "table")
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


#: Bytes of an Arrow batch that goes to a Python worker at most (or one longer row): rows alone don't bound it.
BATCH_BYTES, _BATCH = 8 << 20, "spark.sql.execution.arrow.maxBytesPerBatch"


def bound_batches(spark: SparkSession) -> None:
    """Arrow batches of at most BATCH_BYTES in this session."""
    if spark.conf.get(_BATCH) != str(BATCH_BYTES):
        spark.conf.set(_BATCH, str(BATCH_BYTES))


def spread(df: DataFrame) -> DataFrame:
    """df as it is, or, where its files give fewer partitions than there are cores, dealt out to all of them."""
    cores = df.sparkSession.sparkContext.defaultParallelism
    return df if df.rdd.getNumPartitions() >= cores else df.repartition(cores)


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    """A table of a folder of Parquet tables, in at least as many partitions as there are cores."""
    return spread(spark.read.parquet(f"{folder}/{name}.parquet"))
