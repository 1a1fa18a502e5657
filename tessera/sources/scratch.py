"""Folders for derived tables that driver and executors share."""

from __future__ import annotations

import os
import uuid

from pyspark.sql import DataFrame, SparkSession


def new_folder(spark: SparkSession, label: str) -> str:
    """A fresh path in spark.checkpoint.dir, or in the warehouse where that is unset."""
    root = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_derived"
    return f"{root.rstrip('/')}/{label}-{uuid.uuid4().hex}"


def publish(df: DataFrame, label: str) -> DataFrame:
    """Write df as Parquet to a fresh folder and read it again, so that it is computed once and its lineage ends there."""
    path = new_folder(df.sparkSession, label)
    df.write.parquet(path)
    return df.sparkSession.read.schema(df.schema).parquet(path)


def remove(spark: SparkSession, path: str) -> None:
    """Delete a folder on whatever file system it is."""
    folder = spark._jvm.org.apache.hadoop.fs.Path(path)
    folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def ship(spark: SparkSession) -> None:
    """Let Python workers import this package from the driver's path; elsewhere than on one machine, install it or give it as --py-files."""
    root = os.path.dirname(os.path.dirname(os.path.dirname(os.path.abspath(__file__))))
    paths = spark.sparkContext.environment.get("PYTHONPATH", "").split(os.pathsep)
    if root not in paths:
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join([root, *filter(None, paths)])


BATCH_ROWS = 500
"""Rows of an Arrow batch: long texts are held by the hundred, not by Spark's ten thousand."""


def small_batches(spark: SparkSession) -> None:
    """Let Python steps of this session take small batches, so that a worker's memory does not follow the partition."""
    if int(spark.conf.get("spark.sql.execution.arrow.maxRecordsPerBatch")) > BATCH_ROWS:
        spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", str(BATCH_ROWS))
