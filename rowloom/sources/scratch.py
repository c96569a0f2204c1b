"""Where intermediate data may be written."""

from __future__ import annotations

import uuid

from pyspark.sql import SparkSession


def _shared_dir(spark: SparkSession) -> str:
    """The folder the cluster names for checkpoints, and where it names none a folder
    of the warehouse; both are shared by all executors."""
    named = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{named.rstrip('/')}/rowloom-{spark.sparkContext.applicationId}"


def ensure_checkpoint_dir(spark: SparkSession) -> None:
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(_shared_dir(spark))


def scratch_path(spark: SparkSession, name: str) -> str:
    """A fresh path for one intermediate table."""
    return f"{_shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Delete what this application has left there, once its results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(_shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)
