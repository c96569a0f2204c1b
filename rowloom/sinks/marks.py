"""Small text files in the shared folder: manifests and marks of what is done."""

from __future__ import annotations

from pyspark.sql import SparkSession


def _at(spark: SparkSession, path: str):
    where = spark._jvm.org.apache.hadoop.fs.Path(path)
    return where.getFileSystem(spark._jsc.hadoopConfiguration()), where


def write_text(spark: SparkSession, path: str, text: str) -> None:
    """Written beside and renamed, so that the file is there whole or not at all."""
    system, where = _at(spark, path)
    beside = where.suffix(".part")
    out = system.create(beside, True)
    out.write(bytearray(text.encode()))
    out.close()
    system.delete(where, False)
    if not system.rename(beside, where):
        raise OSError(f"{path} cannot be written")


def read_text(spark: SparkSession, path: str) -> str:
    return "\n".join(r[0] for r in spark.read.text(path, wholetext=True).collect())


def exists(spark: SparkSession, path: str) -> bool:
    system, where = _at(spark, path)
    return system.exists(where)


def names_in(spark: SparkSession, path: str) -> list[str]:
    """Names of what a folder holds."""
    system, where = _at(spark, path)
    return [s.getPath().getName() for s in system.listStatus(where)]
