"""The table access and the decorator the query modules share."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession

NAMES = (
    "region nation customer supplier part orders lineitem events documents embeddings "
    "pages benchmark labels conversations"
).split()


class Tables:
    """The tables of one folder, as attributes."""

    def __init__(self, spark: SparkSession, folder: str) -> None:
        self.spark, self.folder = spark, folder.rstrip("/")

    def path(self, name: str) -> str:
        return f"{self.folder}/{name}.parquet"

    def __getattr__(self, name: str) -> DataFrame:
        if name not in NAMES:
            raise AttributeError(name)
        return self.spark.read.parquet(self.path(name))

    def views(self, *names: str) -> None:
        for name in names:
            getattr(self, name).createOrReplaceTempView(name)

    def sql(self, text: str) -> DataFrame:
        """Spark SQL over ``{table}`` names."""
        used = {n: getattr(self, n) for n in NAMES if "{" + n + "}" in text}
        return self.spark.sql(text, **used)


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    """Register ``fn(tables) -> DataFrame`` with its SQL equivalent."""

    def register(fn: Callable[[Tables], DataFrame]):
        if name in QUERIES:
            raise ValueError(f"query {name} is registered twice")
        QUERIES[name] = lambda spark, folder: fn(Tables(spark, folder))
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def plain(text: str) -> str:
    """The same text for the checking engine, where tables are plain names."""
    for n in NAMES:
        text = text.replace("{" + n + "}", n)
    return text
