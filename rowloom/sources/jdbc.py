"""External databases through Spark's JDBC source, and lookups per row."""

from __future__ import annotations

import re
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass, field as default
from datetime import date, datetime

import pandas as pd
from pyspark.sql import DataFrame, SparkSession, types as T

from rowloom.sources.sqlstep import NAMED, has_named, has_positional, outside_quotes, parameter_row, trim_statement

# Url prefix -> database kind, and the driver class of each kind.
KINDS = {
    "jdbc:oracle:": "oracle",
    "jdbc:mysql:": "mysql",
    "jdbc:mariadb:": "mariadb",
    "jdbc:postgresql:": "postgresql",
    "jdbc:sqlserver:": "sqlserver",
    "jdbc:sqlite:": "sqlite",
}
DRIVERS = {
    "oracle": "oracle.jdbc.OracleDriver",
    "mysql": "com.mysql.cj.jdbc.Driver",
    "mariadb": "org.mariadb.jdbc.Driver",
    "postgresql": "org.postgresql.Driver",
    "sqlserver": "com.microsoft.sqlserver.jdbc.SQLServerDriver",
    "sqlite": "org.sqlite.JDBC",
}


# How each database marks parameters, and which of them know the
# standard timestamp literal or treat a backslash in text as an escape.
MARKS = {
    "oracle": ":{n}",
    "mysql": "%s",
    "mariadb": "%s",
    "postgresql": "%s",
    "sqlserver": "?",
    "sqlite": "?",
}
TIMESTAMP_LITERAL = ("oracle", "mysql", "mariadb", "postgresql")
BACKSLASH_ESCAPES = ("mysql", "mariadb")


@dataclass(frozen=True)
class JdbcConnection:
    url: str
    properties: Mapping[str, str] = default(default_factory=dict)

    @property
    def kind(self) -> str:
        for prefix, kind in KINDS.items():
            if self.url.lower().startswith(prefix):
                return kind
        raise ValueError(f"unknown database in {self.url.split(':', 2)[:2]}")

    def options(self) -> dict[str, str]:
        return {"url": self.url, "driver": DRIVERS[self.kind], **self.properties}


@dataclass(frozen=True)
class Split:
    """How a read is divided among tasks: equal ranges of a numeric or time column."""

    column: str
    lower: str
    upper: str
    partitions: int

    def options(self) -> dict[str, str]:
        return {
            "partitionColumn": self.column,
            "lowerBound": str(self.lower),
            "upperBound": str(self.upper),
            "numPartitions": str(self.partitions),
        }


def literal(value: object, kind: str) -> str:
    """One value as SQL text; Spark's JDBC source has no parameters of its own."""
    if value is None:
        return "NULL"
    if isinstance(value, bool):
        return str(value).upper() if kind == "postgresql" else str(int(value))
    if isinstance(value, (bytes, bytearray)):
        raise TypeError("a binary value cannot be a literal in a JDBC query")
    if isinstance(value, (datetime, date)):
        at = value if isinstance(value, datetime) else datetime(value.year, value.month, value.day)
        text = at.isoformat(sep="T" if kind == "sqlserver" else " ")
        return f"TIMESTAMP '{text}'" if kind in TIMESTAMP_LITERAL else f"'{text}'"
    if isinstance(value, str):
        if kind in BACKSLASH_ESCAPES:
            value = value.replace("\\", "\\\\")
        return "'" + value.replace("'", "''") + "'"
    return str(value)


def bound_sql(sql: str, params: DataFrame | Mapping | Sequence | None, kind: str) -> str:
    """The query with its parameters filled in as literals; text inside quotes is
    left alone."""
    if params is None:
        return sql
    wanted = NAMED if has_named(sql) else r"\?"
    if wanted != NAMED and not has_positional(sql):
        return sql
    names, values = parameter_row(params)
    by_name, in_order = dict(zip(names, values)), iter(values)

    def fill(m: re.Match) -> str:
        return literal(by_name[m.group(2)] if m.group(0).startswith(":") else next(in_order), kind)

    return outside_quotes(wanted, fill, sql, kind in BACKSLASH_ESCAPES)


def _ended(sql: str) -> str:
    """A comment at the end of a query must not hide what follows it."""
    return sql + "\n" if "--" in sql else sql


def read_options(
    connection: JdbcConnection,
    table: str = "",
    sql: str = "",
    split: Split | None = None,
    fetch_size: int = 10_000,
    params: DataFrame | Mapping | Sequence | None = None,
) -> dict[str, str]:
    """A query is wrapped as a subquery, so an ORDER BY in it is not kept."""
    if bool(table) == bool(sql):
        raise ValueError("give either a table or a query")
    source = table or f"({_ended(bound_sql(trim_statement(sql), params, connection.kind))}) q"
    out = {**connection.options(), "dbtable": source, "fetchsize": str(fetch_size)}
    return {**out, **split.options()} if split else out


def read_jdbc(spark: SparkSession, connection: JdbcConnection, **how) -> DataFrame:
    """Filters and column selection on the result are pushed into the database."""
    return spark.read.format("jdbc").options(**read_options(connection, **how)).load()


def lookup_each_row(
    rows: DataFrame,
    connect: Callable[[], object],
    kind: str,
    sql: str,
    schema: str | T.StructType,
    fetch: int = 10_000,
) -> DataFrame:
    """The query's result for every input row, asked of the database itself.

    Each partition keeps one DB-API connection and streams its answers.  Where
    the table can be read into Spark, ``sql_each_row`` does this as one join.
    """
    text, columns = trim_statement(sql), list(rows.columns)
    order: list[str] = []

    def mark(m: re.Match) -> str:
        order.append(m.group(2) if m.group(0).startswith(":") else columns[len(order)])
        return MARKS[kind].format(n=len(order))

    statement = outside_quotes(NAMED if has_named(text) else r"\?", mark, text, kind in BACKSLASH_ESCAPES)
    fields = (T.StructType.fromDDL(schema) if isinstance(schema, str) else schema).fieldNames()

    def ask(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        connection = None
        try:
            for frame in frames:
                for row in frame.astype(object).where(frame.notna(), None).to_dict("records"):
                    connection = connection or connect()
                    cursor = connection.cursor()
                    cursor.execute(statement, [row[c] for c in order])
                    while found := cursor.fetchmany(fetch):
                        yield pd.DataFrame([tuple(f) for f in found], columns=fields)
        finally:
            if connection is not None:
                connection.close()

    return rows.mapInPandas(ask, schema)
