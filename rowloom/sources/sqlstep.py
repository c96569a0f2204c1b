"""SQL text as a step: plain, with parameters from a row, or once per row."""

from __future__ import annotations

import re
import uuid
from collections.abc import Callable, Mapping, Sequence

from pyspark.sql import DataFrame, SparkSession

from rowloom.functions.values import quoted

# Fixed value: the form of a named parameter.
NAMED = r":\{([a-zA-Z_]\w*)\}"


_NAMES_AND_COMMENTS = r"""`(?:[^`]|``)*`|--[^\n]*|/\*.*?\*/"""
_QUOTED = r"""'(?:[^']|'')*'|"(?:[^"]|"")*"|""" + _NAMES_AND_COMMENTS
_ESCAPED = r"""'(?:[^'\\]|''|\\.)*'|"(?:[^"\\]|""|\\.)*"|""" + _NAMES_AND_COMMENTS


def outside_quotes(pattern: str, fill: Callable[[re.Match], str], sql: str, escapes: bool = True) -> str:
    """Replace what ``pattern`` matches outside literals, quoted names and comments.
    ``escapes``: a backslash keeps a quote from ending a literal, as in Spark SQL."""
    found = re.compile(f"(?P<quoted__>{_ESCAPED if escapes else _QUOTED})|{pattern}", re.S)
    return found.sub(lambda m: m.group(0) if m.group("quoted__") is not None else fill(m), sql)


def _unquoted(pattern: str, sql: str) -> bool:
    seen: list[str] = []
    outside_quotes(pattern, lambda m: seen.append(m.group(0)) or m.group(0), sql)
    return bool(seen)


def has_positional(sql: str) -> bool:
    return _unquoted(r"\?", sql)


def trim_statement(sql: str) -> str:
    return sql.strip().rstrip(";").rstrip()


def has_named(sql: str) -> bool:
    return _unquoted(NAMED, sql)


def parameter_row(params: DataFrame | Mapping | Sequence | None) -> tuple[list[str], list]:
    """Names and values of the parameter row; of a frame only the first row."""
    if params is None:
        return [], []
    if isinstance(params, DataFrame):
        row = params.first()
        if row is None:
            raise ValueError("the statement has parameters but the input has no row")
        return list(params.columns), list(row)
    if isinstance(params, Mapping):
        return list(params), list(params.values())
    return [], list(params)


def sql_input(spark: SparkSession, sql: str, params: DataFrame | Mapping | Sequence | None = None) -> DataFrame:
    """Run a query on the session's views and tables.

    ``:{name}`` binds by column name and ``?`` by column order; if both occur the
    names win.  Values are bound by Spark, never pasted into the text.
    """
    text = trim_statement(sql)
    if has_named(text):
        names, values = parameter_row(params)
        return spark.sql(outside_quotes(NAMED, lambda m: f":{m.group(2)}", text), args=dict(zip(names, values)))
    if params is not None and has_positional(text):
        return spark.sql(text, args=parameter_row(params)[1])
    return spark.sql(text)


def sql_each_row(spark: SparkSession, sql: str, rows: DataFrame, check_empty: bool = True) -> DataFrame:
    """The query's result for every input row, as one lateral join.

    Parameters become references to the outer row, so equality conditions are
    planned as an ordinary equi-join.  Only the query's columns are returned, and
    repeated input rows repeat their result.
    """
    if check_empty and rows.isEmpty():
        raise ValueError("the statement runs once per row but the input has no row")
    outer = "p_" + uuid.uuid4().hex
    text = trim_statement(sql)
    if has_named(text):
        text = outside_quotes(NAMED, lambda m: f"{outer}.{quoted(m.group(2))}", text)
    else:
        columns = iter(rows.columns)
        text = outside_quotes(r"\?", lambda m: f"{outer}.{quoted(next(columns))}", text)
    rows.createOrReplaceTempView(outer)
    try:
        return spark.sql(f"SELECT q.* FROM {outer}, LATERAL ({text}\n) AS q")
    finally:
        spark.catalog.dropTempView(outer)


def sql_columns(spark: SparkSession, sql: str) -> list[tuple[str, str]]:
    """Names and types of a query's columns; analysis only, no data is read."""
    return [(f.name, f.dataType.simpleString()) for f in spark.sql(trim_statement(sql)).schema.fields]


def list_tables(spark: SparkSession) -> list[str]:
    return sorted(t.name for t in spark.catalog.listTables())


def list_columns(spark: SparkSession, table: str) -> list[str]:
    return spark.table(table).columns


def preview(df: DataFrame, rows: int = 100) -> DataFrame:
    return df.limit(rows)


def exec_sql(spark: SparkSession, sql: str, rows: DataFrame | None = None) -> DataFrame | None:
    """Run one statement for its effect and hand the input on unchanged."""
    spark.sql(trim_statement(sql))
    return rows
