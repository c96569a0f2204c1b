"""Select, rename, cast, constants, calculated columns, pass-through."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.functions.calc import expression
from rowloom.functions.values import cast_value, field, quoted, resolve, text_literal


@dataclass(frozen=True)
class Mapping:
    """One output column: a source column or a constant, with a name and a type."""

    source: str = ""
    target: str = ""
    type: str = ""
    included: bool = True
    constant: str = ""

    @property
    def name(self) -> str:
        return self.target or self.source

    def line(self) -> str:
        flag = "true" if self.included else "false"
        return "|".join([self.source, self.target, self.type, flag, self.constant])


def parse_mappings(text: str) -> list[Mapping]:
    """Read ``source|target|type|included|constant`` lines; ``source=target`` and
    a bare ``source`` are read as well.  A constant may itself contain ``|``."""
    out = []
    for raw in text.split("\n"):
        line = raw.strip()
        if "|" in line:
            cells = line.split("|", 4)
            cells += [""] * (5 - len(cells))
            source, target, kind, included = (c.strip() for c in cells[:4])
            item = Mapping(source, target, kind, included.lower() != "false", cells[4])
        else:
            source, _, target = (part.strip() for part in line.partition("="))
            item = Mapping(source, target)
        if item.source or item.target or item.constant:
            out.append(item)
    return out


def format_mappings(mappings: Iterable[Mapping]) -> str:
    return "\r\n".join(m.line() for m in mappings)


def auto_mappings(df: DataFrame) -> list[Mapping]:
    return [Mapping(c, c) for c in df.columns]


def duplicate_targets(mappings: Iterable[Mapping]) -> list[str]:
    seen: set[str] = set()
    twice: list[str] = []
    for m in mappings:
        if m.included:
            (twice if m.name.lower() in seen else seen.add(m.name.lower()) or []).append(m.name)
    return twice


def _usable(mappings: str | Iterable[Mapping]) -> list[Mapping]:
    items = parse_mappings(mappings) if isinstance(mappings, str) else list(mappings)
    return [m for m in items if m.included and (m.source or m.constant)]


def select_values(
    df: DataFrame,
    mappings: str | Iterable[Mapping],
    strict: bool = False,
    emit_on_empty: bool = False,
) -> DataFrame:
    """Project to the mapped columns.

    Source columns that do not exist are left out; of two mappings to one name
    the later wins at the earlier's place; no mapping at all passes the input
    through.  ``emit_on_empty`` makes constants alone yield one row for an empty
    input, at the price of one emptiness check.
    """
    items = _usable(mappings)
    if not items:
        return df
    if strict and duplicate_targets(items):
        raise ValueError(f"columns mapped twice: {duplicate_targets(items)}")
    if emit_on_empty and all(m.constant for m in items) and df.isEmpty():
        return constant_row(df.sparkSession, items)
    columns = {}
    for m in items:
        source = text_literal(m.constant) if m.constant else field(df, m.source)
        if source is not None:
            columns[m.name] = cast_value(source, m.type).col.alias(m.name)
    return df.select(*columns.values())


def constant_row(spark: SparkSession, mappings: str | Iterable[Mapping]) -> DataFrame:
    """The single row that constants alone produce."""
    columns = {
        m.name: cast_value(text_literal(m.constant), m.type).col.alias(m.name)
        for m in _usable(mappings)
        if m.constant
    }
    return spark.range(1).select(*columns.values())


def calculate(
    df: DataFrame,
    kind: str = "add",
    field1: str = "",
    field2: str = "",
    output: str = "Result",
    value: str = "0",
) -> DataFrame:
    """Add (or replace) one calculated column."""
    return df.withColumn(resolve(df, output) or output, expression(df, kind, field1, field2, value))


def pass_through(df: DataFrame) -> DataFrame:
    return df


def rename(df: DataFrame, names: dict[str, str]) -> DataFrame:
    """Rename columns; an empty new name keeps the old one."""
    return df.select(*[F.col(quoted(c)).alias(names.get(c) or c) for c in df.columns])
