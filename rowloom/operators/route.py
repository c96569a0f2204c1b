"""Filter with pass and fail ports, and value-based routing."""

from __future__ import annotations

from collections.abc import Iterable
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.compare import NULL_TESTS, OPERATORS, compare_fields, compare_literal
from rowloom.functions.values import as_text, field, quoted, resolve, null_field

PASS, FAIL, DEFAULT = "pass", "fail", "default"


def predicate(
    df: DataFrame,
    name: str,
    op: str = "equals",
    value: str = "",
    right: str = "",
    textual_equality: bool = False,
) -> Column:
    """The filter condition; NULL means "does not pass".

    A column that does not exist passes nothing, for any operator.
    """
    if op not in OPERATORS:
        raise ValueError(f"unknown filter operator {op!r}; known: {list(OPERATORS)}")
    left = field(df, name)
    if left is None:
        return F.lit(False)
    if op in NULL_TESTS:
        return left.col.isNull() if op == "isNull" else left.col.isNotNull()
    if right:
        other = field(df, right)
        return F.lit(False) if other is None else compare_fields(op, left, other, textual_equality)
    return compare_literal(op, left, value)


def filter_rows(df: DataFrame, name: str, op: str = "equals", value: str = "", right: str = "", **kw) -> DataFrame:
    """Only the passing rows; the bare condition is left to predicate pushdown."""
    return df.where(predicate(df, name, op, value, right, **kw))


def filter_split(
    df: DataFrame, name: str, op: str = "equals", value: str = "", right: str = "", **kw
) -> dict[str, DataFrame]:
    """Both ports; every row is in exactly one, and an unread port costs nothing."""
    test = predicate(df, name, op, value, right, **kw)
    return {PASS: df.where(test), FAIL: df.where(~F.coalesce(test, F.lit(False)))}


def filter_tag(df: DataFrame, name: str, op: str = "equals", value: str = "", right: str = "", tag: str = "branch", **kw) -> DataFrame:
    """One pass over the rows, with the port each row belongs to."""
    test = F.coalesce(predicate(df, name, op, value, right, **kw), F.lit(False))
    return df.withColumn(tag, F.when(test, F.lit(PASS)).otherwise(F.lit(FAIL)))


@dataclass(frozen=True)
class Case:
    value: str
    key: str
    label: str


def parse_cases(text: str) -> list[Case]:
    """``value|key|label`` lines.  The key defaults to the value; a key that
    reads ``default`` gets the suffix ``_case``; lines without a value are skipped."""
    out = []
    for line in text.replace("\r", "\n").split("\n"):
        value, key, label = ([c.strip() for c in line.split("|")] + ["", "", ""])[:3]
        if not value:
            continue
        key = key or value
        if key.lower() == DEFAULT:
            key += "_case"
        out.append(Case(value, key, label or f"{key} (= {value})"))
    return out


def _values_by_port(cases: Iterable[Case]) -> dict[str, list[str]]:
    """First case of a value wins, so each value belongs to one port."""
    owner: dict[str, str] = {}
    ports: dict[str, list[str]] = {}
    for c in cases:
        ports.setdefault(c.key, [])
        if c.value not in owner:
            owner[c.value] = c.key
            ports[c.key].append(c.value)
    return ports


def switch_ports(cases: str | list[Case], include_default: bool = True) -> list[str]:
    items = parse_cases(cases) if isinstance(cases, str) else cases
    names = list(dict.fromkeys(c.key for c in items))
    return [*names, DEFAULT] if include_default or not names else names


def branch_column(df: DataFrame, name: str, cases: str | list[Case], include_default: bool = True) -> Column:
    """The port of each row; NULL where the row is to be dropped."""
    items = parse_cases(cases) if isinstance(cases, str) else cases
    text = as_text(field(df, name) or null_field())
    branch = F.lit(DEFAULT) if include_default else F.lit(None).cast("string")
    for port, values in reversed(_values_by_port(items).items()):
        if values:
            branch = F.when(text.isin(values), F.lit(port)).otherwise(branch)
    return branch


def switch(
    df: DataFrame, name: str, cases: str | list[Case], include_default: bool = True
) -> dict[str, DataFrame]:
    """One lazily filtered frame per port.  Each port is a plain ``IN`` list on
    the column, which the scan can evaluate."""
    items = parse_cases(cases) if isinstance(cases, str) else cases
    text = as_text(field(df, name) or null_field())
    by_port = _values_by_port(items)
    ports = {p: df.where(text.isin(v) if v else F.lit(False)) for p, v in by_port.items()}
    if include_default or not by_port:
        known = [v for values in by_port.values() for v in values]
        rest = text.isNull() | ~text.isin(known) if known else F.lit(True)
        ports[DEFAULT] = df.where(rest if include_default else F.lit(False))
    return ports


def switch_tag(
    df: DataFrame, name: str, cases: str | list[Case], include_default: bool = True, tag: str = "branch"
) -> DataFrame:
    """All ports in one pass: rows tagged with their port, unrouted rows dropped."""
    out = df.withColumn(tag, branch_column(df, name, cases, include_default))
    return out if include_default else out.where(F.col(quoted(tag)).isNotNull())


def branch_counts(tagged: DataFrame, tag: str = "branch") -> DataFrame:
    column = resolve(tagged, tag)
    return tagged.groupBy(F.col(quoted(column))).agg(F.count(F.lit(1)).alias("n"))
