"""Two-input join with the NULL-matches-empty key rule, and union of inputs.

Skew: the plans keep both join inputs as plain shuffles and use join types whose
hot partitions adaptive execution can split.  Adaptive execution splits no full outer
join, so that is planned as the inner join plus the rows of either side without a
partner: each of these can be split, keys of the other side collapse before their shuffle,
and the shuffles of the rows are used by both.  Of other outer joins only the preserved
side is split.  Where keys may be hot on the other one, ``hot_rows`` looks for them (which
runs a job) and sends them through an inner join.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.functions.values import (
    Field,
    as_text,
    common_type,
    decimal_digits,
    field,
    in_parts,
    null_field,
    quoted,
    resolve,
    to_type,
)
from rowloom.operators.skew import hot_keys

JOIN_TYPES = ("INNER", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER")
_MATCHED = "__matched"


def split_names(names: str | Sequence[str]) -> list[str]:
    parts = names.split(",") if isinstance(names, str) else names
    return [p.strip() for p in parts if p.strip()]


def check_columns(df: DataFrame) -> None:
    """Two columns that differ only by case cannot be told apart later."""
    seen: dict[str, str] = {}
    for c in df.columns:
        if c.lower() in seen:
            raise ValueError(f"columns {seen[c.lower()]!r} and {c!r} differ only by case")
        seen[c.lower()] = c


class Key(NamedTuple):
    """One join key, brought to one type on both sides."""

    left: Column
    right: Column
    null_safe: bool

    @property
    def condition(self) -> Column:
        return self.left.eqNullSafe(self.right) if self.null_safe else self.left == self.right


def join_key(left: Field | None, right: Field | None) -> Key:
    """NULL, missing and empty text all match each other."""
    left, right = left or null_field(), right or null_field()
    if left.type == right.type and not left.text:
        return Key(left.col, right.col, True)
    if left.numeric and right.numeric or left.moment and right.moment:
        if not (left.floating or right.floating or left.moment or left.integral and right.integral):
            whole, fraction = decimal_digits(left.type, right.type)
            if whole + fraction > 38:
                return Key(in_parts(left, fraction), in_parts(right, fraction), True)
        shared = common_type(left.type, right.type)
        return Key(left.col.cast(shared), right.col.cast(shared), True)
    empty = F.lit("")
    return Key(F.coalesce(as_text(left), empty), F.coalesce(as_text(right), empty), False)


def _output(left: DataFrame, right: DataFrame, matched: Column | None) -> list[Column]:
    """Left columns, then new right columns; the right side overwrites shared
    columns wherever a right row is present, even with NULL."""
    out = []
    for c in left.columns:
        mine, other = field(left, c, "l"), field(right, c, "r")
        if other is None:
            out.append(mine.col.alias(c))
            continue
        shared = common_type(mine.type, other.type)
        theirs = to_type(other, shared)
        if matched is not None:
            theirs = F.when(matched, theirs).otherwise(to_type(mine, shared))
        out.append(theirs.alias(c))
    new = [c for c in right.columns if resolve(left, c) is None]
    return out + [F.col(f"r.{quoted(c)}").alias(c) for c in new]


def merge_join(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str] = (),
    how: str = "INNER",
    hot_rows: int | None = None,
) -> DataFrame:
    """Join two inputs on equally named keys; no keys means the cross product.

    With ``hot_rows``, outer joins first look for keys with more rows than that on
    the side that adaptive execution cannot split; without, no job runs.
    """
    if how not in JOIN_TYPES:
        raise ValueError(f"unknown join type {how!r}; known: {list(JOIN_TYPES)}")
    check_columns(left)
    check_columns(right)
    names = split_names(keys)
    if not names:
        return left.alias("l").crossJoin(right.alias("r")).select(*_output(left, right, None))
    pairs = [join_key(field(left, k, "l"), field(right, k, "r")) for k in names]
    if how == "INNER":
        return _joined(left, right, pairs, "inner")
    if how == "RIGHT OUTER":
        return _outer(left, right, pairs, "right", hot_rows)
    if how == "FULL OUTER" and hot_rows is None:
        if left.isStreaming or right.isStreaming:
            return _full(left, right, pairs)
        alone = unmatched_rows(left, right, pairs)
        return _joined(left, right, pairs, "inner").union(_unmatched_left(left, right, pairs)).union(alone)
    out = _outer(left, right, pairs, "left", hot_rows)
    return out if how == "LEFT OUTER" else out.union(unmatched_rows(left, right, pairs))


def _joined(left: DataFrame, right: DataFrame, pairs: list[Key], how: str) -> DataFrame:
    on = reduce(lambda a, b: a & b, [p.condition for p in pairs])
    if how == "left":
        marked = right.withColumn(_MATCHED, F.lit(True)).alias("r")
        return left.alias("l").join(marked, on, how).select(*_output(left, right, F.col(f"r.{_MATCHED}")))
    return left.alias("l").join(right.alias("r"), on, how).select(*_output(left, right, None))


def _full(left: DataFrame, right: DataFrame, pairs: list[Key]) -> DataFrame:
    """One full outer join.  A shared column is the right row's where there is one."""
    on = reduce(lambda a, b: a & b, [p.condition for p in pairs])
    marked = right.withColumn(_MATCHED, F.lit(True)).alias("r")
    return left.alias("l").join(marked, on, "full").select(*_output(left, right, F.col(f"r.{_MATCHED}")))


def _outer(left: DataFrame, right: DataFrame, pairs: list[Key], how: str, hot_rows: int | None) -> DataFrame:
    """Adaptive execution splits hot keys of the preserved side only.  Keys that
    are hot on the other side certainly match there, so their rows need no outer
    join: they go through an inner join, which can be split on both sides."""
    other = [p.right if how == "left" else p.left for p in pairs]
    side = right.alias("r") if how == "left" else left.alias("l")
    streams = left.isStreaming or right.isStreaming
    hot = hot_keys(side, other, None if streams else hot_rows)
    if hot is None:
        return _joined(left, right, pairs, how)

    def part(df: DataFrame, alias: str, columns: list[Column], kind: str) -> DataFrame:
        listed = F.broadcast(hot.alias("h"))
        on = reduce(lambda a, b: a & b, [c.eqNullSafe(F.col(f"h.k{i}")) for i, c in enumerate(columns)])
        return df.alias(alias).join(listed, on, kind)

    def both(kind: str) -> tuple[DataFrame, DataFrame]:
        return part(left, "l", [p.left for p in pairs], kind), part(right, "r", [p.right for p in pairs], kind)

    return _joined(*both("left_anti"), pairs, how).union(_joined(*both("left_semi"), pairs, "inner"))


def unmatched_rows(left: DataFrame, right: DataFrame, pairs: list[Key]) -> DataFrame:
    """Right rows without a left row, in the output's shape."""
    known = left.alias("l").select(*[p.left.alias(f"k{i}") for i, p in enumerate(pairs)]).distinct().alias("k")
    on = reduce(lambda a, b: a & b, [p.right.eqNullSafe(F.col(f"k.k{i}")) for i, p in enumerate(pairs)])
    columns = []
    for c in left.columns:
        mine, other = field(left, c), field(right, c, "r")
        value = F.lit(None).cast(mine.type) if other is None else to_type(other, common_type(mine.type, other.type))
        columns.append(value.alias(c))
    columns += [F.col(f"r.{quoted(c)}") for c in right.columns if resolve(left, c) is None]
    return right.alias("r").join(known, on, "left_anti").alias("r").select(*columns)


def _unmatched_left(left: DataFrame, right: DataFrame, pairs: list[Key]) -> DataFrame:
    """Left rows without a right row, in the output's shape."""
    known = right.alias("r").select(*[p.right.alias(f"k{i}") for i, p in enumerate(pairs)]).distinct().alias("k")
    on = reduce(lambda a, b: a & b, [p.left.eqNullSafe(F.col(f"k.k{i}")) for i, p in enumerate(pairs)])
    columns = []
    for c in left.columns:
        mine, other = field(left, c, "l"), field(right, c, "r")
        columns.append((mine.col if other is None else to_type(mine, common_type(mine.type, other.type))).alias(c))
    columns += [F.lit(None).cast(right.schema[c].dataType).alias(c) for c in right.columns if resolve(left, c) is None]
    return left.alias("l").join(known, on, "left_anti").alias("l").select(*columns)


def merge_join_inputs(inputs: Sequence[DataFrame], keys: str | Sequence[str] = (), how: str = "INNER", hot_rows: int | None = None) -> DataFrame:
    """First input is left, second is right; more are an error."""
    if len(inputs) != 2:
        raise ValueError(f"a join takes two inputs, got {len(inputs)}")
    return merge_join(inputs[0], inputs[1], keys, how, hot_rows)


def union_inputs(inputs: Sequence[DataFrame]) -> DataFrame:
    """All rows of all inputs, by column name; types are widened to a common one,
    columns an input lacks are NULL."""
    if not inputs:
        raise ValueError("a union needs at least one input")
    if len(inputs) == 1:
        return inputs[0]
    names: dict[str, str] = {}
    types: dict[str, T.DataType] = {}
    for df in inputs:
        check_columns(df)
        for f in df.schema.fields:
            low = f.name.lower()
            names.setdefault(low, f.name)
            types[low] = common_type(types[low], f.dataType) if low in types else f.dataType
    parts = []
    for df in inputs:
        columns = [
            to_type(field(df, name) or Field(F.lit(None).cast(types[low]), types[low]), types[low]).alias(name)
            for low, name in names.items()
        ]
        parts.append(df.select(*columns))
    return reduce(lambda a, b: a.union(b), parts)
