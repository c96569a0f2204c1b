"""Shared pieces of keyed operators: one row per key, and skew-proof matching."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import quoted, resolve

COPIES = "__copies"


def own_names(df: DataFrame, names: Sequence[str], what: str) -> list[str]:
    out = []
    for n in names:
        found = resolve(df, n)
        if found is None:
            raise ValueError(f"{what} {n!r} is not a column of {df.columns}")
        out.append(found)
    return out


def columns_of(names: Sequence[str], alias: str = "") -> list[Column]:
    dot = f"{alias}." if alias else ""
    return [F.col(dot + quoted(n)) for n in names]


def one_per_key(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    last: bool,
    keep: Sequence[str] | None = None,
) -> DataFrame:
    """The first or last row of every key in the given order, with its number of
    copies in ``__copies``.

    This is an aggregate, not a window: the rows of a hot key collapse inside the
    map tasks, before the shuffle.
    """
    order = F.struct(*columns_of(own_names(df, order_by, "order column")))
    pick = F.max_by if last else F.min_by
    kept = [c for c in (keep if keep is not None else df.columns) if c not in keys]
    row = F.struct(*columns_of(kept), F.lit(True).alias("__any"))
    picked = df.groupBy(*columns_of(keys)).agg(
        pick(row, order).alias("__row"), F.count(F.lit(1)).alias(COPIES)
    )
    out = [F.col(quoted(k)) for k in keys] + [F.col(f"__row.{quoted(c)}").alias(c) for c in kept]
    return picked.select(*out, COPIES)


def require_order(order_by: Sequence[str], assume_unique: bool, what: str) -> None:
    if not order_by and not assume_unique:
        raise ValueError(
            f"{what}: rows with one key need an order to choose by; "
            "pass order_by, or assume_unique=True when keys never repeat"
        )


def all_present(keys: Sequence[str]) -> Column:
    return reduce(lambda a, b: a & b, [c.isNotNull() for c in columns_of(keys)])


def equal_keys(keys: Sequence[str], left: str, right: str, split_hot: bool = True) -> Column:
    """SQL equality on every key, plus equality of the keys' hashes.

    The hash changes no result.  It keeps a side that was just aggregated by the
    same keys from lending its partitioning to the join, so both join inputs are
    plain shuffles, which is what adaptive execution needs to split a hot key.
    """
    mine, theirs = columns_of(keys, left), columns_of(keys, right)
    same = [a == b for a, b in zip(mine, theirs)]
    if split_hot:
        same.append(F.xxhash64(*mine) == F.xxhash64(*theirs))
    return reduce(lambda a, b: a & b, same)
