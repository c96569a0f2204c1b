"""Keyed insert-or-update, update and delete as table-valued operators.

Plain Parquet tables have no row-level changes, so each operator returns the new
state of the target as a frame.  Write it to a new path or table version; never
over the path it was read from.

Rows whose key contains NULL match nothing, so they bypass the join: they are
neither shuffled nor gathered in one task.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import field, quoted, resolve, to_type, values_differ
from rowloom.operators.join import check_columns, split_names
from rowloom.operators.keyed import (
    COPIES,
    all_present,
    columns_of,
    equal_keys,
    one_per_key,
    own_names,
    require_order,
)

_ORDER = "__order"
INSERTED, UPDATED, UNCHANGED, DELETED = "inserted", "updated", "unchanged", "deleted"


def _update_names(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    update_fields: str | Sequence[str] | None,
    order_by: str | Sequence[str],
) -> list[str]:
    """Given fields, or every non-key column of the source; a column that only
    orders the source rows is not one."""
    if update_fields is not None:
        chosen = split_names(update_fields)
        if chosen or not isinstance(update_fields, str):
            return chosen
    low = {k.lower() for k in keys}
    ordering = {o.lower() for o in split_names(order_by) if resolve(target, o) is None}
    return [c for c in source.columns if c.lower() not in low | ordering]


def _changes(
    target: DataFrame,
    source: DataFrame,
    keys: list[str],
    updates: list[str],
    order_by: str | Sequence[str],
    assume_unique: bool,
) -> tuple[DataFrame, DataFrame]:
    """The source in the target's names and types: (one row per full key, rows
    with a NULL in the key)."""
    order = own_names(source, split_names(order_by), "order column")
    require_order(order, assume_unique, "merge")
    wanted = list(dict.fromkeys([*keys, *updates]))
    columns = [to_type(field(source, c), target.schema[c].dataType).alias(c) for c in wanted]
    ordering = [F.struct(*columns_of(order)).alias(_ORDER)] if order else []
    shaped = source.select(*columns, *ordering)
    present = shaped.where(all_present(keys))
    if assume_unique:
        once = present.select(*columns_of(wanted), F.lit(1).cast("bigint").alias(COPIES))
    else:
        once = one_per_key(present, keys, [_ORDER], last=True, keep=wanted)
    return once, shaped.where(~all_present(keys)).select(*columns_of(wanted))


def _as_target(target: DataFrame, rows: DataFrame) -> DataFrame:
    """Rows in the target's shape; columns they lack are NULL."""
    have = set(rows.columns)
    return rows.select(
        *[
            (F.col(quoted(c)) if c in have else F.lit(None).cast(target.schema[c].dataType)).alias(c)
            for c in target.columns
        ]
    )


def _kind_of(updates: Sequence[str], present: Column) -> Column:
    """What a change does to the target row that it is joined to; NULL for no change."""
    changed = F.lit(False)
    for u in updates:
        changed = changed | values_differ(F.col(f"t.{quoted(u)}"), F.col(f"s.{quoted(u)}"))
    return F.when(present, F.when(changed, F.lit(UPDATED)).otherwise(F.lit(UNCHANGED)))


def _merged(target: DataFrame, keys: list[str], updates: set[str], present: Column) -> list[Column]:
    out = []
    for c in target.columns:
        old = F.col(f"t.{quoted(c)}")
        if c in keys:
            out.append(F.coalesce(old, F.col(f"s.{quoted(c)}")).alias(c))
        elif c in updates:
            out.append(F.when(present, F.col(f"s.{quoted(c)}")).otherwise(old).alias(c))
        else:
            out.append(old.alias(c))
    return out


def _prepare(target: DataFrame, source: DataFrame, keys: str | Sequence[str], what: str) -> list[str]:
    names = split_names(keys)
    if not names:
        raise ValueError(f"{what} needs at least one key column")
    check_columns(target)
    check_columns(source)
    return own_names(target, names, "key")


def insert_rows(target: DataFrame, source: DataFrame) -> DataFrame:
    """Target plus the source rows, matched by column name."""
    names = own_names(target, source.columns, "column")
    columns = [to_type(field(source, c), target.schema[c].dataType).alias(c) for c in names]
    return target.union(_as_target(target, source.select(*columns)))


def upsert(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    update_fields: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    target_unique: bool = True,
    kind: str | None = None,
) -> DataFrame:
    """Insert new keys and update known ones; the last row of a key wins.

    With ``update_fields`` only keys and those fields are written, so inserted
    rows are NULL elsewhere; fields the source lacks are ignored.  Rows with a
    NULL key are always inserted.  A target that may repeat keys
    (``target_unique=False``) is planned as two joins whose hot keys can be split.
    ``kind`` names a further column that tells what became of each row: inserted, updated,
    unchanged (its values were the same), or NULL where nothing was to be changed.
    """
    names = _prepare(target, source, keys, "upsert")
    own_names(source, names, "key")
    given = [u for u in _update_names(target, source, names, update_fields, order_by) if resolve(source, u)]
    written = own_names(target, given, "column")
    updates = [u for u in written if u not in names]
    once, loose = _changes(target, source, names, updates, order_by, assume_unique)
    known = target.where(all_present(names)).alias("t")
    changes = once.alias("s")
    present = F.col(f"s.{COPIES}").isNotNull()
    columns = _merged(target, names, set(updates), present)
    new_kind, old_kind = ([], []) if kind is None else ([F.lit(INSERTED).alias(kind)], [F.lit(None).cast("string").alias(kind)])
    if kind is not None:
        row_kind = F.when(F.col("t.__old").isNull(), F.lit(INSERTED)).otherwise(_kind_of(updates, present))
        known = target.where(all_present(names)).withColumn("__old", F.lit(True)).alias("t")
        columns = [*columns, row_kind.alias(kind)]
    if target_unique:
        merged = known.join(changes, equal_keys(names, "t", "s", split_hot=False), "full").select(*columns)
    else:
        kept = known.join(changes, equal_keys(names, "t", "s"), "left").select(*columns)
        seen = target.select(*columns_of(names)).distinct().alias("t")
        new = changes.join(seen, equal_keys(names, "t", "s"), "left_anti")
        merged = kept.union(_as_target(target, new).select("*", *new_kind))
    untouched = target.where(~all_present(names)).select("*", *old_kind)
    return merged.union(untouched).union(_as_target(target, loose).select("*", *new_kind))


def upsert_first_column(target: DataFrame, source: DataFrame, **options) -> DataFrame:
    """Upsert keyed by the source's first column."""
    return upsert(target, source, [source.columns[0]], **options)


def update_matched(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    update_fields: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    kind: str | None = None,
) -> DataFrame:
    """Update rows whose key is in the source; never insert.

    Every target row with the key is updated.  An update field the source lacks
    becomes NULL; a key column the source lacks matches nothing.  ``kind`` as in ``upsert``.
    """
    names = _prepare(target, source, keys, "update")
    old_kind = [] if kind is None else [F.lit(None).cast("string").alias(kind)]
    if any(resolve(source, k) is None for k in names):
        return target.select("*", *old_kind)
    fields = own_names(target, _update_names(target, source, names, update_fields, order_by), "column")
    fields = [f for f in fields if f not in names]
    if not fields:
        return target.select("*", *old_kind)
    have = [f for f in fields if resolve(source, f)]
    once, _ = _changes(target, source, names, have, order_by, assume_unique)
    for f in fields:
        if f not in have:
            once = once.withColumn(f, F.lit(None).cast(target.schema[f].dataType))
    known = target.where(all_present(names)).alias("t")
    present = F.col(f"s.{COPIES}").isNotNull()
    joined = known.join(once.alias("s"), equal_keys(names, "t", "s"), "left")
    row_kind = [] if kind is None else [_kind_of(fields, present).alias(kind)]
    updated = joined.select(*_merged(target, names, set(fields), present), *row_kind)
    return updated.union(target.where(~all_present(names)).select("*", *old_kind))


def delete_by_key(target: DataFrame, source: DataFrame, keys: str | Sequence[str], kind: str | None = None) -> DataFrame:
    """Target rows whose key is not in the source; NULL keys delete nothing.

    With ``kind`` the deleted rows are still there, marked as such in that column.
    """
    names = _prepare(target, source, keys, "delete")
    old_kind = [] if kind is None else [F.lit(None).cast("string").alias(kind)]
    if any(resolve(source, k) is None for k in names):
        return target.select("*", *old_kind)
    gone = source.select(
        *[to_type(field(source, k), target.schema[k].dataType).alias(k) for k in names]
    ).where(all_present(names)).distinct()
    known = target.where(all_present(names)).alias("t")
    if kind is None:
        kept = known.join(gone.alias("s"), equal_keys(names, "t", "s"), "left_anti")
    else:
        met = known.join(gone.withColumn(COPIES, F.lit(1)).alias("s"), equal_keys(names, "t", "s"), "left")
        kept = met.select("t.*", F.when(F.col(f"s.{COPIES}").isNotNull(), F.lit(DELETED)).alias(kind))
    return kept.union(target.where(~all_present(names)).select("*", *old_kind))


def matching_rows(df: DataFrame, other: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """Rows whose key occurs in the other frame, once each: a semi-join."""
    names = _prepare(df, other, keys, "matching_rows")
    own_names(other, names, "key")
    known = other.select(*[to_type(field(other, k), df.schema[k].dataType).alias(k) for k in names])
    known = known.where(all_present(names)).distinct()
    return df.alias("t").join(known.alias("s"), equal_keys(names, "t", "s"), "left_semi")


def upsert_counts(
    target: DataFrame,
    source: DataFrame,
    keys: str | Sequence[str],
    update_fields: str | Sequence[str] | None = None,
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
) -> DataFrame:
    """One row: ``processed`` source rows, keys ``inserted`` / ``updated`` /
    ``unchanged``.  Rows with a NULL key count as inserted."""
    names = _prepare(target, source, keys, "upsert")
    given = [u for u in _update_names(target, source, names, update_fields, order_by) if resolve(source, u)]
    updates = [u for u in own_names(target, given, "column") if u not in names]
    once, loose = _changes(target, source, names, updates, order_by, assume_unique)
    old = target.where(all_present(names)).select(*columns_of([*names, *updates]), F.lit(True).alias("__old"))
    joined = once.alias("s").join(old.alias("t"), equal_keys(names, "t", "s", split_hot=False), "left")
    changed = F.lit(False)
    for u in updates:
        changed = changed | values_differ(F.col(f"t.{quoted(u)}"), F.col(f"s.{quoted(u)}"))
    kind = F.when(F.col("t.__old").isNull(), F.lit("i")).when(changed, F.lit("u")).otherwise(F.lit("n"))
    rows = joined.select(F.col(f"s.{COPIES}").alias("copies"), kind.alias("kind")).union(
        loose.select(F.lit(1).cast("bigint"), F.lit("i"))
    )
    return rows.agg(
        F.coalesce(F.sum("copies"), F.lit(0)).cast("bigint").alias("processed"),
        F.count_if(F.col("kind") == "i").alias("inserted"),
        F.count_if(F.col("kind") == "u").alias("updated"),
        F.count_if(F.col("kind") == "n").alias("unchanged"),
    )


def update_counts(target: DataFrame, source: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """One row: ``processed`` source rows, ``updated`` target rows, and
    ``unmatched`` source rows whose key the target lacks."""
    names = _prepare(target, source, keys, "update")
    own_names(source, names, "key")
    shaped = source.select(*[to_type(field(source, k), target.schema[k].dataType).alias(k) for k in names])
    wanted = shaped.groupBy(*columns_of(names)).agg(F.count(F.lit(1)).alias("copies")).alias("s")
    held = target.where(all_present(names)).groupBy(*columns_of(names)).agg(F.count(F.lit(1)).alias("rows")).alias("t")
    joined = wanted.join(held, equal_keys(names, "t", "s", split_hot=False), "left")
    return joined.agg(
        F.coalesce(F.sum("s.copies"), F.lit(0)).cast("bigint").alias("processed"),
        F.coalesce(F.sum("t.rows"), F.lit(0)).cast("bigint").alias("updated"),
        F.coalesce(F.sum(F.when(F.col("t.rows").isNull(), F.col("s.copies"))), F.lit(0))
        .cast("bigint")
        .alias("unmatched"),
    )


def merge_into_table(source: DataFrame, table: str, keys: Sequence[str], update_fields: Sequence[str]) -> None:
    """The same upsert, run by the table's own catalog where it can merge rows.

    ``source`` must hold one row per key.  Plain Parquet tables reject this.
    """
    condition = equal_keys(list(keys), table, "s", split_hot=False)
    values = {c: F.col(f"s.{quoted(c)}") for c in [*keys, *update_fields]}
    writer = source.alias("s").mergeInto(table, condition)
    if update_fields:
        writer = writer.whenMatched().update({c: values[c] for c in update_fields})
    writer.whenNotMatched().insert(values).merge()
