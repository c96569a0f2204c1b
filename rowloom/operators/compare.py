"""Row-by-row comparison of two tables by key."""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.functions.compare import values_equal
from rowloom.functions.values import Field, common_type, field, null_field, quoted, resolve, to_type
from rowloom.operators.join import check_columns, split_names
from rowloom.operators.keyed import COPIES, one_per_key, require_order

MATCH, DIFF, ONLY_LEFT, ONLY_RIGHT = "MATCH", "DIFF", "ONLY_LEFT", "ONLY_RIGHT"
STATUS, DIFF_COLUMNS = "_status", "_diff_columns"
_HERE = "__here"


def compare_columns(left: DataFrame, right: DataFrame, keys: Sequence[str], columns: str | Sequence[str] = ()) -> list[str]:
    """The columns to compare: those given, else all of both sides but the keys."""
    chosen = split_names(columns)
    if chosen:
        return chosen
    low = {k.lower() for k in keys}
    out: dict[str, str] = {}
    for c in [*left.columns, *right.columns]:
        if c.lower() not in low:
            out.setdefault(c.lower(), c)
    return list(out.values())


def _same_key(a: Field | None, b: Field | None) -> Column:
    """NULL matches NULL only; mixed types meet in a common one."""
    a, b = a or null_field(), b or null_field()
    shared = common_type(a.type, b.type)
    return to_type(a, shared).eqNullSafe(to_type(b, shared))


def table_compare(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    columns: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    split_hot: bool = True,
    ignore_case: bool = False,
    trim: bool = False,
    nulls_equal: bool = True,
    include_matched: bool = False,
) -> DataFrame:
    """Keys, ``c_L``/``c_R`` per compared column, ``_status`` and ``_diff_columns``.

    Of several right rows with one key the first in ``order_by`` is compared; all
    left rows are.  A left outer join and the right rows without a left key: both can be
    split by adaptive execution where a left key is hot.  Without ``split_hot`` one full
    outer join does it, which cannot.
    """
    names = split_names(keys)
    if not names:
        raise ValueError("table_compare needs at least one key column")
    check_columns(left)
    check_columns(right)
    compared = compare_columns(left, right, names, columns)
    order = split_names(order_by)
    require_order(order, assume_unique, "table_compare")
    right_keys = [resolve(right, k) for k in names if resolve(right, k)]
    repeats = not assume_unique and bool(right_keys)
    once = one_per_key(right, right_keys, order, last=False).drop(COPIES) if repeats else right

    on = reduce(lambda a, b: a & b, [_same_key(field(left, k, "l"), field(right, k, "r")) for k in names])
    on_left, on_right = F.col(f"l.{_HERE}").isNotNull(), F.col(f"r.{_HERE}").isNotNull()
    l = left.withColumn(_HERE, F.lit(True)).alias("l")
    r = once.withColumn(_HERE, F.lit(True)).alias("r")
    joined = l.join(r, on, "left" if split_hot else "full")
    unequal = {
        c: ~values_equal(
            field(left, c, "l") or null_field(), field(right, c, "r") or null_field(), ignore_case, trim, nulls_equal
        )
        for c in compared
    }
    differing = F.concat_ws(",", *[F.when(test, F.lit(c)) for c, test in unequal.items()])
    status = (
        F.when(~on_right, F.lit(ONLY_LEFT))
        .when(~on_left, F.lit(ONLY_RIGHT))
        .when(differing == "", F.lit(MATCH))
        .otherwise(F.lit(DIFF))
    )
    keys_out = [_key_value(field(left, k, "l"), field(right, k, "r"), on_left).alias(k) for k in names]
    values = []
    for c in compared:
        for f, suffix in ((field(left, c, "l"), "_L"), (field(right, c, "r"), "_R")):
            values.append((f.col if f else F.lit(None).cast("string")).alias(c + suffix))
    diffs = F.when(on_left & on_right, differing).otherwise(F.lit(""))
    out = joined.select(*keys_out, *values, status.alias(STATUS), diffs.alias(DIFF_COLUMNS))
    if not include_matched:
        out = out.where(F.col(STATUS) != MATCH)
    if not split_hot:
        return out
    left_keys = [resolve(left, k) for k in names if resolve(left, k)]
    known = left.select(*[F.col(quoted(k)) for k in left_keys]).distinct()
    alone = once.alias("r").join(known.alias("l"), on, "left_anti").alias("r")
    return out.union(alone.select(*_right_only(left, right, names, compared)))


def _key_type(l: Field | None, r: Field | None) -> T.DataType:
    return common_type((l or r or null_field()).type, (r or l or null_field()).type)


def _key_value(l: Field | None, r: Field | None, on_left: Column) -> Column:
    """The left row's key, or the right row's where there is no left row."""
    shared = _key_type(l, r)
    if l is None or r is None:
        return to_type(l or r or null_field(), shared)
    return F.when(on_left, to_type(l, shared)).otherwise(to_type(r, shared))


def _right_only(left: DataFrame, right: DataFrame, names: list[str], compared: list[str]) -> list[Column]:
    """Right rows without a partner, in the output's shape."""
    out = []
    for k in names:
        l, r = field(left, k, "l"), field(right, k, "r")
        shared = _key_type(l, r)
        out.append((to_type(r, shared) if r else F.lit(None).cast(shared)).alias(k))
    for c in compared:
        l, r = field(left, c, "l"), field(right, c, "r")
        out.append(F.lit(None).cast(l.type if l else "string").alias(c + "_L"))
        out.append((r.col if r else F.lit(None).cast("string")).alias(c + "_R"))
    return [*out, F.lit(ONLY_RIGHT).alias(STATUS), F.lit("").alias(DIFF_COLUMNS)]


def compare_summary(left: DataFrame, right: DataFrame, keys: str | Sequence[str], **options) -> DataFrame:
    """Rows per status; matching rows count even where the comparison hides them."""
    options["include_matched"] = True
    out = table_compare(left, right, keys, **options)
    return out.groupBy(STATUS).agg(F.count(F.lit(1)).alias("n"))


def right_duplicates(right: DataFrame, keys: str | Sequence[str]) -> DataFrame:
    """How many right rows are ignored because an earlier row has their key."""
    names = [resolve(right, k) for k in split_names(keys)]
    per_key = right.groupBy(*[F.col(quoted(k)) for k in names]).agg(F.count(F.lit(1)).alias("n"))
    return per_key.agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("bigint").alias("duplicates"))
