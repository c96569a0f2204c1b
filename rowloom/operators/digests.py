"""Table comparison by digests: only rows of buckets that differ are joined.

Rows are dealt over buckets by a hash of their keys.  A bucket's digest is a count and
sums of row hashes, taken with opposite signs on the two sides, so its order does not
matter and both sides meet in one aggregation, of which each task sends a few numbers for
a bucket.  Buckets form a tree of two levels: ``COARSE`` ones, and those that differ are
divided into leaves of about ``LEAF_ROWS`` rows.  Rows of leaves that differ go through the
ordinary comparison; where tables are nearly the same, these are few.

Equal digests mean equal rows up to a chance of one in 2**64 for a bucket, as two
independent hashes are summed.  Values that are equal only by a rule (case, blanks, close
doubles) have different hashes; they cost work, not correctness.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import Field, as_text, common_type, field, null_field, resolve, to_type
from rowloom.operators.compare import compare_columns, table_compare
from rowloom.operators.join import check_columns, split_names
from rowloom.operators.keyed import COPIES, columns_of, one_per_key, require_order

COARSE = 4_096
LEAF_ROWS = 8
_COARSE, _LEAF = "__coarse", "__leaf"
_HASHED = ("string", "boolean", "tinyint", "smallint", "int", "bigint", "float", "double", "date", "timestamp", "timestamp_ntz", "binary")


def _shared_key(left: Field | None, right: Field | None) -> Column:
    left, right = left or null_field(), right or null_field()
    return to_type(left, common_type(left.type, right.type))


def _value(mine: Field | None, other: Field | None) -> Column:
    """What is hashed of a compared cell: equal only where the cells are."""
    mine, other = mine or null_field(), other or null_field()
    kind = mine.type.simpleString()
    if mine.type == other.type and (kind in _HASHED or kind.startswith("decimal")):
        return mine.col
    return as_text(mine)


def _hashes(df: DataFrame, other: DataFrame, keys: list[str], compared: list[str], side: str, nulls_equal: bool) -> tuple[Column, Column, Column]:
    """A hash of the keys, and two of the row.  Rows with a value that may not equal itself
    get hashes of their side."""
    shared = [_shared_key(field(df, k), field(other, k)) for k in keys]
    cells = []
    own = F.lit(False)
    for c in compared:
        mine = field(df, c)
        cells.append(_value(mine, field(other, c)))
        if not nulls_equal:
            own = own | (F.lit(True) if mine is None else mine.col.isNull())
        if mine is not None and mine.floating:
            own = own | F.coalesce(F.isnan(mine.col), F.lit(False))
    # nulls leave a hash as it is, so their places are hashed as well
    places = [F.concat_ws("", *[x.isNull().cast("int").cast("string") for x in [*shared, *cells]]), F.when(own, F.lit(side)).otherwise(F.lit(""))]
    return F.xxhash64(F.lit(1), *shared), F.xxhash64(F.lit(2), *shared, *cells, *places), F.xxhash64(F.lit(3), *places, *cells, *shared)


def _differing(left: DataFrame, right: DataFrame, parts: Sequence[str]) -> DataFrame:
    """The parts whose digests differ, with ``n``, the rows of both sides."""
    def signed(df: DataFrame, sign: int) -> DataFrame:
        halves = [x for h in ("__h1", "__h2") for x in (F.col(h).bitwiseAND(F.lit(0xFFFFFFFF)), F.shiftrightunsigned(h, 32))]
        return df.select(*columns_of(parts), F.lit(sign).cast("long").alias("s"), *[(x * F.lit(sign)).alias(f"d{i}") for i, x in enumerate(halves)])

    sums = [F.sum(c).alias(c) for c in ("s", "d0", "d1", "d2", "d3")]
    digests = signed(left, 1).union(signed(right, -1)).groupBy(*columns_of(parts)).agg(F.count(F.lit(1)).alias("n"), *sums)
    return digests.where("s <> 0 OR d0 <> 0 OR d1 <> 0 OR d2 <> 0 OR d3 <> 0").select(*columns_of(parts), "n")


def differing_rows(
    left: DataFrame, right: DataFrame, keys: Sequence[str], compared: Sequence[str], nulls_equal: bool = True, coarse: int = COARSE, leaf_rows: int = LEAF_ROWS
) -> tuple[DataFrame, DataFrame]:
    """The rows of both sides that are in leaves with different digests.  ``right`` has one
    row for each key."""
    def marked(df: DataFrame, other: DataFrame, side: str) -> DataFrame:
        key, one, two = _hashes(df, other, list(keys), list(compared), side, nulls_equal)
        return df.withColumns({"__key": key, "__h1": one, "__h2": two}).withColumn(_COARSE, F.pmod("__key", F.lit(coarse)))

    l, r = marked(left, right, "l"), marked(right, left, "r")
    # at most ``coarse`` rows, whatever the tables hold
    some = F.broadcast(_differing(l, r, [_COARSE]).select(_COARSE, F.ceil(F.col("n") / (2 * leaf_rows)).alias("__leaves")))
    leaf = F.pmod(F.xxhash64("__key"), "__leaves").alias(_LEAF)
    parts = [_COARSE, _LEAF]
    within = [df.join(some, _COARSE).select(*columns_of([*df.columns]), leaf) for df in (l, r)]
    leaves = _differing(*within, parts).select(*columns_of(parts))
    return tuple(x.join(leaves, parts, "left_semi").select(*columns_of(df.columns)) for x, df in zip(within, (left, right)))


def digest_compare(
    left: DataFrame,
    right: DataFrame,
    keys: str | Sequence[str],
    columns: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    ignore_case: bool = False,
    trim: bool = False,
    nulls_equal: bool = True,
    coarse: int = COARSE,
    leaf_rows: int = LEAF_ROWS,
) -> DataFrame:
    """The rows of ``table_compare`` without matches.

    A leaf whose digests are equal holds the same rows on both sides, each key once, so
    all of them match.  Of several right rows with one key the first counts.
    """
    names = split_names(keys)
    if not names:
        raise ValueError("digest_compare needs at least one key column")
    check_columns(left)
    check_columns(right)
    order = split_names(order_by)
    require_order(order, assume_unique, "digest_compare")
    right_keys = [resolve(right, k) for k in names if resolve(right, k)]
    once = right if assume_unique or not right_keys else one_per_key(right, right_keys, order, last=False).drop(COPIES).select(*columns_of(right.columns))
    compared = compare_columns(left, right, names, columns)
    some = differing_rows(left, once, names, compared, nulls_equal, coarse, leaf_rows)
    return table_compare(*some, names, compared, assume_unique=True, ignore_case=ignore_case, trim=trim, nulls_equal=nulls_equal)
