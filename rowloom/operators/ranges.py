"""Lookup of values in ranges: ``low <= value <= high``, beside equal keys.

A condition on a range alone is planned as a nested loop.  Here values and ends become
whole numbers, and every range is placed on the first level whose cells (of a power of
four) are no shorter than the range, so it lies in one or two of them.  A value is looked
up once on each level that has ranges at all (at most 33), so the join is on equal keys,
level and cell, which Spark shuffles, and splits where a cell is hot.  The condition itself
is checked on what meets.  No cell size has to be guessed, short and long ranges may be
mixed, and a range finds at most about eight times the values it holds where these are
evenly spread.  A range with an open end is on the top level, with all values; half of them
or so are its result anyway.

NULL values and NULL keys find nothing and lie in nothing, as in SQL; a NULL end is open.
NaN is read as SQL reads it: larger than any number.  A range whose end is before its start
holds nothing.  Repeated values and ranges repeat their result.  With no ranges, INNER has
no row and LEFT OUTER has every left row once.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce

from pyspark.sql import Column, DataFrame, functions as F, types as T

from rowloom.functions.values import Field, common_type, field, quoted, resolve, to_type
from rowloom.operators.join import check_columns, split_names

RANGE_JOINS = ("INNER", "LEFT OUTER")
_FAR = 1 << 60
"""Whole numbers beyond this share the cells at the edge."""
_LEVEL, _CELL, _VALUE = "__level", "__cell", "__value"


def _needed(df: DataFrame, name: str, alias: str | None = None) -> Field:
    found = field(df, name, alias)
    if found is None:
        raise ValueError(f"unknown column {name!r}; known: {df.columns}")
    return found


def _shared_type(fields: Sequence[Field]) -> T.DataType:
    shared = reduce(common_type, [f.type for f in fields])
    numeric = isinstance(shared, T.NumericType)
    if not numeric and not isinstance(shared, (T.DateType, T.TimestampType, T.TimestampNTZType)):
        raise ValueError(f"ranges are of numbers, dates or moments, not of {shared.simpleString()}")
    return shared


def _whole(value: Column, kind: T.DataType, unit: float | None) -> Column:
    """A whole number that never falls while the value rises; equal ones are told apart
    by the condition."""
    if isinstance(kind, T.DateType):
        return F.unix_date(value).cast("bigint")
    if isinstance(kind, T.TimestampNTZType):
        value = F.to_utc_timestamp(value.cast("timestamp"), F.current_timezone())
    if isinstance(kind, (T.TimestampType, T.TimestampNTZType)):
        return F.unix_micros(value)
    if isinstance(kind, T.IntegralType) and unit is None:
        return value.cast("bigint")
    if unit is None:
        unit = 10.0 ** -kind.scale if isinstance(kind, T.DecimalType) else 1.0
    scaled = value.cast("double") / F.lit(float(unit))
    return F.floor(F.least(F.greatest(scaled, F.lit(float(-_FAR))), F.lit(float(_FAR)))).cast("bigint")


def _placed(ranges: DataFrame, low: Column, high: Column) -> DataFrame:
    """Each range once for each of its one or two cells."""
    length = F.col("__to") - F.col("__from")
    bits = F.when(length == 0, 0).otherwise(F.length(F.bin(length)))
    level = F.ceil(bits / 2).cast("int")
    shift = lambda c: F.call_function("shiftright", c, F.col(_LEVEL) * 2)
    ends = ranges.withColumns({"__from": low, "__to": high}).where(F.col("__from") <= F.col("__to"))
    leveled = ends.withColumn(_LEVEL, level)
    cells = F.array_distinct(F.array(shift(F.col("__from")), shift(F.col("__to"))))
    return leveled.withColumn(_CELL, F.explode(cells)).drop("__from", "__to")


def range_join(
    left: DataFrame,
    right: DataFrame,
    value: str,
    low: str,
    high: str,
    keys: str | Sequence[str] = (),
    how: str = "INNER",
    low_open: bool = False,
    high_open: bool = False,
    unit: float | None = None,
) -> DataFrame:
    """Left rows with the right rows whose range ``low`` to ``high`` holds ``value``.

    ``keys`` must be equal too, by their names on both sides; right keys are not repeated
    in the output.  ``low_open`` and ``high_open``: the end itself is outside.  ``unit`` is
    the step that fractions are divided by for their cell (default: that of a decimal's
    last digit, 1 for floating numbers); it never changes the result.  All columns are kept,
    so others than the keys may not have one name on both sides.
    """
    if how not in RANGE_JOINS:
        raise ValueError(f"unknown range join {how!r}; known: {list(RANGE_JOINS)}")
    check_columns(left)
    check_columns(right)
    names = split_names(keys)
    right_keys = [_needed(right, k) and resolve(right, k) for k in names]
    both = {c.lower() for c in left.columns} & {c.lower() for c in right.columns if c not in right_keys}
    if both:
        raise ValueError(f"columns of both inputs: {sorted(both)}")

    kind = _shared_type([_needed(left, value), _needed(right, low), _needed(right, high)])
    is_floating = isinstance(kind, (T.FloatType, T.DoubleType))
    kind = T.DoubleType() if is_floating else kind
    from_, to = (to_type(_needed(right, c), kind) for c in (low, high))
    start, end = (_whole(c, kind, unit) for c in (from_, to))
    clip = lambda c: F.least(F.greatest(c, F.lit(-_FAR)), F.lit(_FAR))
    first = F.when(from_.isNull(), F.lit(-_FAR)).otherwise(clip(start))
    last = F.when(to.isNull(), F.lit(_FAR)).otherwise(clip(end))
    placed = _placed(right, first, last)

    used = placed.agg(F.sort_array(F.collect_set(_LEVEL))).scalar()  # at most 33 numbers
    at = clip(_whole(to_type(_needed(left, value), kind), kind, unit))
    probes = left.where(_needed(left, value).col.isNotNull()).withColumn(_VALUE, at).withColumn(_LEVEL, F.explode(used))
    probes = probes.withColumn(_CELL, F.call_function("shiftright", F.col(_VALUE), F.col(_LEVEL) * 2)).drop(_VALUE)

    l, r = probes.alias("l"), placed.alias("r")
    pairs = [(_needed(left, k, "l"), _needed(right, k, "r")) for k in names]
    types = [common_type(a.type, b.type) for a, b in pairs]
    equal = [to_type(a, t) == to_type(b, t) for (a, b), t in zip(pairs, types)]
    point, lower, upper = (to_type(_needed(df, c, a), kind) for df, c, a in ((left, value, "l"), (right, low, "r"), (right, high, "r")))
    above = point > lower if low_open else point >= lower
    below = point < upper if high_open else point <= upper
    meets = [F.col(f"l.{_LEVEL}") == F.col(f"r.{_LEVEL}"), F.col(f"l.{_CELL}") == F.col(f"r.{_CELL}")]
    holds = (lower.isNull() | above) & (upper.isNull() | below)
    found = l.join(r, reduce(lambda a, b: a & b, [*equal, *meets, holds]), "inner")
    new = [c for c in right.columns if c not in right_keys]
    mine = [F.col(f"l.{quoted(c)}").alias(c) for c in left.columns]
    out = found.select(*mine, *[F.col(f"r.{quoted(c)}").alias(c) for c in new])
    if how == "INNER":
        return out

    asked = [*[resolve(left, k) for k in names], resolve(left, value)]
    hit = out.select(*[F.col(quoted(c)).alias(f"k{i}") for i, c in enumerate(asked)]).distinct().alias("h")
    same = reduce(lambda a, b: a & b, [F.col(f"l.{quoted(c)}") == F.col(f"h.k{i}") for i, c in enumerate(asked)])
    alone = left.alias("l").join(hit, same, "left_anti").select(*left.columns)
    return out.union(alone.select("*", *[F.lit(None).cast(right.schema[c].dataType).alias(c) for c in new]))
