"""How a value is read as a number, a moment, a flag or text.

Columns have one type each, so every rule here is chosen from the column's type
when the plan is built; only text columns are examined row by row.  All
expressions are built-in Spark functions and stay inside code generation.
"""

from __future__ import annotations

import re
from datetime import datetime
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F, types as T

# The texts accepted as numbers and as moments, and the text form
# of a moment.
NUMBER_PATTERN = r"^[+-]?([0-9][0-9,]*(\.[0-9]*)?|\.[0-9]+)([eE][+-]?[0-9]+)?$"
MOMENT_PATTERN = (
    r"^[0-9]{4}[/-][0-9]{1,2}[/-][0-9]{1,2}"
    r"([ T][0-9]{1,2}:[0-9]{2}(:[0-9]{2}(\.[0-9]{1,6})?)?)?$"
)
MOMENT_TEXT_FORMAT = "yyyy/MM/dd HH:mm:ss"

DECIMAL = T.DecimalType(38, 18)
_INTEGRAL = (T.ByteType, T.ShortType, T.IntegerType, T.LongType)
_FLOATING = (T.FloatType, T.DoubleType)
_MOMENT = (T.TimestampType, T.TimestampNTZType, T.DateType)


class Field(NamedTuple):
    """A column expression together with its type."""

    col: Column
    type: T.DataType

    @property
    def integral(self) -> bool:
        return isinstance(self.type, _INTEGRAL)

    @property
    def floating(self) -> bool:
        return isinstance(self.type, _FLOATING)

    @property
    def numeric(self) -> bool:
        return isinstance(self.type, T.NumericType)

    @property
    def moment(self) -> bool:
        return isinstance(self.type, _MOMENT)

    @property
    def text(self) -> bool:
        return isinstance(self.type, (T.StringType, T.CharType, T.VarcharType))


def resolve(df: DataFrame, name: str) -> str | None:
    """The frame's own spelling of ``name`` (case-insensitive), or None."""
    exact = [c for c in df.columns if c == name]
    loose = [c for c in df.columns if c.lower() == name.lower()]
    return (exact or loose or [None])[0]


def quoted(name: str) -> str:
    return "`" + name.replace("`", "``") + "`"


def field(df: DataFrame, name: str, alias: str | None = None) -> Field | None:
    """The named column of ``df``, or None when the frame has no such column."""
    found = resolve(df, name)
    if found is None:
        return None
    path = quoted(found) if alias is None else f"{alias}.{quoted(found)}"
    return Field(F.col(path), df.schema[found].dataType)


def null_field() -> Field:
    return Field(F.lit(None).cast("string"), T.StringType())


def text_literal(value: str) -> Field:
    return Field(F.lit(value), T.StringType())


def as_text(f: Field) -> Column:
    """Text form of a value: ``5.0`` reads ``5``, moments use one fixed format."""
    if f.text:
        return f.col
    if isinstance(f.type, _FLOATING):
        value = f.col.cast("double")
        plain = _plain_decimal(value)
        size = F.abs(value)
        return F.when(
            (value == 0) | ((size >= 1e-4) & (size < 1e15)), plain
        ).otherwise(value.cast("string"))
    if isinstance(f.type, T.DecimalType):
        text = f.col.cast("string")
        if f.type.scale == 0:
            return text
        return F.regexp_replace(text, r"\.?0+$", "")
    if f.moment:
        return F.date_format(f.col, MOMENT_TEXT_FORMAT)
    if isinstance(f.type, T.BooleanType):
        return F.when(f.col, F.lit("True")).when(~f.col, F.lit("False"))
    return f.col.cast("string")


def _plain_decimal(value: Column) -> Column:
    return F.regexp_replace(
        value.try_cast("decimal(38,20)").cast("string"), r"\.?0+$", ""
    )


def _number_text(text: Column) -> Column:
    """The digits of a text number, or NULL when the text is not a number."""
    trimmed = F.trim(text)
    return F.when(trimmed.rlike(NUMBER_PATTERN), F.translate(trimmed, ",", ""))


def number(f: Field) -> Column:
    """The value as a double; NULL when it is not a number."""
    if f.numeric:
        return f.col.cast("double")
    if f.text:
        return _number_text(f.col).try_cast("double")
    return F.lit(None).cast("double")


def number_or_zero(f: Field) -> Column:
    return F.coalesce(number(f), F.lit(0.0))


def decimal_number(f: Field) -> Column:
    """The value as an exact decimal; NULL when it is not a number."""
    if f.numeric:
        return f.col.try_cast(DECIMAL)
    if f.text:
        return _number_text(f.col).try_cast(DECIMAL)
    return F.lit(None).cast(DECIMAL)


def moment(f: Field) -> Column:
    """The value as a zone-less timestamp; NULL when it is not a moment.

    The pattern is tested first, so the cast never sees (and never raises an
    exception for) text that is no date.
    """
    if f.moment:
        return f.col.cast("timestamp_ntz")
    if f.text:
        trimmed = F.trim(f.col)
        dashed = F.translate(trimmed, "/", "-")
        return F.when(
            trimmed.rlike(MOMENT_PATTERN), dashed.try_cast("timestamp_ntz")
        )
    return F.lit(None).cast("timestamp_ntz")


def flag(f: Field) -> Column:
    """``true``/``false`` in any case become a boolean, all else NULL."""
    if isinstance(f.type, T.BooleanType):
        return f.col
    if f.text:
        word = F.lower(F.trim(f.col))
        return F.when(word == "true", True).when(word == "false", False)
    return F.lit(None).cast("boolean")


def _whole(f: Field, target: str) -> Column:
    if f.integral:
        return f.col.try_cast(target)
    exact = decimal_number(f)
    return F.when(exact == F.floor(exact), exact).try_cast(target)


def cast_value(f: Field, type_name: str, decimal: T.DecimalType = DECIMAL) -> Field:
    """Cast to one of the named types; NULL where the value cannot be read."""
    name = (type_name or "").strip().lower()
    if name == "string":
        return Field(as_text(f), T.StringType())
    if name == "int":
        return Field(_whole(f, "int"), T.IntegerType())
    if name == "long":
        return Field(_whole(f, "bigint"), T.LongType())
    if name == "decimal":
        return Field(decimal_number(f).try_cast(decimal), decimal)
    if name == "double":
        return Field(number(f), T.DoubleType())
    if name == "datetime":
        return Field(moment(f), T.TimestampNTZType())
    if name == "bool":
        return Field(flag(f), T.BooleanType())
    return f


def micros_between(later: Column, earlier: Column) -> Column:
    """Microseconds from ``earlier`` to ``later``, both zone-less timestamps.

    Subtracting two zone-less timestamps never consults the session time zone,
    so a daylight-saving change cannot alter the result.
    """
    gap = later - earlier
    minutes = (
        F.extract(F.lit("DAY"), gap).cast("bigint") * 1440
        + F.extract(F.lit("HOUR"), gap).cast("bigint") * 60
        + F.extract(F.lit("MINUTE"), gap).cast("bigint")
    )
    seconds = F.extract(F.lit("SECOND"), gap)
    return minutes * 60_000_000 + (seconds * 1_000_000).cast("bigint")


# --- the same readings for literals, done once on the driver ---------------


def literal_number(text: str) -> float | None:
    stripped = text.strip()
    if not re.match(NUMBER_PATTERN, stripped):
        return None
    return float(stripped.replace(",", ""))


def literal_moment(text: str) -> datetime | None:
    stripped = text.strip()
    if not re.match(MOMENT_PATTERN, stripped):
        return None
    parts = [int(p) for p in re.split(r"[/\- T:.]", stripped.split(".")[0])]
    fraction = stripped.split(".")[1] if "." in stripped else ""
    try:
        at = datetime(*parts)
    except ValueError:
        return None
    return at.replace(microsecond=int(fraction.ljust(6, "0"))) if fraction else at


def common_type(left: T.DataType, right: T.DataType) -> T.DataType:
    """The narrowest type that holds both; text when there is none."""
    if left == right:
        return left
    if isinstance(left, T.NullType):
        return right
    if isinstance(right, T.NullType):
        return left
    lf, rf = Field(None, left), Field(None, right)
    if lf.numeric and rf.numeric:
        if lf.integral and rf.integral:
            return left if _INTEGRAL.index(type(left)) > _INTEGRAL.index(type(right)) else right
        if isinstance(left, _FLOATING) or isinstance(right, _FLOATING):
            return T.DoubleType()
        return _common_decimal(left, right)
    if lf.moment and rf.moment:
        return T.TimestampNTZType()
    return T.StringType()


def decimal_digits(left: T.DataType, right: T.DataType) -> tuple[int, int]:
    """Whole and fractional digits that hold both sides."""
    sizes = [(t.precision, t.scale) if isinstance(t, T.DecimalType) else (19, 0) for t in (left, right)]
    return max(p - s for p, s in sizes), max(s for _, s in sizes)


def _common_decimal(left: T.DataType, right: T.DataType) -> T.DecimalType:
    """Room for the whole digits of both sides, and for their fractions as far as 38
    digits go."""
    whole, fraction = decimal_digits(left, right)
    return T.DecimalType(38, min(fraction, 38 - whole))


def in_parts(f: Field, fraction: int) -> Column:
    """A number without rounding: its whole part and its fraction."""
    n = f.col.cast("decimal(20,0)") if f.integral else f.col
    return F.struct(F.floor(n).cast("decimal(38,0)").alias("whole"), (n % F.lit(1)).cast(T.DecimalType(38, fraction)).alias("part"))


def to_type(f: Field, target: T.DataType) -> Column:
    if f.type == target:
        return f.col
    if isinstance(target, T.StringType):
        return as_text(f)
    return f.col.cast(target)


def values_differ(a: Column, b: Column) -> Column:
    """NULL-safe inequality of two columns of one type."""
    return ~a.eqNullSafe(b)
