"""Calculated columns: arithmetic, minutes between two moments, concat, constant."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import (
    Field,
    as_text,
    field,
    literal_number,
    micros_between,
    moment,
    null_field,
    number_or_zero,
)


def add(a: Field, b: Field) -> Column:
    return number_or_zero(a) + number_or_zero(b)


def subtract(a: Field, b: Field) -> Column:
    return number_or_zero(a) - number_or_zero(b)


def multiply(a: Field, b: Field) -> Column:
    return number_or_zero(a) * number_or_zero(b)


def divide(a: Field, b: Field) -> Column:
    """NULL for a zero divisor."""
    return F.try_divide(number_or_zero(a), number_or_zero(b))


def minutes_between(a: Field, b: Field) -> Column:
    """``a - b`` in minutes, two digits, half to even; numbers count as days."""
    if a.moment and b.moment:
        return F.bround(micros_between(moment(a), moment(b)) / F.lit(60_000_000.0), 2)
    return F.bround((number_or_zero(a) - number_or_zero(b)) * F.lit(24.0) * F.lit(60.0), 2)


def concat(a: Field, b: Field) -> Column:
    return F.concat(F.coalesce(as_text(a), F.lit("")), F.coalesce(as_text(b), F.lit("")))


def constant(text: str) -> Column:
    """A number where the text reads as one, otherwise the text itself."""
    amount = literal_number(text)
    return F.lit(text) if amount is None else F.lit(amount)


EXPRESSIONS = {
    "add": add,
    "subtract": subtract,
    "multiply": multiply,
    "divide": divide,
    "dateDiffMinutes": minutes_between,
    "concat": concat,
}


def expression(df: DataFrame, kind: str, field1: str = "", field2: str = "", value: str = "0") -> Column:
    """The named calculation over two columns of ``df`` (absent ones are NULL)."""
    if kind == "constant":
        return constant(value)
    if kind not in EXPRESSIONS:
        raise ValueError(f"unknown calculation {kind!r}; known: {sorted([*EXPRESSIONS, 'constant'])}")
    a, b = field(df, field1) or null_field(), field(df, field2) or null_field()
    return EXPRESSIONS[kind](a, b)
