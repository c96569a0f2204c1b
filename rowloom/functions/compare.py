"""The comparison rule of filters and the equality rule of table comparison."""

from __future__ import annotations

from pyspark.sql import Column, functions as F, types as T

from rowloom.functions.values import (
    Field,
    as_text,
    decimal_number,
    literal_moment,
    literal_number,
    moment,
    number,
    text_literal,
)

EQUALITY = ("equals", "notEquals")
ORDER = {
    "greaterThan": lambda a, b: a > b,
    "greaterOrEqual": lambda a, b: a >= b,
    "lessThan": lambda a, b: a < b,
    "lessOrEqual": lambda a, b: a <= b,
}
NULL_TESTS = ("isNull", "isNotNull")
OPERATORS = (*EQUALITY, "contains", *ORDER, *NULL_TESTS)


def _apply(op: str, left: Column, right: Column) -> Column:
    if op == "equals":
        return left == right
    if op == "notEquals":
        return left != right
    return ORDER[op](left, right)


def _as_words(op: str, left: Column, right: Column) -> Column:
    """Plain text: equality and containment ignore case, order is binary."""
    if op == "contains":
        return F.contains(F.lower(left), F.lower(right))
    if op in EQUALITY:
        return _apply(op, F.lower(left), F.lower(right))
    return _apply(op, left, right)


def _as_moments(op: str, left: Column, right: Column) -> Column:
    return F.lit(False) if op == "contains" else _apply(op, left, right)


def compare_literal(op: str, left: Field, value: str) -> Column:
    """``left op 'value'``; the literal is read once here, so that the remaining
    predicate is simple enough to be pushed into the scan."""
    at, amount = literal_moment(value), literal_number(value)
    if left.moment:
        if at is not None:
            target = left.type if not isinstance(left.type, T.DateType) else T.TimestampNTZType()
            column = left.col if target == left.type else moment(left)
            return _as_moments(op, column, F.lit(at.isoformat(sep=" ")).cast(target))
        return _as_words(op, as_text(left), F.lit(value))
    if left.numeric:
        if amount is None or op == "contains":
            return _as_words(op, as_text(left), F.lit(value))
        if op in EQUALITY and not isinstance(left.type, T.DecimalType):
            return _equals_number_text(op, left, amount, value)
        return _apply(op, left.col, _number_literal(left, amount))
    if not left.text:
        return _as_words(op, as_text(left), F.lit(value))
    words = _as_words(op, left.col, F.lit(value))
    # A comparison with an unreadable text is NULL, which passes on to the next
    # reading; the text is parsed once only.
    if amount is not None and op in ORDER:
        return F.coalesce(_apply(op, number(left), F.lit(amount)), words)
    if at is not None and op == "contains":
        return words & moment(left).isNull()
    if at is not None:
        target = F.lit(at.isoformat(sep=" ")).cast("timestamp_ntz")
        return F.coalesce(_apply(op, moment(left), target), words)
    return words


def _number_literal(left: Field, amount: float) -> Column:
    if left.integral and abs(amount) < 2**31 and amount == int(amount):
        return F.lit(int(amount))
    return F.lit(amount)


def _equals_number_text(op: str, left: Field, amount: float, value: str) -> Column:
    """Equality is textual: ``5`` is a number's text, ``5.0`` and ``05`` are of none.
    Which of these the literal is, is known here, so the scan compares numbers."""
    if not (amount == 0 or 1e-4 <= abs(amount) < 1e15):
        return _as_words(op, as_text(left), F.lit(value))
    plain = str(int(amount)) if amount == int(amount) else repr(amount)
    if plain == value:
        return _apply(op, left.col, _number_literal(left, amount))
    return F.lit(False) if op == "equals" else left.col.isNotNull()


def compare_fields(op: str, left: Field, right: Field, textual_equality: bool = False) -> Column:
    """``left op right`` for two columns; NULL on either side gives NULL."""
    if left.numeric and right.numeric and op != "contains":
        if op in EQUALITY and textual_equality:
            return _apply(op, as_text(left), as_text(right))
        return _apply(op, left.col, right.col)
    words = _as_words(op, as_text(left), as_text(right))
    readable_as_moment = (left.moment or left.text) and (right.moment or right.text)
    readable_as_number = (left.numeric or left.text) and (right.numeric or right.text)
    if left.moment and right.moment:
        return _as_moments(op, moment(left), moment(right))
    if op == "contains":
        if not readable_as_moment:
            return words
        return words & (moment(left).isNull() | moment(right).isNull())
    readings = []
    if readable_as_moment:
        readings.append(_apply(op, moment(left), moment(right)))
    if readable_as_number and op in ORDER:
        readings.append(_apply(op, number(left), number(right)))
    return F.coalesce(*readings, words)


def values_equal(
    left: Field,
    right: Field,
    ignore_case: bool = False,
    trim: bool = False,
    nulls_equal: bool = True,
) -> Column:
    """Equality of two cells; never NULL."""
    both_null = left.col.isNull() & right.col.isNull()
    one_null = left.col.isNull() | right.col.isNull()
    same = F.coalesce(_cells_equal(left, right, ignore_case, trim), F.lit(False))
    return F.when(both_null, F.lit(nulls_equal)).when(one_null, F.lit(False)).otherwise(same)


def _cells_equal(left: Field, right: Field, ignore_case: bool, trim: bool) -> Column:
    if left.moment and right.moment:
        return moment(left) == moment(right)
    if left.numeric and right.numeric:
        if left.integral and right.integral:
            return left.col == right.col
        if not left.floating and not right.floating:
            return exactly_equal(left, right)
        return _close_doubles(left.col.cast("double"), right.col.cast("double"))
    a, b = as_text(left), as_text(right)
    words_a, words_b = (F.trim(a), F.trim(b)) if trim else (a, b)
    if ignore_case:
        words_a, words_b = F.lower(words_a), F.lower(words_b)
    words = words_a == words_b
    if not ((left.numeric or left.text) and (right.numeric or right.text)):
        return words
    # Equal texts are equal under either reading; only unequal ones are parsed.
    as_numbers = decimal_number(left) == decimal_number(right)
    return F.when(a == b, F.lit(True)).otherwise(F.coalesce(as_numbers, words))


def exactly_equal(left: Field, right: Field) -> Column:
    """Equality of integers and decimals of any width: whole parts and fractions are
    compared apart, as their common type may need more than 38 digits."""
    a, b = (f.col.cast("decimal(20,0)") if f.integral else f.col for f in (left, right))
    return (F.floor(a) == F.floor(b)) & ((a % F.lit(1)) == (b % F.lit(1)))


def _close_doubles(a: Column, b: Column) -> Column:
    """Doubles are equal when they agree in 15 significant digits."""
    digits = F.format_string("%.14e", a) == F.format_string("%.14e", b)
    far = F.abs(a - b) > F.greatest(F.abs(a), F.abs(b)) * 1e-14
    return F.when(a == b, F.lit(True)).when(far, F.lit(False)).otherwise(digits)


__all__ = [
    "OPERATORS",
    "NULL_TESTS",
    "compare_literal",
    "compare_fields",
    "values_equal",
    "text_literal",
]
