"""Event analysis: interval to the previous event, events to columns, overlaps."""

from __future__ import annotations

from collections.abc import Mapping, Sequence
from functools import reduce

from pyspark.sql import DataFrame, functions as F

from rowloom.functions.values import quoted, resolve
from rowloom.operators.keyed import columns_of, own_names
from rowloom.operators.ordered import with_previous
from rowloom.operators.project import calculate
from rowloom.operators.route import FAIL, PASS, filter_rows, predicate

PREFIX = "PREVIOUS_"


def previous_event(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: Sequence[str],
    prefix: str = PREFIX,
    keep_first: bool = False,
    group_rows: int | None = None,
) -> DataFrame:
    """Each row with ``columns`` of the row before it in its group.

    This is the join of row number k with row number k-1, in one scan and one
    shuffle.  The first row of a group has no partner and is dropped unless
    ``keep_first``.
    """
    names = {c: prefix + c for c in own_names(df, columns, "column")}
    marked = df.withColumn("__here", F.lit(True))
    out = with_previous(marked, keys, order_by, {**names, "__here": "__before"}, group_rows)
    if not keep_first:
        out = out.where(F.col("__before"))
    return out.drop("__here", "__before")


def event_intervals(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order_by: Sequence[str] = (),
    output: str = "INTERVAL_MIN",
    group_rows: int | None = None,
) -> DataFrame:
    """Minutes from the previous row's ``end`` to this row's ``start``."""
    out = previous_event(df, keys, order_by or [end], [end], group_rows=group_rows)
    return calculate(out, "dateDiffMinutes", start, PREFIX + resolve(df, end), output)


def event_pivot(
    df: DataFrame,
    keys: Sequence[str],
    event: str,
    values: Mapping[object, Mapping[str, str]],
    order_by: str,
    complete: bool = True,
) -> DataFrame:
    """One row per key with columns taken from the rows of several events.

    ``values`` maps an event to ``{column: output name}``; of several rows of one
    event the latest by ``order_by`` is used.  One aggregation replaces the
    self-join of one filtered copy per event.  ``complete`` keeps only keys that
    have every event, as the inner join does.
    """
    keys = own_names(df, keys, "key")
    moment = resolve(df, order_by)
    what, when = F.col(quoted(resolve(df, event))), F.col(quoted(moment))
    picks, present, columns = [], [], []
    for i, (value, names) in enumerate(values.items()):
        here = what == value
        latest = F.max(F.when(here, when))
        picks.append(latest.alias(f"__m{i}"))
        present.append(F.col(f"__m{i}").isNotNull())
        own = {resolve(df, c): out for c, out in names.items()}
        columns += [F.col(f"__m{i}").alias(out) for c, out in own.items() if c == moment]
        others = {c: out for c, out in own.items() if c != moment}
        # The latest moment itself is a plain maximum; a single further column
        # still aggregates in hash tables; several must come from one row.
        if len(others) == 1:
            ((c, out),) = others.items()
            picks.append(F.max_by(F.when(here, F.col(quoted(c))), F.when(here, when)).alias(f"__v{i}"))
            columns.append(F.col(f"__v{i}").alias(out))
        elif others:
            row = F.struct(*[F.col(quoted(c)).alias(out) for c, out in others.items()])
            picks.append(F.max_by(F.when(here, row), F.when(here, when)).alias(f"__v{i}"))
            columns += [F.col(f"__v{i}.{quoted(out)}").alias(out) for out in others.values()]
    out = df.where(what.isin(list(values))).groupBy(*columns_of(keys)).agg(*picks)
    if complete:
        out = out.where(reduce(lambda a, b: a & b, present))
    return out.select(*columns_of(keys), *columns)


def overlap_split(
    df: DataFrame,
    keys: Sequence[str],
    start: str,
    end: str,
    order_by: Sequence[str] = (),
    output: str = "INTERVAL_MIN",
    group_rows: int | None = None,
) -> dict[str, DataFrame]:
    """Rows that begin before the previous row of the group has ended and end
    after it, with the minutes between the two ends; all others on ``fail``."""
    chained = previous_event(df, keys, order_by or [end], [end], group_rows=group_rows)
    before = PREFIX + resolve(df, end)
    begins, ends = (predicate(chained, c, op, right=before) for c, op in ((start, "lessThan"), (end, "greaterThan")))
    overlaps = F.coalesce(begins & ends, F.lit(False))
    return {
        PASS: calculate(chained.where(overlaps), "dateDiffMinutes", end, before, output),
        FAIL: chained.where(~overlaps),
    }


def within_period(df: DataFrame, moment: str, start: str, end: str) -> DataFrame:
    """Rows with ``start < moment <= end``, the bounds being columns or not."""
    after = filter_rows(df, moment, "greaterThan", right=start)
    return filter_rows(after, moment, "lessOrEqual", right=end)
