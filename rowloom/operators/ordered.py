"""Operators that need the order of rows within a group: previous row, next row,
running count, and a global row number.

A window hands each group to one task.  Where one group may hold a large share of
all rows, ``group_rows`` cuts it along its order into cells: the window runs on
(group, cell), and only the rows at the cell edges look across, through a table
with one row per cell of a hot group.  Every hot group is cut at its own quantiles,
so groups that follow one another in the order are cut as well as groups that
overlap.  A value of the first order column that by itself fills more than a cell
gets a cell of its own, which the next order column cuts further.

Looking for hot groups runs jobs while the plan is built, so it is done only when
``group_rows`` is given.
"""

from __future__ import annotations

from collections.abc import Sequence
from functools import reduce
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, Window, functions as F

from rowloom.functions.values import quoted
from rowloom.operators.keyed import columns_of, own_names
from rowloom.operators.skew import hot_hashes, sampled
from rowloom.sources.scratch import ensure_checkpoint_dir

_HASH, _CUTS = "__hash", "__cuts"
_PER_CUT = 200


class Cut(NamedTuple):
    """Rows with their cells; ``cells`` are the columns that number them in order,
    and ``is_hot`` marks the rows of the groups that are cut."""

    rows: DataFrame
    cells: list[str]
    is_hot: Column

    @property
    def hot(self) -> DataFrame:
        return self.rows.where(self.is_hot)


def _quantiles(sample: DataFrame, parts: Sequence[str], rows_per_row: float, limit: int) -> DataFrame:
    """Cut points of each part (a hot group, or a value of one) that still has more than
    ``limit`` rows: its own quantiles in the sample, repeated where one value fills
    several cells."""
    size = F.col("__n") * F.lit(rows_per_row)
    pieces = F.ceil(size / F.lit(float(limit))).cast("int")
    known = F.sort_array(F.collect_list("__p"))
    per = sample.groupBy(*columns_of(parts)).agg(F.count(F.lit(1)).alias("__n"), known.alias("__s"))
    place = lambda i: F.greatest(F.lit(1), F.ceil(i * F.size("__s") / pieces).cast("int"))
    cuts = F.when(F.size("__s") == 0, F.slice("__s", 1, 0)).otherwise(
        F.transform(F.sequence(F.lit(1), pieces - 1), lambda i: F.element_at("__s", place(i)))
    )
    return per.where(pieces > 1).select(*columns_of(parts), cuts.alias(_CUTS))


def _cut(df: DataFrame, keys: Sequence[str], order_by: Sequence[str], group_rows: int | None) -> Cut | None:
    """``df`` cut into cells, or None when no group is hot.

    The sample is kept while the cut points are taken from it; these are fixed
    values once found, so every use of the cells agrees, also when lost tasks are
    run again.
    """
    hot = hot_hashes(df, columns_of(keys), group_rows) if order_by else None
    if hot is None:
        return None
    spark, pieces = df.sparkSession, hot.pieces()
    rate = min(1.0, _PER_CUT * sum(pieces.values()) / hot.rows)
    listed = spark.createDataFrame([(h,) for h in pieces], f"{_HASH} bigint")
    hashed = df.withColumn(_HASH, F.xxhash64(*columns_of(keys)))
    narrow = hashed.join(F.broadcast(listed), _HASH, "left_semi").select(_HASH, *columns_of(order_by))
    sample = sampled(narrow, rate).persist()
    rows = hashed
    cells: list[str] = []
    try:
        for i, name in enumerate(order_by):
            parts, cell = [_HASH, *cells], f"__cell{i}"
            # only cells of one value (or of none) may be cut by the next column
            single = sample.where(F.col(cells[-1]) % 2 == 1) if cells else sample
            found = _quantiles(single.withColumn("__p", F.col(quoted(name))), parts, 1 / rate, hot.limit)
            points = found.collect()
            if not points:
                break
            table = F.broadcast(spark.createDataFrame(points, found.schema))
            numbered = _cell_number(F.col(quoted(name)), max(len(r[_CUTS]) for r in points)).alias(cell)
            rows = rows.join(table, parts, "left").select(*columns_of(rows.columns), numbered)
            sample = sample.join(table, parts, "left").select(*columns_of(sample.columns), numbered)
            cells.append(cell)
    finally:
        sample.unpersist()
    if not cells:
        return None
    return Cut(rows, cells, F.col(cells[0]) != 0)


def _cell_number(p: Column, most: int) -> Column:
    """The cell of a value among its part's cut points, at most ``most``: even between two
    points, odd for a value that fills a cell of its own, and for no value; 0 where nothing
    is cut.  Points are in order, so they are searched by halves."""
    steps = F.array(*[F.lit(1 << k) for k in reversed(range(max(1, most.bit_length())))])
    further = lambda at, step: F.when(F.get(_CUTS, at + step - 1) < p, at + step).otherwise(at)
    below = F.aggregate(steps, F.lit(0), further)
    found = F.struct(below.alias("below"))
    repeated = lambda x: F.coalesce((F.get(_CUTS, x["below"]) == p) & (F.get(_CUTS, x["below"] + 1) == p), F.lit(False))
    number = F.element_at(F.transform(F.array(found), lambda x: 2 + 2 * x["below"] + repeated(x).cast("int")), 1)
    return F.when(F.col(_CUTS).isNull(), F.lit(0)).when(p.isNull(), F.lit(1)).otherwise(number).cast("bigint")


def _edge_join(rows: DataFrame, edges: DataFrame, names: Sequence[str]) -> DataFrame:
    """Join the per-cell table to the rows; Spark broadcasts it where it is small."""
    a, b = columns_of(names, "a"), columns_of(names, "b")
    on = reduce(lambda x, y: x & y, [m.eqNullSafe(n) for m, n in zip(a, b)])
    return rows.alias("a").join(edges.alias("b"), on, "left")


def _neighbour(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: dict[str, str],
    back: bool,
    group_rows: int | None,
) -> DataFrame:
    keys = own_names(df, keys, "key")
    order_by = own_names(df, order_by, "order column")
    sources = own_names(df, list(columns), "column")
    names = list(columns.values())
    shift = F.lag if back else F.lead
    order = columns_of(order_by)
    cut = _cut(df, keys, order_by, group_rows)
    if cut is None:
        w = Window.partitionBy(*columns_of(keys)).orderBy(*order)
        return df.withColumns({n: shift(F.col(quoted(s))).over(w) for s, n in zip(sources, names)})

    parts = [*keys, *cut.cells]
    w = Window.partitionBy(*columns_of(parts)).orderBy(*order)
    row = F.struct(*[F.col(quoted(s)).alias(f"v{i}") for i, s in enumerate(sources)])
    pick = F.max_by if back else F.min_by
    ends = cut.hot.groupBy(*columns_of(parts)).agg(pick(row, F.struct(*order)).alias("__end"))
    across = Window.partitionBy(*columns_of(keys)).orderBy(*cut.cells)
    edges = ends.select(*columns_of(parts), shift("__end").over(across).alias("__edge"))
    inside = cut.rows.withColumn("__near", shift(row).over(w))
    joined = _edge_join(inside, edges, parts)
    found = F.coalesce(F.col("a.__near"), F.col("b.__edge"))
    return joined.select(
        *columns_of(df.columns, "a"), *[found[f"v{i}"].alias(n) for i, n in enumerate(names)]
    )


def with_previous(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: dict[str, str],
    group_rows: int | None = None,
) -> DataFrame:
    """Add ``columns`` (source -> new name) of the row before, within each group.

    The order is ascending and should be total.  Groups with more than
    ``group_rows`` rows are cut; None plans the plain window.
    """
    return _neighbour(df, keys, order_by, columns, True, group_rows)


def with_next(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    columns: dict[str, str],
    group_rows: int | None = None,
) -> DataFrame:
    """Like ``with_previous``, for the row after."""
    return _neighbour(df, keys, order_by, columns, False, group_rows)


def with_running_count(
    df: DataFrame,
    keys: Sequence[str],
    order_by: Sequence[str],
    name: str,
    condition: Column | None = None,
    group_rows: int | None = None,
) -> DataFrame:
    """Add the number of rows so far (this one included) that meet ``condition``."""
    keys = own_names(df, keys, "key")
    order_by = own_names(df, order_by, "order column")
    counted = F.lit(1) if condition is None else F.when(condition, 1)
    cut = _cut(df, keys, order_by, group_rows)
    parts = keys if cut is None else [*keys, *cut.cells]
    upto = Window.partitionBy(*columns_of(parts)).orderBy(*columns_of(order_by))
    running = F.count(counted).over(upto.rowsBetween(Window.unboundedPreceding, 0))
    if cut is None:
        return df.withColumn(name, running)
    sizes = cut.hot.groupBy(*columns_of(parts)).agg(F.count(counted).alias("__n"))
    before = Window.partitionBy(*columns_of(keys)).orderBy(*cut.cells).rowsBetween(Window.unboundedPreceding, -1)
    edges = sizes.select(*columns_of(parts), F.sum("__n").over(before).alias("__before"))
    joined = _edge_join(cut.rows.withColumn("__n", running), edges, parts)
    count = F.col("a.__n") + F.coalesce(F.col("b.__before"), F.lit(0))
    return joined.select(*columns_of(df.columns, "a"), count.alias(name))


def global_row_number(df: DataFrame, order_by: Sequence[str], name: str = "ROWNUM") -> DataFrame:
    """Number all rows in a global order without gathering them in one task.

    A distributed sort fixes the order; each row's id holds its partition and its
    place in it, and the partition sizes (one row per partition) turn that into a
    number.  The sorted rows are checkpointed, so that the sizes and the rows
    agree even if a task is lost and run again.
    """
    order_by = own_names(df, order_by, "order column")
    ensure_checkpoint_dir(df.sparkSession)
    ids = df.orderBy(*columns_of(order_by)).withColumn("__id", F.monotonically_increasing_id())
    fixed = ids.checkpoint()
    part = F.shiftright("__id", 33).cast("int")
    sizes = fixed.groupBy(part.alias("__part")).agg(F.count(F.lit(1)).alias("__n"))
    before = Window.orderBy("__part").rowsBetween(Window.unboundedPreceding, -1)
    starts = sizes.select("__part", F.coalesce(F.sum("__n").over(before), F.lit(0)).alias("__start"))
    placed = fixed.withColumn("__part", part).join(F.broadcast(starts), "__part")
    local = F.col("__id").bitwiseAND(F.lit((1 << 33) - 1))
    return placed.select(*columns_of(df.columns), (F.col("__start") + local + 1).cast("bigint").alias(name))
