"""Keyed changes and statements in an external database.

Spark's JDBC writer only appends.  Here each partition opens one connection (any
DB-API module) and sends batches.  The source is reduced to one row per key
first, so rows are independent: no order between partitions matters and a task
that runs again writes the same values.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator, Sequence
from dataclasses import dataclass
from itertools import islice

from pyspark import Accumulator
from pyspark.sql import DataFrame, Row, SparkSession, functions as F

from rowloom.functions.values import resolve
from rowloom.operators.join import split_names
from rowloom.operators.keyed import COPIES, all_present, columns_of, one_per_key, own_names, require_order
from rowloom.sources.jdbc import MARKS

# How each database quotes names and merges.
QUOTES = {
    "oracle": ("", ""),
    "mysql": ("`", "`"),
    "mariadb": ("`", "`"),
    "postgresql": ('"', '"'),
    "sqlserver": ("[", "]"),
    "sqlite": ('"', '"'),
}
MERGE_STYLE = {
    "oracle": "merge",
    "mysql": "duplicate",
    "mariadb": "duplicate",
    "postgresql": "conflict",
    "sqlserver": "merge",
    "sqlite": "conflict",
}


@dataclass(frozen=True)
class Statements:
    """The parameterised statements of one database kind."""

    kind: str

    def name(self, ident: str) -> str:
        opening, closing = QUOTES[self.kind]
        return f"{opening}{ident}{closing}"

    def _names(self, columns: Sequence[str], prefix: str = "") -> str:
        return ", ".join(prefix + self.name(c) for c in columns)

    def marks(self, count: int, start: int = 1) -> list[str]:
        return [MARKS[self.kind].format(n=i) for i in range(start, start + count)]

    def insert(self, table: str, columns: Sequence[str]) -> str:
        return f"INSERT INTO {self.name(table)} ({self._names(columns)}) VALUES ({', '.join(self.marks(len(columns)))})"

    def _matches(self, keys: Sequence[str], start: int) -> str:
        return " AND ".join(f"{self.name(k)} = {m}" for k, m in zip(keys, self.marks(len(keys), start)))

    def update(self, table: str, keys: Sequence[str], updates: Sequence[str]) -> str:
        """Parameters: update values, then key values."""
        values = ", ".join(f"{self.name(u)} = {m}" for u, m in zip(updates, self.marks(len(updates))))
        return f"UPDATE {self.name(table)} SET {values} WHERE {self._matches(keys, len(updates) + 1)}"

    def delete(self, table: str, keys: Sequence[str]) -> str:
        return f"DELETE FROM {self.name(table)} WHERE {self._matches(keys, 1)}"

    def upsert(self, table: str, columns: Sequence[str], keys: Sequence[str], updates: Sequence[str]) -> str:
        style = MERGE_STYLE[self.kind]
        if style == "merge":
            return self._merge(table, columns, keys, updates)
        base = self.insert(table, columns)
        if style == "conflict":
            action = "NOTHING"
            if updates:
                action = "UPDATE SET " + ", ".join(f"{self.name(u)} = excluded.{self.name(u)}" for u in updates)
            return f"{base} ON CONFLICT ({self._names(keys)}) DO {action}"
        # This kind uses the table's own unique key.  Setting a key to itself
        # leaves a known row as it is.
        targets = [(u, f"VALUES({self.name(u)})") for u in updates] or [(keys[0], self.name(keys[0]))]
        return f"{base} ON DUPLICATE KEY UPDATE " + ", ".join(f"{self.name(c)} = {v}" for c, v in targets)

    def _merge(self, table: str, columns: Sequence[str], keys: Sequence[str], updates: Sequence[str]) -> str:
        oracle = self.kind == "oracle"
        row = ", ".join(f"{m} AS {self.name(c)}" for c, m in zip(columns, self.marks(len(columns))))
        source = f"(SELECT {row}{' FROM DUAL' if oracle else ''})"
        alias = " " if oracle else " AS "
        on = " AND ".join(f"t.{self.name(k)} = s.{self.name(k)}" for k in keys)
        parts = [f"MERGE INTO {self.name(table)}{alias}t USING {source}{alias}s ON ({on})"]
        if updates:
            changes = ", ".join(f"t.{self.name(u)} = s.{self.name(u)}" for u in updates)
            parts.append(f"WHEN MATCHED THEN UPDATE SET {changes}")
        parts.append(
            f"WHEN NOT MATCHED THEN INSERT ({self._names(columns)}) VALUES ({self._names(columns, 's.')})"
        )
        return " ".join(parts) + ("" if oracle else ";")


CONNECTIONS = 16
"""Connections that one write opens at once, whatever the number of executors."""


class Sent:
    """Rows that a write has sent and rows that the database says it changed, counted in
    the write itself; ``affected`` is None where the driver doesn't tell."""

    def __init__(self, spark: SparkSession) -> None:
        new = spark.sparkContext.accumulator
        self.rows: Accumulator = new(0)
        self.changed: Accumulator = new(0)
        self.untold: Accumulator = new(0)
        self.done = False

    def counts(self) -> dict[str, int | None] | None:
        if not self.done:
            return None
        return {"sent": self.rows.value, "affected": None if self.untold.value else self.changed.value}


def send(
    df: DataFrame,
    connect: Callable[[], object],
    statement: str,
    columns: Sequence[str],
    commit_size: int = 100,
    connections: int = CONNECTIONS,
    in_order: bool = False,
    sent: Sent | None = None,
) -> None:
    """Run ``statement`` once per row, in batches, over ``connections`` partitions with a
    connection each; ``in_order`` keeps the rows of a partition together.

    ``connect`` is called inside the tasks.  Tasks may run again after a loss, so
    the statement must be idempotent.  ``sent`` counts the rows of finished tasks.
    """
    names = list(columns)
    tell = None if sent is None else (sent.rows, sent.changed, sent.untold)

    def run(rows: Iterator[Row]) -> None:
        pending = ([row[n] for n in names] for row in rows)
        batch = list(islice(pending, commit_size))
        if not batch:
            return
        connection = connect()
        try:
            cursor = connection.cursor()
            while batch:
                cursor.executemany(statement, batch)
                connection.commit()
                if tell is not None:
                    affected = getattr(cursor, "rowcount", -1)
                    tell[0].add(len(batch))
                    tell[1 if affected >= 0 else 2].add(affected if affected >= 0 else 1)
                batch = list(islice(pending, commit_size))
        except Exception:
            connection.rollback()
            raise
        finally:
            connection.close()

    rows = df.select(*columns_of(list(dict.fromkeys(names))))
    (rows.rdd.coalesce(connections) if in_order else rows.repartition(connections)).foreachPartition(run)
    if sent is not None:
        sent.done = True


def _keys(df: DataFrame, keys: str | Sequence[str]) -> list[str]:
    names = own_names(df, split_names(keys), "key")
    if not names:
        raise ValueError("a change of an external table needs at least one key column")
    return names


def _reduced(
    df: DataFrame, keys: Sequence[str], columns: Sequence[str], order_by, assume_unique: bool
) -> DataFrame:
    order = own_names(df, split_names(order_by), "order column")
    require_order(order, assume_unique, "external merge")
    if assume_unique:
        return df.select(*columns_of(columns))
    present = df.where(all_present(keys))
    loose = df.where(~all_present(keys)).select(*columns_of(columns))
    return one_per_key(present, keys, order, last=True, keep=columns).drop(COPIES).select(*columns_of(columns)).union(loose)


def upsert_external(
    df: DataFrame,
    connect: Callable[[], object],
    kind: str,
    table: str,
    keys: str | Sequence[str],
    update_fields: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    commit_size: int = 100,
    sent: Sent | None = None,
) -> DataFrame:
    names = _keys(df, keys)
    low = {k.lower() for k in names}
    chosen = split_names(update_fields)
    updates = [c for c in df.columns if c.lower() not in low and (not chosen or c.lower() in {u.lower() for u in chosen})]
    columns = [*names, *updates]
    rows = _reduced(df, names, columns, order_by, assume_unique)
    send(rows, connect, Statements(kind).upsert(table, columns, names, updates), columns, commit_size, sent=sent)
    return df


def update_external(
    df: DataFrame,
    connect: Callable[[], object],
    kind: str,
    table: str,
    keys: str | Sequence[str],
    update_fields: str | Sequence[str] = (),
    order_by: str | Sequence[str] = (),
    assume_unique: bool = False,
    commit_size: int = 100,
    sent: Sent | None = None,
) -> DataFrame:
    """An update field the source lacks is set to NULL."""
    names = _keys(df, keys)
    low = {k.lower() for k in names}
    updates = split_names(update_fields) or [c for c in df.columns if c.lower() not in low]
    lacking = {u: F.lit(None).cast("string") for u in updates if resolve(df, u) is None}
    full = df.withColumns(lacking) if lacking else df
    updates = own_names(full, updates, "column")
    rows = _reduced(full, names, [*names, *[u for u in updates if u not in names]], order_by, assume_unique)
    send(rows, connect, Statements(kind).update(table, names, updates), [*updates, *names], commit_size, sent=sent)
    return df


def delete_external(
    df: DataFrame, connect: Callable[[], object], kind: str, table: str, keys: str | Sequence[str], commit_size: int = 100, sent: Sent | None = None
) -> DataFrame:
    names = _keys(df, keys)
    gone = df.select(*columns_of(names)).where(all_present(names)).distinct()
    send(gone, connect, Statements(kind).delete(table, names), names, commit_size, sent=sent)
    return df


def exec_each_row(
    df: DataFrame, connect: Callable[[], object], statement: str, commit_size: int = 100, sent: Sent | None = None
) -> DataFrame:
    """Run a statement for every row, values bound by column order."""
    send(df, connect, statement, df.columns, commit_size, in_order=True, sent=sent)
    return df
