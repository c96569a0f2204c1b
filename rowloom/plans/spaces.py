"""Where the tables behind a connection live."""

from __future__ import annotations

from collections.abc import Callable
from dataclasses import dataclass, field as default

from pyspark.sql import DataFrame, Observation, SparkSession, functions as F

from rowloom.functions.values import resolve
from rowloom.operators import merge
from rowloom.operators.keyed import columns_of
from rowloom.plans.commit import Commit
from rowloom.sinks import external
from rowloom.sinks.tables import append_jdbc
from rowloom.sources.jdbc import JdbcConnection, Split, lookup_each_row, read_jdbc
from rowloom.sources.sqlstep import exec_sql, has_named, has_positional, parameter_row, sql_each_row, sql_input

Action = Callable[[], object]
Counts = Callable[[], "dict[str, int | None] | None"]
_KIND = "__kind"


def seen(observation: Observation) -> bool:
    """Whether a query has filled the observation; reading it before would wait."""
    inner = observation._jo
    return inner is not None and inner.future().isCompleted()


@dataclass
class Parameters:
    """The first row of each parameter input, read once: all statements that hang
    on one input see the same values."""

    seen: dict[int, tuple[DataFrame, dict]] = default(default_factory=dict)

    def of(self, sql: str, rows: DataFrame | None) -> dict | None:
        if rows is None or not (has_named(sql) or has_positional(sql)):
            return None
        if id(rows) not in self.seen:
            names, values = parameter_row(rows)
            self.seen[id(rows)] = (rows, dict(zip(names, values)))
        return self.seen[id(rows)][1]


@dataclass
class SessionSpace:
    """Views and tables of the Spark session.

    A change makes a new state of the table, which replaces its view, so later
    steps read the changed table.  ``flush`` commits the changes of tables of the
    catalog, when everything that reads them has run: all of them are staged in the
    shared folder while the tables are still as they were; then tables to which rows were
    only inserted get these, and other states replace their tables.

    ``observed`` are the same states with their changed rows counted; only ``flush`` reads
    them, so ``writes``, a function for each change, tells what was written, without a query
    of its own.
    """

    spark: SparkSession
    states: dict[str, DataFrame] = default(default_factory=dict)
    observed: dict[str, DataFrame] = default(default_factory=dict)
    writes: list[Counts] = default(default_factory=list)
    stored: dict[str, tuple[str, list[DataFrame] | None]] = default(default_factory=dict)
    parameters: Parameters = default(default_factory=Parameters)

    def query(self, sql: str, rows: DataFrame | None, each_row: bool, split: Split | None = None) -> DataFrame:
        if each_row and rows is not None:
            return sql_each_row(self.spark, sql, rows)
        return sql_input(self.spark, sql, self.parameters.of(sql, rows))

    def execute(self, sql: str, rows: DataFrame | None, each_row: bool) -> list[Action]:
        if each_row:
            raise ValueError("a statement per row needs an external database")
        return [lambda: exec_sql(self.spark, sql)]

    def _replace(self, table: str, state: DataFrame, inserted: DataFrame | None = None) -> list[Action]:
        key = table.lower()
        if key not in self.states and (name := self._catalog_name(table)):
            self.stored[key] = (name, [])
        if key in self.stored:
            name, rows = self.stored[key]
            self.stored[key] = (name, None if rows is None or inserted is None else [*rows, inserted])
        self.states[key] = state
        if "." not in table:
            state.createOrReplaceTempView(table)
        return []

    def _catalog_name(self, table: str) -> str | None:
        """The full name of a table of the catalog; a view is no table."""
        catalog = self.spark.catalog
        if not catalog.tableExists(table) or catalog.getTable(table).tableType not in ("MANAGED", "EXTERNAL"):
            return None
        return table if "." in table else f"{catalog.currentDatabase()}.{table}"

    def flush(self) -> None:
        """Write what changed, once: everything is staged before any table changes."""
        if not self.stored:
            return
        commit = Commit(self.spark)
        for key, (name, rows) in self.stored.items():
            columns = self.spark.table(name).columns
            if rows is None:
                commit.replace(name, self.observed[key].select(*columns_of(columns)))
            for some in rows or ():
                commit.append(name, some.select(*columns_of([c for c in columns if resolve(some, c)])))
        commit.run()
        for key in self.stored:
            if "." not in key:
                self.spark.catalog.dropTempView(key)
            # what was read is no longer the state
            self.states.pop(key)
            self.observed.pop(key)
        self.stored.clear()

    def _now(self, table: str, observed: bool = False) -> DataFrame:
        state = (self.observed if observed else self.states).get(table.lower())
        return self.spark.table(table) if state is None else state

    def _processed(self, rows: DataFrame) -> tuple[DataFrame, Observation]:
        """The rows, counted while they pass; a frame of its own, read by ``flush`` alone."""
        counted = Observation()
        return rows.observe(counted, F.count(F.lit(1)).alias("processed")), counted

    def _count(self, table: str, change: Callable[[DataFrame, DataFrame], DataFrame], rows: DataFrame, kinds: list[str]) -> None:
        """Applies ``change`` to the observed state; it marks changed rows in a column."""
        source, processed = self._processed(rows)
        marked, changed = change(self._now(table, True), source), Observation()
        sums = [F.count_if(F.col(_KIND) == k).alias(k) for k in kinds]
        after = marked.observe(changed, *sums).where(~F.col(_KIND).eqNullSafe(merge.DELETED)).drop(_KIND)
        self.observed[table.lower()] = after
        self.writes.append(lambda: {**processed.get, **changed.get} if seen(processed) and seen(changed) else None)

    def insert(self, table: str, rows: DataFrame, commit_size: int) -> list[Action]:
        source, processed = self._processed(rows)
        before = self._now(table, True)
        actions = self._replace(table, merge.insert_rows(self._now(table), rows), source)
        self.observed[table.lower()] = merge.insert_rows(before, source)
        tell = lambda n: {"processed": n, "inserted": n}
        self.writes.append(lambda: tell(processed.get["processed"]) if seen(processed) else None)
        return actions

    def upsert(self, table: str, rows: DataFrame, keys, updates, order_by, commit_size: int) -> list[Action]:
        keys = keys or [rows.columns[0]]
        change = lambda now, source, kind=None: merge.upsert(now, source, keys, updates, order_by, target_unique=False, kind=kind)
        self._count(table, lambda now, source: change(now, source, _KIND), rows, [merge.INSERTED, merge.UPDATED, merge.UNCHANGED])
        return self._replace(table, change(self._now(table), rows))

    def update(self, table: str, rows: DataFrame, keys, updates, order_by, commit_size: int) -> list[Action]:
        change = lambda now, source, kind=None: merge.update_matched(now, source, keys, updates, order_by, kind=kind)
        self._count(table, lambda now, source: change(now, source, _KIND), rows, [merge.UPDATED, merge.UNCHANGED])
        return self._replace(table, change(self._now(table), rows))

    def delete(self, table: str, rows: DataFrame, keys, commit_size: int) -> list[Action]:
        self._count(table, lambda now, source: merge.delete_by_key(now, source, keys, _KIND), rows, [merge.DELETED])
        return self._replace(table, merge.delete_by_key(self._now(table), rows, keys))


@dataclass
class JdbcSpace:
    """An external database: reads through JDBC; lookups per row and keyed changes
    through DB-API connections that ``connect`` opens inside the tasks."""

    spark: SparkSession
    connection: JdbcConnection
    connect: Callable[[], object] | None = None
    parameters: Parameters = default(default_factory=Parameters)
    writes: list[Counts] = default(default_factory=list)

    def _sent(self) -> external.Sent:
        sent = external.Sent(self.spark)
        self.writes.append(sent.counts)
        return sent

    def query(self, sql: str, rows: DataFrame | None, each_row: bool, split: Split | None = None) -> DataFrame:
        if each_row and rows is not None:
            # Every column NULL: the database still tells the result's columns.
            shape = read_jdbc(self.spark, self.connection, sql=sql, params=dict.fromkeys(rows.columns)).schema
            return lookup_each_row(rows, self.connect, self.connection.kind, sql, shape)
        return read_jdbc(self.spark, self.connection, sql=sql, params=self.parameters.of(sql, rows), split=split)

    def execute(self, sql: str, rows: DataFrame | None, each_row: bool) -> list[Action]:
        if each_row and rows is not None:
            sent = self._sent()
            return [lambda: external.exec_each_row(rows, self.connect, sql, sent=sent)]

        def once() -> None:
            connection = self.connect()
            try:
                connection.cursor().execute(sql)
                connection.commit()
            finally:
                connection.close()

        return [once]

    def insert(self, table: str, rows: DataFrame, commit_size: int) -> list[Action]:
        counted = Observation()
        source = rows.observe(counted, F.count(F.lit(1)).alias("sent"))
        self.writes.append(lambda: {**counted.get, "affected": None} if seen(counted) else None)
        return [lambda: append_jdbc(source, self.connection, table, commit_size)]

    def upsert(self, table: str, rows: DataFrame, keys, updates, order_by, commit_size: int) -> list[Action]:
        keys, kind, sent = keys or [rows.columns[0]], self.connection.kind, self._sent()
        return [
            lambda: external.upsert_external(
                rows, self.connect, kind, table, keys, updates or (), order_by, commit_size=commit_size, sent=sent
            )
        ]

    def update(self, table: str, rows: DataFrame, keys, updates, order_by, commit_size: int) -> list[Action]:
        kind, sent = self.connection.kind, self._sent()
        return [
            lambda: external.update_external(
                rows, self.connect, kind, table, keys, updates or (), order_by, commit_size=commit_size, sent=sent
            )
        ]

    def delete(self, table: str, rows: DataFrame, keys, commit_size: int) -> list[Action]:
        kind, sent = self.connection.kind, self._sent()
        return [lambda: external.delete_external(rows, self.connect, kind, table, keys, commit_size, sent)]
