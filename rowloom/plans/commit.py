"""Changes of several tables, staged together and then committed.

All changes are written to the shared folder while every table is still as it was, so
whatever is computed from a table sees its old rows.  Then a manifest names the staged
data, and only after it is written are tables changed.  A commit that was cut off is
finished by ``recover``: replacing a table twice does no harm, and an append is left out
when its table no longer has the files that the manifest notes.
"""

from __future__ import annotations

import hashlib
import json
from dataclasses import asdict, dataclass

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators.keyed import columns_of
from rowloom.sinks.marks import exists as _exists, read_text as _read_text, write_text as _write_text
from rowloom.sinks.tables import append_table
from rowloom.sources.scratch import scratch_path

_MANIFEST, _DONE = "manifest.json", "done"


@dataclass(frozen=True)
class Change:
    """Staged rows that replace a table or are added to it."""

    table: str
    path: str
    replaces: bool
    files: str = ""


def _files_of(spark: SparkSession, table: str) -> str:
    """A digest of the names of a table's files."""
    spark.catalog.refreshTable(table)
    return hashlib.sha256("\n".join(sorted(spark.table(table).inputFiles())).encode()).hexdigest()


class Commit:
    """Collects changes with ``replace`` and ``append``; ``run`` commits them."""

    def __init__(self, spark: SparkSession) -> None:
        self.spark, self.folder = spark, scratch_path(spark, "commit")
        self.changes: list[Change] = []

    def _stage(self, rows: DataFrame, table: str, replaces: bool) -> None:
        path = f"{self.folder}/{len(self.changes)}"
        rows.write.parquet(path)
        self.changes.append(Change(table, path, replaces))

    def replace(self, table: str, state: DataFrame) -> None:
        self._stage(state, table, True)

    def append(self, table: str, rows: DataFrame) -> None:
        self._stage(rows, table, False)

    def run(self) -> None:
        """Writes the manifest, then changes the tables one after the other."""
        noted = [Change(c.table, c.path, c.replaces, "" if c.replaces else _files_of(self.spark, c.table)) for c in self.changes]
        # of several appends to a table, each one changes the files that the next one finds
        seen: set[str] = set()
        for k, c in enumerate(noted):
            if c.table in seen:
                noted[k] = Change(c.table, c.path, c.replaces)
            seen.add(c.table)
        _write_text(self.spark, f"{self.folder}/{_MANIFEST}", json.dumps([asdict(c) for c in noted]))
        _switch(self.spark, self.folder, noted, again=False)


def _switch(spark: SparkSession, folder: str, changes: list[Change], again: bool) -> None:
    for k, c in enumerate(changes):
        mark = f"{folder}/{_DONE}-{k}"
        if again and _exists(spark, mark):
            continue
        files = c.files
        if not c.replaces and not files and again:
            # noted when the append before it was done
            files = _read_text(spark, f"{folder}/{_DONE}-{max(i for i in range(k) if changes[i].table == c.table)}")
        rows = spark.read.parquet(c.path)
        if c.replaces:
            rows.select(*columns_of(spark.table(c.table).columns)).write.mode("overwrite").insertInto(c.table)
        elif not (again and _files_of(spark, c.table) != files):
            append_table(rows, c.table)
        _write_text(spark, mark, _files_of(spark, c.table))


def recover(spark: SparkSession, folder: str) -> bool:
    """Finishes the commit of a folder; False where it had not got to its manifest, so
    that no table was changed."""
    path = f"{folder}/{_MANIFEST}"
    if not _exists(spark, path):
        return False
    _switch(spark, folder, [Change(**c) for c in json.loads(_read_text(spark, path))], again=True)
    return True
