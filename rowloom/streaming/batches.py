"""Writing a stream in micro-batches: by port, appended, or merged by key.

Every batch writes to a place named after its id, so a batch that runs again
after a failure replaces its own output and nothing else.
"""

from __future__ import annotations

import json
from collections.abc import Callable, Sequence
from dataclasses import dataclass, field as default

from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.streaming import StreamingQuery

from rowloom.functions.values import field, resolve, to_type
from rowloom.operators.merge import upsert
from rowloom.sinks.marks import names_in, read_text, write_text
from rowloom.sinks.tables import write_routed

Trigger = dict[str, object]
ONCE: Trigger = {"availableNow": True}
_BUCKET, _MANIFEST = "bucket", "manifest.json"


def start_batches(stream: DataFrame, each: Callable[[DataFrame, int], None], checkpoint: str, trigger: Trigger) -> StreamingQuery:
    return (
        stream.writeStream.foreachBatch(each)
        .option("checkpointLocation", checkpoint)
        .trigger(**trigger)
        .start()
    )


def route_stream(
    stream: DataFrame,
    tag: Callable[[DataFrame], DataFrame],
    path: str,
    checkpoint: str,
    column: str = "branch",
    trigger: Trigger = ONCE,
) -> StreamingQuery:
    """Write each batch once, divided into one folder per port.  ``tag`` adds the
    port column (``filter_tag`` or ``switch_tag``)."""

    def each(batch: DataFrame, ident: int) -> None:
        write_routed(tag(batch), f"{path}/batch_id={ident}", column)

    return start_batches(stream, each, checkpoint, trigger)


def append_stream(stream: DataFrame, path: str, checkpoint: str, trigger: Trigger = ONCE) -> StreamingQuery:
    """Insert every batch into one table folder."""

    def each(batch: DataFrame, ident: int) -> None:
        batch.write.mode("overwrite").parquet(f"{path}/batch_id={ident}")

    return start_batches(stream, each, checkpoint, trigger)


@dataclass
class UpsertStream:
    """Merge batches into a keyed table that is kept in buckets, a version for each batch.

    Rows are dealt over ``buckets`` by a hash of their keys.  A batch reads and writes only
    the buckets that it has keys of; the manifest of its version names, for every bucket,
    the folder that holds it, which may be of an earlier version.  Version n is computed
    from version n-1 only and its manifest is written last, so running batch n again gives
    the same version, and a new process goes on from the version before its first batch
    (``latest`` is only what ``state()`` shows).

    ``held`` turns rows of the table into rows of a batch; then those already held compete
    with the new ones in ``order_by``.
    """

    spark: SparkSession
    initial: DataFrame
    path: str
    keys: Sequence[str]
    order_by: Sequence[str]
    update_fields: Sequence[str] | None = None
    latest: int = default(default=-1)
    buckets: int = 64
    held: Callable[[DataFrame], DataFrame] | None = None

    def _manifest(self, ident: int) -> dict[str, str] | None:
        """Folders by bucket, None before the first version."""
        if ident < 0:
            return None
        return json.loads(read_text(self.spark, f"{self.path}/version={ident}/{_MANIFEST}"))

    def _read(self, folders: Sequence[str]) -> DataFrame:
        schema = self.initial.schema
        if not folders:
            return self.spark.createDataFrame([], schema)
        return self.spark.read.schema(schema).parquet(*[f"{self.path}/{f}" for f in folders])

    def state(self, ident: int | None = None) -> DataFrame:
        manifest = self._manifest(self.latest if ident is None else ident)
        return self.initial if manifest is None else self._read(list(manifest.values()))

    def _bucket(self, df: DataFrame) -> Column:
        """By the keys as they are in the table; rows that lack one are dealt too."""
        keys = [to_type(field(df, k), self.initial.schema[resolve(self.initial, k)].dataType) for k in self.keys]
        return F.pmod(F.xxhash64(*keys), F.lit(self.buckets)).cast("int")

    def apply(self, batch: DataFrame, ident: int) -> None:
        before = self._manifest(ident - 1)
        touched = [str(r[0]) for r in batch.select(self._bucket(batch)).distinct().collect()]  # at most ``buckets``
        known = {} if before is None else before
        old = self.initial if before is None else self._read([known[b] for b in touched if b in known])
        if self.held is not None:
            batch = batch.unionByName(self.held(old))
        merged = upsert(old, batch, self.keys, self.update_fields, self.order_by)
        place = f"version={ident}"
        rows = merged.withColumn(_BUCKET, self._bucket(merged)).repartition(_BUCKET)
        rows.write.mode("overwrite").partitionBy(_BUCKET).parquet(f"{self.path}/{place}")
        folders = [n for n in names_in(self.spark, f"{self.path}/{place}") if n.startswith(f"{_BUCKET}=")]
        written = {n.partition("=")[2]: f"{place}/{n}" for n in folders}
        kept = {b: f for b, f in known.items() if b not in touched}
        write_text(self.spark, f"{self.path}/{place}/{_MANIFEST}", json.dumps(kept | written))
        self.latest = ident

    def start(self, stream: DataFrame, checkpoint: str, trigger: Trigger = ONCE) -> StreamingQuery:
        return start_batches(stream, self.apply, checkpoint, trigger)
