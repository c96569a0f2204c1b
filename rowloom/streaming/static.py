"""Join or compare a stream with a static table, to the end.

Batches do what can be decided row by row: the rows of the stream with their partners, or
without one.  What the static table alone has is known only when the stream has ended:
every batch stores the keys it brought, and ``result`` adds the static rows whose key never
came.  Keys are stored distinct within a batch, so they grow with the stream's keys and not
with its rows; they are never gathered.

A batch writes to places named after its id, so running it again replaces its own output,
and a new process finds what earlier ones wrote.  A stream without rows leaves nothing but
the static rows.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence
from dataclasses import dataclass

from pyspark.sql import DataFrame, functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rowloom.functions.values import field, quoted, resolve
from rowloom.operators.compare import ONLY_RIGHT, STATUS, table_compare
from rowloom.operators.join import JOIN_TYPES, join_key, merge_join, split_names, unmatched_rows
from rowloom.sinks.marks import exists, names_in
from rowloom.streaming.batches import ONCE, Trigger, start_batches

_ROWS, _KEYS = "rows", "keys"


@dataclass
class _Seen:
    """Rows and keys under ``path``, a folder of each for every batch."""

    static: DataFrame
    path: str
    keys: str | Sequence[str]

    def _store(self, batch: DataFrame, out: DataFrame, ident: int) -> None:
        brought = [F.col(quoted(resolve(batch, k))) for k in split_names(self.keys) if resolve(batch, k)]
        batch.select(*brought).distinct().write.mode("overwrite").parquet(f"{self.path}/{_KEYS}/batch_id={ident}")
        out.write.mode("overwrite").parquet(f"{self.path}/{_ROWS}/batch_id={ident}")

    def _stored(self, part: str, shape: StructType) -> DataFrame:
        """What the batches wrote; columns that were not stored are NULL."""
        spark = self.static.sparkSession
        place = f"{self.path}/{part}"
        if not exists(spark, place) or not [n for n in names_in(spark, place) if n.startswith("batch_id=")]:
            return spark.createDataFrame([], shape)
        return spark.read.schema(shape).parquet(f"{place}/batch_id=*")


def _shape(stream: StructType, static: DataFrame, of: Callable[[DataFrame], DataFrame]) -> StructType:
    """The columns of a result, found from an empty batch."""
    return of(static.sparkSession.createDataFrame([], stream)).schema


@dataclass
class JoinStream(_Seen):
    """``merge_join(stream, static, keys, how)`` for a stream on the left."""

    how: str
    shape: StructType

    def __post_init__(self) -> None:
        if self.how not in JOIN_TYPES:
            raise ValueError(f"unknown join type {self.how!r}; known: {list(JOIN_TYPES)}")
        if not split_names(self.keys):
            raise ValueError("a stream joins on at least one key")

    def _partners(self, batch: DataFrame) -> DataFrame:
        kept = "LEFT OUTER" if self.how in ("LEFT OUTER", "FULL OUTER") else "INNER"
        return merge_join(batch, self.static, self.keys, kept)

    def apply(self, batch: DataFrame, ident: int) -> None:
        self._store(batch, self._partners(batch), ident)

    def start(self, stream: DataFrame, checkpoint: str, trigger: Trigger = ONCE) -> StreamingQuery:
        return start_batches(stream, self.apply, checkpoint, trigger)

    def result(self) -> DataFrame:
        """All rows so far; static rows count as unmatched while their key has not come."""
        found = self._stored(_ROWS, _shape(self.shape, self.static, self._partners))
        if self.how not in ("RIGHT OUTER", "FULL OUTER"):
            return found
        seen = self._stored(_KEYS, self.shape)
        pairs = [join_key(field(seen, k, "l"), field(self.static, k, "r")) for k in split_names(self.keys)]
        return found.union(unmatched_rows(seen, self.static, pairs))


@dataclass
class CompareStream(_Seen):
    """``table_compare(stream, static, keys)`` for a stream on the left; ``options`` as there."""

    shape: StructType
    options: dict

    def _compared(self, batch: DataFrame) -> DataFrame:
        """Only left rows: what a batch lacks, another may bring."""
        out = table_compare(batch, self.static, self.keys, **self.options, split_hot=True)
        return out.where(F.col(STATUS) != ONLY_RIGHT)

    def apply(self, batch: DataFrame, ident: int) -> None:
        self._store(batch, self._compared(batch), ident)

    def start(self, stream: DataFrame, checkpoint: str, trigger: Trigger = ONCE) -> StreamingQuery:
        return start_batches(stream, self.apply, checkpoint, trigger)

    def result(self) -> DataFrame:
        """All left rows so far, and the static rows whose key has not come."""
        found = self._stored(_ROWS, _shape(self.shape, self.static, self._compared))
        seen = self._stored(_KEYS, self.shape)
        alone = table_compare(seen, self.static, self.keys, **self.options, split_hot=True)
        return found.union(alone.where(F.col(STATUS) == ONLY_RIGHT))
