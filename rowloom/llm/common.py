"""What the text operators share: Arrow batches in and out, words as hashes,
shared scratch space, and connected components.

Text functions run in ``mapInArrow``: Spark deals the rows, bounds a batch in rows
and bytes, and reruns lost tasks; a batch is worked on as Arrow and numpy arrays.
"""

from __future__ import annotations

import ctypes
import gc
import uuid
from contextlib import suppress
from collections.abc import Callable, Iterator, Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, functions as F
from pyspark.sql.types import StructType

SLICE_BYTES = 3_000_000
"""Text that a task works on at once.  A longer text is a slice of its own."""


def give_back() -> None:
    """Return freed memory to the system: Python workers outlive their tasks, and what
    they hold is missing to the next ones."""
    gc.collect()
    pa.default_memory_pool().release_unused()
    with suppress(OSError, AttributeError):
        ctypes.CDLL(None).malloc_trim(0)


def shared_dir(spark: SparkSession) -> str:
    """The folder that all executors share: ``spark.checkpoint.dir``, and where that is
    unset a folder of the warehouse, which is shared as well."""
    folder = spark.conf.get("spark.checkpoint.dir", None) or f"{spark.conf.get('spark.sql.warehouse.dir').rstrip('/')}/_scratch"
    return f"{folder.rstrip('/')}/rowloom-{spark.sparkContext.applicationId}"


def scratch_path(spark: SparkSession, name: str) -> str:
    return f"{shared_dir(spark)}/{name}-{uuid.uuid4().hex}"


def clear_scratch(spark: SparkSession) -> None:
    """Deletes what this application has left in the shared folder, once its results are read."""
    path = spark._jvm.org.apache.hadoop.fs.Path(shared_dir(spark))
    path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


def cut(df: DataFrame) -> DataFrame:
    """The frame, written to the shared folder and read from there."""
    spark = df.sparkSession
    if spark.sparkContext.getCheckpointDir() is None:
        spark.sparkContext.setCheckpointDir(shared_dir(spark))
    return df.checkpoint()


def whole(text: str = "text") -> Column:
    """A text column; null counts as empty."""
    return F.coalesce(F.col(text).cast("string"), F.lit(""))


def remainder(key: Column, modulus: int) -> Column:
    """crc32 of the key as text, modulo; a null key gives -1, which no rule selects."""
    return F.coalesce(F.pmod(F.crc32(key.cast("string").cast("binary")), F.lit(modulus)), F.lit(-1))


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Consecutive rows of at most ``limit`` bytes of text (one row at least)."""
    ends = np.cumsum(np.asarray(pc.fill_null(pc.binary_length(batch.column(text)), 0), dtype=np.int64))
    start = 0
    while start < batch.num_rows:
        before = ends[start - 1] if start else 0
        stop = max(start + 1, int(np.searchsorted(ends, before + limit, "right")))
        yield batch.slice(start, stop - start)
        start = stop


def per_slice(df: DataFrame, text: str, schema: str | StructType, make: Callable[[], Callable[[pa.RecordBatch], dict]], limit: int = SLICE_BYTES) -> DataFrame:
    """``make()`` runs once in each task and returns a function from a slice of rows to
    the columns of ``schema``."""
    names = schema.names if isinstance(schema, StructType) else [f.split()[0].strip("`") for f in _fields(schema)]

    def run(batches):
        work = make()
        for batch in batches:
            for part in slices(batch, text, limit):
                found = work(part)
                yield pa.RecordBatch.from_arrays([_array(found[n]) for n in names], names)
        del work
        give_back()

    return df.mapInArrow(run, schema)


def packed(docs: DataFrame, columns: Sequence[str]) -> Column:
    """The columns as one struct ``row``, so that no name of theirs can clash."""
    return F.struct(*[F.col(f"`{c}`") for c in columns]).alias("row")


def _fields(schema: str) -> list[str]:
    fields, depth, start = [], 0, 0
    for i, c in enumerate(schema):
        depth += (c == "<") - (c == ">")
        if c == "," and not depth:
            fields.append(schema[start:i].strip())
            start = i + 1
    return [*fields, schema[start:].strip()]


def _array(values) -> pa.Array:
    if isinstance(values, pa.ChunkedArray):
        return values.combine_chunks()
    return values if isinstance(values, pa.Array) else pa.array(values)


class Words:
    """Words of a slice: ``hashes`` (uint64 per word), ``starts`` (first word of each
    text and the total at the end), ``ids`` into ``vocabulary``."""

    def __init__(self, texts: pa.Array, seed: int = 0) -> None:
        import xxhash

        lists = pc.ascii_split_whitespace(texts.cast(pa.large_string()))
        flat = lists.flatten()
        sizes = np.asarray(pc.fill_null(pc.list_value_length(lists), 0), dtype=np.int64)
        owner = np.repeat(np.arange(len(sizes)), sizes)
        full = np.asarray(pc.greater(pc.binary_length(flat), 0), dtype=bool)
        if not full.all():  # white space at an end of a text leaves an empty piece there
            flat, owner = flat.filter(pa.array(full)), owner[full]
        self.starts = np.zeros(len(sizes) + 1, np.int64)
        np.cumsum(np.bincount(owner, minlength=len(sizes)), out=self.starts[1:])
        coded = flat.dictionary_encode()
        self.ids = np.asarray(coded.indices, dtype=np.int64)
        self.vocabulary = coded.dictionary
        one = xxhash.xxh3_64_intdigest
        table = np.fromiter((one(w.encode(), seed) for w in self.vocabulary.to_pylist()), np.uint64, len(self.vocabulary))
        self.table = table
        self.hashes = table[self.ids] if len(table) else np.zeros(0, np.uint64)
        self.owner = owner

    def counts(self) -> np.ndarray:
        return np.diff(self.starts)


_ODD = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray, salt: int = 0) -> np.ndarray:
    """A well mixed uint64 for each uint64."""
    x = x + np.uint64((salt * int(_ODD)) & (2**64 - 1))
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def runs_of(hashes: np.ndarray, width: int) -> np.ndarray:
    """A hash of each ``width`` consecutive words (the last ``width - 1`` starts are left out)."""
    n = len(hashes) - width + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(n, np.uint64)
    for j in range(width):
        total = total * _ODD + hashes[j : j + n]
    return mixed(total)


def inside(starts: np.ndarray, width: int, total: int) -> np.ndarray:
    """Of the windows of ``runs_of``, those that lie within one text."""
    n = total - width + 1
    if n <= 0:
        return np.zeros(0, bool)
    ok = np.ones(n, bool)
    for back in range(1, width):
        cut_at = starts[1:-1] - back
        ok[cut_at[(cut_at >= 0) & (cut_at < n)]] = False
    return ok


def components(edges: DataFrame, rounds: int = 60) -> DataFrame:
    """``(id, component)`` for every id in ``edges(a, b)``; component is the smallest id
    that can be reached.

    Large-star and small-star steps in turn: each links the neighbours of a node to
    the smallest of them, so the number of links never grows and chains shorten
    geometrically.  Each round is cut through the shared folder.
    """
    links = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct())
    ids = links.select(F.col("a").alias("id")).union(links.select("b")).distinct()
    before = None
    for _ in range(rounds):
        both = links.union(links.select("b", "a"))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        large = both.join(least, "a").where("b > a").select(F.col("b").alias("a"), F.col("m").alias("b"))
        large = large.where("a <> b").distinct()
        low = large.groupBy("a").agg(F.min("b").alias("m"))
        small = large.join(low, "a").select("b", "m").where("b <> m").select(F.col("b").alias("a"), F.col("m").alias("b"))
        links = cut(small.union(low).distinct())
        seen = links.agg(F.count(F.lit(1)), F.sum(F.xxhash64("a", "b").cast("decimal(38,0)"))).first()
        if seen == before:
            break
        before = seen
    else:
        raise RuntimeError(f"components not settled after {rounds} rounds")
    root = links.groupBy("a").agg(F.min("b").alias("component")).withColumnRenamed("a", "id")
    return ids.join(root, "id", "left").select("id", F.coalesce("component", "id").alias("component"))
