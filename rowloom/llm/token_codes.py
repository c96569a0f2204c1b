"""Token ids in files of directly addressable codes (DAC).

An id is split into chunks of 8 bits.  Level 0 holds the lowest chunk of every id,
level 1 the next chunk of those ids that have more, and so on.  A bitmap for each
level says which of its chunks continue, and a rank directory holds the number of ones
before each 512 bits, so the place of an id's next chunk is one rank query:
``token_at`` reads any token without decoding those before it.

Files are Parquet tables without compression; a row is a segment of whole documents in
ascending order of id: the documents' ids and token counts, and levels, bitmaps and
directories as binary columns.  Spark writes and commits them, so lost tasks are run
again and any store that Spark knows will do.

Each document is ended by ``end_id``.  A null text is empty: the end id alone.
Documents without an id come first; of equal ids the order is that of their texts.
"""

from __future__ import annotations

import os
import zlib
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from rowloom.llm.bpe import checked, pretokens
from rowloom.llm.common import give_back, slices, whole

WORDS_KEPT = 500_000
"""Words whose ids a worker process remembers; when there are more it starts anew."""
SEGMENT = 1_000_000
"""Tokens after which a segment ends, at the end of a document."""
_BLOCK = 512

SCHEMA = ("part long, part_null boolean, segment int, first long, n_tokens long, doc_ids array<long>, doc_tokens array<long>, "
          "levels array<binary>, continues array<binary>, ranks array<binary>")


def coded(ids: np.ndarray) -> tuple[list[bytes], list[bytes], list[bytes]]:
    """Levels, bitmaps and rank directories."""
    levels, continues, ranks = [], [], []
    rest = ids.astype(np.uint32)
    while True:
        levels.append((rest & np.uint32(255)).astype(np.uint8).tobytes())
        rest = rest >> np.uint32(8)
        more = rest > 0
        if not more.any():
            return levels, continues, ranks
        bits = np.packbits(more, bitorder="little")
        continues.append(bits.tobytes())
        ones = np.add.reduceat(np.bitwise_count(bits), np.arange(0, len(bits), _BLOCK // 8), dtype=np.int64)
        ranks.append(np.r_[0, np.cumsum(ones)[:-1]].astype(np.uint32).tobytes())
        rest = rest[more]


def decoded(levels: list[bytes], continues: list[bytes]) -> np.ndarray:
    """All ids of a segment."""
    ids = np.frombuffer(levels[0], np.uint8).astype(np.uint32)
    at = None
    for k, bits in enumerate(continues):
        size = len(ids) if at is None else len(at)
        more = np.flatnonzero(np.unpackbits(np.frombuffer(bits, np.uint8), bitorder="little", count=size))
        at = more if at is None else at[more]
        ids[at] |= np.frombuffer(levels[k + 1], np.uint8).astype(np.uint32) << np.uint32(8 * (k + 1))
    return ids


def token_at(levels: list[bytes], continues: list[bytes], ranks: list[bytes], k: int) -> int:
    """One id, by rank queries alone."""
    value = levels[0][k]
    for level, bits in enumerate(continues):
        if not bits[k >> 3] >> (k & 7) & 1:
            break
        block = k // _BLOCK
        before = np.frombuffer(bits, np.uint8, (k >> 3) - block * (_BLOCK // 8), block * (_BLOCK // 8))
        k = int(np.frombuffer(ranks[level], np.uint32)[block]) + int(np.bitwise_count(before).sum()) + (bits[k >> 3] & ((1 << (k & 7)) - 1)).bit_count()
        value |= levels[level + 1][k] << (8 * (level + 1))
    return value


class WordEncoder:
    """Ids by the tokenizers library, asked once for each distinct pre-token: a byte-level
    tokenizer encodes these independently of each other."""

    def __init__(self, path: str) -> None:
        import json
        import re

        from tokenizers import Tokenizer

        with open(path, encoding="utf-8") as f:
            checked(json.load(f))
        # a task has one core; threads of the library's own would take those of others
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.library = Tokenizer.from_file(path)
        self.library.no_truncation()
        self.library.no_padding()
        added = sorted((t.content for t in self.library.get_added_tokens_decoder().values()), key=len, reverse=True)
        self.added = added
        self.split = re.compile("(" + "|".join(map(re.escape, added)) + ")") if added else None
        self.known: dict[str, bytes] = {}

    def pieces(self, text: str) -> list[str]:
        if not any(t in text for t in self.added):
            return pretokens(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else pretokens(part))]

    def __call__(self, texts: list[str], end: bytes) -> list[bytes]:
        """Little-endian 32-bit ids of each text, ended."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        pieces = [self.pieces(t) for t in texts]
        fresh = [*set().union(*pieces).difference(self.known)]
        for w, e in zip(fresh, self.library.encode_batch_fast(fresh, add_special_tokens=False)):
            self.known[w] = array("I", e.ids).tobytes()
        known = self.known.__getitem__
        return [b"".join(map(known, p)) + end for p in pieces]


def stretch(levels: list[bytes], continues: list[bytes], ranks: list[bytes], a: int, b: int) -> np.ndarray:
    """The ids at places ``a`` to ``b``, of which only the bytes that hold them are read: a
    rank query for each level finds where the stretch goes on in the next one."""
    ids = np.frombuffer(levels[0], np.uint8, b - a, a).astype(np.uint32)
    at = np.arange(b - a)
    for level, bits in enumerate(continues):
        if not len(at):
            break
        block, low = a // _BLOCK, a & 7
        before = np.frombuffer(bits, np.uint8, (a >> 3) - block * (_BLOCK // 8), block * (_BLOCK // 8))
        inside = np.unpackbits(np.frombuffer(bits, np.uint8, (b + 7 >> 3) - (a >> 3), a >> 3), bitorder="little")
        more = np.flatnonzero(inside[low : low + b - a])
        a = int(np.frombuffer(ranks[level], np.uint32)[block]) + int(np.bitwise_count(before).sum()) + int(inside[:low].sum())
        b, at = a + len(more), at[more]
        ids[at] |= np.frombuffer(levels[level + 1], np.uint8, b - a, a).astype(np.uint32) << np.uint32(8 * (level + 1))
    return ids


@lru_cache(1)
def encoder_of(path: str) -> WordEncoder:
    return WordEncoder(path)


def write_codes(docs: DataFrame, path: str, tokenizer: str, end_id: int = 0, id_col: str = "doc_id", text_col: str = "text") -> None:
    """Encodes and writes all documents in ascending order of id."""
    given = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    ordered = given.repartitionByRange("id").sortWithinPartitions("id", "text")

    def run(batches):
        encoder, end = encoder_of(tokenizer), np.array([end_id], "<u4").tobytes()
        part = None
        number = before = held = 0
        ids: list = []
        texts: list[bytes] = []

        def segment() -> pa.RecordBatch:
            tokens = np.frombuffer(b"".join(texts), "<u4")
            levels, continues, ranks = coded(tokens)
            one = lambda x, kind: pa.array([x], kind)
            return pa.RecordBatch.from_arrays(
                [one(part[0], pa.int64()), one(part[0] is None, pa.bool_()), one(number, pa.int32()), one(before, pa.int64()), one(len(tokens), pa.int64()),
                 one(ids, pa.list_(pa.int64())), one([len(t) // 4 for t in texts], pa.list_(pa.int64())),
                 *[one(x, pa.list_(pa.binary())) for x in (levels, continues, ranks)]],
                [f.split()[0] for f in SCHEMA.split(", ")])

        for batch in batches:
            for rows in slices(batch, "text", 2_000_000):
                some = rows.column("id").to_pylist()
                part = part or (some[0],)
                for i, t in zip(some, encoder(rows.column("text").to_pylist(), end)):
                    ids.append(i)
                    texts.append(t)
                    held += len(t) // 4
                    if held >= SEGMENT:
                        yield segment()
                        number, before, held = number + 1, before + held, 0
                        ids, texts = [], []
        if ids:
            yield segment()
        del ids, texts
        give_back()

    ordered.mapInArrow(run, SCHEMA).write.option("compression", "none").option("parquet.enable.dictionary", "false").parquet(path)


def with_starts(segments: DataFrame) -> DataFrame:
    """Segments with ``start``, the tokens of all segments before."""
    parts = segments.groupBy("part", "part_null").agg(F.sum("n_tokens").alias("total"))
    # one row for each written file, so a single ordered sum
    order = Window.orderBy(F.desc("part_null"), "part").rowsBetween(Window.unboundedPreceding, -1)
    base = parts.select(F.col("part").alias("p"), F.col("part_null").alias("pn"), F.coalesce(F.sum("total").over(order), F.lit(0)).alias("base"))
    return segments.join(base, F.col("part").eqNullSafe(F.col("p")) & (F.col("part_null") == F.col("pn"))).withColumn("start", F.col("base") + F.col("first")).drop("p", "pn", "base")


def read_codes(spark: SparkSession, path: str, id_col: str = "doc_id") -> DataFrame:
    """Per document, from the files: id, ``start`` (tokens of all documents before),
    ``n_tokens`` and ``ids_crc32``."""
    segments = with_starts(spark.read.schema(SCHEMA).parquet(path)).select("start", "doc_ids", "doc_tokens", "levels", "continues")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                raw = memoryview(decoded(row["levels"], row["continues"]).astype("<u4").tobytes())
                counts = np.array(row["doc_tokens"], np.int64)
                starts = np.r_[0, np.cumsum(counts)]
                crc = [zlib.crc32(raw[4 * a : 4 * b]) for a, b in zip(starts[:-1].tolist(), starts[1:].tolist())]
                yield pa.RecordBatch.from_arrays([pa.array(row["doc_ids"], pa.int64()), pa.array(starts[:-1] + row["start"]), pa.array(counts), pa.array(crc, pa.int64())],
                                                 [id_col, "start", "n_tokens", "ids_crc32"])

    return segments.mapInArrow(run, f"`{id_col}` long, start long, n_tokens long, ids_crc32 long")


def tokens(spark: SparkSession, path: str, first: int, last: int) -> DataFrame:
    """Tokens ``first`` up to ``last`` (exclusive) of all documents one after the other, as
    ``place`` and ``token``; places beyond the end have no rows.

    The segments that hold them are found from their sizes.  The parts of the files are in
    order, so bounds of the parts are pushed into the scan; in a segment the rank
    directories lead to the bytes, and nothing else of it is decoded.
    """
    files = spark.read.schema(SCHEMA).parquet(path)
    keys = ["part", "part_null", "segment"]
    held = with_starts(files.select(*keys, "first", "n_tokens")).where((F.col("start") < last) & (F.col("start") + F.col("n_tokens") > first))
    ends = held.agg(F.min("part").alias("low"), F.max("part").alias("high"), F.max("part_null").alias("null")).first()
    inside = F.col("part").between(ends["low"], ends["high"]) if ends["low"] is not None else F.lit(False)
    near = files.where(inside | F.col("part_null") if ends["null"] else inside).drop("first", "n_tokens", "doc_ids", "doc_tokens")
    starts = held.select(*[F.col(k).alias(f"h_{k}") for k in keys], "start", "n_tokens")
    same = F.col("part").eqNullSafe(F.col("h_part")) & (F.col("part_null") == F.col("h_part_null")) & (F.col("segment") == F.col("h_segment"))
    met = near.join(starts, same).select("start", "n_tokens", "levels", "continues", "ranks")

    def run(batches):
        for batch in batches:
            for row in batch.to_pylist():
                a, b = max(0, first - row["start"]), min(row["n_tokens"], last - row["start"])
                found = stretch(row["levels"], row["continues"], row["ranks"], a, b)
                yield pa.RecordBatch.from_arrays([pa.array(np.arange(a, b) + row["start"]), pa.array(found.astype(np.int64))], ["place", "token"])

    return met.mapInArrow(run, "place long, token long")
