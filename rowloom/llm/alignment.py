"""Tokens of two tokenizers aligned by bytes, and how often their ids meet.

Both sides of a text are cut at the byte offsets where tokens of both end; all tokens of
a piece are linked.  How many documents hold a pair of ids is counted by spilling:

1. A slice of documents is a *run*.  Its records (id A, id B, document) are sorted, those
   of one id A together, and dealt by the low bits of id A over ``PARTS`` parts; each is
   a row with two zstandard blocks: the run's pairs with their numbers of documents, and
   the documents with how often they hold the pair.  Runs are written to the shared folder.
2. The pairs of all runs of a part are merged from a heap of run heads.  Ids of side A
   come in order, so all pairs of an id are at hand at once, and with them their maximum.
   What is merged are counts by run, not records, and many runs are merged in groups
   first, so an id that all documents hold is no large group.
3. The counts stream back over the runs, which add them up for their documents; sums of a
   run meet at its documents.

Texts that are null or empty, or whose tokens do not give their bytes back on both sides
(as with a space mark U+2581), have no tokens: zeros, and an empty ``groups_sha256``.
Repeated rows count as documents of their own; rows without id are aligned like others.
"""

from __future__ import annotations

import hashlib
import heapq
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, functions as F

from rowloom.llm import bpe, pieces
from rowloom.llm.common import give_back, scratch_path, slices, whole

PARTS = 64
RUNS_MERGED = 512
"""Runs that are merged in one group."""
_DOC_BITS = 20


class Sides:
    """Both tokenizers: ids and token bytes."""

    def __init__(self, byte_level: str, piece_model: str) -> None:
        import tiktoken

        v = bpe.Vocabulary(byte_level)
        ranks = {v.bytes[i]: i for i in [*v.of_byte.tolist(), *v.made.tolist()]}
        if (np.diff(v.made) <= 0).any() or v.of_byte.max() >= v.made.min():
            raise ValueError("ids of side A are not in the order of merges")
        # without added tokens: their strings are plain text
        self.a = tiktoken.Encoding("a", pat_str=bpe.PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.b = pieces.codec_of(piece_model)
        size_a = np.zeros(max(v.bytes) + 1, np.int64)
        size_a[list(ranks.values())] = [*map(len, ranks)]
        self.size_a, self.size_b = size_a, np.array([*map(len, self.b.pieces.bytes)], np.int64)
        self.n_b = len(self.size_b)
        # printed ids: those that end a piece are followed by another sign
        self.print_a = [b"%d%c" % (i, end) for i in range(len(size_a)) for end in b",|"]
        self.print_b = [b"%d%c" % (i, end) for i in range(self.n_b) for end in b",;"]
        self.printed = self.print_a + self.print_b

    def tokens(self, texts: list[str]) -> tuple[list[np.ndarray], list[np.ndarray]]:
        """Ids of both sides for each text; none where the bytes differ."""
        side_a = [np.array(self.a.encode_ordinary(f" {t}") if t else [], np.int64) for t in texts]
        side_b = [np.frombuffer(self.b.raw(t), "<u4").astype(np.int64) for t in texts]
        none = np.zeros(0, np.int64)
        for k, (t, a, b) in enumerate(zip(texts, side_a, side_b)):
            # the byte level gives all bytes back, and pieces all but a written space mark
            if pieces.SPACE in t or int(self.size_a[a].sum()) != int(self.size_b[b].sum()):
                side_a[k] = side_b[k] = none
        return side_a, side_b


class Aligned:
    """The documents of a slice: pieces, links, and records for counting."""

    def __init__(self, sides: Sides, texts: list[str]) -> None:
        given_a, given_b = sides.tokens(texts)
        n = len(texts)
        self.n_a, self.n_b = (np.fromiter(map(len, x), np.int64, n) for x in (given_a, given_b))
        a, b = (np.concatenate(x).astype(np.int64) if n else np.zeros(0, np.int64) for x in (given_a, given_b))
        doc_a, doc_b = np.repeat(np.arange(n), self.n_a), np.repeat(np.arange(n), self.n_b)
        ends_a, ends_b = np.cumsum(sides.size_a[a]), np.cumsum(sides.size_b[b])
        last_a, last_b = _met(ends_a, ends_b), _met(ends_b, ends_a)
        piece_a, piece_b = np.cumsum(last_a) - last_a, np.cumsum(last_b) - last_b
        self.n_groups = np.bincount(doc_a[last_a], minlength=n)
        many_a, many_b = np.bincount(piece_a), np.bincount(piece_b)
        doc = doc_a[last_a]
        self.n_links = np.zeros(n, np.int64)
        np.add.at(self.n_links, doc, many_a * many_b)
        self.sha = self._printed(sides, a, b, last_a, last_b, piece_a, piece_b, many_a, many_b)
        # links of single tokens, then those of larger pieces by different ids
        single = (many_a == 1) & (many_b == 1)
        x, y, at = a[single[piece_a]], b[single[piece_b]], doc[single]
        times = np.ones(len(x), np.int64)
        if not single.all():
            pa_, a_, ca = _distinct(piece_a, a, ~single[piece_a])
            pb_, b_, cb = _distinct(piece_b, b, ~single[piece_b])
            low, high = np.searchsorted(pb_, pa_, "left"), np.searchsorted(pb_, pa_, "right")
            k = high - low
            i = np.repeat(np.arange(len(pa_)), k)
            j = np.arange(len(i)) - np.repeat(np.cumsum(k) - k, k) + np.repeat(low, k)
            x, y, at = np.r_[x, a_[i]], np.r_[y, b_[j]], np.r_[at, doc[pa_[i]]]
            times = np.r_[times, ca[i] * cb[j]]
        key = (x * sides.n_b + y) << _DOC_BITS | at
        order = np.lexsort((key, x % PARTS)) if len(key) else np.zeros(0, np.int64)
        key, times, part = key[order], times[order], (x % PARTS)[order]
        heads = _heads(key)
        self.times = np.add.reduceat(times, heads) if len(heads) else times
        self.key, self.part = key[heads], part[heads]

    def _printed(self, sides, a, b, last_a, last_b, piece_a, piece_b, many_a, many_b) -> list[str]:
        """Digests of the pieces: ids of A, ids of B; piece by piece."""
        codes = np.empty(len(a) + len(b), np.int64)
        codes[np.arange(len(a)) + (np.cumsum(many_b) - many_b)[piece_a]] = 2 * a + last_a
        codes[np.arange(len(b)) + np.cumsum(many_a)[piece_b]] = 2 * b + last_b + len(sides.print_a)
        ends = np.cumsum(self.n_a + self.n_b)
        out = []
        for start, end in zip([0, *ends[:-1].tolist()], ends.tolist()):
            text = b"".join(map(sides.printed.__getitem__, codes[start:end].tolist()))
            out.append(hashlib.sha256(text[:-1]).hexdigest() if text else "")
        return out

    def blocks(self) -> Iterator[tuple[int, bytes, bytes]]:
        """Part, pairs with their numbers of documents, and the documents."""
        bounds = np.searchsorted(self.part, np.arange(PARTS + 1))
        for part in np.flatnonzero(np.diff(bounds)).tolist():
            some = slice(bounds[part], bounds[part + 1])
            key, times = self.key[some], self.times[some]
            pair = key >> _DOC_BITS
            heads = _heads(pair)
            yield part, packed_run(pair[heads], np.diff(np.r_[heads, len(pair)])), pack(key & ((1 << _DOC_BITS) - 1), times)


def _met(ends: np.ndarray, other: np.ndarray) -> np.ndarray:
    if not len(ends):
        return np.zeros(0, bool)
    at = np.searchsorted(other, ends)
    return other[np.minimum(at, len(other) - 1)] == ends


def _heads(x: np.ndarray) -> np.ndarray:
    """Where a sorted array takes another value."""
    return np.flatnonzero(np.r_[True, x[1:] != x[:-1]]) if len(x) else np.zeros(0, np.int64)


def _distinct(piece: np.ndarray, ids: np.ndarray, of: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Different ids of each piece, by piece, and how often they are there."""
    key, count = np.unique(piece[of] << 32 | ids[of], return_counts=True)
    return key >> 32, key & 0xFFFFFFFF, count


def pack(*arrays: np.ndarray) -> bytes:
    """Arrays of whole numbers from 0 on, each in the narrowest type, in a zstandard frame."""
    import zstandard

    out = []
    for x in arrays:
        kind = np.min_scalar_type(int(x.max()) if len(x) else 0)
        out += [np.array([kind.itemsize, len(x)], "<i8").tobytes(), x.astype(kind).tobytes()]
    return zstandard.ZstdCompressor(level=3).compress(b"".join(out))


def unpack(blob: bytes) -> list[np.ndarray]:
    import zstandard

    raw, at, out = zstandard.ZstdDecompressor().decompress(blob), 0, []
    while at < len(raw):
        size, n = np.frombuffer(raw, "<i8", 2, at).tolist()
        out.append(np.frombuffer(raw, f"<u{size}", n, at + 16).astype(np.int64))
        at += 16 + size * n
    return out


def packed_run(pair: np.ndarray, count: np.ndarray) -> bytes:
    """Ascending pairs by their differences, and counts."""
    return pack(np.diff(pair, prepend=0), count)


def unpacked_run(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    pair, count = unpack(blob)
    return np.cumsum(pair), count


def merge(runs: list[tuple[np.ndarray, np.ndarray]], n_b: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs and counts of one id A after the other, from a heap of the runs' heads."""
    bounds = []
    heap = []
    for k, (pair, _) in enumerate(runs):
        a = pair // n_b
        heads = _heads(a)
        bounds.append((a[heads].tolist(), [*heads.tolist(), len(pair)]))
        if len(pair):
            heap.append((bounds[k][0][0], k, 0))
    heapq.heapify(heap)
    while heap:
        now = heap[0][0]
        found = []
        while heap and heap[0][0] == now:
            _, k, at = heap[0]
            ids, cuts = bounds[k]
            found.append((runs[k][0][cuts[at] : cuts[at + 1]], runs[k][1][cuts[at] : cuts[at + 1]]))
            if at + 1 < len(ids):
                heapq.heapreplace(heap, (ids[at + 1], k, at + 1))
            else:
                heapq.heappop(heap)
        if len(found) == 1:
            yield found[0]
            continue
        pair, count = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
        order = np.argsort(pair, kind="stable")
        heads = _heads(pair[order])
        yield pair[order][heads], np.add.reduceat(count[order], heads)


def spilled(docs: DataFrame, byte_level: str, piece_model: str, id_col: str, text_col: str) -> DataFrame:
    """Runs: a row with the documents (part -1) and one for each part that has pairs."""
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    id_kind = docs.schema[id_col].dataType.simpleString()
    kind = f"array<struct<id:{id_kind},n_a:long,n_b:long,n_groups:long,n_links:long,groups_sha256:string>>"
    names = ["run", "part", "pairs", "members", "docs"]

    def run(batches):
        sides, number, base = Sides(byte_level, piece_model), 0, TaskContext.get().partitionId() << 32
        for batch in batches:
            for rows in slices(batch, "text"):
                found = Aligned(sides, rows.column("text").to_pylist())
                columns = [rows.column("id"), *map(pa.array, (found.n_a, found.n_b, found.n_groups, found.n_links, found.sha))]
                some = pa.StructArray.from_arrays([columns[0], *columns[1:5], columns[5].cast(pa.string())], ["id", "n_a", "n_b", "n_groups", "n_links", "groups_sha256"])
                one = pa.ListArray.from_arrays(pa.array([0, len(some)], pa.int32()), some)
                yield pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([-1], pa.int32()), pa.array([None], pa.binary()), pa.array([None], pa.binary()), one], names)
                for part, pairs, members in found.blocks():
                    yield pa.RecordBatch.from_arrays([pa.array([base + number]), pa.array([part], pa.int32()), pa.array([pairs], pa.binary()), pa.array([members], pa.binary()), pa.array([None], one.type)], names)
                number += 1
        del sides
        give_back()

    return given.mapInArrow(run, f"run long, part int, pairs binary, members binary, docs {kind}")


def counted(runs: DataFrame, salts: int, n_b: int) -> DataFrame:
    """``(part, pairs, best)``: every pair of a part with its number of documents, and
    whether it is the highest of its id A."""

    def partly(table: pa.Table) -> pa.Table:
        found = [*merge([unpacked_run(x.as_py()) for x in table.column("pairs")], n_b)]
        pair, count = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
        return pa.table({"part": table.column("part")[:1], "pairs": pa.array([packed_run(pair, count)], pa.binary())})

    def wholly(table: pa.Table) -> pa.Table:
        found = [*merge([unpacked_run(x.as_py()) for x in table.column("pairs")], n_b)]
        pair, count = np.concatenate([p for p, _ in found]), np.concatenate([c for _, c in found])
        best = np.concatenate([c == c.max() for _, c in found])
        return pa.table({"part": table.column("part")[:1], "pairs": pa.array([packed_run(pair, count)], pa.binary()), "best": pa.array([pack(best.astype(np.int64))], pa.binary())})

    some = runs.select("part", _salt(salts), "pairs").groupBy("part", "salt").applyInArrow(partly, "part int, pairs binary")
    return some.groupBy("part").applyInArrow(wholly, "part int, pairs binary, best binary")


def _salt(salts: int):
    return F.pmod(F.xxhash64("run"), F.lit(salts)).cast("int").alias("salt")


def contributions(runs: DataFrame, counts: DataFrame, salts: int) -> DataFrame:
    """``(run, sums)``: for documents of a run what the pairs of one part add."""

    def back(mine: pa.Table, final: pa.Table) -> pa.Table:
        pair, count = unpacked_run(final.column("pairs")[0].as_py())
        best = unpack(final.column("best")[0].as_py())[0]
        sums = []
        for pairs, members in zip(mine.column("pairs"), mine.column("members")):
            own, docs = unpacked_run(pairs.as_py())
            doc, times = unpack(members.as_py())
            at = np.repeat(np.searchsorted(pair, own), docs)
            who, where = np.unique(doc, return_inverse=True)
            n_best, total = np.zeros(len(who), np.int64), np.zeros(len(who), np.int64)
            np.add.at(n_best, where, times * best[at])
            np.add.at(total, where, times * count[at])
            sums.append(pack(who, n_best, total))
        return pa.table({"run": mine.column("run"), "sums": pa.array(sums, pa.binary())})

    left = runs.select("run", "part", "pairs", "members", _salt(salts)).groupBy("part", "salt")
    right = counts.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(salts - 1)))).groupBy("part", "salt")
    return left.cogroup(right).applyInArrow(back, "run long, sums binary")


def alignment(docs: DataFrame, byte_level: str, piece_model: str, id_col: str = "doc_id", text_col: str = "text", runs_merged: int = RUNS_MERGED) -> DataFrame:
    """Per document: id, tokens of both sides, pieces and links; ``n_best``, the links
    whose pair is in as many documents as any pair of its id A; ``count_sum``, the sum of
    these numbers over all links; ``groups_sha256``."""
    spark = docs.sparkSession
    runs = spilled(docs, byte_level, piece_model, id_col, text_col)
    path = scratch_path(spark, "runs")
    runs.write.option("compression", "none").parquet(path)
    runs = spark.read.schema(runs.schema).parquet(path)
    own, dealt = runs.where("part < 0").select("run", "docs"), runs.where("part >= 0")
    salts = max(1, -(-own.count() // runs_merged))
    n_b = len(pieces.codec_of(piece_model).pieces.bytes)
    sums = contributions(dealt, counted(dealt, salts, n_b), salts)

    def together(mine: pa.Table, added: pa.Table) -> pa.Table:
        docs = mine.column("docs").combine_chunks().flatten()
        n_best, total = np.zeros(len(docs), np.int64), np.zeros(len(docs), np.int64)
        for blob in added.column("sums"):
            who, best, counts = unpack(blob.as_py())
            n_best[who] += best
            total[who] += counts
        columns = dict(zip([f.name for f in docs.type], docs.flatten()))
        return pa.table({k: columns[k] for k in ("id", "n_a", "n_b", "n_groups", "n_links")} | {"n_best": pa.array(n_best), "count_sum": pa.array(total), "groups_sha256": columns["groups_sha256"]})

    kind = docs.schema[id_col].dataType.simpleString()
    schema = f"id {kind}, n_a long, n_b long, n_groups long, n_links long, n_best long, count_sum long, groups_sha256 string"
    return own.groupBy("run").cogroup(sums.groupBy("run")).applyInArrow(together, schema).withColumnRenamed("id", id_col)
