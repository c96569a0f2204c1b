"""Repeated passages by relative Lempel-Ziv parsing.

Each document is factored, left to right, against the documents with smaller ids.  A
factor is a copy of words that stand in such a document (its source) from a word number
(its offset) on; words in no factor are literals, and every word in a factor is removed.

1. Index.  A reference is found by its windows of ``WINDOW`` words, each with the document
   and word number where it starts.  Windows are represented by an anchor, the
   ``ANCHOR``-word gram with the least hash in it, so equal passages choose equal anchors
   (about one word in five).  Anchors of two or more rows become a filter of bounded size
   (``FILTER_BYTES``), which is broadcast; a full filter only lets more through, results
   never depend on it.  The other windows are the index, in buckets by their hash.
2. Look-up.  In a batch of texts, a window of several documents gets the smallest of them
   as its source at once and goes to its own document's group; the smallest alone goes to
   the bucket, so a passage in a third of all documents costs one entry a batch there.
   In a bucket each window's source is the smallest document of all.
3. Parse.  The windows found go back to their document.  A factor starts at the first
   window with a source and is extended as long as the next window has the same source,
   one word further on; then it ends with the last window's last word.  A factor of another
   source may begin inside it: its words up to there are the earlier factor's, and what is
   left of it (``WINDOW`` words at least with the words before the boundary) is a factor
   with its offset moved on.  So factors never overlap, and their words are the words
   covered by windows that a smaller document holds.

A source is the smallest document of its batch or of all, so it may depend on how the
rows are dealt; which words are removed doesn't.  A window's identity is a hash of 64 bits
and its bucket, from an independent hash.

Null and empty texts have no words.  A document without an id is left whole and is no
reference.  Rows with the same id are no references for each other; an offset in such a
source counts in one of its rows.  Ids are whole numbers or text of such.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import Words, inside, mixed, per_slice, runs_of, slices, whole

WINDOW, ANCHOR = 13, 5
FILTER_BYTES = 8 << 20
BUCKET_BYTES = 4_000_000
"""Text for each bucket of window hashes."""
SLICE = 4_000_000
GROUP_BYTES = 5_000_000
"""Text of the documents that are put together again in one group."""


class Windows:
    """Windows of a slice: place of the first word, row, hash, second hash and anchor."""

    def __init__(self, texts: pa.Array) -> None:
        self.words = Words(texts)
        hashes = self.words.hashes
        self.at = np.flatnonzero(inside(self.words.starts, WINDOW, len(hashes)))
        self.row = self.words.owner[self.at]
        if not len(self.at):
            self.hash = self.second = self.anchor = np.zeros(0, np.uint64)
            return
        self.hash = runs_of(hashes, WINDOW)[self.at]
        self.second = runs_of(mixed(hashes, 7), WINDOW)[self.at]
        least = runs_of(hashes, ANCHOR)
        size, span = 1, WINDOW - ANCHOR + 1
        grams = least
        while 2 * size <= span:
            least = np.minimum(least[:-size], least[size:])
            size *= 2
        rest = span - size
        if rest:
            least = np.minimum(least[: len(grams) - span + 1], least[rest : rest + len(grams) - span + 1])
        self.anchor = least[self.at]


def of_document(hashes: np.ndarray, ids: np.ndarray) -> np.ndarray:
    """One number for a window of a document."""
    return mixed(hashes ^ mixed(ids.view(np.uint64), 11), 13)


def _home(ids: np.ndarray, groups: int) -> np.ndarray:
    u = ids.view(np.uint64)
    return ((u ^ (u >> np.uint64(17)) ^ (u >> np.uint64(31))) & np.uint64(2**62 - 1)).astype(np.int64) % groups


def _home_column(name: str, groups: int):
    c = F.col(name)
    folded = c.bitwiseXOR(F.shiftrightunsigned(c, 17)).bitwiseXOR(F.shiftrightunsigned(c, 31)).bitwiseAND(F.lit(2**62 - 1))
    return F.coalesce(folded % groups, F.pmod(F.xxhash64("text"), F.lit(groups))).cast("int")


def _bounds(sorted_keys: np.ndarray) -> list[tuple[int, int]]:
    if not len(sorted_keys):
        return []
    heads = np.flatnonzero(np.r_[True, sorted_keys[1:] != sorted_keys[:-1]])
    return [*zip(heads.tolist(), [*heads[1:].tolist(), len(sorted_keys)])]


def _blobs(values: np.ndarray, bounds: list[tuple[int, int]]) -> pa.Array:
    return pa.array([values[a:b].tobytes() for a, b in bounds], pa.binary())


def _all(table: pa.Table, name: str, kind) -> np.ndarray:
    return np.frombuffer(b"".join(table.column(name).to_pylist()), kind)


def _bits(codes: np.ndarray, size: int) -> list[np.ndarray]:
    c = codes.astype(np.uint64)
    return [(mixed(c, salt) % np.uint64(8 * size)).astype(np.int64) for salt in (1, 2)]


def repeated_anchors(given: DataFrame, buckets: int) -> tuple[np.ndarray, int]:
    """A filter with a segment of ``size`` bytes for each bucket of anchors."""
    size = FILTER_BYTES // buckets

    def make():
        def work(part: pa.RecordBatch) -> dict:
            w = Windows(part.column("text"))
            order = np.lexsort((w.row, w.anchor))
            anchor, row = w.anchor[order], w.row[order]
            new = np.r_[True, (anchor[1:] != anchor[:-1]) | (row[1:] != row[:-1])] if len(anchor) else np.zeros(0, bool)
            values, counts = np.unique(anchor[new], return_counts=True)
            home = (values % np.uint64(buckets)).astype(np.int32)
            order = np.argsort(home, kind="stable")
            home, values, counts = home[order], values[order], counts[order]
            codes = (values >> np.uint64(32)).astype(np.uint32)
            bounds = _bounds(home)
            twice = pa.array([codes[a:b][counts[a:b] > 1].tobytes() for a, b in bounds], pa.binary())
            return {"bucket": pa.array(home[[a for a, _ in bounds]] if bounds else home), "codes": _blobs(codes, bounds), "twice": twice}

        return work

    def segment(table: pa.Table) -> pa.Table:
        codes = np.sort(_all(table, "codes", np.uint32))
        again = np.r_[codes[1:][codes[1:] == codes[:-1]], _all(table, "twice", np.uint32)]
        bits = np.zeros(8 * size, np.uint8)
        for at in _bits(np.unique(again), size):
            bits[at] = 1
        return pa.table({"bucket": table.column("bucket")[:1], "bits": pa.array([np.packbits(bits, bitorder="little").tobytes()], pa.binary())})

    parts = per_slice(given, "text", "bucket int, codes binary, twice binary", make, SLICE).groupBy("bucket").applyInArrow(segment, "bucket int, bits binary")
    found = np.zeros((buckets, size), np.uint8)
    for r in parts.toLocalIterator():  # FILTER_BYTES altogether
        found[r["bucket"]] = np.frombuffer(r["bits"], np.uint8)
    return found.reshape(-1), size


def passages(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_words``, ``n_removed``, ``kept`` (the other words, joined by a
    blank) and ``factors``, in order: words ``first`` up to ``end`` (exclusive) are those of
    document ``source`` from word ``offset`` on."""
    spark = docs.sparkSession
    given = docs.select(F.col(id_col).cast("long").alias("id"), whole(text_col).alias("text"))
    total = given.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    buckets = max(64, -(-total // BUCKET_BYTES))
    groups = (total // GROUP_BYTES) | 1 if total > 64 * GROUP_BYTES else 63
    anchors = 1 << min(16, max(6, int(buckets).bit_length()))
    known = given.where("id is not null")
    bits, size = repeated_anchors(known, anchors)
    seen = spark.sparkContext.broadcast(bits)

    def make():
        bits = seen.value

        def work(part: pa.RecordBatch) -> dict:
            w = Windows(part.column("text"))
            segment = (w.anchor % np.uint64(anchors)).astype(np.int64)
            keep = np.ones(len(w.at), bool)
            for at in _bits((w.anchor >> np.uint64(32)).astype(np.uint32), size):
                keep &= (bits[segment * size + (at >> 3)] >> (at & 7).astype(np.uint8)) & 1 > 0
            row = w.row[keep]
            ids = np.asarray(part.column("id"), dtype=np.int64)[row]
            places = (w.at[keep] - w.words.starts[row]).astype(np.int32)
            found = _Places(w.hash[keep], ids, places, (w.second[keep] % np.uint64(buckets)).astype(np.int64))
            # the smallest document of this slice asks the bucket; the others have their source
            own, other = found.first, ~found.first
            target = np.r_[found.bucket[own], buckets + _home(found.ids[other], groups)]
            codes = np.r_[found.hashes[own], of_document(found.hashes[other], found.ids[other])]
            return _dealt("bucket", target, codes, np.r_[found.ids[own], found.source[other]], np.r_[found.places[own], found.offset[other]])

        return work

    def look_up(table: pa.Table) -> pa.Table:
        bucket = table.column("bucket")[0].as_py()
        codes, ids, places = (_all(table, n, k) for n, k in _ENTRY.items())
        if bucket >= buckets:  # a group of documents whose sources are known
            return pa.table(_dealt("home", np.full(len(codes), bucket - buckets), codes, ids, places))
        found = _Places(codes, ids, places)
        other = ~found.first
        keys = of_document(found.hashes[other], found.ids[other])
        return pa.table(_dealt("home", _home(found.ids[other], groups), keys, found.source[other], found.offset[other]))

    def put_back(left: pa.Table, right: pa.Table) -> pa.Table:
        keys, source, offset = (_all(right, n, k) for n, k in _ENTRY.items())
        order = np.lexsort((offset, source, keys))
        order = order[np.r_[True, keys[order][1:] != keys[order][:-1]]] if len(order) else order
        known = keys[order], source[order], offset[order]
        parts = [_factored(rows, *known) for b in left.combine_chunks().to_batches() for rows in slices(b, "text")]
        return pa.Table.from_batches(parts, _OUT)

    entry = "codes binary, ids binary, places binary"
    met = per_slice(known, "text", f"bucket long, {entry}", make, SLICE).groupBy("bucket")
    back = met.applyInArrow(look_up, f"home int, {entry}")
    dealt = given.withColumn("home", _home_column("id", groups))
    schema = "id long, n_words long, n_removed long, kept string, factors array<struct<first:long,end:long,source:long,offset:long>>"
    return dealt.groupBy("home").cogroup(back.groupBy("home")).applyInArrow(put_back, schema).withColumnRenamed("id", id_col)


_ENTRY = {"codes": np.uint64, "ids": np.int64, "places": np.int32}
"""What travels for each window: to a bucket its hash, document and place; to its document
a key of both, the source and the offset there."""


class _Places:
    """Distinct (bucket, hash, document) with their first place, in order; ``first`` marks
    the smallest document of a hash, ``source`` and ``offset`` are that one's for all."""

    def __init__(self, hashes: np.ndarray, ids: np.ndarray, places: np.ndarray, bucket: np.ndarray | None = None) -> None:
        bucket = np.zeros(len(hashes), np.int64) if bucket is None else bucket
        order = np.lexsort((places, ids, hashes, bucket))
        self.bucket, self.hashes, self.ids, self.places = bucket[order], hashes[order], ids[order], places[order]
        self.first = np.zeros(len(ids), bool)
        if len(ids):
            head = np.r_[True, (self.bucket[1:] != self.bucket[:-1]) | (self.hashes[1:] != self.hashes[:-1])]
            new = head | np.r_[True, self.ids[1:] != self.ids[:-1]]
            self.bucket, self.hashes, self.ids, self.places, self.first = (x[new] for x in (self.bucket, self.hashes, self.ids, self.places, head))
        least = np.flatnonzero(self.first)[np.cumsum(self.first) - 1] if len(ids) else np.zeros(0, np.int64)
        self.source, self.offset = self.ids[least], self.places[least]


def _dealt(key: str, target: np.ndarray, codes: np.ndarray, ids: np.ndarray, places: np.ndarray) -> dict:
    """Entries as one row for each target; neighbours in a source lie side by side."""
    order = np.lexsort((places, ids, target))
    target = target[order]
    bounds = _bounds(target)
    heads = target[[a for a, _ in bounds]] if bounds else target
    blobs = {n: _blobs(x[order].astype(k), bounds) for (n, k), x in zip(_ENTRY.items(), (codes, ids, places))}
    return {key: pa.array(heads.astype(np.int32 if key == "home" else np.int64)), **blobs}


_OUT = pa.schema([("id", pa.int64()), ("n_words", pa.int64()), ("n_removed", pa.int64()), ("kept", pa.string()),
                  ("factors", pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "end", "source", "offset")])))])


def _parsed(w: Windows, hit: np.ndarray, source: np.ndarray, offset: np.ndarray) -> dict[int, list[dict]]:
    """The factors of each row of a slice; the arrays have an entry for each window."""
    at, row = w.at[hit], w.row[hit]
    if not len(at):
        return {}
    source, offset = source[hit], offset[hit].astype(np.int64)
    same = (np.diff(row) == 0) & (np.diff(at) == 1) & (np.diff(source) == 0) & (np.diff(offset) == 1)
    heads = np.flatnonzero(np.r_[True, ~same])
    last = np.r_[heads[1:], len(at)] - 1
    first, end, row = at[heads], at[last] + WINDOW, row[heads]
    # words that the factor before has already taken
    taken = np.r_[0, np.maximum(end[:-1] - first[1:], 0)]
    taken[1:][row[1:] != row[:-1]] = 0
    base = w.words.starts[row]
    columns = (row, first + taken - base, end - base, source[heads], offset[heads] + taken)
    found: dict[int, list[dict]] = {}
    for r, a, b, s, o in zip(*(c.tolist() for c in columns)):
        found.setdefault(r, []).append({"first": a, "end": b, "source": s, "offset": o})
    return found


def _factored(rows: pa.RecordBatch, keys: np.ndarray, source: np.ndarray, offset: np.ndarray) -> pa.RecordBatch:
    w = Windows(rows.column("text"))
    ids = rows.column("id").to_pylist()
    numbers = np.array([i or 0 for i in ids], np.int64)
    mine = of_document(w.hash, numbers[w.row])
    place = np.minimum(np.searchsorted(keys, mine), max(0, len(keys) - 1))
    hit = keys[place] == mine if len(keys) else np.zeros(len(mine), bool)
    hit &= np.array([i is not None for i in ids], bool)[w.row]
    factors = _parsed(w, hit, source[place], offset[place]) if len(keys) else {}
    out: dict[str, list] = {n: [] for n in ("n_words", "n_removed", "kept", "factors")}
    for i, text in enumerate(rows.column("text").to_pylist()):
        words, mine = text.encode().split(), factors.get(i, [])
        kept, done = [], 0
        for f in mine:
            kept += words[done : f["first"]]
            done = f["end"]
        kept = words if not mine else kept + words[done:]
        out["n_words"].append(len(words))
        out["n_removed"].append(len(words) - len(kept))
        out["kept"].append(b" ".join(kept).decode())
        out["factors"].append(mine)
    return pa.RecordBatch.from_arrays([rows.column("id"), *[pa.array(out[n], _OUT.field(n).type) for n in out]], schema=_OUT)
