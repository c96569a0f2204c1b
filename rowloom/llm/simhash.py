"""SimHash fingerprints, links by multi-index hashing, and near-duplicate groups.

``fingerprints`` sums the bits of the hashes of a text's word shingles.

``links`` finds all pairs of fingerprints that differ in at most ``distance`` bits.
The 64 bits are cut into three segments with radii whose sizes add up so that two
linked fingerprints lie, in some segment, within its radius (pigeonhole).  Every
fingerprint enumerates the Hamming ball of that radius in each segment, looks the
values up in that segment's table, and the complete distance is verified in the join
itself, so only true links leave it.  Equal fingerprints are one class and never
expanded into pairs.  Both sides of the join are plain shuffles, which adaptive
execution splits where a value is hot.

``near_copies`` (the pipeline's rule: five-word shingles, similarity 0.8) links two
texts when the Jaccard similarity of their shingle sets is at least 0.8, counted on the
sets themselves.  Fingerprints only find the candidates, and must be wider for it: at
similarity 0.8 about 15 % of the bits differ, so 4 of 64 would miss nearly all.  It uses
128 bits of the distinct shingles in seven segments of 18 and enumerates balls of radius
1 on both sides, so that texts meet when a segment differs in up to two bits; complete
distances of at most ``NEAR_BITS`` make clusters of candidates.  By the usual model
(differing share acos(2s/(1+s))/pi) a pair of similarity 0.8 becomes a candidate with
a chance of 98.6 %, of 0.9 over 99.9 %; the rest is missed unless other links join it.
In a cluster all pairs within ``NEAR_BITS`` are compared that are not joined already.

Null texts count as empty.  Texts without words have fingerprint 0.  A row without id
has its fingerprint and the component of its class.  Repeated rows are copies.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import Words, components, cut, give_back, inside, mixed, packed, per_slice, runs_of, whole

WORDS = 4
SEED = 42
DISTANCE = 4

NEAR_WORDS = 5
NEAR_SHARE = (4, 5)
"""Least Jaccard similarity of a link."""
NEAR_BITS = 30
SEGMENTS, SEGMENT_BITS = 7, 18
BUCKET_ROWS = 150_000
DEAL_ROWS = 2_500
LARGE_RUN = 2_000
LEADERS = 16
BLOCK = 1_000
"""Members of a cluster that a task holds of each side."""

_LOWER = bytes(c + 32 if 65 <= c <= 90 else c for c in range(256))


def majority(hashes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each stretch between starts the bits that are set in over half its hashes."""
    sizes = np.diff(starts)
    out = np.zeros(len(sizes), np.uint64)
    full = np.flatnonzero(sizes > 0)
    if not len(full):
        return out
    # eight bits at a time, one in each byte of a sum of at most 255 hashes
    blocks = -(-sizes[full] // 255)
    first = np.r_[0, np.cumsum(blocks)]
    at = np.repeat(starts[:-1][full], blocks) + 255 * (np.arange(first[-1]) - np.repeat(first[:-1], blocks))
    half = sizes[full]
    for bit in range(8):
        ones = (hashes >> np.uint64(bit)) & np.uint64(0x0101010101010101)
        sums = np.add.reduceat(ones, at).astype("<u8").view(np.uint8).reshape(-1, 8)
        counts = np.add.reduceat(sums, first[:-1], axis=0, dtype=np.int64)
        for byte in range(8):
            out[full] |= (2 * counts[:, byte] > half).astype(np.uint64) << np.uint64(8 * byte + bit)
    return out


def shingle_hashes(text: bytes, width: int, seed: int) -> list[bytes]:
    """XXH64 of the text's shingles as digests, in order; of all words if they are fewer."""
    import xxhash

    words = text.translate(_LOWER).split()
    if not words:
        return []
    joined = b" ".join(words)
    digest = xxhash.xxh64_digest
    if len(words) <= width:
        return [digest(joined, seed)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = np.r_[0, ends[:-1]][: len(words) - width + 1].tolist()
    return [digest(joined[a:b], seed) for a, b in zip(starts, (ends[width - 1 :] - 1).tolist())]


def fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = WORDS, seed: int = SEED) -> DataFrame:
    """``(id_col, fingerprint)``; the fingerprint is the unsigned value's 64 bits."""
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def make():
        def work(part: pa.RecordBatch) -> dict:
            digests = [shingle_hashes(t.encode(), width, seed) for t in part.column("text").to_pylist()]
            starts = np.cumsum([0, *map(len, digests)])
            hashes = np.frombuffer(b"".join(d for of in digests for d in of), ">u8").astype(np.uint64)
            return {"id": part.column("id"), "fingerprint": pa.array(majority(hashes, starts).view(np.int64))}

        return work

    return per_slice(given, "text", f"id {docs.schema[id_col].dataType.simpleString()}, fingerprint long", make).withColumnRenamed("id", id_col)


def segments(distance: int) -> list[tuple[int, int, int]]:
    """(shift, bits, radius) of three segments: their radii plus one add up to more than
    the distance; those with the smaller radius are narrower."""
    least, more = divmod(distance + 1, 3)
    radii = [least - 1] * (3 - more) + [least] * more
    sizes = [20, 22, 22] if radii[0] < radii[-1] else [21, 21, 22]
    shifts = [0, sizes[0], sizes[0] + sizes[1]]
    return [*zip(shifts, sizes, radii)]


def links(classes: DataFrame, distance: int = DISTANCE) -> DataFrame:
    """``(a, b)``: fingerprints of ``classes(fingerprint)``, all different, a < b, that
    differ in at most ``distance`` bits."""
    fp = F.col("fingerprint")
    index, probe = [], []
    for number, (shift, bits, radius) in enumerate(segments(distance)):
        value = F.shiftrightunsigned(fp, shift).bitwiseAND(F.lit((1 << bits) - 1))
        key = lambda v, n=number: v.bitwiseOR(F.lit(n << 32))
        index.append(F.array(key(value)))
        ball = grown = F.array(key(value))
        masks = F.array(*[F.lit(1 << b).cast("long") for b in range(bits)])
        for _ in range(radius):
            grown = F.flatten(F.transform(grown, lambda v: F.transform(masks, lambda m: v.bitwiseXOR(m))))  # noqa: B023
            ball = F.array_distinct(F.concat(ball, grown))
        probe.append(ball)
    table = classes.select(fp.alias("b"), F.explode(F.concat(*index)).alias("key"))
    asked = classes.select(fp.alias("a"), F.explode(F.concat(*probe)).alias("key"))
    near = (F.col("a") < F.col("b")) & (F.bit_count(F.col("a").bitwiseXOR(F.col("b"))) <= distance)
    return asked.join(table, "key").where(near).select("a", "b").distinct()


def groups(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", distance: int = DISTANCE) -> DataFrame:
    """``(id_col, fingerprint, component_id)``: the smallest id that links reach."""
    prints = cut(fingerprints(docs, id_col, text_col))
    classes = cut(prints.groupBy("fingerprint").agg(F.min(id_col).alias("least")))
    pairs = links(classes.select("fingerprint"), distance)
    # components of fingerprints; then the smallest id of each
    reached = components(pairs)
    least = classes.join(reached, classes["fingerprint"] == reached["id"]).groupBy("component").agg(F.min("least").alias("low"))
    of = reached.join(least, "component").select(F.col("id").alias("fingerprint"), "low")
    named = cut(classes.join(of, "fingerprint", "left").select("fingerprint", F.coalesce("low", "least").alias("component_id")))
    return prints.join(named, "fingerprint", "left").select(id_col, "fingerprint", "component_id")


def hex_of(fingerprint: str = "fingerprint"):
    return F.lower(F.lpad(F.hex(fingerprint), 16, "0"))


# ---- near copies by wide fingerprints -------------------------------------------------


def shingle_sets(texts: pa.Array, width: int = NEAR_WORDS) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the distinct shingles of each text, ascending, and where each text starts."""
    seen = Words(pc.ascii_lower(texts))
    n, total = len(seen.starts) - 1, len(seen.hashes)
    at = np.flatnonzero(inside(seen.starts, width, total))
    shingles, owner = runs_of(seen.hashes, width)[at], seen.owner[at]
    short = np.flatnonzero((seen.counts() > 0) & (seen.counts() < width))
    whole_ones = [runs_of(some, len(some)) for some in (seen.hashes[seen.starts[i] : seen.starts[i + 1]] for i in short)]  # fewer words: all of them
    shingles, owner = np.concatenate([shingles, *whole_ones]), np.r_[owner, short]
    order = np.lexsort((shingles, owner))
    shingles, owner = shingles[order], owner[order]
    new = np.ones(len(order), bool)
    new[1:] = (shingles[1:] != shingles[:-1]) | (owner[1:] != owner[:-1])
    return shingles[new], np.r_[0, np.cumsum(np.bincount(owner[new], minlength=n))]


def wide_fingerprints(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", width: int = NEAR_WORDS) -> DataFrame:
    """``(id, text_hash, f1, f2, same, n)``: 128 bits from mixed hashes of the distinct
    shingles, a hash of their set, and how many they are."""
    given = docs.select(F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"), whole(text_col).alias("text"))

    def make():
        def work(part: pa.RecordBatch) -> dict:
            shingles, starts = shingle_sets(part.column("text"), width)
            f = [majority(mixed(shingles, salt), starts).view(np.int64) for salt in (1, 2)]
            sums = np.r_[np.uint64(0), np.cumsum(mixed(shingles, 3), dtype=np.uint64)][starts]
            same = (sums[1:] - sums[:-1]).view(np.int64)
            return {"id": part.column("id"), "text_hash": part.column("text_hash"), "f1": pa.array(f[0]), "f2": pa.array(f[1]), "same": pa.array(same), "n": pa.array(np.diff(starts))}

        return work

    return per_slice(given, "text", f"id {docs.schema[id_col].dataType.simpleString()}, text_hash long, f1 long, f2 long, same long, n long", make)


def _segment(f1: np.ndarray, f2: np.ndarray, k: int) -> np.ndarray:
    at = k * SEGMENT_BITS
    if at >= 64:
        f = f2 >> np.uint64(at - 64)
    elif at + SEGMENT_BITS <= 64:
        f = f1 >> np.uint64(at)
    else:
        f = (f1 >> np.uint64(at)) | (f2 << np.uint64(64 - at))
    return f & np.uint64((1 << SEGMENT_BITS) - 1)


def near_links(classes: DataFrame, bits: int = NEAR_BITS) -> DataFrame:
    """``(a, b)`` of ``classes(id, f1, f2)``: enough links to join all classes that meet
    in some ball and differ in at most ``bits`` bits.

    A row of the shuffle holds all members that one batch has for one bucket of ball
    values.  In a bucket, members with the same value are compared; two that are joined
    already are not compared again.  Values with over ``LARGE_RUN`` members are first
    joined through ``LEADERS`` of them; then each member outside the largest part is
    compared with all that are still apart from it, so no pair is left out.
    """
    n = classes.count()
    per = SEGMENTS * (SEGMENT_BITS + 1)
    buckets = max(64, -(-n * per // BUCKET_ROWS))

    def deal(batches):
        for batch in (b.slice(i, DEAL_ROWS) for b in batches for i in range(0, b.num_rows, DEAL_ROWS)):
            ids = np.asarray(batch.column("id"), dtype=np.int64)
            f1, f2 = (np.asarray(batch.column(c), dtype=np.int64).view(np.uint64) for c in ("f1", "f2"))
            keys = []
            for k in range(SEGMENTS):
                v = _segment(f1, f2, k) | np.uint64(k << 32)
                keys += [v, *[v ^ np.uint64(1 << b) for b in range(SEGMENT_BITS)]]
            keys = np.concatenate(keys)
            who = np.tile(np.arange(len(ids)), per)
            home = (mixed(keys) % np.uint64(buckets)).astype(np.int64)
            order = np.argsort(home, kind="stable")
            heads = np.flatnonzero(np.r_[True, np.diff(home[order]) > 0]) if len(order) else np.zeros(0, np.int64)
            cuts = [*zip(heads, [*heads[1:], len(order)])]
            blob = lambda x: pa.array([x[order[a:b]].tobytes() for a, b in cuts], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(home[order[heads]].astype(np.int32)), blob(keys), blob(ids[who]), blob(f1[who]), blob(f2[who])],
                                             ["bucket", "key", "id", "f1", "f2"])
        give_back()

    def join(table: pa.Table) -> pa.Table:
        column = lambda name, kind: np.frombuffer(b"".join(table.column(name).to_pylist()), kind)
        a, b = linked(column("key", np.uint64), column("id", np.int64), column("f1", np.uint64), column("f2", np.uint64), bits)
        return pa.table({"a": a, "b": b})

    dealt = classes.select("id", "f1", "f2").mapInArrow(deal, "bucket int, key binary, id binary, f1 binary, f2 binary")
    return dealt.groupBy("bucket").applyInArrow(join, "a long, b long")


def linked(key: np.ndarray, ids: np.ndarray, f1: np.ndarray, f2: np.ndarray, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """A star for each group of members that links join."""
    order = np.lexsort((ids, key))
    key, f1, f2 = key[order], f1[order], f2[order]
    names, who = np.unique(ids[order], return_inverse=True)
    root = np.arange(len(names))
    near = lambda i, j: np.bitwise_count(f1[i] ^ f1[j]) + np.bitwise_count(f2[i] ^ f2[j]) <= bits

    def unite(i: np.ndarray, j: np.ndarray) -> None:
        nonlocal root
        for x, y in zip(who[i].tolist(), who[j].tolist()):
            while root[x] != x:
                x = root[x]
            while root[y] != y:
                y = root[y]
            root[max(x, y)] = min(x, y)
        while (root[root] != root).any():
            root = root[root]

    heads = np.flatnonzero(np.r_[True, key[1:] != key[:-1]]) if len(key) else np.zeros(0, np.int64)
    sizes = np.diff(np.r_[heads, len(key)])
    large = np.repeat(sizes > LARGE_RUN, sizes)
    # rows that have a partner at this step in their run
    i = np.arange(len(key) - 1)
    i = i[~large[:-1]] if len(key) else i
    step = 1
    while len(i):
        i = i[i + step < len(key)]
        i = i[key[i] == key[i + step]]
        apart = i[root[who[i]] != root[who[i + step]]]
        hit = apart[near(apart, apart + step)]
        if len(hit):
            unite(hit, hit + step)
        step += 1
    for h, n in zip(heads[sizes > LARGE_RUN], sizes[sizes > LARGE_RUN]):
        run = rest = np.arange(h, h + n)
        for _ in range(LEADERS):
            if len(rest):
                hit = near(rest, rest[0])
                unite(rest[hit], np.full(hit.sum(), rest[0]))
                rest = rest[~hit]
        # of two members that are apart, one is outside the largest part
        _, part, count = np.unique(root[who[run]], return_inverse=True, return_counts=True)
        for x in run[part != count.argmax()]:
            apart = run[root[who[run]] != root[who[x]]]
            hit = apart[near(apart, x)]
            if len(hit):
                unite(hit, np.full(len(hit), x))
    moved = np.flatnonzero(root != np.arange(len(names)))
    return names[moved], names[root[moved]]


def joined(table: pa.Table) -> pa.Table:
    """A star for each group of members, cluster by cluster, that links of at least the
    similarity join.  Rows of ``side`` 1 are compared with those of side 2, rows of side 0
    with each other; members of one ``part`` are joined already."""
    if not table.num_rows:
        return pa.table({"a": pa.array([], pa.int64()), "b": pa.array([], pa.int64())})
    table = table.sort_by([("cluster", "ascending"), ("id", "ascending"), ("side", "ascending")])
    column = lambda name: np.asarray(table.column(name))
    cluster, ids, side, n = column("cluster"), column("id"), column("side"), column("n")
    f1, f2 = column("f1").view(np.uint64), column("f2").view(np.uint64)
    sets = [np.frombuffer(x.as_buffer(), np.uint64) for x in table.column("shingles")]
    names, who = np.unique(np.r_[column("part"), ids], return_inverse=True)
    root = np.arange(len(names))
    who = who[: len(ids)]  # a part stands for its members
    over, under = NEAR_SHARE
    heads = np.flatnonzero(np.r_[True, cluster[1:] != cluster[:-1]])
    for h, end in zip(heads, [*heads[1:], len(cluster)]):
        own = np.arange(h, end)
        left, right = own[side[own] < 2], own[side[own] != 1]
        for x in left:
            some = right[np.searchsorted(right, x + 1) :] if side[x] == 0 else right
            some = some[root[who[some]] != root[who[x]]]
            near = np.bitwise_count(f1[some] ^ f1[x]) + np.bitwise_count(f2[some] ^ f2[x]) <= NEAR_BITS
            some = some[near & (under * n[some] >= over * n[x]) & (under * n[x] >= over * n[some])]
            for y in some:
                if root[who[y]] == root[who[x]]:
                    continue
                small, large = (sets[x], sets[y]) if len(sets[x]) <= len(sets[y]) else (sets[y], sets[x])
                at = np.searchsorted(large, small)
                common = int((large[np.minimum(at, len(large) - 1)] == small).sum()) if len(large) else 0
                if under * common >= over * (len(small) + len(large) - common):
                    low, high = sorted((root[who[x]], root[who[y]]))
                    root[root == high] = low
    moved = np.flatnonzero(root != np.arange(len(names)))
    give_back()
    return pa.table({"a": pa.array(names[moved]), "b": pa.array(names[root[moved]])})


def verified(docs: DataFrame, members: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """``(id, component)`` of ``members(id, cluster, f1, f2, n, doc, text_hash)``: joined by
    links of at least the similarity, among pairs of a cluster within ``NEAR_BITS``.

    Clusters of at most ``BLOCK`` members are compared whole, many in one task.  Larger
    ones are dealt over blocks: first about ``LEADERS`` members are compared with all; then
    each member outside the largest part is compared with all members of other parts, one
    block with one block in a task.  A set travels once for each block that it meets, and
    tasks give back links only, not the pairs that they look at.
    """
    def make():
        def work(part: pa.RecordBatch) -> dict:
            shingles, starts = shingle_sets(part.column("text"))
            return {"id": part.column("id"), "shingles": pa.array([shingles[a:b].tobytes() for a, b in zip(starts[:-1], starts[1:])], pa.binary())}

        return work

    texts = docs.select(F.col(id_col).alias("doc_"), F.xxhash64(F.col(text_col)).alias("hash_"), whole(text_col).alias("text"))
    own = members.join(texts, F.col("doc").eqNullSafe(F.col("doc_")) & (F.col("text_hash") == F.col("hash_"))).select("id", "text")
    sets = per_slice(own, "text", "id long, shingles binary", make).dropDuplicates(["id"])
    size = members.groupBy("cluster").agg(F.count(F.lit(1)).alias("size"))
    blocks, block = F.ceil(F.col("size") / BLOCK).cast("int"), F.pmod(F.xxhash64("id", F.lit(1)), "blocks").cast("int")
    sized = members.join(size, "cluster").join(sets, "id").withColumn("blocks", blocks)
    rows = cut(sized.select("id", "cluster", "f1", "f2", "n", "shingles", "size", "blocks", block.alias("block"), (F.pmod(F.xxhash64("id"), "size") < LEADERS).alias("leads")))
    shape = ["cluster", "id", "part", "n", "f1", "f2", "shingles"]

    def compared(given: DataFrame) -> DataFrame:
        return given.groupBy("home", "i", "j").applyInArrow(joined, "a long, b long")

    # the homes of small clusters hold about a block of members each
    homes = max(1, members.count() // BLOCK)
    every = rows.withColumn("part", F.col("id"))
    small = every.where("blocks = 1").select(F.pmod(F.xxhash64("cluster"), F.lit(homes)).alias("home"), F.lit(-1).alias("i"), F.lit(-1).alias("j"), *shape, F.lit(0).alias("side"))
    large = every.where("blocks > 1")
    leaders = large.where("leads").select(F.col("cluster").alias("home"), F.lit(0).alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *shape, F.lit(1).alias("side"))
    led = large.select(F.col("cluster").alias("home"), F.lit(0).alias("i"), F.col("block").alias("j"), *shape, F.lit(2).alias("side"))
    first = cut(compared(small.union(leaders).union(led)))
    reached = cut(components(first))
    parts = rows.where("blocks > 1").join(reached, "id", "left").withColumn("part", F.coalesce("component", "id")).drop("component")
    parts = cut(parts)
    counts = parts.groupBy("cluster", "part").agg(F.count(F.lit(1)).alias("k"))
    largest = counts.groupBy("cluster").agg(F.max_by("part", F.struct("k", "part")).alias("largest"), (F.sum("k") - F.max("k")).alias("outside")).where("outside > 0")
    apart = parts.join(largest, "cluster").withColumn("lots", F.ceil(F.col("outside") / BLOCK).cast("int"))
    lone = apart.where("part <> largest and not leads")
    lot = F.pmod(F.xxhash64("id", F.lit(2)), "lots").cast("int")
    lone = lone.select(F.col("cluster").alias("home"), lot.alias("i"), F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)).alias("j"), *shape, F.lit(1).alias("side"))
    met = apart.where("not leads").select(F.col("cluster").alias("home"), F.explode(F.sequence(F.lit(0), F.col("lots") - 1)).alias("i"), F.col("block").alias("j"), *shape, F.lit(2).alias("side"))
    rest = cut(compared(lone.union(met)))
    return reached if rest.isEmpty() else components(first.union(rest))


def near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """``(id, text_hash, group, stays)`` per distinct (id, text): the group's smallest id
    stays."""
    prints = cut(wide_fingerprints(docs, id_col, text_col))
    row = F.struct(F.col("id").isNull().alias("none"), "id", "text_hash")
    # texts with the same set of shingles
    of = ["f1", "f2", "same", "n"]
    classes = prints.groupBy(*of).agg(F.min(row).alias("first"))
    number = F.coalesce(F.col("first.id").cast("long"), F.xxhash64(*of))
    classes = cut(classes.select(*of, number.alias("number"), "first"))
    # the same id in several classes: the classes keep apart by their fingerprints
    nodes = cut(classes.groupBy("number").agg(F.min(F.struct(*of)).alias("of")))
    classes = classes.join(nodes, "number").select(*of, "first", F.when(F.struct(*of) == F.col("of"), F.col("number")).otherwise(F.xxhash64(*of, "number")).alias("id"))
    classes = cut(classes)
    clusters = components(near_links(classes))
    members = cut(classes.join(clusters, "id").select("id", F.col("component").alias("cluster"), "f1", "f2", "n", F.col("first.id").alias("doc"), F.col("first.text_hash").alias("text_hash")))
    reached = verified(docs, members, id_col, text_col)
    return classes.join(reached, "id", "left").select(F.col("first.id").alias("id"), F.col("first.text_hash").alias("text_hash"), (F.coalesce("component", "id")).alias("group"), (F.coalesce("component", "id") == F.col("id")).alias("stays"))


def without_near_copies(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """The rows of ``docs``, one of each group of copies and near copies."""
    stays = near_copies(docs, id_col, text_col).where("stays").select(F.col("id").alias("id_"), F.col("text_hash").alias("text_hash_"))
    keyed = docs.select(packed(docs, docs.columns), F.col(id_col).alias("id"), F.xxhash64(F.col(text_col)).alias("text_hash"))
    same = keyed["id"].eqNullSafe(F.col("id_")) & (keyed["text_hash"] == F.col("text_hash_"))
    return keyed.join(stays, same).dropDuplicates(["id", "text_hash"]).select("row.*")
