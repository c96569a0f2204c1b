"""Secrets in texts, and how widely each is copied.

All of it is DataFrame expressions.  Places come from two readings of a text by the
same pattern: the pieces between matches and the matches, whose lengths add up to the
code points before each match.

A credential that many owners share is an example from a manual; one that belongs to
one or two owners may be live.  So every candidate's hash is aggregated over the whole
corpus to the number of distinct owners and repositories.  ``opaque`` strings (long,
with upper and lower case letters and digits, outside other spans) become spans only
when they are not widely copied (over many owners, or by one owner into very many
repositories); the spans of the fixed kinds stay in any case and are
marked as ``live`` or not.

A hash may stand in any share of the rows: it is pre-aggregated per owner and
repository, and the widely shared hashes, few as each has many owners, are dealt out
in ``SALTS`` copies for the way back.

Null texts count as empty: no spans.  Repeated rows are kept and each gets its result;
owners or repositories that are null count as one.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.llm.common import cut, packed, whole

MAX_OWNERS = 2
"""A value with more owners than this is widely copied."""
MAX_PER_OWNER = 50
"""And so is one in more repositories than this for each of its owners."""
SALTS = 64

# Fixed patterns: kind, pattern, group with the value, least length of the value.
ASSIGN = r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)"""
ACCESS = r"AKIA[A-Z0-9]{16,}"
HEX = r"[0-9a-f]{24,}"
OPAQUE = r"(?<![A-Za-z0-9+/_-])(?=[A-Za-z+/_-]*[0-9])(?=[a-z0-9+/_-]*[A-Z])(?=[A-Z0-9+/_-]*[a-z])[A-Za-z0-9+/_-]{20,}"
KINDS = [("assign", ASSIGN, 1, 6), ("access", ACCESS, 0, 20), ("hex", HEX, 0, 24), ("opaque", OPAQUE, 0, 20)]
BASE = 3
"""The first kinds, whose spans always stay."""


def _found(text: Column, rank: int) -> Column:
    """Spans of a kind: rank, start, end, value hash and whether it looks live."""
    name, pattern, group, least = KINDS[rank]
    whole_match = F.regexp_extract_all(text, F.lit(pattern), F.lit(0))
    value = F.regexp_extract_all(text, F.lit(pattern), F.lit(group)) if group else whole_match
    between = F.split(text, pattern, -1)
    pieces = F.arrays_zip(whole_match.alias("m"), value.alias("v"), F.slice(between, 1, F.size(whole_match)).alias("p"))

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.char_length(x["p"])
        end = start + F.char_length(x["m"])
        v = x["v"]
        live = v.rlike("[0-9]") & v.rlike("[A-Za-z]") & ~v.rlike(r"(?i)example|changeme|placeholder|your|xxxx|0000|1234") & (F.size(F.array_distinct(F.split(v, ""))) >= 6)
        span = F.struct(F.lit(rank).alias("rank"), start.cast("long").alias("start"), end.cast("long").alias("end"), F.xxhash64(v).alias("hash"), live.alias("live"))
        return F.struct(end.alias("at"), F.when(F.char_length(v) >= least, F.concat(acc["out"], F.array(span))).otherwise(acc["out"]).alias("out"))

    none = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<rank:int,start:bigint,end:bigint,hash:bigint,live:boolean>>").alias("out"))
    return F.when(F.size(whole_match) > 0, F.aggregate(pieces, none, step, lambda acc: acc["out"])).otherwise(none["out"])


def candidates(text: Column) -> Column:
    """All spans in order of start, then kind; opaque ones only outside the others."""
    base = F.flatten(F.array(*[_found(text, k) for k in range(BASE)]))
    extra = F.filter(_found(text, BASE), lambda x: x["live"] & ~F.exists(base, lambda b: (b["start"] < x["end"]) & (x["start"] < b["end"])))
    by_place = lambda a, b: F.when(a["start"] != b["start"], F.when(a["start"] < b["start"], -1).otherwise(1)).otherwise(a["rank"] - b["rank"])
    return F.array_sort(F.concat(base, extra), by_place)


def ownership(found: DataFrame) -> DataFrame:
    """``(hash, owners, repositories)`` from rows of ``hash, owner, repository``."""
    each = found.groupBy("hash", "owner", "repository").agg(F.lit(1).alias("one"))
    per_owner = each.groupBy("hash", "owner").agg(F.count(F.lit(1)).alias("n"))
    return per_owner.groupBy("hash").agg(F.count(F.lit(1)).alias("owners"), F.sum("n").alias("repositories"))


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source", repository_col: str | None = None,
            max_owners: int = MAX_OWNERS, max_per_owner: int = MAX_PER_OWNER) -> DataFrame:
    """Per document: ``id_col``, ``text_hash`` and ``spans`` in order: rank (of
    ``KINDS``), start, end, live (looks live, is owned by few and not copied widely:
    neither into more repositories than ``max_per_owner`` for each of its owners)."""
    owner, repository = F.col(owner_col).cast("string"), F.col(repository_col or id_col).cast("string")
    text = F.col("text_")
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text_"), owner.alias("owner"), repository.alias("repository"))
    # rows without text, so small; the cut also fixes the row numbers
    found = cut(given.select(F.monotonically_increasing_id().alias("row"), "id", "owner", "repository", F.xxhash64("text_").alias("text_hash"), candidates(text).alias("found")))
    some = found.where(F.size("found") > 0)
    each = some.select("row", "owner", "repository", F.explode(F.array_distinct(F.col("found.hash"))).alias("hash"))
    copied = (F.col("owners") > max_owners) | (F.col("repositories") > max_per_owner * F.col("owners"))
    shared = ownership(each).where(copied).select("hash", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1))).alias("salt"))
    salted = each.select("row", "hash", F.pmod(F.xxhash64("row"), F.lit(SALTS)).cast("int").alias("salt"))
    wide = salted.join(shared, ["hash", "salt"]).groupBy("row").agg(F.collect_set("hash").alias("wide"))
    joined = found.join(wide, "row", "left")
    owned = lambda x: x["live"] & ~F.coalesce(F.array_contains("wide", x["hash"]), F.lit(False))
    marked = F.transform("found", lambda x: F.struct(x["rank"].alias("rank"), x["start"].alias("start"), x["end"].alias("end"), owned(x).alias("live")))
    kept = F.filter(marked, lambda x: (x["rank"] < BASE) | x["live"])
    return joined.select(F.col("id").alias(id_col), "text_hash", kept.alias("spans"))


def span_list(spans: Column) -> Column:
    """``kind:start:end``, joined by commas."""
    names = F.array(*[F.lit(k[0]) for k in KINDS])
    return F.array_join(F.transform(spans, lambda x: F.concat_ws(":", F.element_at(names, x["rank"] + 1), x["start"].cast("string"), x["end"].cast("string"))), ",")


def base_spans(spans: Column) -> Column:
    return F.filter(spans, lambda x: x["rank"] < BASE)


def masked(text: Column, spans: Column, mask: str = "[secret]") -> Column:
    """The text with every span replaced; overlapping spans become one mask."""
    def step(acc: Column, x: Column) -> Column:
        fresh = x["start"] >= acc["at"]
        piece = F.when(fresh, F.concat(F.substring(text, (acc["at"] + 1).cast("int"), (x["start"] - acc["at"]).cast("int")), F.lit(mask))).otherwise("")
        return F.struct(F.greatest(acc["at"], x["end"]).alias("at"), F.concat(acc["out"], piece).alias("out"))

    start = F.struct(F.lit(0).cast("long").alias("at"), F.lit("").alias("out"))
    rest = lambda acc: F.concat(acc["out"], F.substring(text, (acc["at"] + 1).cast("int"), F.char_length(text)))
    return F.when(F.size(spans) > 0, F.aggregate(spans, start, step, rest)).otherwise(text)


def without_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", owner_col: str = "source") -> DataFrame:
    """The rows of ``docs`` with every span masked."""
    found = secrets(docs, id_col, text_col, owner_col).where(F.size("spans") > 0)
    # equal rows have equal spans
    spans = cut(found.groupBy(F.col(id_col).alias("id_"), F.col("text_hash").alias("hash_")).agg(F.first("spans").alias("spans_")))
    keyed = docs.select(packed(docs, docs.columns), F.col(id_col).alias("id"), F.xxhash64(whole(text_col)).alias("hash"))
    joined = keyed.join(spans, F.col("id").eqNullSafe(F.col("id_")) & (F.col("hash") == F.col("hash_")), "left")
    given = F.col("row")[text_col]
    text = F.when(F.col("spans_").isNull(), given).otherwise(masked(given, F.col("spans_")))
    return joined.select(*[text.alias(c) if c == text_col else F.col("row")[c].alias(c) for c in docs.columns])
