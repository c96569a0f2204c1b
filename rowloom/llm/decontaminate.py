"""Benchmark passages in documents: one Aho-Corasick automaton over the normalised
words of all test items, run once over each document.

Normalising replaces, byte for byte, everything but digits, letters and non-ASCII
characters by a blank and lowers A-Z; words are then numbered by the items'
vocabulary and the automaton reads numbers.  Word places map back to code points of
the original text.

Null and empty texts have no words, so no hits; an item without words never hits; an
item without an id hits but is not named.  Repeated rows are treated alike, each
alone.  Texts are read whole.
"""

from __future__ import annotations

import re
from collections.abc import Iterable, Sequence

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from rowloom.llm.common import packed, per_slice, whole

WINDOW = 13
SHARD_WORDS = 200_000
"""Words of test items in one automaton, and so in one broadcast (about 100 MB in a
task).  More items than that are scanned for in further passes; each pass adds to
the hits of those before."""

_BLANKED = bytes(c + 32 if 65 <= c <= 90 else c if c >= 128 or chr(c).isalnum() else 32 for c in range(256))
_WORD = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+")


def normalised(text: str) -> list[bytes]:
    return text.encode("utf-8", "surrogatepass").translate(_BLANKED).split()


class Scanner:
    def __init__(self, items: Iterable[tuple[str | None, str]], window: int = WINDOW) -> None:
        import ahocorasick

        self.numbers: dict[bytes, int] = {}
        self.window, self.names = window, []
        owners: dict[tuple[int, ...], set[int]] = {}
        for name, text in items:
            words = tuple(self.numbers.setdefault(w, len(self.numbers) + 1) for w in normalised(text))
            if words:
                self.names.append(name)
                for i in range(max(1, len(words) - window + 1)):
                    owners.setdefault(words[i : i + window], set()).add(len(self.names) - 1)
        self.automaton = ahocorasick.Automaton(ahocorasick.STORE_ANY, ahocorasick.KEY_SEQUENCE)
        for words, of in owners.items():
            self.automaton.add_word(words, (len(words), of))
        if owners:
            self.automaton.make_automaton()
        self.empty = not owners

    def scan(self, words: list[bytes]) -> tuple[list[list[int]], set[str]]:
        """Hit stretches of words as [first, end), joined where they touch; named items."""
        spans: list[list[int]] = []
        named: set[str] = set()
        if self.empty:
            return spans, named
        number = self.numbers.get
        for last, (size, of) in self.automaton.iter(tuple([number(w, 0) for w in words])):
            first, end = last - size + 1, last + 1
            named.update(self.names[i] for i in of if self.names[i] is not None)
            while spans and spans[-1][1] >= first:
                first = min(first, spans.pop()[0])
            spans.append([first, end])
        return spans, named


def joined(spans: list[list[int]]) -> list[list[int]]:
    out: list[list[int]] = []
    for first, end in sorted(spans):
        if out and out[-1][1] >= first:
            out[-1][1] = max(out[-1][1], end)
        else:
            out.append([first, end])
    return out


SCHEMA = "n_words long, n_hit long, items array<string>, spans array<struct<first:long,end:long,start:long,stop:long>>"


def contamination(docs: DataFrame, items: DataFrame, carry: Sequence[str] = ("doc_id",), text_col: str = "text",
                  item_col: str = "item_id", item_text: str = "text", window: int = WINDOW) -> DataFrame:
    """Per document: ``row`` with the carried columns, words, words inside an occurrence
    of an item's window, the items that occur, and the hit stretches in words and in
    code points."""
    tests = items.select(F.col(item_col).cast("string").alias("name"), whole(item_text).alias("text"))
    sized = F.size(F.split("text", r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"))
    shards = max(1, -(-(tests.agg(F.sum(sized)).first()[0] or 0) // SHARD_WORDS))
    spark = docs.sparkSession
    out = docs.select(packed(docs, carry), whole(text_col).alias("text"), F.lit(None).cast("array<struct<first:long,end:long>>").alias("had"), F.lit(None).cast("array<string>").alias("named"))
    for shard in range(shards):
        mine = tests if shards == 1 else tests.where(F.pmod(F.xxhash64("name", "text"), F.lit(shards)) == shard)
        known = spark.sparkContext.broadcast([(r["name"], r["text"]) for r in mine.select("name", "text").distinct().toLocalIterator()])
        out = _pass(out, known, window, shard == shards - 1)
    return out


def without_contaminated(docs: DataFrame, items: DataFrame, text_col: str = "text", **names: str) -> DataFrame:
    """The rows of ``docs`` that are not contaminated."""
    return contamination(docs, items, docs.columns, text_col, **names).where(~is_contaminated()).select("row.*")


def _pass(rows: DataFrame, known, window: int, last: bool) -> DataFrame:
    def make():
        scanner = Scanner(known.value, window)

        def work(part: pa.RecordBatch) -> dict:
            texts = part.column("text").to_pylist()
            had, named = part.column("had").to_pylist(), part.column("named").to_pylist()
            found: dict[str, list] = {n: [] for n in ("n_words", "n_hit", "items", "spans", "had", "named")}
            for text, old, names in zip(texts, had, named):
                words = normalised(text)
                spans, items = scanner.scan(words)
                if old:
                    spans = joined(spans + [[s["first"], s["end"]] for s in old])
                items |= set(names or ())
                if not last:
                    found["had"].append([{"first": a, "end": b} for a, b in spans])
                    found["named"].append(sorted(items))
                    continue
                found["n_words"].append(len(words))
                found["n_hit"].append(sum(b - a for a, b in spans))
                found["items"].append(sorted(items))
                places = [m.span() for m in _WORD.finditer(text)] if spans else []
                found["spans"].append([{"first": a, "end": b, "start": places[a][0], "stop": places[b - 1][1]} for a, b in spans])
            out = {"row": part.column("row"), "text": part.column("text")}
            span = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "end")]))
            if not last:
                return out | {"had": pa.array(found["had"], span), "named": pa.array(found["named"], pa.list_(pa.string()))}
            full = pa.list_(pa.struct([(n, pa.int64()) for n in ("first", "end", "start", "stop")]))
            return out | {"n_words": pa.array(found["n_words"], pa.int64()), "n_hit": pa.array(found["n_hit"], pa.int64()),
                          "items": pa.array(found["items"], pa.list_(pa.string())), "spans": pa.array(found["spans"], full)}

        return work

    more = SCHEMA if last else "text string, had array<struct<first:long,end:long>>, named array<string>"
    schema = StructType([rows.schema["row"], *StructType.fromDDL(more).fields])
    return per_slice(rows, "text", schema, make)


def is_contaminated(n_hit: str = "n_hit", n_words: str = "n_words"):
    """Hit, and at least one word in twenty."""
    return (F.col(n_hit) > 0) & (20 * F.col(n_hit) >= F.col(n_words))
