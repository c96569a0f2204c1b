"""Quality rules: counts of lines, symbols and repeats, and how far a document's
characters and common words diverge from its language.

The references are the character classes and the ``COMMON`` most frequent words of
each language over all documents; a document is compared with that of its ``lang``
(none or unknown: with all documents together) by Jensen-Shannon distance, base 2,
from 0 to 1.  Short texts diverge by chance, so below ``MIN_CHARS`` or ``MIN_WORDS``
the respective distance is not judged.

Null texts count as empty: all counts 0, distances null, failed for too few words.
Each row is judged alone; repeated rows get equal verdicts.  With no documents there
are no references and no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, Window, functions as F

from rowloom.llm.common import Words, give_back, inside, mixed, runs_of, slices, whole

WINDOW = 8
COMMON = 64
MIN_CHARS, MIN_WORDS = 200, 60
MAX_CHARS_DISTANCE, MAX_WORDS_DISTANCE = 0.28, 0.72
ANY = ""
"""The reference of all languages together."""
DEALT = 256
"""Parts in which a language's words are cut before they meet."""
MAX_LANGUAGES = 1000
"""References are broadcast, so their number is checked."""

CLASSES = ("lower", "upper", "digit", "blank", "line", "mark", "symbol", "other")


def _class_of(byte: int) -> int:
    c = chr(byte)
    if byte >= 192:  # the first byte of a character beyond ASCII
        return 7
    if byte >= 128:
        return 8
    if c.islower():
        return 0
    if c.isupper():
        return 1
    if c.isdigit():
        return 2
    if c in "\n\r":
        return 4
    if c.isspace():
        return 3
    return 5 if c in ".,;:!?'\"()-" else 6


_CLASS = bytes(map(_class_of, range(256)))
_BLANKS, _SYMBOLS = b" \t\n\r\x0b\x0c", b"#*$%&|<>"


def class_counts(text: bytes) -> np.ndarray:
    return np.bincount(np.frombuffer(text.translate(_CLASS), np.uint8), minlength=9)[:8]


def js_distance(counts: np.ndarray, reference: np.ndarray) -> np.ndarray:
    """Of each row of counts to the reference; NaN for a row without counts."""
    total = counts.sum(-1, keepdims=True)
    with np.errstate(divide="ignore", invalid="ignore"):
        p = counts / total
        q = reference / max(reference.sum(), 1)
        m = (p + q) / 2
        kl = lambda x: np.where(x > 0, x * np.log2(x / m), 0).sum(-1)
        return np.sqrt(np.clip((kl(p) + kl(q + 0 * p)) / 2, 0, 1)) + 0 * total[..., 0] / total[..., 0]


def references(docs: DataFrame, text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """``(lang, kind, key, n)``: character classes and the most frequent words, counted
    over all documents; lang is "" for all of them together."""

    def count(batches):
        words: dict[str, dict[str, int]] = {}
        chars: dict[str, np.ndarray] = {}
        held = 0

        def rows():
            out = [(g, "word", w, n) for g, of in words.items() for w, n in of.items()]
            out += [(g, "char", c, int(n)) for g, of in chars.items() for c, n in zip(CLASSES, of) if n]
            words.clear(), chars.clear()
            if out:
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in zip(*out)], ["lang", "kind", "key", "n"])

        for batch in batches:
            for part in slices(batch, "text"):
                langs = part.column("lang").to_pylist()
                for lang, text in zip(langs, part.column("text").to_pylist()):
                    chars[lang] = chars.get(lang, 0) + class_counts(text.encode())
                seen = Words(pc.ascii_lower(part.column("text")))
                vocabulary = seen.vocabulary.to_pylist()
                code = {g: i for i, g in enumerate(dict.fromkeys(langs))}
                group = np.array([code[g] for g in langs])[seen.owner] if len(seen.ids) else np.zeros(0, np.int64)
                for g, i in code.items():
                    n = np.bincount(seen.ids[group == i], minlength=len(vocabulary))
                    of = words.setdefault(g, {})
                    for k in np.flatnonzero(n):
                        of[vocabulary[k]] = of.get(vocabulary[k], 0) + int(n[k])
                held = sum(map(len, words.values()))
                if held > 200_000:
                    yield from rows()
        yield from rows()
        give_back()

    given = docs.select(whole(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(ANY)).alias("lang"))
    counted = given.mapInArrow(count, "lang string, kind string, key string, n long").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    # the list of all languages is cut from complete counts, as each language's own is
    both = F.explode(F.when(F.col("lang") == ANY, F.array("lang")).otherwise(F.array("lang", F.lit(ANY)))).alias("lang")
    totals = counted.select(both, "kind", "key", "n").groupBy("lang", "kind", "key").agg(F.sum("n").alias("n"))
    return most(most(totals.withColumn("deal", F.spark_partition_id() % DEALT), "lang", "kind", "deal"), "lang", "kind").drop("deal")


def most(counts: DataFrame, *group: str) -> DataFrame:
    """The ``COMMON`` most frequent keys of each group.  Cut in parts first, so that the
    most frequent language's lists of all partitions do not meet in one task."""
    top = Window.partitionBy(*group).orderBy(F.desc("n"), "key")
    return counts.withColumn("r", F.row_number().over(top)).where(F.col("r") <= COMMON).drop("r")


def quality(docs: DataFrame, refs: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang") -> DataFrame:
    """Per document: the counts, the two distances, and the reasons to reject it."""
    rows = refs.limit(MAX_LANGUAGES * (COMMON + 8) + 1).collect()
    if len(rows) > MAX_LANGUAGES * (COMMON + 8):
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    chars: dict[str, np.ndarray] = {}
    words: dict[str, dict[str, int]] = {}
    for r in rows:
        if r["kind"] == "char":
            chars.setdefault(r["lang"], np.zeros(8))[CLASSES.index(r["key"])] = r["n"]
        else:
            words.setdefault(r["lang"], {})[r["key"]] = r["n"]
    known = docs.sparkSession.sparkContext.broadcast((chars, words))
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"), F.coalesce(F.col(lang_col).cast("string"), F.lit(ANY)).alias("lang"))
    schema = (f"id {docs.schema[id_col].dataType.simpleString()}, n_words long, word_chars long, n_symbols long, "
              "n_dup_lines long, n_repeat_words long, chars_distance double, words_distance double")

    def run(batches):
        judge = Judge(*known.value)
        for batch in batches:
            for part in slices(batch, "text"):
                yield judge(part)
        give_back()

    found = given.mapInArrow(run, schema).withColumnRenamed("id", id_col)
    few = F.col("n_words") < 20
    repeats = 100 * F.col("n_repeat_words") > 30 * F.col("n_words")
    reasons = F.array_compact(F.array(
        F.when(few, "few_words"), F.when(repeats, "repeats"),
        F.when(F.col("chars_distance") > MAX_CHARS_DISTANCE, "characters"), F.when(F.col("words_distance") > MAX_WORDS_DISTANCE, "words")))
    return found.withColumn("base_failed", few | repeats).withColumn("reasons", reasons)


class Judge:
    def __init__(self, chars: dict[str, np.ndarray], words: dict[str, dict[str, int]]) -> None:
        self.chars = chars
        self.words = {g: {w: i for i, w in enumerate(of)} for g, of in words.items()}
        self.shares = {g: np.array([*of.values()], float) for g, of in words.items()}

    def __call__(self, part: pa.RecordBatch) -> pa.RecordBatch:
        texts, langs = part.column("text").to_pylist(), part.column("lang").to_pylist()
        seen = Words(part.column("text"))
        counts, n, total = seen.counts(), len(texts), len(seen.ids)
        raw = [t.encode() for t in texts]
        blanks = [len(b) - len(b.translate(None, _BLANKS)) for b in raw]
        symbols = [len(b) - len(b.translate(None, _SYMBOLS)) for b in raw]
        lines = []
        for t in texts:
            full = [x for x in t.split("\n") if x.strip(" \t\r\x0b\x0c")] if "\n" in t else ()
            lines.append(len(full) - len(set(full)))
        repeats = self.repeated(seen, n)
        classes = np.array([class_counts(b) for b in raw]).reshape(n, 8)
        of_chars, of_words = np.full(n, np.nan), np.full(n, np.nan)
        vocabulary = pc.ascii_lower(seen.vocabulary).to_pylist()
        for lang in dict.fromkeys(langs):
            mine = np.array([g == lang for g in langs])
            g = lang if lang in self.chars else ANY
            if g in self.chars:
                of_chars[mine] = js_distance(classes[mine], self.chars[g])
            if g in self.words:
                place, share = self.words[g], self.shares[g]
                table = np.array([place.get(w, -1) for w in vocabulary], np.int64)
                at = table[seen.ids] if total else np.zeros(0, np.int64)
                row = np.cumsum(mine) - 1
                use = (at >= 0) & mine[seen.owner] if total else np.zeros(0, bool)
                hist = np.bincount(row[seen.owner[use]] * len(share) + at[use], minlength=int(mine.sum()) * len(share))
                of_words[mine] = js_distance(hist.reshape(-1, len(share)), share)
                none = mine & (counts >= MIN_WORDS) & np.isnan(of_words)  # words enough, but no common one
                of_words[none] = 1.0
        sizes = np.array([len(t) for t in texts])
        of_chars[sizes < MIN_CHARS] = np.nan
        of_words[counts < MIN_WORDS] = np.nan
        null = lambda x: pa.array(x, pa.float64(), mask=np.isnan(x))
        columns = [part.column("id"), pa.array(counts), pa.array(sizes - np.array(blanks)) if n else pa.array([], pa.int64()), pa.array(symbols, pa.int64()),
                   pa.array(lines, pa.int64()), pa.array(repeats, pa.int64()), null(of_chars), null(of_words)]
        return pa.RecordBatch.from_arrays(columns, ["id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "chars_distance", "words_distance"])

    @staticmethod
    def repeated(seen: Words, n: int) -> np.ndarray:
        """Words of each text inside windows that the text has twice or more."""
        total = len(seen.hashes)
        windows, ok = runs_of(seen.hashes, WINDOW), inside(seen.starts, WINDOW, total)
        at = np.flatnonzero(ok)
        keys = mixed(windows[at] ^ mixed(seen.owner[at].astype(np.uint64), 3), 5)
        order = np.argsort(keys)
        same = keys[order][1:] == keys[order][:-1]
        twice = np.zeros(len(at), bool)
        twice[order[1:][same]] = True
        twice[order[:-1][same]] = True
        edge = np.zeros(total + 1, np.int64)
        np.add.at(edge, at[twice], 1)
        np.add.at(edge, at[twice] + WINDOW, -1)
        covered = np.cumsum(edge[:-1]) > 0
        return np.bincount(seen.owner[covered], minlength=n) if total else np.zeros(n, np.int64)
