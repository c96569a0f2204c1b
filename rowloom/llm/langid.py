"""Language identification by compression: the language whose dictionary makes a
text smallest.

A raw-content zstandard dictionary for each language is joined from texts of at most
``SAMPLE_TEXTS`` labelled documents (those with the least hashes of id and text, so
the choice is the same at every size and layout), an equal share of each up to
``DICTIONARY`` bytes.  A text is compressed whole, in blocks of ``BLOCK`` bytes, once
for each language.  If the second smallest is not larger by ``MARGIN``, the result is
marked as rejected; the best guess stays in ``lang_pred``.

Null texts and texts without a letter are ``und`` with score 0.  With no labelled
document every text is ``und``.  Equal sizes: the first language by name.
"""

from __future__ import annotations

import pyarrow as pa
import regex
from pyspark.sql import DataFrame, Window, functions as F

from rowloom.llm.common import per_slice, whole

SAMPLE_TEXTS = 400
DICTIONARY = 100_000
BLOCK = 8_000
LEVEL = 6
MARGIN = 0.01
DEALT = 16
"""Parts in which the sampled texts of a language are cut before they meet."""
MAX_LANGUAGES = 200
"""Languages are broadcast with a dictionary each, so their number is checked."""

_LETTER = regex.compile(r"\p{L}")


def language_texts(docs: DataFrame, text_col: str = "text", lang_col: str = "lang", id_col: str = "doc_id") -> dict[str, bytes]:
    """The dictionary of each language, from labelled documents."""
    share = 2 * DICTIONARY // SAMPLE_TEXTS
    given = docs.where(F.col(lang_col).isNotNull()).select(
        F.col(lang_col).cast("string").alias("lang"), F.xxhash64(F.col(id_col), F.col(text_col)).alias("h"), whole(text_col).alias("text")).where("trim(text) <> ''")
    # a part from the middle: first lines are the likeliest to be headings and licenses
    part = given.select("lang", "h", F.expr(f"substring(text, cast(greatest(1, (length(text) - {share}) / 2) as int), {share})").alias("text"))
    # cut in parts first, so that the texts of all partitions do not meet in one task
    chosen = part.withColumn("deal", F.spark_partition_id() % DEALT)
    for group in (["lang", "deal"], ["lang"]):
        order = Window.partitionBy(*group).orderBy("h", "text")
        chosen = chosen.withColumn("r", F.row_number().over(order)).where(F.col("r") <= SAMPLE_TEXTS)
    rows = chosen.select("lang", "r", "text").limit(MAX_LANGUAGES * SAMPLE_TEXTS + 1).collect()
    if len(rows) > MAX_LANGUAGES * SAMPLE_TEXTS:
        raise ValueError(f"more than {MAX_LANGUAGES} languages")
    out: dict[str, bytes] = {}
    for r in sorted(rows, key=lambda r: (r["lang"], -r["r"])):
        out[r["lang"]] = (out.get(r["lang"], b"") + r["text"].encode() + b"\n")[-DICTIONARY:]
    return out


class Sizes:
    """Compressed size of a text with each language's dictionary."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        import zstandard as z

        options = dict(write_content_size=False, write_checksum=False, write_dict_id=False)
        self.languages = sorted(dictionaries)
        self.by = []
        for name in self.languages:
            d = z.ZstdCompressionDict(dictionaries[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            d.precompute_compress(level=LEVEL)
            self.by.append(z.ZstdCompressor(level=LEVEL, dict_data=d, **options))

    def __call__(self, text: str) -> list[int]:
        raw = text.encode()
        blocks = [raw[i : i + BLOCK] for i in range(0, len(raw), BLOCK)]
        return [sum(len(c.compress(b)) for b in blocks) for c in self.by]


def languages(docs: DataFrame, dictionaries: dict[str, bytes], id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``lang_pred``, ``score`` (0: as likely another, 1: far from all
    others), ``margin`` and ``rejected``."""
    known = docs.sparkSession.sparkContext.broadcast(dictionaries)
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def make():
        sizes = Sizes(known.value)

        def work(part: pa.RecordBatch) -> dict:
            out: dict[str, list] = {"lang_pred": [], "score": [], "margin": [], "rejected": []}
            for text in part.column("text").to_pylist():
                lang, score, margin = "und", 0.0, 0.0
                if sizes.languages and _LETTER.search(text):
                    found = sizes(text)
                    best, *rest = sorted(zip(found, sizes.languages))
                    margin = (rest[0][0] - best[0]) / rest[0][0] if rest else 1.0
                    lang, score = best[1], margin / (margin + 4 * MARGIN)
                out["lang_pred"].append(lang)
                out["score"].append(score)
                out["margin"].append(margin)
                out["rejected"].append(margin < MARGIN)
            return {"id": part.column("id"), "lang_pred": pa.array(out["lang_pred"], pa.string()), "score": pa.array(out["score"], pa.float64()),
                    "margin": pa.array(out["margin"], pa.float64()), "rejected": pa.array(out["rejected"], pa.bool_())}

        return work

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, lang_pred string, score double, margin double, rejected boolean"
    return per_slice(given, "text", schema, make).withColumnRenamed("id", id_col)
