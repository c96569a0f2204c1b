"""Registered queries of the text operators, with SQL where SQL can express them."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, functions as F

from rowloom.llm import alignment, bpe, chat, decontaminate, langid, periodic, pieces, quality, secrets, simhash, substring, token_codes, toxicity
from rowloom.llm.common import remainder, scratch_path

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def query(name: str, sql: str | None = None):
    def register(fn):
        QUERIES[name] = fn
        if sql is not None:
            ORACLES[name] = sql
        return fn

    return register


def tokenizer() -> str:
    """The vocabulary file of the queries; operators take any path."""
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def piece_model() -> str:
    import public_tokenizers

    return public_tokenizers.path("piece_bpe_32k.model")


def table(spark: SparkSession, folder: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{folder.rstrip('/')}/{name}.parquet")


@query("op1_bpe_round_trip")
def op1(spark: SparkSession, folder: str) -> DataFrame:
    return bpe.round_trip(table(spark, folder, "documents"), tokenizer())


@query("op2_toxicity")
def op2(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = remainder(F.col("doc_id"), 3) == 1
    model = toxicity.learn(docs.where(~held), table(spark, folder, "labels").where(~held))
    found = toxicity.toxicity(docs, model).select("row.*", "*")
    predicted = (F.col("score") >= toxicity.THRESHOLD).cast("int")
    return found.select("doc_id", held.alias("held_out"), "score", predicted.alias("predicted"), "n_exact", "n_misspelled", "n_quoted")


@query("op3_secret_scan")
def op3(spark: SparkSession, folder: str) -> DataFrame:
    found = secrets.secrets(table(spark, folder, "documents"))
    count = lambda rank: F.size(F.filter("spans", lambda x: x["rank"] == rank)).cast("long")
    return found.select(
        "doc_id", count(0).alias("n_assign"), count(1).alias("n_access"), count(2).alias("n_hex"),
        F.sha2(secrets.span_list(secrets.base_spans(F.col("spans"))).cast("binary"), 256).alias("base_sha256"), secrets.span_list(F.col("spans")).alias("spans"),
        F.size(F.filter("spans", lambda x: x["live"])).cast("long").alias("n_live"))


@query("op4_token_codes")
def op4(spark: SparkSession, folder: str) -> DataFrame:
    path = scratch_path(spark, "codes")
    token_codes.write_codes(table(spark, folder, "documents"), path, tokenizer())
    return token_codes.read_codes(spark, path)


@query("op5_chat_format", """
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations WHERE conv_id IS NOT NULL
  UNION ALL VALUES (-1, 0, 'user', '</s>[INST] ok [/INST]'), (-1, 1, 'assistant', '</s>[INST] ok [/INST]')
), e AS (
  SELECT *, replace(replace(text, '\\', '\\\\'), '<|', '<\\|') AS etext,
         replace(replace(replace(role, '\\', '\\\\'), '<|', '<\\|'), chr(10), '<\\n') AS erole FROM t
)
SELECT conv_id, count(*) AS n_turns, sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, etext)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::BIGINT AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn, role, etext) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length('<|start|>') + length(erole) + 1 + length(etext) + length('<|end|>') + 1)::BIGINT AS formatted_chars
FROM e GROUP BY conv_id
""")
def op5(spark: SparkSession, folder: str) -> DataFrame:
    said = "</s>[INST] ok [/INST]"
    own = spark.createDataFrame([(-1, 0, "user", said), (-1, 1, "assistant", said)], "conv_id long, turn long, role string, text string")
    messages = table(spark, folder, "conversations").select("conv_id", "turn", "role", "text").unionByName(own)
    out = chat.format_chats(messages.withColumn("parts", chat.text_part(F.col("text"))))
    turns, loss = chat.read_turns(F.col("formatted")), chat.masked_text(F.col("formatted"), F.col("loss"))
    read = out.select("conv_id", turns.alias("turns"), loss.alias("masked"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    line = F.lit("\n")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], line, t["text"], line)), "").cast("binary"), 256).alias("turns_sha256"),
        F.char_length("masked").cast("long").alias("loss_chars"), F.sha2(F.col("masked").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")


@query("op6_substring_dedup", r"""
WITH w AS (SELECT doc_id, regexp_extract_all(coalesce(text, ''), '[^\x20\x09-\x0D]+') AS ws FROM documents),
     windows AS (SELECT doc_id, i, array_to_string(ws[i:i + 12], ' ') AS win FROM w, LATERAL (SELECT unnest(range(1, len(ws) - 11)) AS i)),
     own AS (SELECT win, min(doc_id) AS least FROM windows GROUP BY win),
     gone AS (SELECT DISTINCT doc_id, i + j AS place FROM windows JOIN own USING (win), range(13) r(j) WHERE least < doc_id),
     words AS (SELECT doc_id, unnest(ws) AS word, generate_subscripts(ws, 1) AS place FROM w),
     kept AS (SELECT doc_id, count(*) AS n, string_agg(word, ' ' ORDER BY place) AS text FROM words ANTI JOIN gone USING (doc_id, place) GROUP BY doc_id)
SELECT doc_id, len(ws)::BIGINT AS n_words, (len(ws) - coalesce(n, 0))::BIGINT AS n_removed, sha256(coalesce(kept.text, '')) AS kept_sha256
FROM w LEFT JOIN kept USING (doc_id)
""")
def op6(spark: SparkSession, folder: str) -> DataFrame:
    found = substring.passages(table(spark, folder, "documents"))
    return found.select("doc_id", "n_words", "n_removed", F.sha2(F.col("kept").cast("binary"), 256).alias("kept_sha256"))


@query("op7_language_id")
def op7(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    held = remainder(F.col("doc_id"), 4) == 2
    found = langid.languages(docs, langid.language_texts(docs.where(~held)))
    return found.select("doc_id", held.alias("held_out"), "lang_pred", "score", "margin", "rejected")


@query("op8_simhash_groups")
def op8(spark: SparkSession, folder: str) -> DataFrame:
    found = simhash.groups(table(spark, folder, "documents"))
    return found.select("doc_id", simhash.hex_of().alias("fingerprint"), "component_id")


@query("op9_quality_rules")
def op9(spark: SparkSession, folder: str) -> DataFrame:
    docs = table(spark, folder, "documents")
    found = quality.quality(docs, quality.references(docs))
    return found.select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed",
                        (F.size("reasons") == 0).alias("kept"), "chars_distance", "words_distance", F.concat_ws(",", "reasons").alias("reasons"))


@query("op10_decontamination", r"""
WITH lowered AS (SELECT 'd' AS kind, doc_id AS id, text FROM documents UNION ALL SELECT 'b', item_id, text FROM benchmark),
     w AS (SELECT kind, id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'),
                                               '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS ws FROM lowered),
     b AS (SELECT id AS item, least(13, len(ws)) AS size, array_to_string(ws[i:i + least(13, len(ws)) - 1], ' ') AS win
           FROM w, LATERAL (SELECT unnest(range(1, greatest(len(ws) - 11, 2))) AS i) WHERE kind = 'b' AND len(ws) > 0),
     d AS (SELECT id, size, i, array_to_string(ws[i:i + size - 1], ' ') AS win
           FROM w, (SELECT DISTINCT size FROM b), LATERAL (SELECT unnest(range(1, len(ws) - size + 2)) AS i) WHERE kind = 'd'),
     met AS (SELECT id, size, i, item FROM d JOIN b USING (size, win)),
     hits AS (SELECT id, count(*) AS n FROM (SELECT DISTINCT id, i + j AS place FROM (SELECT DISTINCT id, size, i FROM met), LATERAL (SELECT unnest(range(size)) AS j)) GROUP BY id),
     named AS (SELECT id, count(*) AS n, string_agg(item, ',' ORDER BY item) AS items FROM (SELECT DISTINCT id, item::VARCHAR AS item FROM met WHERE item IS NOT NULL) GROUP BY id)
SELECT w.id AS doc_id, len(ws)::BIGINT AS n_words, coalesce(hits.n, 0)::BIGINT AS n_hit, coalesce(named.n, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(hits.n, 0) > 0 AND 20 * coalesce(hits.n, 0) >= len(ws) AS contaminated
FROM w LEFT JOIN hits ON hits.id = w.id LEFT JOIN named ON named.id = w.id WHERE kind = 'd'
""")
def op10(spark: SparkSession, folder: str) -> DataFrame:
    found = decontaminate.contamination(table(spark, folder, "documents"), table(spark, folder, "benchmark")).select("row.*", "*")
    names = F.concat_ws(",", F.array_sort("items"))
    return found.select("doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"), F.sha2(names.cast("binary"), 256).alias("items_sha256"),
                        decontaminate.is_contaminated().alias("contaminated"))


@query("op11_periodic_runs")
def op11(spark: SparkSession, folder: str) -> DataFrame:
    found = periodic.runs(table(spark, folder, "documents"), alter=periodic.planted)
    found = found.withColumn("most", periodic.most_repeated())
    digest = lambda text: F.sha2(text.cast("binary"), 256)
    return found.select(
        "doc_id", F.size("runs").cast("long").alias("n_runs"), F.col("most.start").alias("start"), F.col("most.length").alias("length"), F.col("most.period").alias("period"),
        F.expr("1000 * most.length div most.period").alias("exponent_milli"), digest(periodic.run_lines()).alias("runs_sha256"), digest(F.col("collapsed")).alias("collapsed_sha256"))


@query("op12_token_alignment")
def op12(spark: SparkSession, folder: str) -> DataFrame:
    return alignment.alignment(table(spark, folder, "documents"), tokenizer(), piece_model())


@query("op13_piece_round_trip")
def op13(spark: SparkSession, folder: str) -> DataFrame:
    return pieces.round_trip(table(spark, folder, "documents"), piece_model())


@query("pipeline")
def pipeline(spark: SparkSession, folder: str) -> DataFrame:
    import corpus_pipeline

    return corpus_pipeline.run(spark, folder)
