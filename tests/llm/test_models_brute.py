"""Distances of quality rules and languages by compression, against plain Python."""

import math
import random
import re
from collections import Counter

import pytest
import zstandard
from pyspark.sql import functions as F

from rowloom.llm import langid, quality
from tests.llm.test_text_operators import SCHEMA, odd_rows, prose


def words(t):
    return re.findall(r"[^\x20\x09-\x0D]+", t or "")


def lowered(w):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in w)


def kind_of(c):
    if ord(c) > 127:
        return "other"
    if c.islower():
        return "lower"
    if c.isupper():
        return "upper"
    if c.isdigit():
        return "digit"
    if c in "\r\n":
        return "line"
    if c.isspace():
        return "blank"
    return "mark" if c in ".,;:!?'\"()-" else "symbol"


def distance(p, q):
    """Jensen-Shannon, base 2."""
    total = 0.0
    a, b = sum(p.values()), sum(q.values())
    for k in {*p, *q}:
        x, y = p.get(k, 0) / a, q.get(k, 0) / b
        m = (x + y) / 2
        total += (x * math.log2(x / m) if x else 0) + (y * math.log2(y / m) if y else 0)
    return math.sqrt(max(0, total / 2))


def mixed_rows():
    """A language with many words that are rare overall, and one below its cut that is
    frequent in all; documents without a language, of an odd one, repeated."""
    rand = random.Random(11)
    rows = list(odd_rows())
    for i in range(60):
        lang = rand.choice(["en", "de", "fr", None])
        own = " ".join(rand.choice([f"{lang}{k}" for k in range(90)] + ["The", "the", "of"]) for _ in range(rand.choice([30, 80, 200])))
        rows.append((100 + i, own + rand.choice(["", "\n###$$", " 12 34, 5!"]), lang, "s", 1))
    rows += [(300, prose(100, 1), "xx", "s", 1), (301, "#$ " * 400, "en", "s", 1), (302, " ".join(f"q{i}" for i in range(90)), None, "s", 1)]
    return rows + rows[-3:]


def brute_references(rows):
    chars, terms = {}, {}
    for _, t, lang, *_ in rows:
        for g in {lang or "", ""}:
            chars.setdefault(g, Counter()).update(map(kind_of, t or ""))
            terms.setdefault(g, Counter()).update(map(lowered, words(t)))
    top = {g: dict(sorted(c.items(), key=lambda x: (-x[1], x[0]))[: quality.COMMON]) for g, c in terms.items()}
    return chars, top


def test_references_are_cut_from_complete_counts(spark):
    rows = mixed_rows()
    chars, top = brute_references(rows)
    refs = quality.references(spark.createDataFrame(rows, SCHEMA).repartition(7)).collect()
    got = {(r["lang"], r["kind"], r["key"]): r["n"] for r in refs}
    assert len(got) == len(refs)
    expected = {(g, "char", k): n for g, c in chars.items() for k, n in c.items()}
    assert got == expected | {(g, "word", k): n for g, c in top.items() for k, n in c.items()}


def test_distances_and_verdicts(spark):
    rows = mixed_rows()
    chars, top = brute_references(rows)
    df = spark.createDataFrame(rows, SCHEMA).repartition(5)
    expected = []
    for i, t, lang, *_ in rows:
        t, w = t or "", words(t)
        g = lang if lang in chars else ""
        c = distance(Counter(map(kind_of, t)), chars[g]) if len(t) >= quality.MIN_CHARS else None
        d = None
        if len(w) >= quality.MIN_WORDS:
            mine = Counter(x for x in map(lowered, w) if x in top[g])
            d = distance(mine, top[g]) if mine else 1.0
        expected.append((str(i), c, d))
    found = [(str(r["doc_id"]), r["chars_distance"], r["words_distance"], r["base_failed"], r["reasons"]) for r in quality.quality(df, quality.references(df)).collect()]
    order = lambda r: (r[0], r[1] or -1, r[2] or -1)
    assert len(found) == len(expected)
    assert any(e[1] is not None for e in expected) and any(e[2] is not None for e in expected)
    for (i, c, d, failed, reasons), e in zip(sorted(found, key=order), sorted(expected, key=order)):
        assert (i, c, d) == (e[0], e[1] and pytest.approx(e[1], abs=1e-9), e[2] and pytest.approx(e[2], abs=1e-9))
        assert ("characters" in reasons) == (c is not None and c > quality.MAX_CHARS_DISTANCE)
        assert ("words" in reasons) == (d is not None and d > quality.MAX_WORDS_DISTANCE)
        assert failed == bool({"few_words", "repeats"} & set(reasons))


def language_rows():
    rand = random.Random(3)
    sounds = {"aa": "aeiourst", "bb": "oumklpqv", "cc": "äöüßxyzw"}
    def text(lang, n):
        return " ".join("".join(rand.choice(sounds[lang]) for _ in range(rand.randint(2, 7))) for _ in range(n))
    rows = [(i, text(lang, rand.choice([3, 40, 300])), lang) for i, lang in enumerate(rand.choice(list(sounds)) for _ in range(150))]
    rows += [(500, None, "aa"), (501, "", "bb"), (502, "12 34 !!", "aa"), (503, "x" * 30_000, None), (504, text("cc", 9000), None), (505, rows[0][1] + " " + rows[1][1], None)]
    return rows + rows[:4]


@pytest.mark.parametrize("parts,deal", [(1, 16), (9, 2)])
def test_languages_equal_a_plain_loop(spark, monkeypatch, parts, deal):
    monkeypatch.setattr(langid, "SAMPLE_TEXTS", 20)
    monkeypatch.setattr(langid, "DEALT", deal)
    rows = language_rows()
    df = spark.createDataFrame(rows, "doc_id long, text string, lang string").repartition(parts)
    share = 2 * langid.DICTIONARY // 20
    hashed = df.select("lang", "text", F.xxhash64("doc_id", "text").alias("h")).collect()
    expected = {}
    for lang in ("aa", "bb", "cc"):
        def part(t):
            at = max(1, int((len(t) - share) / 2)) - 1
            return t[at : at + share]
        mine = sorted((r["h"], part(r["text"])) for r in hashed if r["lang"] == lang and r["text"] and r["text"].strip(" "))[:20]
        expected[lang] = b"".join(t.encode() + b"\n" for _, t in reversed(mine))[-langid.DICTIONARY :]
    texts = langid.language_texts(df)
    assert texts == expected
    made = {}
    for lang, raw in expected.items():
        made[lang] = zstandard.ZstdCompressor(
            level=langid.LEVEL, dict_data=zstandard.ZstdCompressionDict(raw, dict_type=zstandard.DICT_TYPE_RAWCONTENT),
            write_content_size=False, write_checksum=False, write_dict_id=False)
    want = []
    for i, t, _ in rows:
        if not t or not any(c.isalpha() for c in t):
            want.append((i, "und"))
            continue
        raw = t.encode()
        size = lambda c: sum(len(c.compress(raw[k : k + langid.BLOCK])) for k in range(0, len(raw), langid.BLOCK))
        want.append((i, min((size(c), g) for g, c in made.items())[1]))
    assert sorted((r["doc_id"], r["lang_pred"]) for r in langid.languages(df, texts).collect()) == sorted(want)
