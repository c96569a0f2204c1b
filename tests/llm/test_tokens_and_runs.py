"""Piece encoding, token alignment and periodic runs against the libraries and plain loops."""

import hashlib
import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest
from pyspark.sql import functions as F

from rowloom.llm import alignment, common, periodic, pieces, queries
from tests.llm.test_text_operators import SCHEMA, by_row, odd_rows, prose, sha, words


@pytest.fixture(scope="module")
def docs(spark):
    return spark.createDataFrame(odd_rows(), SCHEMA).repartition(3).cache()


@pytest.fixture(scope="module")
def none(spark):
    return spark.createDataFrame([], SCHEMA)


@pytest.fixture(scope="module")
def model():
    return pytest.importorskip("public_tokenizers").path("piece_bpe_32k.model")


@pytest.fixture(scope="module")
def byte_level():
    return pytest.importorskip("public_tokenizers").path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library(model):
    return pytest.importorskip("sentencepiece").SentencePieceProcessor(model_file=model)


@pytest.fixture(scope="module")
def codec(model):
    return pieces.codec_of(model)


# ---- pieces ----


def expected_pieces(rows, library):
    for i, t, *_ in rows:
        ids = library.encode(t or "", add_bos=True, add_eos=True)
        yield i, len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), sha(library.decode(ids))


def test_pieces_equal_library(docs, none, model, library):
    found = pieces.round_trip(docs, model)
    assert by_row(found, "n_tokens", "ids_sha256", "decoded_sha256") == sorted(expected_pieces(odd_rows(), library), key=str)
    assert pieces.round_trip(none, model).count() == 0


def test_pieces_ids_of_other_columns(spark, model, library):
    """Other column names, an id of text, and an extra column named like an own one."""
    rows = spark.createDataFrame([("a", "the cat", 1), (None, None, 2)], "key string, body string, n_tokens int")
    found = {r["key"]: r["ids"] for r in pieces.encoded(rows, model, "key", "body").collect()}
    assert found == {"a": library.encode("the cat", add_bos=True, add_eos=True), None: [1, 2]}


def test_pieces_random_texts(codec, library):
    r = random.Random(3)
    letters = "ab é'st<|>\n\t 1２½\xa0\x85\x1c日🙂llvdmRE  ▁▁\r\0的한"
    texts = ["".join(r.choice(letters) for _ in range(r.randint(0, 60))) for _ in range(3000)]
    texts += [" " * k + x for k in range(70) for x in ("", "a", "\n", "the ")]
    texts += [c * k for c in ("a", "=-", "-", "0", "の") for k in range(80)]
    texts += ["<s> </s> <unk> <0x41>", prose(3000, 5), "".join(prose(500, 6).split()), "x" * 20_000]
    for text in texts:
        ids = library.encode(text, add_bos=True, add_eos=True)
        assert codec.encode(text).tolist() == ids, text
        assert codec.decode(codec.encode(text)) == library.decode(ids), text


def test_pieces_backtrack(codec):
    """Some word's longest first piece leads nowhere, so the bitfield is in use."""
    p, seen = codec.pieces, 0
    for word in (w for w in set(prose(4000, 9).split()) for w in [pieces.SPACE + w]):
        ids = p.run(word)
        longest = max((n for n in p.ids if word.startswith(n)), key=len)
        seen += p.names[ids[0]] != longest
        assert "".join(p.names[i] for i in ids) == word
    assert seen


def test_pieces_refuses_other_models(tmp_path, monkeypatch, model):
    import sentencepiece

    class Odd(sentencepiece.SentencePieceProcessor):
        def normalize(self, text):
            return text.strip()

    monkeypatch.setattr(sentencepiece, "SentencePieceProcessor", Odd)
    with pytest.raises(ValueError):
        pieces.Pieces(model)


# ---- alignment ----


def plain_alignment(rows, byte_level, library):
    from tokenizers import Tokenizer

    first = Tokenizer.from_file(byte_level)
    first.encode_special_tokens = True
    of = {c: bytes([b]) for c, b in alignment.bpe.byte_symbols().items()}
    out, held = [], defaultdict(set)
    for row, (i, t, *_) in enumerate(rows):
        a = first.encode(" " + t, add_special_tokens=False).ids if t else []
        b = library.encode(t) if t else []
        bytes_a = [b"".join(of[c] for c in first.id_to_token(x)) for x in a]
        bytes_b = [bytes([int(p[3:5], 16)]) if library.is_byte(x) else p.replace("▁", " ").encode() for x in b for p in [library.id_to_piece(x)]]
        if not t or b"".join(bytes_a) != b" " + t.encode() or b"".join(bytes_b) != b" " + t.encode():
            out.append((i, 0, 0, 0, Counter(), ""))
            continue
        ends = [set(np.cumsum([len(x) for x in s]).tolist()) for s in (bytes_a, bytes_b)]
        groups, at_a, at_b = [], 0, 0
        for end in sorted(ends[0] & ends[1]):
            ga, gb = [], []
            at = 0
            for side, ids, sizes in ((ga, a, bytes_a), (gb, b, bytes_b)):
                at = 0
                for x, s in zip(ids, sizes):
                    at += len(s)
                    if (groups[-1][2] if groups else 0) < at <= end:
                        side.append(x)
            groups.append((ga, gb, end))
        links = Counter((x, y) for ga, gb, _ in groups for x in ga for y in gb)
        for pair in links:
            held[pair].add(row)
        out.append((i, len(a), len(b), len(groups), links, sha(";".join(",".join(map(str, ga)) + "|" + ",".join(map(str, gb)) for ga, gb, _ in groups))))
    count = {p: len(s) for p, s in held.items()}
    most = defaultdict(int)
    for (a, _), n in count.items():
        most[a] = max(most[a], n)
    return [(i, na, nb, ng, sum(links.values()), sum(n for p, n in links.items() if count[p] == most[p[0]]), sum(n * count[p] for p, n in links.items()), h) for i, na, nb, ng, links, h in out]


FIELDS = ("n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256")


def aligned_rows():
    odd = [r for r in odd_rows() if len(r[1] or "") < 6000]
    r = random.Random(4)
    more = [(100 + k, "".join(r.choice("ab é'st\n 1２\xa0日🙂llv  的<|endoftext|>") for _ in range(80)), "en", "a", 0) for k in range(30)]
    return odd + more + [(200, "with ▁ mark", "en", "a", 0), (201, "=" * 300, "en", "a", 0), (202, " " * 90, "en", "a", 0)]


@pytest.mark.parametrize(("limit", "merged"), [(common.SLICE_BYTES, 512), (400, 2)])
def test_alignment_equals_plain(spark, byte_level, model, library, monkeypatch, limit, merged):
    """Also with many small runs that are merged in groups of two."""
    monkeypatch.setattr(alignment, "slices", lambda batch, text: common.slices(batch, text, limit))
    rows = aligned_rows()
    given = spark.createDataFrame(rows, SCHEMA).withColumn("run", F.lit("x")).repartition(3)
    found = alignment.alignment(given, byte_level, model, runs_merged=merged)
    assert by_row(found, *FIELDS) == sorted(plain_alignment(rows, byte_level, library), key=str)


def test_alignment_of_nothing(spark, none, byte_level, model):
    assert alignment.alignment(none, byte_level, model).count() == 0
    empty = spark.createDataFrame([(1, None), (2, "")], "doc_id long, text string")
    assert by_row(alignment.alignment(empty, byte_level, model), *FIELDS) == [(1, 0, 0, 0, 0, 0, 0, ""), (2, 0, 0, 0, 0, 0, 0, "")]


def test_runs_are_merged():
    rows = [(np.array([3, 4, 13, 25]), np.array([1, 2, 1, 5])), (np.array([4, 25, 26]), np.array([1, 1, 9])), (np.zeros(0, np.int64), np.zeros(0, np.int64))]
    found = [(p.tolist(), c.tolist()) for p, c in alignment.merge(rows, 10)]
    assert found == [([3, 4], [1, 3]), ([13], [1]), ([25, 26], [6, 9])]
    for pair, count in rows:
        back = alignment.unpacked_run(alignment.packed_run(pair, count))
        assert [x.tolist() for x in back] == [pair.tolist(), count.tolist()]


# ---- periodic runs ----


def plain_runs(w, least=24, times=3):
    n, out = len(w), {}
    for q in range(1, n // times + 1):
        i = 0
        while i < n - q:
            j = i
            while j < n - q and w[j] == w[j + q]:
                j += 1
            if j > i and j - i + q >= max(least, times * q):
                out.setdefault((i, j - i + q), q)
            i = max(j, i) + 1
    return sorted((s, m, q) for (s, m), q in out.items())


def random_texts(r):
    texts = []
    for _ in range(r.randint(0, 12)):
        n, k = r.choice([0, 1, 5, 30, 100, 300]), r.choice([1, 2, 3, 50])
        t = [r.randrange(k) for _ in range(n)]
        if n and r.random() < 0.7:
            a, p = r.randrange(n), r.randint(1, max(1, n // 4))
            for i in range(a, r.randint(a, n)):
                t[i] = t[a + (i - a) % p]
        texts.append(t)
    return texts + texts[:1]


@pytest.mark.parametrize(("least", "times"), [(24, 3), (4, 2)])
def test_runs_equal_plain(least, times, monkeypatch):
    r = random.Random(least)
    for turn in range(120):
        if turn == 60:
            monkeypatch.setattr(periodic, "QUERIES", 7)
        texts = random_texts(r)
        starts = np.cumsum([0, *map(len, texts)])
        found = periodic.find_runs(np.array([x for t in texts for x in t], np.int64), starts, least, times)
        got = [[] for _ in texts]
        for owner, *run in zip(*(x.tolist() for x in found)):
            got[owner].append(tuple(run))
        assert got == [plain_runs(t, least, times) for t in texts]


def test_common_extensions():
    r = np.random.default_rng(1)
    for n, k in ((1, 1), (40, 1), (500, 2), (700, 40)):
        given = r.integers(0, k, n)
        given[n // 2 :] = given[: n - n // 2]
        i, j = np.sort(r.integers(0, n, (2, 300)), axis=0)
        i, j = i[i < j], j[i < j]

        def common_words(a, b):
            m = 0
            while b + m < n and given[a + m] == given[b + m]:
                m += 1
            return m

        assert periodic.CoverLce(given)(i, j).tolist() == [common_words(a, b) for a, b in zip(i.tolist(), j.tolist())]


def contract_row(i, text):
    w = words(text)
    n = len(w)
    h = zlib.crc32(str(i).encode()) if i is not None else 1
    if h % 10 == 0 and n:
        g = h // 10
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[k] if k < a else w[a + (k - a) % p] for k in range(n)]
    found = plain_runs(w)
    gone = {k for s, m, q in found for k in range(s + q, s + m)}
    best = min(found, key=lambda x: (-x[1] / x[2], x[0], x[2]), default=(None,) * 3)
    return (i, len(found), *best, 1000 * best[1] // best[2] if found else None, sha("".join(f"{s},{m},{q}\n" for s, m, q in found)), sha(" ".join(x for k, x in enumerate(w) if k not in gone)))


def test_run_query_equals_plain(spark, tmp_path):
    rows = [r for r in odd_rows() if len(r[1] or "") < 5000]
    rows += [(500 + k, prose(150 + k, k), "en", "a", 0) for k in range(120)]
    rows += [(400, "x " * 70 + "y " * 30 + "a b " * 15, "en", "a", 0), (401, "z y " * 20 + "q " + "w v u " * 13 + "k", "en", "a", 0), (402, "a " * 23, "en", "a", 0)]
    spark.createDataFrame(rows, SCHEMA).repartition(3).write.parquet(str(tmp_path / "documents.parquet"))
    fields = ("n_runs", "start", "length", "period", "exponent_milli", "runs_sha256", "collapsed_sha256")
    found = by_row(queries.op11(spark, str(tmp_path)), *fields)
    assert found == sorted((contract_row(i, t) for i, t, *_ in rows), key=str)
    assert sum(r[1] > 0 for r in found) > 5


def test_runs_of_nothing(none):
    assert periodic.runs(none).count() == 0


def test_very_long_texts(spark):
    """A text of one word, and one of a long period."""
    cycle = prose(4000, 11)
    given = spark.createDataFrame([(1, "a " * 50_000), (2, " ".join([cycle] * 4))], "doc_id long, text string")
    found = {r["doc_id"]: [tuple(x) for x in r["runs"]] for r in periodic.runs(given).collect()}
    assert found == {1: [(0, 50_000, 1)], 2: [(0, 16_000, 4000)]}
