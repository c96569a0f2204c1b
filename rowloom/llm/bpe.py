"""BPE encoding by a pair occurrence index, and decoding.

A task collects the words (pre-tokens) of its texts that it has not met, lays their
symbols out in one array, and maps each pair of neighbours that has a rank to all its
places.  Ranks are applied in ascending order: all places of the pair are merged at
once, and the pairs to the left and right of each are added to the lists of their
ranks.  A pair with a merged symbol always has a later rank than the merge that made
it, so each rank is visited once; ``Vocabulary`` checks this when it is read.

Texts are whole; a null text is empty and has no tokens.  An added token (such as the
end-of-text mark) written out in a text is that token, as in the tokenizers library.
Ids that are unknown cannot be decoded and raise.
"""

from __future__ import annotations

import heapq
import json
import re
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import per_slice, whole

WORDS_KEPT = 250_000
"""Words whose tokens a worker process remembers; when there are more it starts anew."""

# Fixed pattern of the pre-tokens; \\s is Unicode White_Space.
PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"
# The same for texts below U+0100, with the members of \p{L}, \p{N} and \s there.
_L, _N, _S = "A-Za-z\xaa\xb5\xba\xc0-\xd6\xd8-\xf6\xf8-\xff", "0-9\xb2\xb3\xb9\xbc-\xbe", "\t-\r \x85\xa0"
_LATIN = re.compile(f"'s|'t|'re|'ve|'m|'ll|'d| ?[{_L}]+| ?[{_N}]+| ?[^{_S}{_L}{_N}]+|[{_S}]+(?![^{_S}])|[{_S}]+")
_BEYOND = re.compile("[Ā-\U0010ffff]")


@lru_cache(1)
def _any():
    import regex

    return regex.compile(PATTERN)


def pretokens(text: str) -> list[str]:
    return (_any() if _BEYOND.search(text) else _LATIN).findall(text)


def byte_symbols() -> dict[str, int]:
    """The printable character that stands for each byte in a byte-level vocabulary:
    visible Latin-1 characters for themselves, all others from U+0100 on."""
    visible = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in visible]
    return {chr(b): b for b in visible} | {chr(256 + i): b for i, b in enumerate(hidden)}


def checked(given: dict) -> dict:
    """A tokenizer file's content; one with settings that would give other ids than a plain
    byte-level tokenizer's raises."""
    model, before = given["model"], given.get("pre_tokenizer") or {}
    off = ("dropout", "continuing_subword_prefix", "end_of_word_suffix", "fuse_unk", "byte_fallback", "ignore_merges")
    wrong = [f"model.{n}" for n in off if model.get(n)]
    wrong += [n for n in ("normalizer", "truncation", "padding") if given.get(n)]
    wrong += [f"added_tokens.{n}" for n in ("single_word", "lstrip", "rstrip") if any(t.get(n) for t in given.get("added_tokens", ()))]
    if model.get("type", "BPE") != "BPE":
        wrong.append("model.type")
    if before.get("type") != "ByteLevel" or before.get("add_prefix_space", True) or not before.get("use_regex", True):
        wrong.append("pre_tokenizer")
    if (given.get("decoder") or {}).get("type") != "ByteLevel":
        wrong.append("decoder")
    if wrong:
        raise ValueError(f"not a plain byte-level tokenizer: {', '.join(wrong)}")
    return given


class Vocabulary:
    """Ids, merges and added tokens of a byte-level tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as f:
            given = checked(json.load(f))
        model, of = given["model"], byte_symbols()
        self.bytes = {i: bytes(of[c] for c in token) for token, i in model["vocab"].items() if all(c in of for c in token)}
        self.added = {t["content"]: t["id"] for t in given["added_tokens"]}
        self.bytes.update({i: t.encode() for t, i in self.added.items()})
        ids = model["vocab"]
        self.of_byte = np.zeros(256, np.int64)
        for c, b in of.items():
            self.of_byte[b] = ids[c]
        merges = [m.split(" ") if isinstance(m, str) else m for m in model["merges"]]
        self.left = np.array([ids[a] for a, _ in merges], np.int64)
        self.right = np.array([ids[b] for _, b in merges], np.int64)
        self.made = np.array([ids[a + b] for a, b in merges], np.int64)
        self.size = max(ids.values()) + 1
        born = {m: r for r, m in reversed([*enumerate(self.made.tolist())])}
        if len(born) < len(merges) or any(max(born.get(a, -1), born.get(b, -1)) >= r for r, (a, b) in enumerate(zip(self.left.tolist(), self.right.tolist()))):
            raise ValueError("merges are not in the order in which their parts arise")
        keys = self.left * self.size + self.right
        order = np.argsort(keys)
        self.keys, self.rank_of = keys[order], order

    def ranks(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of each pair, -1 for none."""
        keys = left * self.size + right
        at = np.searchsorted(self.keys, keys)
        at[at == len(self.keys)] = 0
        return np.where(self.keys[at] == keys, self.rank_of[at], -1)


def encode_words(words: list[bytes], v: Vocabulary) -> tuple[np.ndarray, np.ndarray]:
    """Token ids of all words in one array, and where each word's begin (and the end)."""
    sizes = np.fromiter(map(len, words), np.int64, len(words))
    starts = np.zeros(len(words) + 1, np.int64)
    np.cumsum(sizes, out=starts[1:])
    total = int(starts[-1])
    symbol = v.of_byte[np.frombuffer(b"".join(words), np.uint8)]
    # neighbours within a word; a place is that of a symbol's first byte
    after, before = np.arange(1, total + 1), np.arange(-1, total - 1)
    after[starts[1:][sizes > 0] - 1] = -1
    before[starts[:-1][sizes > 0]] = -1
    lists: dict[int, list[np.ndarray]] = {}

    def note(places: np.ndarray) -> list[int]:
        """Adds places to the lists of their pairs; the ranks that are new."""
        places = places[places >= 0]
        places = places[after[places] >= 0]
        if not len(places):
            return []
        ranks = v.ranks(symbol[places], symbol[after[places]])
        places, ranks = places[ranks >= 0], ranks[ranks >= 0]
        if not len(places):
            return []
        order = np.argsort(ranks, kind="stable")
        places, ranks = places[order], ranks[order]
        heads = np.flatnonzero(np.r_[True, ranks[1:] != ranks[:-1]])
        fresh = []
        for r, some in zip(ranks[heads].tolist(), np.split(places, heads[1:])):
            if r not in lists:
                lists[r] = []
                fresh.append(r)
            lists[r].append(some)
        return fresh

    heap = note(np.arange(total))
    heapq.heapify(heap)
    while heap:
        r = heapq.heappop(heap)
        places = np.unique(np.concatenate(lists.pop(r)))
        left, right = v.left[r], v.right[r]
        # still there: the symbols may have gone into other merges
        places = places[(symbol[places] == left) & (after[places] >= 0)]
        places = places[symbol[after[places]] == right]
        if left == right and len(places) > 1:
            # of overlapping pairs (aaa) every other one from the left of each run
            chained = np.r_[False, after[places[:-1]] == places[1:]]
            nth = np.arange(len(places)) - np.maximum.accumulate(np.where(chained, 0, np.arange(len(places))))
            places = places[nth % 2 == 0]
        if not len(places):
            continue
        gone = after[places]
        beyond = after[gone]
        symbol[places], symbol[gone] = v.made[r], -1
        after[places] = beyond
        before[beyond[beyond >= 0]] = places[beyond >= 0]
        for fresh in note(np.unique(np.r_[before[places], places])):
            heapq.heappush(heap, fresh)
    kept = symbol >= 0
    counts = np.r_[0, np.cumsum(kept)]
    return symbol[kept], counts[starts]


class Codec:
    """Encodes texts and decodes ids; remembers words."""

    def __init__(self, path: str) -> None:
        self.v = Vocabulary(path)
        self.known: dict[str, np.ndarray] = {}
        self.split = re.compile("(" + "|".join(re.escape(t) for t in sorted(self.v.added, key=len, reverse=True)) + ")") if self.v.added else None
        self.table = [self.v.bytes.get(i) for i in range(max(self.v.bytes) + 1)]

    def pieces(self, text: str) -> list[str]:
        """Pre-tokens and added tokens in order."""
        if self.split is None or not any(t in text for t in self.v.added):
            return pretokens(text)
        return [w for i, part in enumerate(self.split.split(text)) for w in ([part] if i % 2 else pretokens(part))]

    def learn(self, words: set[str]) -> None:
        """Encodes words not met before, all at once."""
        if len(self.known) > WORDS_KEPT:
            self.known.clear()
        fresh = [w for w in words if w not in self.known]
        own = [w for w in fresh if w not in self.v.added]
        ids, starts = encode_words([w.encode() for w in own], self.v)
        ids = ids.astype(np.int32)
        for w, a, b in zip(own, starts[:-1].tolist(), starts[1:].tolist()):
            self.known[w] = ids[a:b].tobytes()
        self.known.update({w: np.array([self.v.added[w]], np.int32).tobytes() for w in fresh if w in self.v.added})

    def encode(self, texts: list[str]) -> list[np.ndarray]:
        pieces = [self.pieces(t) for t in texts]
        self.learn({w for p in pieces for w in p})
        known = self.known.__getitem__
        return [np.frombuffer(b"".join(map(known, p)), np.int32) for p in pieces]

    def decode(self, ids: np.ndarray) -> str:
        return b"".join(map(self.table.__getitem__, ids.tolist())).decode("utf-8", "replace")


@lru_cache(1)
def codec_of(path: str) -> Codec:
    """One for a worker process, so that later tasks know the words of earlier ones."""
    return Codec(path)


def encoded(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``ids``, the tokens of its whole text."""
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def make():
        codec = codec_of(tokenizer)

        def work(part: pa.RecordBatch) -> dict:
            return {"id": part.column("id"), "ids": _lists(codec.encode(part.column("text").to_pylist()))}

        return work

    return per_slice(given, "text", f"id {docs.schema[id_col].dataType.simpleString()}, ids array<int>", make).withColumnRenamed("id", id_col)


def round_trip(docs: DataFrame, tokenizer: str, id_col: str = "doc_id", text_col: str = "text", with_ids: bool = False) -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids_sha256`` of the decimal ids joined by commas,
    and ``decoded_sha256`` of the text decoded from the ids; ``ids`` if asked for."""
    import hashlib

    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def make():
        codec = codec_of(tokenizer)
        decimal = [b"%d" % i for i in range(len(codec.table))]

        def work(part: pa.RecordBatch) -> dict:
            n, of_ids, of_text = [], [], []
            found = codec.encode(part.column("text").to_pylist())
            for ids in found:
                n.append(len(ids))
                of_ids.append(hashlib.sha256(b",".join(map(decimal.__getitem__, ids.tolist()))).hexdigest())
                of_text.append(hashlib.sha256(codec.decode(ids).encode()).hexdigest())
            out = {"id": part.column("id"), "n_tokens": pa.array(n, pa.int64()), "ids_sha256": pa.array(of_ids, pa.string()), "decoded_sha256": pa.array(of_text, pa.string())}
            return out | ({"ids": _lists(found)} if with_ids else {})

        return work

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", ids array<int>" * with_ids
    return per_slice(given, "text", schema, make).withColumnRenamed("id", id_col)


def _lists(of: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, of)]).astype(np.int32)
    return pa.ListArray.from_arrays(pa.array(ends), pa.array(np.concatenate(of) if of else np.zeros(0, np.int32)))
