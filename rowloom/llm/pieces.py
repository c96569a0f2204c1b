"""SentencePiece encoding (models of merges) by backtracking, and decoding.

The library joins the pair of neighbours whose piece has the best score, the leftmost
of equals, until no pair is a piece.  The same ids are found without a queue of pairs:
a text is taken apart so that every two adjacent pieces stay apart when the characters
of both are merged again.  From each position the longest piece found by an
Aho-Corasick automaton is tried first, then shorter ones; a position from which no
piece leads on goes into a bitfield and is not entered again.  As a prefix has only one
such way, a position fails for good.

Where no piece of the model holds a character before a space mark, a text is encoded
word by word, and a worker remembers the words it has met.  Characters without a piece
become their bytes.  Models that normalise, that have pieces of the user's own or unused
ones, or that lack the pieces of single bytes are refused.

Texts are whole; a null text is empty: the begin and end ids alone.  Repeated rows and
rows without an id are encoded like any other.  A space mark (U+2581) written out in a
text is decoded as a space, as the library does.
"""

from __future__ import annotations

import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import per_slice, whole

WORDS_KEPT = 250_000
"""Words whose ids a worker process remembers, and as many older ones."""
LONG_WORD = 200
"""Longer words are not remembered."""
PAIRS_KEPT = 300_000

SPACE = "▁"
_PROBE = "  Aé①\n ﬁ "


class Known(dict):
    """Values by key, made when first asked for.  When there are too many, they become
    the old ones, of which those that are asked for again are kept."""

    def __init__(self, make, most: int) -> None:
        super().__init__()
        self.make, self.most, self.old = make, most, {}

    def __missing__(self, key):
        if len(self) >= self.most:
            self.old = dict(self)
            self.clear()
        value = self.old.get(key)
        if value is None:
            value = self.make(key)
        self[key] = value
        return value


class Pieces:
    """The pieces of a model: ids, scores, and the automaton of those that merges reach."""

    def __init__(self, path: str) -> None:
        import ahocorasick
        import sentencepiece

        given = sentencepiece.SentencePieceProcessor(model_file=path)
        count = given.get_piece_size()
        names = [given.id_to_piece(i) for i in range(count)]
        self.begin, self.end = given.bos_id(), given.eos_id()
        control = [i for i in range(count) if given.is_control(i) or given.is_unknown(i)]
        self.of_byte = [given.piece_to_id(f"<0x{b:02X}>") for b in range(256)]
        if not all(given.is_byte(i) for i in self.of_byte) or any(given.is_unused(i) for i in range(count)):
            raise ValueError("the model has unused pieces or no pieces of single bytes")
        if given.normalize(_PROBE) != SPACE + _PROBE.replace(" ", SPACE):
            raise ValueError("the model normalises texts")
        apart = {*control, *self.of_byte}
        self.names = {i: n for i, n in enumerate(names) if i not in apart}
        self.ids = {n: i for i, n in self.names.items()}
        self.score = {i: given.get_score(i) for i in self.names}
        self.size = {i: len(n) for i, n in self.names.items()}
        self.letters = {n for n in self.ids if len(n) == 1}
        self.bytes = [b""] * count
        for i, n in self.names.items():
            self.bytes[i] = n.replace(SPACE, " ").encode()
        for b, i in enumerate(self.of_byte):
            self.bytes[i] = bytes([b])
        self.automaton = ahocorasick.Automaton()
        for n, i in self.ids.items():
            if self.merged(n) == [i]:  # others are never the outcome of merges
                self.automaton.add_word(n, i)
        self.automaton.make_automaton()
        # the next shorter piece that begins a piece, -1 for none
        begins = lambda n: next((self.automaton.get(n[:k]) for k in range(len(n) - 1, 0, -1) if n[:k] in self.automaton), -1)
        self.shorter = {i: begins(n) for n, i in self.ids.items()}
        self.apart = Known(self._apart, PAIRS_KEPT)
        # a text may be cut where no piece reaches over
        pattern = r".+" if any(re.search(f"[^{SPACE}]{SPACE}", n) for n in self.ids) else f"{SPACE}*[^{SPACE}]+|{SPACE}+"
        if pattern != ".+" and not any("\n" in n for n in self.ids):
            pattern = f"{SPACE}*[^{SPACE}\n]+|{SPACE}+|\n"
        self.words = re.compile(pattern, re.DOTALL)
        probe = list(self.ids)[:2000]
        for name, ids in zip(probe, given.encode(probe)):
            if list(self.encode(SPACE + name.replace(" ", SPACE))) != ids:
                raise ValueError("the model does not join pairs by score")

    def _apart(self, pair: int) -> bool:
        """Whether two adjacent pieces stay as they are when their letters are merged."""
        a, b = divmod(pair, len(self.bytes))
        return self.merged(self.names[a] + self.names[b]) == [a, b]

    def merged(self, text: str) -> list[int]:
        """Ids of a short run of letters, pair by pair."""
        ids, score = self.ids, self.score
        parts = list(text)
        pairs = [ids.get(a + b) for a, b in zip(parts, parts[1:])]
        while True:
            best, at = None, -1
            for k, p in enumerate(pairs):
                if p is not None and (best is None or score[p] > best):
                    best, at = score[p], k
            if at < 0:
                return [ids[p] for p in parts]
            parts[at : at + 2] = [parts[at] + parts[at + 1]]
            del pairs[at]
            if at:
                pairs[at - 1] = ids.get(parts[at - 1] + parts[at])
            if at < len(pairs):
                pairs[at] = ids.get(parts[at] + parts[at + 1])

    def run(self, text: str) -> list[int]:
        """Ids of letters that all have a piece, by backtracking."""
        n, size, shorter, apart, count = len(text), self.size, self.shorter, self.apart, len(self.bytes)
        longest = self.automaton.iter_long
        out: list[int] = []
        at, last = 0, -1
        for _, i in longest(text):  # the longest from place to place, while they fit
            if last >= 0 and not apart[last * count + i]:
                break
            out.append(i)
            at += size[i]
            last = i
        else:
            return out
        failed = bytearray((n >> 3) + 1)
        i = shorter[i]
        while at < n:
            while i >= 0:
                to = at + size[i]
                if not failed[to >> 3] >> (to & 7) & 1 and (last < 0 or apart[last * count + i]):
                    break
                i = shorter[i]
            if i >= 0:
                out.append(i)
                at, last = to, i
                if at < n:
                    i = next(longest(text, at))[1]
            else:
                failed[at >> 3] |= 1 << (at & 7)
                if not out:
                    raise ValueError("no way through the pieces")
                i = shorter[out.pop()]
                at -= size[last]
                last = out[-1] if out else -1
        return out

    def encode(self, word: str) -> list[int]:
        """Ids of a part of a text; spaces are marked already."""
        if self.letters.issuperset(word):
            return self.run(word) if word else []
        out: list[int] = []
        start = 0
        for at, c in enumerate(word):
            if c not in self.letters:
                if at > start:
                    out += self.run(word[start:at])
                out += [self.of_byte[b] for b in c.encode()]
                start = at + 1
        return out + self.run(word[start:]) if start < len(word) else out


class PieceCodec:
    """Encodes texts and decodes ids; remembers words."""

    def __init__(self, path: str) -> None:
        self.pieces = Pieces(path)
        self.known = Known(self.ids_of, WORDS_KEPT)
        self.first = np.array([self.pieces.begin], "<u4").tobytes()
        self.last = np.array([self.pieces.end], "<u4").tobytes()

    def ids_of(self, word: str) -> bytes:
        return array("I", self.pieces.encode(word)).tobytes()

    def raw(self, text: str) -> bytes:
        """Little-endian 32-bit ids of a text, without begin and end."""
        if not text:
            return b""
        words = self.pieces.words.findall(SPACE + text.replace(" ", SPACE))
        if max(map(len, words)) > LONG_WORD:
            return b"".join([self.known[w] if len(w) <= LONG_WORD else self.ids_of(w) for w in words])
        return b"".join(map(self.known.__getitem__, words))

    def encode(self, text: str) -> np.ndarray:
        """All ids of a text, with begin and end."""
        return np.frombuffer(self.first + self.raw(text) + self.last, "<u4")

    def decode(self, ids: np.ndarray) -> str:
        """The text of ids; the space that encoding puts first goes."""
        given = b"".join(map(self.pieces.bytes.__getitem__, ids.tolist()))
        return (given[1:] if given.startswith(b" ") else given).decode("utf-8", "replace")


@lru_cache(1)
def codec_of(path: str) -> PieceCodec:
    """One for a worker process, so that later tasks know the words of earlier ones."""
    return PieceCodec(path)


def encoded(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id and ``ids``, the pieces of its whole text with begin and end."""
    return _per_document(docs, model, id_col, text_col, ["ids"])


def round_trip(docs: DataFrame, model: str, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """Per document: id, ``n_tokens``, ``ids_sha256`` of the ids as little-endian unsigned
    32-bit integers, and ``decoded_sha256`` of the text decoded from the ids."""
    return _per_document(docs, model, id_col, text_col, ["n_tokens", "ids_sha256", "decoded_sha256"])


def _per_document(docs: DataFrame, model: str, id_col: str, text_col: str, wanted: list[str]) -> DataFrame:
    import hashlib

    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    kinds = {"n_tokens": "long", "ids_sha256": "string", "decoded_sha256": "string", "ids": "array<int>"}

    def make():
        codec = codec_of(model)

        def work(part: pa.RecordBatch) -> dict:
            found = [codec.encode(t) for t in part.column("text").to_pylist()]
            out = {"id": part.column("id"), "n_tokens": pa.array(list(map(len, found)), pa.int64())}
            if "ids" in wanted:
                flat = np.concatenate(found) if found else np.zeros(0, "<u4")
                out["ids"] = pa.ListArray.from_arrays(pa.array(np.cumsum([0, *map(len, found)]), pa.int32()), pa.array(flat.astype(np.int32)))
            else:
                out["ids_sha256"] = pa.array([hashlib.sha256(x).hexdigest() for x in found], pa.string())
                out["decoded_sha256"] = pa.array([hashlib.sha256(codec.decode(x).encode()).hexdigest() for x in found], pa.string())
            return out

        return work

    schema = f"id {docs.schema[id_col].dataType.simpleString()}, " + ", ".join(f"{w} {kinds[w]}" for w in wanted)
    return per_slice(given, "text", schema, make).withColumnRenamed("id", id_col)
