"""Toxic texts: Levenshtein automata intersected with a trie of learned terms, and
the context of each mention.

Learning.  Terms are whole words and word stems (prefixes) that stand in toxic
labelled documents far more often than chance; a stem covers words not seen before.
Terms are counted over at most ``SAMPLE_ROWS`` labelled documents (those with the
least hashes), which is the documented bound of what the classifier is fitted on.

Matching.  ``Automaton`` runs a word through all terms' automata of edit distance 1 at
once: its states are sets of (trie node, errors), made when first reached, so that a
word costs one step for each letter until no term can match.  Of a white-space word its
letter runs are matched, and the word itself without outer punctuation, so that a digit or
symbol can be the edit.

Scoring.  A mention belongs to a channel: exact, misspelled or quoted (in quotation
marks within ``QUOTE_WORDS`` words on both sides).  Each term has log odds in each
channel, counted on the labelled documents, so that a misspelling which is a word of
clean documents loses its weight.  A logistic regression on the highest odds and the
sum of the odds of each channel gives the score; without evidence a quoted mention
weighs a quarter of an exact one.

Null and empty texts score the prior without any term.  Labels that are null are left
out; of several labels of a document the highest counts.  With no labels no term is
known and every score is the same, below 0.5.
"""

from __future__ import annotations

import math
import re
from collections.abc import Sequence

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import StructType

from rowloom.llm.common import Words, cut, give_back, packed, slices, whole

SAMPLE_ROWS = 30_000
MAX_TERMS = 2_000
"""Terms kept, the surest first; they are broadcast."""
STEMS = range(4, 11)
FUZZY_LETTERS = 5
"""Shorter terms must match exactly."""
QUOTE_WORDS = 12
STATES_KEPT = 20_000
"""States of the automaton that a task remembers; when there are more it builds them anew."""
THRESHOLD = 0.7

_TOKEN = re.compile(r"[^\W\d_]+")
_OUTER = re.compile(r"^[\W_]+|[\W_]+$")
_OPENS = re.compile(r"[^\w]*[\"“„«‹]\w")
_CLOSES = re.compile(r"\w[^\w]*[\"”“»›]")


class Automaton:
    """All terms within one edit of a word.  A stem (``lowe*``) matches any word that
    begins with it; a misspelled stem must be followed as it is.  The edit may be at the
    first letter only with ``first``."""

    def __init__(self, terms: list[str], first: bool = False) -> None:
        self.first = first
        self.children: list[dict[str, int]] = [{}]
        self.ends: list[tuple[int, bool] | None] = [None]  # term and whether it is a stem
        self.deep = [0]
        for number, term in enumerate(terms):
            node, stem = 0, term.endswith("*")
            for c in term.rstrip("*"):
                if c not in self.children[node]:
                    self.children[node][c] = len(self.children)
                    self.children.append({})
                    self.ends.append(None)
                    self.deep.append(self.deep[node] + 1)
                node = self.children[node][c]
            self.ends[node] = (number, stem)
        self.known: dict[str, tuple] = {}
        self._anew()

    def _anew(self) -> None:
        """Forgets all states but the first; they are made as words ask for them."""
        self.states: list[tuple[frozenset, tuple, tuple]] = []
        self.numbers: dict[frozenset, int] = {}
        self.steps: list[dict[str, int]] = []
        self.start = self._state(self._closed({(0, 0)}))

    def _closed(self, nodes: set) -> frozenset:
        """With the term's letters that the word may leave out."""
        return frozenset(nodes | {(k, 1) for n, e in nodes if e == 0 for k in self.children[n].values()})

    def _state(self, nodes: frozenset) -> int:
        if nodes not in self.numbers:
            now, last = set(), set()
            for n, e in nodes:
                if self.ends[n] and not (e and self.deep[n] < FUZZY_LETTERS):
                    (now if self.ends[n][1] else last).add((self.ends[n][0], e))
            self.numbers[nodes] = len(self.states)
            self.states.append((nodes, tuple(now), tuple(last)))
            self.steps.append({})
        return self.numbers[nodes]

    def _step(self, state: int, c: str) -> int:
        after = set()
        for n, e in self.states[state][0]:
            if c in self.children[n]:
                after.add((self.children[n][c], e))
            if e == 0 and (n or self.first):
                after.add((n, 1))
                after.update((k, 1) for k in self.children[n].values())
        self.steps[state][c] = to = self._state(self._closed(after))
        return to

    def match(self, word: str) -> tuple[tuple[int, int], ...]:
        """(term, edits) of each term that matches, with its least edits."""
        if word in self.known:
            return self.known[word]
        if len(self.states) > STATES_KEPT:
            self._anew()
        best: dict[int, int] = {}
        state = self.start
        for c in word:
            state = self.steps[state][c] if c in self.steps[state] else self._step(state, c)
            nodes, now, _ = self.states[state]
            for t, e in now:
                best[t] = min(e, best.get(t, 9))
            if not nodes:
                break
        for t, e in self.states[state][2]:
            best[t] = min(e, best.get(t, 9))
        if len(self.known) > 50_000:
            self.known.clear()
        self.known[word] = found = tuple(sorted(best.items()))
        return found


CHANNELS = ("exact", "misspelled", "quoted")


def matches(word: str, automaton: Automaton) -> list[tuple[int, int]]:
    """(term, edits) in the letter runs of a white-space word; of terms in none of them
    those that the word matches as it is."""
    found = [m for t in _TOKEN.findall(word) for m in automaton.match(t)]
    known = {t for t, _ in found}
    return found + [m for m in automaton.match(_OUTER.sub("", word)) if m[0] not in known]


def mentions(texts: pa.Array, automaton: Automaton) -> list[dict[tuple[int, str], int]]:
    """For each text, (term, channel) and how often."""
    seen = Words(pc.utf8_lower(texts))
    out: list[dict[tuple[int, str], int]] = [{} for _ in range(len(texts))]
    vocabulary = seen.vocabulary.to_pylist()
    hits = {i: found for i, w in enumerate(vocabulary) if (found := matches(w, automaton))}
    if not hits:
        return out
    is_hit = np.zeros(len(vocabulary), bool)
    is_hit[list(hits)] = True
    opens = np.array([bool(_OPENS.match(w)) for w in vocabulary])
    closes = np.array([bool(_CLOSES.search(w)) for w in vocabulary])
    quotes = bool(opens.any() and closes.any())
    for at in np.flatnonzero(is_hit[seen.ids]):
        row = seen.owner[at]
        quoted = quotes and in_quotes(opens, closes, seen.ids[seen.starts[row] : seen.starts[row + 1]], at - seen.starts[row])
        for term, edits in hits[seen.ids[at]]:
            key = term, "quoted" if quoted else "misspelled" if edits else "exact"
            out[row][key] = out[row].get(key, 0) + 1
    return out


def in_quotes(opens: np.ndarray, closes: np.ndarray, words: np.ndarray, at: int) -> bool:
    """A quotation begins few words before and has not ended there, and ends few words after."""
    before, after = words[max(0, at - QUOTE_WORDS) : at + 1], words[at : at + QUOTE_WORDS + 1]
    begun = np.flatnonzero(opens[before])
    return bool(len(begun)) and not closes[before[begun[-1] : -1]].any() and bool(closes[after].any())


class Model:
    """Terms, the log odds of (term, channel), and the weights of ``features``."""

    def __init__(self, terms: list[str], odds: dict[tuple[int, str], float], weights: np.ndarray) -> None:
        self.terms, self.odds, self.weights = terms, odds, weights

    def features(self, found: dict[tuple[int, str], int]) -> list[float]:
        """1; of each channel the highest odds and the logarithm of their sum."""
        out = [1.0]
        for c in CHANNELS:
            of = [self.odds.get(k, 0.0) for k in found if k[1] == c] or [0.0]
            out += [max(of), math.log1p(sum(of))]
        return out

    def score(self, found: dict[tuple[int, str], int]) -> float:
        x = float(np.dot(self.weights, self.features(found)))
        return 1 / (1 + math.exp(-max(-30.0, min(30.0, x))))


def start_weights(prior: float) -> np.ndarray:
    """Where fitting begins and stays without evidence: the odds of an exact mention
    count whole, a misspelled one's most, a quoted one's little."""
    return np.array([prior, 1.0, 0.0, 0.8, 0.0, 0.25, 0.0])


def fitted(x: np.ndarray, y: np.ndarray, prior: float, ridge: float = 2.0) -> np.ndarray:
    """Logistic regression by Newton steps, pulled to ``start_weights``."""
    w = start = start_weights(prior)
    for _ in range(25):
        p = 1 / (1 + np.exp(-np.clip(x @ w, -30, 30)))
        gradient = x.T @ (p - y) + ridge * (w - start)
        curve = (x * (p * (1 - p))[:, None]).T @ x + ridge * np.eye(len(w))
        w = w - np.clip(np.linalg.solve(curve, gradient), -2, 2)
    return w


def _count_terms(batches):
    """Labelled documents in, (term, toxic documents, other documents) out."""
    for batch in batches:
        for part in slices(batch, "text"):
            seen = Words(pc.utf8_lower(part.column("text")))
            toxic = np.asarray(part.column("toxic"), dtype=np.int64)
            words = [max(_TOKEN.findall(w), key=len, default="") for w in seen.vocabulary.to_pylist()]
            for n in (None, *STEMS):
                names = ["" if len(w) < (n or 1) else w if n is None else w[:n] + "*" for w in words]
                code = {t: i for i, t in enumerate(dict.fromkeys(names))}
                of = np.array([code[t] for t in names], np.int64)[seen.ids] if words else np.zeros(0, np.int64)
                pairs = np.unique(seen.owner * max(1, len(code)) + of)
                term, row = pairs % max(1, len(code)), pairs // max(1, len(code))
                k1 = np.bincount(term[toxic[row] > 0], minlength=len(code))
                k0 = np.bincount(term[toxic[row] == 0], minlength=len(code))
                keep = np.array([bool(t) for t in code], bool)
                yield pa.RecordBatch.from_arrays([pa.array([t for t in code if t], pa.string()), pa.array(k1[keep]), pa.array(k0[keep])], ["term", "k1", "k0"])


def learn(docs: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", label_col: str = "toxic") -> Model:
    """From documents with a label."""
    spark = docs.sparkSession
    chosen = (labels.where(F.col(label_col).isNotNull() & F.col(id_col).isNotNull()).groupBy(F.col(id_col).alias("id"))
              .agg(F.max((F.col(label_col) > 0).cast("int")).alias("toxic")).orderBy(F.xxhash64("id"), "id").limit(SAMPLE_ROWS))
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))
    # at most SAMPLE_ROWS ids and labels are broadcast
    train = cut(given.join(F.broadcast(chosen), "id").select("text", "toxic"))
    n = {r["toxic"]: r["n"] for r in train.groupBy("toxic").agg(F.count(F.lit(1)).alias("n")).collect()}
    n1, n0 = n.get(1, 0), n.get(0, 0)
    if not n1 or not n0:
        return Model([], {}, start_weights(math.log((n1 + 0.5) / (n0 + n1 + 5))))
    share = n1 / (n0 + n1)
    counted = train.mapInArrow(_count_terms, "term string, k1 long, k0 long").groupBy("term").agg(F.sum("k1").alias("k1"), F.sum("k0").alias("k0"))
    # a term must speak for abuse by itself; words of a subject only lean to it
    counted = cut(counted.where((F.col("k1") >= 2) & (F.col("k1") > F.col("k0"))))
    tried = counted.where("k1 >= 3").count()
    both = F.col("k1") + F.col("k0")
    surprise = F.col("k1") * F.log(F.col("k1") / (both * share)) + F.when(F.col("k0") > 0, F.col("k0") * F.log(F.col("k0") / (both * (1 - share)))).otherwise(0.0)
    top = counted.withColumn("s", surprise).where(F.col("s") > math.log(tried + 1) + 2).orderBy(F.desc("s"), F.length("term"), "term").limit(20 * MAX_TERMS).collect()
    terms = chosen_terms([(r["term"], r["k1"], r["k0"]) for r in top], n1, n0)
    known = spark.sparkContext.broadcast(terms)

    def found_in(batches):
        automaton = Automaton(known.value, first=True)
        for batch in batches:
            for part in slices(batch, "text"):
                per = mentions(part.column("text"), automaton)
                found = [[f"{t} {c}" for t, c in sorted(m)] for m in per]
                yield pa.RecordBatch.from_arrays([pa.array(found, pa.list_(pa.string())), part.column("toxic")], ["found", "toxic"])

    # one row of at most SAMPLE_ROWS for each labelled document
    rows = [({(int(k.split()[0]), k.split()[1]): 1 for k in r["found"]}, r["toxic"]) for r in train.mapInArrow(found_in, "found array<string>, toxic int").collect()]
    counts: dict[tuple[int, str], list[int]] = {}
    for found, toxic in rows:
        for key in found:
            counts.setdefault(key, [0, 0])[toxic] += 1
    odds, prior = {}, math.log(share / (1 - share))

    def log_odds(k1: float, k0: float) -> float:
        """0 for a channel that as many clean as toxic documents use."""
        return math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1)) if k1 > k0 else 0.0

    for t in range(len(terms)):
        exact = counts.get((t, "exact"), (0, 0))[::-1]
        odds[t, "exact"] = log_odds(*exact)
        for c in CHANNELS[1:]:
            k0, k1 = counts.get((t, c), (0, 0))
            odds[t, c] = min(odds[t, "exact"], log_odds(k1 + exact[0] / 20, k0))
    model = Model(terms, odds, start_weights(prior))
    x = np.array([model.features(found) for found, _ in rows])
    model.weights = fitted(x, np.array([toxic for _, toxic in rows], float), prior)
    return model


def chosen_terms(rows: list[tuple[str, int, int]], n1: int, n0: int) -> list[str]:
    """Of terms that contain one another (a stem and its words) the surest one; of
    equal ones the longest stem."""
    odds = {t: math.log((k1 + 0.5) / (n1 + 1)) - math.log((k0 + 0.5) / (n0 + 1)) for t, k1, k0 in rows}
    seen = {t: (k1, k0) for t, k1, k0 in rows}
    out = []
    for t, k1, k0 in rows:
        bare = t.rstrip("*")
        shorter = [bare[:n] + "*" for n in range(1, len(bare) + (not t.endswith("*")))]
        if any(s in seen and odds[s] > odds[t] for s in shorter):
            continue  # a stem says more
        if any(s in seen and seen[s] == (k1, k0) for s in ([bare + "*"] if not t.endswith("*") else [])):
            continue  # the word is the only one with that stem: the stem says the same
        longer = [u for u in seen if u.endswith("*") and len(u) > len(t) and u.startswith(bare)] if t.endswith("*") else []
        if any(seen[u] == (k1, k0) for u in longer):
            continue  # more letters, the same documents
        out.append(t)
    return out[:MAX_TERMS]


def toxicity(docs: DataFrame, model: Model, carry: Sequence[str] = ("doc_id",), text_col: str = "text") -> DataFrame:
    """Per document: ``row`` with the carried columns, ``score``, and the mentions by channel."""
    known = docs.sparkSession.sparkContext.broadcast(model)
    given = docs.select(packed(docs, carry), whole(text_col).alias("text"))

    def run(batches):
        automaton = Automaton(known.value.terms, first=True)
        for batch in batches:
            for part in slices(batch, "text"):
                yield _scored(part, known.value, automaton)
        del automaton
        give_back()

    more = StructType.fromDDL("score double, n_exact long, n_misspelled long, n_quoted long")
    return given.mapInArrow(run, StructType([given.schema["row"], *more.fields]))


def without_toxic(docs: DataFrame, model: Model, text_col: str = "text", threshold: float = THRESHOLD) -> DataFrame:
    """The rows of ``docs`` that score below the threshold."""
    return toxicity(docs, model, docs.columns, text_col).where(F.col("score") < threshold).select("row.*")


def _scored(part: pa.RecordBatch, model: Model, automaton: Automaton) -> pa.RecordBatch:
    per = mentions(part.column("text"), automaton)
    counts = [pa.array([sum(n for (_, c), n in found.items() if c == channel) for found in per], pa.int64()) for channel in CHANNELS]
    scores = pa.array([model.score(found) for found in per], pa.float64())
    return pa.RecordBatch.from_arrays([part.column("row"), scores, *counts], ["row", "score", *[f"n_{c}" for c in CHANNELS]])
