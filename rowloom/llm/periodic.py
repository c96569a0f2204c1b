"""Runs: stretches of a text's words that repeat with a period, and texts without them.

A run is a maximal stretch with smallest period q and at least ``max(24, 3 q)`` words.
For each period p a grid of places is laid over a text, ``max(24 - p, 2 p)`` words apart,
so that every run with that period holds a grid place i and the place i + p; how far the
words from both agree to the right and to the left (longest common extension, LCE) gives
the stretch.  The grids of all periods together have n log n places.

LCE queries use a difference cover: residues D modulo ``COVER`` such that every
difference is one of two members.  Only suffixes at places with such residues are
sorted, and any two places reach two of them together after fewer than ``COVER`` words.
Those words are compared one by one; beyond, the least common prefix between the two
ranks is looked up in a sparse table.  Suffixes are sorted only of texts in which some
query gets that far.

A null text has no words.  A row without id is never altered by ``planted``.  Repeated
rows are worked on alike.  Words are the same only if all their characters are.
"""

from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

from rowloom.llm.common import Words, per_slice, whole

LEAST = 24
"""Least words of a run."""
TIMES = 3
"""Least length of a run in periods."""
QUERIES = 1_500_000
"""Grid places that are looked at together."""

COVER = 31
# A perfect difference set: each difference modulo 31 is that of one pair of members.
_D = np.array([1, 5, 11, 24, 25, 27])
_AHEAD = np.zeros(COVER, np.int64)  # for each difference the member that has a partner there
for _x in _D.tolist():
    for _y in _D.tolist():
        _AHEAD[(_y - _x) % COVER] = _x
_SAMPLED = np.isin(np.arange(COVER), _D)


class CoverLce:
    """Common extensions to the right of any two places of an array of numbers."""

    def __init__(self, given: np.ndarray) -> None:
        self.n = len(given)
        # beyond the end every place has a number of its own
        self.words = np.r_[given.astype(np.int64), -1 - np.arange(2 * COVER)]
        at = np.flatnonzero(_SAMPLED[np.arange(self.n) % COVER])
        blocks = np.lib.stride_tricks.sliding_window_view(self.words, COVER)[at]
        _, rank = np.unique(np.ascontiguousarray(blocks).view(f"V{8 * COVER}").ravel(), return_inverse=True)
        # suffixes as rows of blocks: those of one residue follow each other
        order = np.lexsort((at, at % COVER))
        rank, place = rank[order].astype(np.int64), at[order]
        self.index = np.full(self.n + COVER, -1)
        self.index[place] = np.arange(len(place))
        last = np.r_[np.diff(place % COVER) != 0, True] if len(place) else np.zeros(0, bool)
        ahead = np.arange(1, len(place) + 1)
        ahead[last] = len(place)  # an end of its own
        levels = [np.r_[rank, -1]]
        jumps = [np.r_[ahead, len(place)]]
        while len(place) and int(levels[-1].max()) < len(place) - 1:
            one, jump = levels[-1], jumps[-1]
            both = one * (len(place) + 1) + one[jump] + 1
            _, ranks = np.unique(both[:-1], return_inverse=True)
            levels.append(np.r_[ranks, -1])
            jumps.append(jump[jump])
        self.rank = levels[-1][:-1]
        suffixes = np.empty(len(place), np.int64)
        suffixes[self.rank] = np.arange(len(place))
        # blocks that neighbours in the order have in common, from the longest step down
        x, y = suffixes[:-1].copy(), suffixes[1:].copy()
        common = np.zeros(len(x), np.int64)
        for k in range(len(levels) - 1, -1, -1):
            same = (levels[k][x] == levels[k][y]) & (x < len(place)) & (y < len(place))
            common[same] += 1 << k
            x[same], y[same] = jumps[k][x[same]], jumps[k][y[same]]
        self.table = [common]
        step = 1
        while 2 * step <= len(common):
            below = self.table[-1]
            self.table.append(np.minimum(below[: len(below) - step], below[step:]))
            step *= 2

    def blocks(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """Whole blocks that the suffixes at sampled places have in common."""
        x, y = self.rank[self.index[i]], self.rank[self.index[j]]
        low, high = np.minimum(x, y), np.maximum(x, y)
        level = np.frexp(high - low)[1] - 1
        out = np.zeros(len(i), np.int64)
        for k in np.unique(level).tolist():
            of = level == k
            row = self.table[k]
            out[of] = np.minimum(row[low[of]], row[high[of] - (1 << k)])
        return out

    def walk(self, i: np.ndarray, j: np.ndarray, most: np.ndarray) -> np.ndarray:
        """Words that agree from both places on, at most so many."""
        out = np.zeros(len(i), np.int64)
        live = np.flatnonzero(most > 0)
        step = 0
        while len(live):
            live = live[self.words[i[live] + step] == self.words[j[live] + step]]
            step += 1
            out[live] = step
            live = live[most[live] > step]
        return out

    def __call__(self, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        """For i < j: how many words from i on equal those from j on."""
        most = (_AHEAD[(j - i) % COVER] - i) % COVER
        out = self.walk(i, j, most)
        far = np.flatnonzero((out == most) & (j + most < self.n))
        if len(far):
            a, b = i[far] + most[far], j[far] + most[far]
            jump = COVER * self.blocks(a, b)
            rest = self.walk(a + jump, b + jump, np.full(len(far), COVER))
            out[far] += jump + rest
        return out


def extensions(words: np.ndarray, i: np.ndarray, j: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """How far words from i and j (i < j) agree: to the right, these included, and to the
    left of them."""
    n = len(words)
    right = CoverLce(words)(i, j)
    left = np.zeros(len(i), np.int64)
    inner = np.flatnonzero(i > 0)
    if len(inner):
        left[inner] = CoverLce(words[::-1])(n - j[inner], n - i[inner])
    return right, left


def grid(sizes: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES):
    """Blocks of grid places ``(place, period)`` of texts of so many words."""
    longest = np.where(sizes >= least, sizes // times, 0)
    text = np.repeat(np.arange(len(sizes)), longest)
    period = np.arange(len(text)) - np.repeat(np.cumsum(longest) - longest, longest) + 1
    apart = np.maximum(least - period, (times - 1) * period)
    places = -(-(sizes[text] - period) // apart)
    ends = np.cumsum(places)
    first = 0
    while first < len(text):
        before = int(ends[first - 1]) if first else 0
        stop = max(first + 1, int(np.searchsorted(ends, before + QUERIES, "right")))
        count = places[first:stop]
        nth = np.arange(int(ends[stop - 1]) - before) - np.repeat(ends[first:stop] - count - before, count)
        yield np.repeat(starts[text[first:stop]], count) + nth * np.repeat(apart[first:stop], count), np.repeat(period[first:stop], count)
        first = stop


def find_runs(ids: np.ndarray, starts: np.ndarray, least: int = LEAST, times: int = TIMES) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Runs of texts, ``starts`` being where each begins and the end of the last: text,
    first word (counted in the text), length and period, by text, first word and period."""
    sizes = np.diff(starts)
    places, periods = [], []
    for i, p in grid(sizes, starts[:-1], least, times):
        hit = ids[i] == ids[i + p]
        places.append(i[hit])
        periods.append(p[hit])
    i, p = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (places, periods))
    owner = np.searchsorted(starts, i, "right") - 1
    # a few words on both sides tell most of them apart; the others' texts are sorted
    few = _near(ids, i, p, starts[owner], starts[owner + 1], most=least)
    hit = few >= np.maximum(least, times * p) - p
    hit |= few < 0
    i, p, owner = i[hit], p[hit], owner[hit]
    if not len(i):
        none = np.zeros(0, np.int64)
        return none, none, none, none
    # these texts alone, one after the other, each ended by a number of its own
    some = np.unique(owner)
    own = sizes[some] + 1
    moved = np.r_[0, np.cumsum(own)]
    words = np.empty(moved[-1], np.int64)
    words[moved[1:] - 1] = -1_000_000 - np.arange(len(some))
    inner = np.ones(len(words), bool)
    inner[moved[1:] - 1] = False
    words[inner] = ids[np.repeat(starts[some], sizes[some]) + np.arange(sizes[some].sum()) - np.repeat(np.cumsum(sizes[some]) - sizes[some], sizes[some])]
    nth = np.searchsorted(some, owner)
    here = i - starts[owner] + moved[nth]
    right, left = extensions(words, here, here + p)
    length = right + left + p
    hit = length >= np.maximum(least, times * p)
    first, length, period, owner = (here - left - moved[nth])[hit], length[hit], p[hit], owner[hit]
    # a run is found from several places, and for multiples of its period
    order = np.lexsort((period, length, first, owner))
    owner, first, length, period = owner[order], first[order], length[order], period[order]
    new = np.ones(len(order), bool)
    new[1:] = (owner[1:] != owner[:-1]) | (first[1:] != first[:-1]) | (length[1:] != length[:-1])
    owner, first, length, period = owner[new], first[new], length[new], period[new]
    order = np.lexsort((period, first, owner))
    return owner[order], first[order], length[order], period[order]


def _near(ids: np.ndarray, i: np.ndarray, p: np.ndarray, low: np.ndarray, high: np.ndarray, most: int) -> np.ndarray:
    """Words around i that equal those p further, both sides together; -1 where ``most``
    words of a side agree, so that the end was not seen."""
    out = np.zeros(len(i), np.int64)
    for step, base in ((1, 0), (-1, -1)):
        live = np.arange(len(i))
        for k in range(most):
            at = i[live] + base + step * k
            live = live[(at >= low[live]) & (at + p[live] < high[live])]
            at = i[live] + base + step * k
            live = live[ids[at] == ids[at + p[live]]]
            out[live[out[live] >= 0]] += 1
            if not len(live):
                break
        out[live] = -1
    return out


def planted(doc_id, n: int) -> np.ndarray | None:
    """Word numbers of a text into which a repeated end is planted, or None: one in ten
    ids, by crc32 of the decimal id."""
    if doc_id is None or not n:
        return None
    h = zlib.crc32(str(doc_id).encode())
    if h % 10:
        return None
    g = h // 10
    a = g % n
    p = 1 + (n - a) // (3 + g % 8)
    i = np.arange(n)
    i[a:] = a + (i[a:] - a) % p
    return i


def runs(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", alter=None, least: int = LEAST, times: int = TIMES) -> DataFrame:
    """Per document: id, ``runs`` (start, length, period; by start, then period) and
    ``collapsed``, its words without those that repeat the first period of a run, joined
    by one space.  ``alter(id, n)`` may give other word numbers to read a text by."""
    given = docs.select(F.col(id_col).alias("id"), whole(text_col).alias("text"))

    def make():
        def work(part: pa.RecordBatch) -> dict:
            seen = Words(part.column("text"))
            ids, starts = seen.ids, seen.starts
            names = part.column("id").to_pylist()
            other: dict[int, np.ndarray] = {}
            if alter is not None:
                ids = ids.copy()
                for d, (name, n) in enumerate(zip(names, np.diff(starts).tolist())):
                    order = alter(name, n)
                    if order is not None:
                        other[d] = order
                        ids[starts[d] : starts[d + 1]] = ids[starts[d] : starts[d + 1]][order]
            owner, first, length, period = find_runs(ids, starts, least, times)
            bounds = np.searchsorted(owner, np.arange(len(names) + 1))
            found, kept = [], []
            for d, text in enumerate(part.column("text").to_pylist()):
                words = text.encode().split()
                if d in other:
                    words = [words[k] for k in other[d].tolist()]
                some = slice(bounds[d], bounds[d + 1])
                here = [*zip(first[some].tolist(), length[some].tolist(), period[some].tolist())]
                found.append([{"start": s, "length": m, "period": q} for s, m, q in here])
                if here:
                    gone = np.zeros(len(words), bool)
                    for s, m, q in here:
                        gone[s + q : s + m] = True
                    words = [words[k] for k in np.flatnonzero(~gone).tolist()]
                kept.append(b" ".join(words).decode())
            return {"id": part.column("id"), "n_words": pa.array(np.diff(starts)), "runs": pa.array(found, pa.list_(_RUN)), "collapsed": pa.array(kept, pa.string())}

        return work

    kind = docs.schema[id_col].dataType.simpleString()
    return per_slice(given, "text", f"id {kind}, n_words long, runs array<struct<start:long,length:long,period:long>>, collapsed string", make).withColumnRenamed("id", id_col)


_RUN = pa.struct([("start", pa.int64()), ("length", pa.int64()), ("period", pa.int64())])


def most_repeated(runs: str = "runs"):
    """The run with the greatest length over period; of ties the first, then that with
    the smaller period.  Products of whole numbers are compared, so ties are exact."""
    better = lambda a, x: F.when(a.isNull() | (x["length"] * a["period"] > a["length"] * x["period"]), x).otherwise(a)
    return F.aggregate(runs, F.lit(None).cast("struct<start:long,length:long,period:long>"), better)


def run_lines(runs: str = "runs"):
    """``start,length,period`` and a line feed for every run."""
    return F.array_join(F.transform(runs, lambda x: F.concat(F.concat_ws(",", x["start"], x["length"], x["period"]), F.lit("\n"))), "")
