"""Finding hot keys: groups too large for one task.

Key hashes are sampled at a rate at which a hot key shows about a thousand times,
and counted by an ordinary distributed aggregation: one narrow scan and a shuffle
of a few bytes per thousands of rows.  The sample only steers the plan; results
never depend on it.  At most ``MAX_HOT`` keys are returned, the largest ones, so
any other key has less than 1/``MAX_HOT`` of all rows.
"""

from __future__ import annotations

import math
from collections.abc import Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, functions as F

MAX_HOT = 20_000
_SEEN = 1_000
_SEED = 7


class Hot(NamedTuple):
    """Estimated rows by key hash, and the rows that one task should get.  All hot
    keys together need at most ``2 * MAX_HOT`` tasks of that size."""

    counts: dict[int, int]
    limit: int

    @property
    def rows(self) -> int:
        return sum(self.counts.values())

    def pieces(self) -> dict[int, int]:
        return {h: math.ceil(n / self.limit) for h, n in self.counts.items()}


def sampled(df: DataFrame, rate: float) -> DataFrame:
    return df if rate >= 1 else df.sample(rate, _SEED)


def hot_hashes(df: DataFrame, keys: Sequence[Column], rows: int | None) -> Hot | None:
    """The keys with more than ``rows`` rows in a batch frame, or None.  Runs one job."""
    if not rows or df.isStreaming:
        return None
    rate = min(1.0, _SEEN / rows)
    counts = sampled(df.select(F.xxhash64(*keys).alias("h")), rate).groupBy("h").agg(F.count(F.lit(1)).alias("n"))
    top = counts.where(F.col("n") > rows * rate).orderBy(F.desc("n"), "h").limit(MAX_HOT).collect()
    found = {r["h"]: round(r["n"] / rate) for r in top}
    return Hot(found, max(rows, sum(found.values()) // MAX_HOT)) if found else None


def hot_keys(df: DataFrame, keys: Sequence[Column], rows: int | None) -> DataFrame | None:
    """The hot keys themselves as columns ``k0, k1 ...``, small enough to broadcast."""
    found = hot_hashes(df, keys, rows)
    if found is None:
        return None
    named = [k.alias(f"k{i}") for i, k in enumerate(keys)]
    wanted = df.where(F.xxhash64(*keys).isin(list(found.counts))).select(*named).distinct()
    return df.sparkSession.createDataFrame(wanted.collect(), wanted.schema)
