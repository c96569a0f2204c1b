"""Readable labels."""

from __future__ import annotations

from pyspark.sql import Column, functions as F


def duration_label(ms: Column) -> Column:
    """``950ms`` below a second, ``12.3s`` below a minute, else ``2m05s``."""
    whole = ms.cast("bigint")
    tenths = F.format_string("%.1fs", whole / F.lit(1000.0))
    minutes = F.floor(whole / F.lit(60_000)).cast("bigint")
    seconds = F.floor((whole % 60_000) / F.lit(1000)).cast("bigint")
    return (
        F.when(whole < 1000, F.format_string("%dms", whole))
        .when(whole < 60_000, tenths)
        .otherwise(F.format_string("%dm%02ds", minutes, seconds))
    )
