"""Registered queries: one Spark query and its ANSI SQL equivalent per operator."""

from __future__ import annotations

from rowloom.queries.registry import ORACLES, QUERIES, Tables  # noqa: F401
from rowloom.queries import (  # noqa: F401
    comparing,
    events,
    files,
    flows,
    joins,
    logs,
    merging,
    projection,
    routing,
    sqltext,
    streams,
)
