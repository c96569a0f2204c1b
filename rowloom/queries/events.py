"""Event analysis on the events table."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.intervals import event_intervals, event_pivot, overlap_split, previous_event
from rowloom.operators.ordered import global_row_number, with_running_count
from rowloom.operators.route import FAIL, PASS
from rowloom.queries.registry import query

MINUTES = "round_even((epoch_us({a}) - epoch_us({b})) / 60000000.0::DOUBLE, 2)"


@query(
    "prev_event_minutes",
    f"""SELECT event_id, user_id, event_type, ts, "PREVIOUS_ts", {MINUTES.format(a="ts", b='"PREVIOUS_ts"')} AS "INTERVAL_MIN"
        FROM (SELECT *, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS "PREVIOUS_ts" FROM events)
        WHERE "PREVIOUS_ts" IS NOT NULL""",
)
def prev_event_minutes(t):
    rows = t.events.select("event_id", "user_id", "event_type", "ts")
    return event_intervals(rows, ["user_id"], "ts", "ts", ["ts", "event_id"])


@query(
    "prev_event_columns",
    """SELECT event_id, user_id, "PREVIOUS_event_type", "PREVIOUS_value" FROM
         (SELECT event_id, user_id, event_type, lag(event_id) OVER w AS p, lag(event_type) OVER w AS "PREVIOUS_event_type",
                 lag(value) OVER w AS "PREVIOUS_value" FROM events
          WINDOW w AS (PARTITION BY user_id, event_type ORDER BY ts, event_id))""",
)
def prev_event_columns(t):
    """Two keys; the first row of a group is kept."""
    rows = t.events.select("event_id", "user_id", "event_type", "ts", "value")
    out = previous_event(rows, ["user_id", "event_type"], ["ts", "event_id"], ["event_type", "value"], keep_first=True)
    return out.select("event_id", "user_id", "PREVIOUS_event_type", "PREVIOUS_value")


@query(
    "prev_event_split",
    """SELECT event_id, event_type, lag(event_id) OVER (PARTITION BY event_type ORDER BY ts, event_id) AS before
       FROM events""",
)
def prev_event_split(t):
    """Few large groups, cut along their order into cells of a bounded size."""
    rows = t.events.select("event_id", "event_type", "ts").withColumn("before", F.col("event_id"))
    out = previous_event(
        rows, ["event_type"], ["ts", "event_id"], ["before"], keep_first=True, group_rows=500
    )
    return out.select("event_id", "event_type", F.col("PREVIOUS_before").alias("before"))


@query(
    "row_number_group",
    """SELECT event_id, count(CASE WHEN value > 10 THEN 1 END) OVER (
           PARTITION BY event_type ORDER BY ts, event_id ROWS UNBOUNDED PRECEDING) AS n FROM events""",
)
def row_number_group(t):
    """A running count in large groups."""
    rows = t.events.select("event_id", "event_type", "ts", "value")
    out = with_running_count(rows, ["event_type"], ["ts", "event_id"], "n", F.col("value") > 10, group_rows=500)
    return out.select("event_id", "n")


BY_DAY = "PARTITION BY CAST(date_trunc('day', ts) AS DATE) ORDER BY ts, event_id"


def _days(t):
    return t.events.select("event_id", "ts", "value", F.to_date("ts").alias("day"))


@query("prev_event_by_day", f"SELECT event_id, lag(event_id) OVER ({BY_DAY}) AS before FROM events")
def prev_event_by_day(t):
    """Groups that follow one another in the order, each cut at its own quantiles."""
    rows = _days(t).withColumn("before", F.col("event_id"))
    out = previous_event(rows, ["day"], ["ts", "event_id"], ["before"], keep_first=True, group_rows=20)
    return out.select("event_id", F.col("PREVIOUS_before").alias("before"))


@query(
    "running_count_by_day",
    f"SELECT event_id, count(CASE WHEN value > 10 THEN 1 END) OVER ({BY_DAY} ROWS UNBOUNDED PRECEDING) AS n FROM events",
)
def running_count_by_day(t):
    return with_running_count(_days(t), ["day"], ["ts", "event_id"], "n", F.col("value") > 10, group_rows=20).select("event_id", "n")


@query(
    "row_number_global",
    """SELECT row_number() OVER (ORDER BY user_id, ts, event_id) AS "ROWNUM", event_id FROM events""",
)
def row_number_global(t):
    rows = t.events.select("event_id", "user_id", "ts")
    return global_row_number(rows, ["user_id", "ts", "event_id"]).select("ROWNUM", "event_id")


PIVOT = """SELECT user_id,
    arg_max(ts, ts) FILTER (event_type = 'view') AS work_start, arg_max(ts, ts) FILTER (event_type = 'click') AS proc_start,
    arg_max(ts, ts) FILTER (event_type = 'purchase') AS proc_end, arg_max(value, ts) FILTER (event_type = 'purchase') AS quantity,
    arg_max(ts, ts) FILTER (event_type = 'signup') AS work_end FROM events"""
NAMES = {
    "view": {"ts": "work_start"},
    "click": {"ts": "proc_start"},
    "purchase": {"ts": "proc_end", "value": "quantity"},
    "signup": {"ts": "work_end"},
}


@query("event_pivot", f"SELECT * FROM ({PIVOT} GROUP BY user_id) WHERE work_start IS NOT NULL AND proc_start IS NOT NULL AND proc_end IS NOT NULL AND work_end IS NOT NULL")
def event_pivot_query(t):
    return event_pivot(t.events, ["user_id"], "event_type", NAMES, "ts")


DAILY = "SELECT *, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events"


@query(
    "event_pivot_partial",
    PIVOT.replace("SELECT user_id", "SELECT user_id, day").replace("FROM events", f"FROM ({DAILY})")
    + " WHERE event_type <> 'error' GROUP BY user_id, day",
)
def event_pivot_partial(t):
    """Keys that lack some of the events are kept, with NULLs."""
    rows = t.events.withColumn("day", F.date_trunc("day", "ts").cast("timestamp_ntz"))
    return event_pivot(rows, ["user_id", "day"], "event_type", NAMES, "ts", complete=False)


SPANS_SQL = """SELECT event_id, user_id, ts AS proc_start, ts + to_minutes(CAST(floor(value) * 20 AS BIGINT)) AS proc_end FROM events"""
CHAIN = f"""SELECT *, lag(proc_end) OVER (PARTITION BY user_id ORDER BY proc_end, event_id) AS "PREVIOUS_proc_end" FROM ({SPANS_SQL})"""
OVERLAPS = """proc_start < "PREVIOUS_proc_end" AND proc_end > "PREVIOUS_proc_end" """


def _spans(t):
    return t.events.select(
        "event_id",
        "user_id",
        F.col("ts").alias("proc_start"),
        (F.col("ts") + F.make_dt_interval(mins=(F.floor("value") * 20).cast("int"))).alias("proc_end"),
    )


@query(
    "overlap_split",
    f"""SELECT *, {MINUTES.format(a="proc_end", b='"PREVIOUS_proc_end"')} AS "INTERVAL_MIN" FROM ({CHAIN})
        WHERE {OVERLAPS}""",
)
def overlap_split_query(t):
    return overlap_split(_spans(t), ["user_id"], "proc_start", "proc_end", ["proc_end", "event_id"])[PASS]


@query(
    "overlap_rejected",
    f"""SELECT * FROM ({CHAIN}) WHERE "PREVIOUS_proc_end" IS NOT NULL AND NOT ({OVERLAPS})""",
)
def overlap_rejected(t):
    return overlap_split(_spans(t), ["user_id"], "proc_start", "proc_end", ["proc_end", "event_id"])[FAIL]


