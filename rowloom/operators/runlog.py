"""Analysis of run logs: events, step records, totals, search, retention.

Inputs are plain tables.  ``logs``: run_id, line_no, ts, message.  ``runs``: id,
pipeline_name, pipeline_path, job_name, job_path, trigger, started_at, ended_at,
status, error_message.
"""

from __future__ import annotations

from collections.abc import Sequence
from datetime import datetime

from pyspark.sql import Column, DataFrame, functions as F

from rowloom.functions.values import micros_between
from rowloom.operators.ordered import with_next, with_running_count
from rowloom.operators.skew import hot_hashes

# The words and forms of a run log's event lines, which follow the
# step name in brackets; its level marks; the note of a cancelled step; and the
# status names.
START_WORD, DONE_WORD, ERROR_WORD, CANCEL_WORD = "実行中", "完了", "エラー:", "キャンセル"
DONE_ROWS = r"^完了\s*\((\d+)行\)"
ERROR_TEXT = r"^エラー:\s*(.+)$"
BLANKS = " \t\n\x0b\f\r"
ERROR_MARKS = ("エラー:", "===== エラー")
WARN_START, WARN_MARK = "警告", "警告:"
RUNNING, SUCCESS, FAILED, CANCELLED = "Running", "Success", "Failed", "Cancelled"


def level(message: Column) -> Column:
    """ERROR, WARN or INFO."""
    error = F.contains(message, F.lit(ERROR_MARKS[0])) | F.contains(message, F.lit(ERROR_MARKS[1]))
    warn = message.startswith(WARN_START) | F.contains(message, F.lit(WARN_MARK))
    return F.when(error, F.lit("ERROR")).when(warn, F.lit("WARN")).otherwise(F.lit("INFO"))


def with_levels(logs: DataFrame) -> DataFrame:
    return logs.withColumn("level", level(F.col("message")))


def parse_events(logs: DataFrame) -> DataFrame:
    """Log lines with ``kind`` (start / done / error / cancel, else NULL),
    ``step_name``, ``row_count`` and ``error_message``.

    Lines are told apart by plain text tests; a pattern is matched only on lines
    that report a row count or an error.  The one-element explode makes a message
    that is itself computed be computed once, not once per test.
    """
    m, rest, kind = F.col("__line"), F.col("__rest"), F.col("kind")
    closing = F.instr(m, "]")
    named = m.startswith("[") & (closing > 2)
    after = F.when(named, F.ltrim(F.substring(m, closing + 1, F.length(m)), F.lit(BLANKS)))
    counted = F.when(rest.startswith(DONE_WORD), F.regexp_extract(rest, DONE_ROWS, 1))
    failed = F.when(rest.startswith(ERROR_WORD), F.regexp_extract(rest, ERROR_TEXT, 1))
    found = (
        F.when(rest.startswith(START_WORD), F.lit("start"))
        .when(counted != "", F.lit("done"))
        .when(failed != "", F.lit("error"))
        .when(rest.startswith(CANCEL_WORD), F.lit("cancel"))
    )
    return (
        logs.withColumn("__line", F.explode(F.array("message")))
        .withColumn("__rest", after)
        .withColumn("kind", found)
        .withColumns(
            {
                "step_name": F.when(kind.isNotNull(), F.substring(m, F.lit(2), closing - 2)),
                "row_count": F.when(kind == "done", counted.try_cast("bigint")),
                "error_message": F.when(kind == "error", failed).when(kind == "cancel", F.lit(CANCEL_WORD)),
            }
        )
        .drop("__line", "__rest")
    )


def step_records(logs: DataFrame, runs: DataFrame, group_rows: int | None = None) -> DataFrame:
    """One record per started step.

    A step ends at the next event of its name in the run.  If that is another
    start, the step was never closed and stays ``Running``; if there is none, it
    takes the status, end and error of its run.
    """
    # A step of a run is no larger than the run: without hot runs nothing is cut.
    if hot_hashes(logs, [F.col("run_id")], group_rows) is None:
        group_rows = None
    events = parse_events(logs).where(F.col("kind").isNotNull())
    events = events.select("run_id", "line_no", "ts", "kind", "step_name", "row_count", "error_message")
    started = F.col("kind") == "start"
    numbered = with_running_count(events, ["run_id"], ["line_no"], "step_order", started, group_rows)
    close = F.struct("kind", "ts", "row_count", "error_message")
    paired = with_next(
        numbered.withColumn("__event", close),
        ["run_id", "step_name"],
        ["line_no"],
        {"__event": "__close"},
        group_rows,
    ).where(started)
    ends = runs.select(
        F.col("id").alias("run_id"),
        F.col("ended_at").alias("__run_end"),
        F.col("status").alias("__run_status"),
        F.col("error_message").alias("__run_error"),
    )
    joined = paired.drop("row_count", "error_message").join(ends, "run_id", "left")
    kind = F.col("__close.kind")
    orphan, reopened = F.col("__close").isNull(), kind == "start"
    status = (
        F.when(orphan, F.coalesce("__run_status", F.lit(RUNNING)))
        .when(reopened, F.lit(RUNNING))
        .when(kind == "done", F.lit(SUCCESS))
        .when(kind == "error", F.lit(FAILED))
        .otherwise(F.lit(CANCELLED))
    )
    ended = F.when(orphan, F.col("__run_end")).when(~reopened, F.col("__close.ts"))
    return joined.select(
        "run_id",
        F.col("step_order").cast("bigint").alias("step_order"),
        "step_name",
        F.col("ts").alias("started_at"),
        ended.alias("ended_at"),
        duration_ms(ended, F.col("ts")).alias("duration_ms"),
        F.when(~orphan & ~reopened, F.col("__close.row_count")).alias("row_count"),
        status.alias("status"),
        F.when(orphan, F.col("__run_error")).when(~reopened, F.col("__close.error_message")).alias("error_message"),
    )


def duration_ms(ended: Column, started: Column) -> Column:
    """Whole milliseconds between two zone-less timestamps."""
    gap = micros_between(ended.cast("timestamp_ntz"), started.cast("timestamp_ntz"))
    return F.floor(gap / F.lit(1000)).cast("bigint")


def run_totals(logs: DataFrame) -> DataFrame:
    """Per run: the sum of all reported row counts and the last one reported."""
    done = parse_events(logs).where(F.col("kind") == "done")
    return done.groupBy("run_id").agg(
        F.sum("row_count").cast("bigint").alias("total_rows"),
        F.max_by("row_count", "line_no").alias("last_rows"),
    )


def run_durations(runs: DataFrame) -> DataFrame:
    return runs.withColumn("duration_ms", duration_ms(F.col("ended_at"), F.col("started_at")))


def _like(columns: Sequence[str], text: str) -> Column:
    """The text anywhere in either column, in any case; ``%`` and ``_`` are wildcards."""
    pattern = "%" + text.replace("\\", "\\\\") + "%"
    first, second = [F.col(c).ilike(pattern) for c in columns]
    return first | second


def search_runs(
    runs: DataFrame,
    since: datetime | str | None = None,
    until: datetime | str | None = None,
    pipeline: str = "",
    job: str = "",
    statuses: Sequence[str] = (),
    triggers: Sequence[str] = (),
    limit: int | None = None,
) -> DataFrame:
    """Runs that meet every given condition, newest first; with ``limit`` that many."""
    out = runs
    if since is not None:
        out = out.where(F.col("started_at") >= F.lit(str(since)).cast("timestamp_ntz"))
    if until is not None:
        out = out.where(F.col("started_at") <= F.lit(str(until)).cast("timestamp_ntz"))
    if pipeline:
        out = out.where(_like(["pipeline_name", "pipeline_path"], pipeline))
    if job:
        out = out.where(_like(["job_name", "job_path"], job))
    if statuses:
        out = out.where(F.col("status").isin(list(statuses)))
    if triggers:
        out = out.where(F.col("trigger").isin(list(triggers)))
    out = out.orderBy(F.col("started_at").desc(), F.col("id").desc())
    return out if limit is None else out.limit(max(1, limit))


def run_detail(runs: DataFrame, steps: DataFrame, logs: DataFrame, run_id: int) -> dict[str, DataFrame]:
    """Header, steps and log lines of one run, each in its own order."""
    return {
        "run": runs.where(F.col("id") == run_id),
        "steps": steps.where(F.col("run_id") == run_id).orderBy("step_order"),
        "logs": logs.where(F.col("run_id") == run_id).orderBy("line_no"),
    }


def retain_runs(
    runs: DataFrame, as_of: Column | datetime, max_age_days: int | None = 30, max_runs: int | None = 5000
) -> DataFrame:
    """Drop runs older than the age, then all beyond the newest ``max_runs``."""
    now = as_of if isinstance(as_of, Column) else F.lit(str(as_of)).cast("timestamp_ntz")
    kept = runs
    if max_age_days and max_age_days > 0:
        kept = kept.where(F.col("started_at") >= now - F.make_dt_interval(F.lit(max_age_days)))
    if max_runs and max_runs > 0:
        kept = kept.orderBy(F.col("started_at").desc(), F.col("id").desc()).limit(max_runs)
    return kept


def cascade(children: DataFrame, runs: DataFrame, keep: bool = True) -> DataFrame:
    """Child rows whose run is (``keep``) or is not in ``runs``."""
    ids = runs.select(F.col("id").alias("run_id"))
    return children.join(ids, "run_id", "left_semi" if keep else "left_anti")
