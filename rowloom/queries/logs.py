"""Run-log analysis on log lines that Spark derives from the events."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.labels import duration_label
from rowloom.operators import runlog
from rowloom.queries.registry import plain, query

# One user is one run, one event is one line of its log.
LOGS = """SELECT user_id AS run_id, event_id AS line_no, ts,
    CASE event_type
      WHEN 'click' THEN '[Step ' || k || '] 実行中...' WHEN 'view' THEN '[Step ' || k || '] 完了 (' || n || '行)'
      WHEN 'error' THEN '[Step ' || k || '] エラー: code ' || n WHEN 'signup' THEN '[Step ' || k || '] キャンセルされました'
      ELSE CASE WHEN k = '1' THEN '警告: ' ELSE 'note ' END || props END AS message
  FROM (SELECT *, CAST(CAST(floor(value) AS BIGINT) % 3 AS VARCHAR(9)) AS k, regexp_extract(props, '[0-9]+', 0) AS n FROM {events})"""
RUNS = """SELECT user_id AS id, 'Flow_' || CAST(user_id % 7 AS VARCHAR(9)) AS pipeline_name,
    '/jobs/p' || CAST(user_id % 5 AS VARCHAR(9)) || '.json' AS pipeline_path,
    'Nightly ' || CAST(user_id % 3 AS VARCHAR(9)) AS job_name, '/jobs/j.json' AS job_path,
    CASE WHEN user_id % 2 = 0 THEN 'manual' ELSE 'schedule' END AS trigger,
    min(ts) AS started_at, max(ts) AS ended_at,
    CASE WHEN user_id % 4 = 0 THEN 'Failed' WHEN user_id % 4 = 1 THEN 'Cancelled' ELSE 'Success' END AS status,
    CASE WHEN user_id % 4 = 0 THEN 'panic' END AS error_message
  FROM {events} GROUP BY user_id"""
WITH = plain(f"WITH logs AS ({LOGS}), runs AS ({RUNS})")

PARSED = r"""SELECT run_id, line_no, ts, message,
    CASE WHEN regexp_matches(message, '^\[[^\]]+\]\s*実行中') THEN 'start'
         WHEN regexp_matches(message, '^\[[^\]]+\]\s*完了\s*\(\d+行\)') THEN 'done'
         WHEN regexp_matches(message, '^\[[^\]]+\]\s*エラー:\s*.+$') THEN 'error'
         WHEN regexp_matches(message, '^\[[^\]]+\]\s*キャンセル') THEN 'cancel' END AS kind,
    CASE WHEN message LIKE '[%' THEN regexp_extract(message, '^\[([^\]]+)\]', 1) END AS step_name,
    CASE WHEN message LIKE '%完了%' THEN CAST(regexp_extract(message, '\((\d+)行\)', 1) AS BIGINT) END AS row_count,
    CASE WHEN message LIKE '%エラー%' THEN regexp_extract(message, 'エラー:\s*(.+)$', 1)
         WHEN message LIKE '%キャンセル%' THEN 'キャンセル' END AS error_message
  FROM logs"""


@query("log_parse", f"{WITH} {PARSED}")
def log_parse(t):
    return runlog.parse_events(t.sql(LOGS))


@query(
    "log_levels",
    f"""{WITH} SELECT level, count(*) AS n FROM (SELECT CASE WHEN message LIKE '%エラー:%' THEN 'ERROR'
        WHEN message LIKE '警告%' THEN 'WARN' ELSE 'INFO' END AS level FROM logs) GROUP BY 1""",
)
def log_levels(t):
    return runlog.with_levels(t.sql(LOGS)).groupBy("level").agg(F.count(F.lit(1)).alias("n"))


MS = "CAST(floor((epoch_us({a}) - epoch_us({b})) / 1000.0) AS BIGINT)"
STEPS = f"""{WITH}, p AS ({PARSED}), e AS (SELECT * FROM p WHERE kind IS NOT NULL),
  x AS (SELECT *, lead(kind) OVER w AS k2, lead(ts) OVER w AS ts2, lead(row_count) OVER w AS rows2, lead(error_message) OVER w AS err2
        FROM e WINDOW w AS (PARTITION BY run_id, step_name ORDER BY line_no)),
  s AS (SELECT x.*, runs.ended_at AS run_end, runs.status AS run_status, runs.error_message AS run_error
        FROM x JOIN runs ON id = run_id WHERE kind = 'start'),
  o AS (SELECT run_id, row_number() OVER (PARTITION BY run_id ORDER BY line_no) AS step_order, step_name, ts AS started_at,
               CASE WHEN k2 IS NULL THEN run_end WHEN k2 <> 'start' THEN ts2 END AS ended_at,
               CASE WHEN k2 = 'done' THEN rows2 END AS row_count,
               CASE WHEN k2 IS NULL THEN run_status WHEN k2 = 'start' THEN 'Running' WHEN k2 = 'done' THEN 'Success'
                    WHEN k2 = 'error' THEN 'Failed' ELSE 'Cancelled' END AS status,
               CASE WHEN k2 IS NULL THEN run_error WHEN k2 IN ('error', 'cancel') THEN err2 END AS error_message FROM s)
  SELECT *, {MS.format(a="ended_at", b="started_at")} AS duration_ms FROM o"""


@query("log_steps", STEPS)
def log_steps(t):
    return runlog.step_records(t.sql(LOGS), t.sql(RUNS))


@query("log_steps_split", STEPS)
def log_steps_split(t):
    """The same records, with long runs cut into cells."""
    return runlog.step_records(t.sql(LOGS), t.sql(RUNS), group_rows=20)


@query(
    "run_totals",
    f"""{WITH}, p AS ({PARSED}) SELECT run_id, CAST(sum(row_count) AS BIGINT) AS total_rows, arg_max(row_count, line_no) AS last_rows
        FROM p WHERE kind = 'done' GROUP BY run_id""",
)
def run_totals(t):
    return runlog.run_totals(t.sql(LOGS))


@query(
    "run_durations",
    f"""{WITH}, d AS (SELECT id, {MS.format(a="ended_at", b="started_at")} AS duration_ms FROM runs)
        SELECT id, duration_ms, (duration_ms // 60000) || 'm' || lpad(CAST((duration_ms % 60000) // 1000 AS VARCHAR), 2, '0') || 's' AS label
        FROM d""",
)
def run_durations(t):
    runs = runlog.run_durations(t.sql(RUNS))
    return runs.select("id", "duration_ms", duration_label(F.col("duration_ms")).alias("label"))


@query(
    "duration_labels",
    """SELECT event_id, ms, CASE WHEN ms < 1000 THEN ms || 'ms' WHEN ms < 60000 THEN printf('%.1fs', ms / 1000.0::DOUBLE)
              ELSE (ms // 60000) || 'm' || lpad(CAST((ms % 60000) // 1000 AS VARCHAR), 2, '0') || 's' END AS label
       FROM (SELECT event_id, CAST(floor(value) AS BIGINT) * CAST(floor(value) AS BIGINT) * 100 AS ms FROM events)""",
)
def duration_labels(t):
    whole = F.floor("value").cast("bigint")
    rows = t.events.select("event_id", (whole * whole * 100).alias("ms"))
    return rows.withColumn("label", duration_label(F.col("ms")))


@query(
    "run_search",
    f"""{WITH} SELECT id, pipeline_name, status, started_at FROM runs
        WHERE started_at >= TIMESTAMP '2024-01-01 02:00:00' AND started_at <= TIMESTAMP '2024-01-20'
          AND (pipeline_name ILIKE '%flow_%' OR pipeline_path ILIKE '%flow_%') AND (job_name ILIKE '%NIGHT%' OR job_path ILIKE '%NIGHT%')
          AND status IN ('Failed', 'Success') AND trigger IN ('manual', 'schedule')
        ORDER BY started_at DESC, id DESC LIMIT 50""",
)
def run_search(t):
    found = runlog.search_runs(
        t.sql(RUNS),
        since="2024-01-01 02:00:00",
        until="2024-01-20",
        pipeline="flow_",
        job="NIGHT",
        statuses=["Failed", "Success"],
        triggers=["manual", "schedule"],
        limit=50,
    )
    return found.select("id", "pipeline_name", "status", "started_at")


@query(
    "run_detail",
    f"""{WITH} SELECT 'log' AS part, run_id, line_no AS place, message AS note FROM logs WHERE run_id = 7
        UNION ALL SELECT 'run', id, 0, status FROM runs WHERE id = 7
        UNION ALL SELECT 'step', run_id, step_order, status FROM ({STEPS}) WHERE run_id = 7""",
)
def run_detail(t):
    logs, runs = t.sql(LOGS), t.sql(RUNS)
    parts = runlog.run_detail(runs, runlog.step_records(logs, runs), logs, 7)
    return (
        parts["logs"]
        .select(F.lit("log").alias("part"), "run_id", F.col("line_no").alias("place"), F.col("message").alias("note"))
        .union(parts["run"].select(F.lit("run"), "id", F.lit(0).cast("bigint"), "status"))
        .union(parts["steps"].select(F.lit("step"), "run_id", "step_order", "status"))
    )


KEPT = """SELECT * FROM runs WHERE started_at >= TIMESTAMP '2024-01-31' - INTERVAL 30 DAY - INTERVAL 12 HOUR
          ORDER BY started_at DESC, id DESC LIMIT 100"""


@query("run_retention", f"{WITH} SELECT id, started_at FROM ({KEPT})")
def run_retention(t):
    return _kept(t).select("id", "started_at")


def _kept(t):
    as_of = F.lit("2024-01-30 12:00:00").cast("timestamp_ntz")
    return runlog.retain_runs(t.sql(RUNS), as_of, 30, 100)


@query("run_cascade", f"{WITH} SELECT run_id, line_no FROM logs WHERE run_id IN (SELECT id FROM ({KEPT}))")
def run_cascade(t):
    return runlog.cascade(t.sql(LOGS), _kept(t)).select("run_id", "line_no")


@query("run_cascade_deleted", f"{WITH} SELECT run_id, line_no FROM logs WHERE run_id NOT IN (SELECT id FROM ({KEPT}))")
def run_cascade_deleted(t):
    return runlog.cascade(t.sql(LOGS), _kept(t), keep=False).select("run_id", "line_no")
