from datetime import datetime, timedelta

import pytest
from pyspark.sql import functions as F

from conftest import dicts, rows
from rowloom.operators import runlog

T0 = datetime(2026, 4, 1, 8, 0)


def logs(spark, *messages, run_id=1):
    data = [(run_id, i, T0 + timedelta(seconds=i), m) for i, m in enumerate(messages)]
    return spark.createDataFrame(data, "run_id long, line_no long, ts timestamp_ntz, message string")


def runs(spark, status="Success", error=None, run_id=1):
    return spark.createDataFrame(
        [(run_id, status, error, T0, T0 + timedelta(minutes=5))],
        "id long, status string, error_message string, started_at timestamp_ntz, ended_at timestamp_ntz",
    )


def steps(spark, *messages, status="Success", error=None, group_rows=None):
    out = runlog.step_records(logs(spark, *messages), runs(spark, status, error), group_rows)
    return dicts(out.orderBy("step_order"))


def test_success(spark):
    (step,) = steps(spark, "[DB Input] 実行中...", "[DB Input] 完了 (1234行)")
    assert step["step_name"] == "DB Input" and step["status"] == "Success" and step["row_count"] == 1234
    assert step["step_order"] == 1 and step["duration_ms"] == 1000 and step["error_message"] is None


def test_error_keeps_its_message_and_wins_over_a_later_close(spark):
    (step,) = steps(spark, "[Calc] 実行中...", "[Calc] エラー: 0 で割れません", "[Calc] 完了 (0行)")
    assert step["status"] == "Failed" and step["error_message"] == "0 で割れません" and step["row_count"] is None


def test_cancel(spark):
    (step,) = steps(spark, "[X] 実行中...", "[X] キャンセルされました")
    assert step["status"] == "Cancelled" and step["error_message"] == "キャンセル"


def test_open_steps_take_the_run_status(spark):
    out = steps(spark, "[A] 実行中...", "[B] 実行中...", status="Failed", error="panic")
    assert [(s["step_name"], s["status"], s["error_message"]) for s in out] == [("A", "Failed", "panic"), ("B", "Failed", "panic")]
    assert out[0]["ended_at"] == T0 + timedelta(minutes=5)


@pytest.mark.parametrize("group_rows", [None, 2])
def test_second_start_leaves_the_first_running(spark, group_rows):
    out = steps(
        spark, "[A] 実行中...", "note", "[A] 実行中...", "[A] 完了 (3行)", "[A] 完了 (4行)", "[A] 実行中...", group_rows=group_rows
    )
    assert [(s["step_order"], s["status"], s["row_count"]) for s in out] == [(1, "Running", None), (2, "Success", 3), (3, "Success", None)]
    assert out[0]["ended_at"] is None


def test_totals(spark):
    lines = []
    for name, n in (("A", 10), ("B", 20), ("C", 5)):
        lines += [f"[{name}] 実行中...", f"[{name}] 完了 ({n}行)"]
    assert rows(runlog.run_totals(logs(spark, *lines))) == [(1, 35, 5)]


def test_levels(spark):
    df = logs(spark, "[A] エラー: x", "===== エラー =====", "警告: y", "note 警告: z", "警告だけ", "fine")
    got = [r["level"] for r in runlog.with_levels(df).orderBy("line_no").collect()]
    assert got == ["ERROR", "ERROR", "WARN", "WARN", "WARN", "INFO"]


def test_parse(spark):
    out = dicts(runlog.parse_events(logs(spark, "[A b]  実行中", "x [A] 実行中", "[A] 完了(7行)", "[A] 完了 (x行)")))
    assert [(r["kind"], r["step_name"], r["row_count"]) for r in out] == [
        ("start", "A b", None),
        (None, None, None),
        ("done", "A", 7),
        (None, None, None),
    ]


def history(spark):
    data = [
        (1, "Load_A", "/p/a.json", None, None, "manual", "Success", 0),
        (2, "load_b", "/p/b.json", "Night", "/j/n.json", "job", "Failed", 1),
        (3, "Other", "/p/LOAD.json", None, None, "cli", "Success", 2),
        (4, "Other", "/p/c.json", "Day", "/j/night.json", "job", "Cancelled", 70),
    ]
    rows_ = [(*d[:7], T0 - timedelta(days=d[7])) for d in data]
    return spark.createDataFrame(
        rows_,
        "id long, pipeline_name string, pipeline_path string, job_name string, job_path string, trigger string, status string, started_at timestamp_ntz",
    )


def test_search(spark):
    ids = lambda **k: [r["id"] for r in runlog.search_runs(history(spark), **k).collect()]
    assert ids() == [1, 2, 3, 4]
    assert ids(pipeline="load") == [1, 2, 3]
    assert ids(pipeline="load_") == [1, 2, 3] and ids(pipeline="r_r") == []
    assert ids(pipeline="oth_r") == [3, 4]
    assert ids(job="NIGHT") == [2, 4]
    assert ids(statuses=["Success", "Cancelled"], triggers=["cli", "job"]) == [3, 4]
    assert ids(since=T0 - timedelta(days=2), until=T0 - timedelta(days=1)) == [2, 3]
    assert ids(limit=0) == [1]


def test_retention_and_cascade(spark):
    df = history(spark)
    assert [r["id"] for r in runlog.retain_runs(df, T0, 60, None).collect()] == [1, 2, 3]
    assert sorted(r["id"] for r in runlog.retain_runs(df, T0, 30, 2).collect()) == [1, 2]
    assert runlog.retain_runs(df, T0, None, None).count() == 4
    kept = runlog.retain_runs(df, F.lit("2026-04-01 08:00:00").cast("timestamp_ntz"), 1, 10)
    children = spark.createDataFrame([(1, "a"), (3, "b"), (9, "c")], "run_id long, x string")
    assert rows(runlog.cascade(children, kept)) == [(1, "a")]
    assert rows(runlog.cascade(children, kept, keep=False)) == [(3, "b"), (9, "c")]


def test_detail(spark):
    l = logs(spark, "[A] 実行中...", "[A] 完了 (1行)").union(logs(spark, "[B] 実行中...", run_id=2))
    r = runs(spark)
    parts = runlog.run_detail(r, runlog.step_records(l, r), l, 1)
    assert {k: v.count() for k, v in parts.items()} == {"run": 1, "steps": 1, "logs": 2}
    assert runlog.run_durations(r).first()["duration_ms"] == 300_000
