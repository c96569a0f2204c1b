import json

import pytest
from pyspark.sql import functions as F

from conftest import dicts, rows
from rowloom.operators.intervals import event_intervals
from rowloom.plans.flow import build
from rowloom.plans.steps import STEPS, Context, step
from rowloom.queries.flows import IDLE


def node(ident, kind, **settings):
    return {"Id": ident, "Name": ident.upper(), "StepType": kind, "CanvasX": 1, "Settings": settings}


def edge(source, target, port=None):
    out = {"SourceStepId": source, "TargetStepId": target}
    return {**out, "SourceBranchKey": port} if port else out


def spec(steps, *edges):
    return {"Name": "t", "Steps": steps, "Connections": [edge(*e) for e in edges]}


@pytest.fixture()
def source(spark):
    spark.createDataFrame([("ok", 1), ("bad", 2), ("ok", 3)], "v string, id int").createOrReplaceTempView("src")
    return node("src", "DBInput", SQL="SELECT * FROM src")


OK = {"FieldName": "v", "Operator": "equals", "Value": "ok"}


def test_ports(spark, source):
    flow = build(
        spec(
            [source, node("f", "Filter", **OK), node("p", "Dummy"), node("q", "Dummy")],
            ("src", "f"), ("f", "p", "pass"), ("f", "q", "fail"),
        ),
        Context(spark),
    )
    assert rows(flow.frame("p")) == [("ok", 1), ("ok", 3)]
    assert rows(flow.frame("Q")) == [("bad", 2)]
    flow.run()


def test_old_specs_read_a_filter_by_its_pass_port(spark, source):
    text = json.dumps(spec([source, node("f", "Filter", **OK), node("p", "Dummy")], ("src", "f"), ("f", "p")))
    assert build(text, Context(spark)).frame("p").count() == 2


def test_spec_from_a_file(spark, source, tmp_path):
    path = tmp_path / "flow.json"
    path.write_text("﻿" + json.dumps(spec([source])), encoding="utf-8")
    assert build(path, Context(spark)).frame("src").count() == 3


def test_named_port_of_a_single_port_step(spark, source):
    flow = build(spec([source, node("d", "Dummy")], ("src", "d", "pass")), Context(spark))
    assert flow.frame("d").count() == 3


def test_fan_out_and_union(spark, source):
    flow = build(
        spec(
            [source, node("f", "Filter", **OK), node("a", "Dummy"), node("b", "Dummy"), node("u", "Dummy")],
            ("src", "f"), ("f", "a"), ("f", "b"), ("a", "u"), ("b", "u"),
        ),
        Context(spark),
        persist=True,
        observe=True,
    )
    assert flow.frame("u").count() == 4
    assert flow.persisted
    flow.run()
    counts = flow.row_counts()
    assert counts[("u", "")] == 4


def test_row_counts(spark, source):
    flow = build(
        spec([source, node("f", "Filter", **OK), node("c", "Calculation", ExpressionType="constant", Constant="1")], ("src", "f"), ("f", "c")),
        Context(spark),
        observe=True,
    )
    flow.run()
    assert flow.row_counts() == {("src", ""): 3, ("f", "pass"): 2, ("c", ""): 2}


def test_switch(spark, source):
    cases = [source, node("s", "Switch", FieldName="v", Cases="ok|good\nbad|poor"), node("x", "Dummy")]
    assert build(spec(cases, ("src", "s"), ("s", "x", "good")), Context(spark)).frame("x").count() == 2
    with pytest.raises(ValueError, match="no port"):
        build(spec(cases, ("src", "s"), ("s", "x")), Context(spark))
    with pytest.raises(ValueError, match="no port"):
        build(spec(cases, ("src", "s"), ("s", "x", "nowhere")), Context(spark))


def test_join_select_and_compare(spark, source):
    steps = [
        source,
        node("l", "SelectValues", FieldMappings="id\nv|left"),
        node("r", "SelectValues", FieldMappings="id\n|right||true|c"),
        node("j", "MergeJoin", JoinType="INNER", KeyFields="id"),
        node("k", "TableCompare", KeyFields="id", IncludeMatched="true"),
    ]
    flow = build(spec(steps, ("src", "l"), ("src", "r"), ("l", "j"), ("r", "j"), ("src", "k"), ("j", "k")), Context(spark))
    assert rows(flow.frame("j")) == [(1, "ok", "c"), (2, "bad", "c"), (3, "ok", "c")]
    assert flow.frame("k").count() == 3
    with pytest.raises(ValueError, match="two inputs"):
        build(spec([source, node("j", "MergeJoin", KeyFields="id")], ("src", "j")), Context(spark))


def test_constant_row_without_input(spark):
    flow = build(spec([node("s", "SelectValues", FieldMappings="|a|int|true|7")]), Context(spark))
    assert dicts(flow.frame("s")) == [{"a": 7}]


def test_changes_make_new_states_that_later_steps_read(spark, source):
    spark.createDataFrame([(1, "one"), (2, "two"), (9, "nine")], "id int, v string").createOrReplaceTempView("dst")
    steps = [
        source,
        node("up", "InsertUpdate", TableName="dst", KeyFields="ID", UpdateFields="v"),
        node("f", "Filter", FieldName="id", Operator="equals", Value="2"),
        node("del", "DBDelete", TableName="dst", KeyFields="id"),
        node("ins", "DBOutput", TableName="dst"),
    ]
    context = Context(spark)
    flow = build(spec(steps, ("src", "up"), ("up", "f"), ("f", "del"), ("del", "ins")), context)
    flow.run()
    expected = [(1, "ok"), (2, "bad"), (3, "ok"), (9, "nine")]
    assert rows(context.session.states["dst"]) == expected
    assert rows(spark.table("dst")) == expected
    assert rows(flow.frame("ins")) == [("bad", 2)]


def test_upsert_mode_uses_the_first_column(spark):
    spark.createDataFrame([(1, "one")], "id int, v string").createOrReplaceTempView("first_dst")
    spark.createDataFrame([(1, "new"), (2, "two")], "id int, v string").createOrReplaceTempView("first_src")
    context = Context(spark)
    build(
        spec([node("i", "MySQLInput", SQL="SELECT * FROM first_src"), node("o", "OracleOutput", TableName="first_dst", Mode="UPSERT")], ("i", "o")),
        context,
    )
    assert rows(context.session.states["first_dst"]) == [(1, "new"), (2, "two")]


def test_files(spark, source, tmp_path):
    out = str(tmp_path / "out_{yyyy}")
    steps = [source, node("w", "ExcelOutput", Format="CSV", FilePath=out)]
    from datetime import datetime

    flow = build(spec(steps, ("src", "w")), Context(spark, as_of=datetime(2026, 1, 1)))
    assert not list(tmp_path.iterdir())
    flow.run()
    back = build(spec([node("r", "ExcelInput", Format="CSV", FilePath=str(tmp_path / "out_2026"))]), Context(spark))
    assert rows(back.frame("r")) == [("bad", "2"), ("ok", "1"), ("ok", "3")]
    with pytest.raises(ValueError, match="cannot be written"):
        build(spec([source, node("w", "ExcelOutput", FilePath=out)], ("src", "w")), Context(spark))


def test_exec_sql_runs_when_the_flow_runs(spark, source):
    steps = [source, node("x", "ExecSQL", SQL="CREATE OR REPLACE TEMP VIEW made AS SELECT 5 AS five")]
    flow = build(spec(steps, ("src", "x")), Context(spark))
    assert not spark.catalog.tableExists("made")
    flow.run()
    assert rows(spark.table("made")) == [(5,)]
    assert flow.frame("x").count() == 3


def test_bad_specs(spark, source):
    with pytest.raises(ValueError, match="cycle"):
        build(spec([node("a", "Dummy"), node("b", "Dummy")], ("a", "b"), ("b", "a")), Context(spark))
    with pytest.raises(ValueError, match="unknown type"):
        build(spec([node("a", "GenerateRows")]), Context(spark))
    with pytest.raises(ValueError, match="unknown step"):
        build(spec([source], ("src", "nowhere")), Context(spark))
    with pytest.raises(ValueError, match="one id"):
        build(spec([source, source]), Context(spark))


def test_own_step_types(spark, source):
    @step("Upper")
    def upper(context, inputs, settings):
        return {"": inputs[0].withColumn(settings["Field"], F.upper(settings["Field"]))}

    try:
        flow = build(spec([source, node("u", "Upper", Field="v")], ("src", "u")), Context(spark))
        assert rows(flow.frame("u")) == [("BAD", 2), ("OK", 1), ("OK", 3)]
    finally:
        del STEPS["Upper"]


def test_statements_of_one_input_see_the_same_values(spark):
    steps = [
        node("v", "DBInput", SQL="SELECT rand() AS x, 2 AS y"),
        node("a", "DBInput", SQL="SELECT :{x} AS x, '?' AS mark"),
        node("b", "DBInput", SQL="SELECT ? AS x, ? AS y"),
    ]
    flow = build(spec(steps, ("v", "a"), ("v", "b")), Context(spark))
    assert flow.frame("a").first()["x"] == flow.frame("b").first()["x"]
    assert flow.frame("b").first()["y"] == 2


def test_work_wait_flow_equals_the_operator(spark, sf_dir):
    """Two numbered inputs and a join give what the previous-event operator gives."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet")
    events.createOrReplaceTempView("events")
    events.select("user_id", "event_id", F.lit(None).cast("double").alias("idle_min")).createOrReplaceTempView("gaps")
    flow = build(IDLE, Context(spark))
    joined = flow.frame("Before").select("user_id", "event_id", "last_ts")
    mine = event_intervals(events, ["user_id"], "ts", "ts", ["ts", "event_id"], "m").select("user_id", "event_id", "PREVIOUS_ts")
    assert rows(joined) == rows(mine)


def test_ports_are_one_plan_with_pushed_filters(spark, sf_dir):
    spark.read.parquet(f"{sf_dir}/lineitem.parquet").createOrReplaceTempView("lineitem")
    read = node("r", "DBInput", SQL="SELECT * FROM lineitem")
    steps = [read, node("f", "Filter", FieldName="l_quantity", Operator="greaterThan", Value="40"), node("k", "SelectValues", FieldMappings="l_orderkey")]
    plan = build(spec(steps, ("r", "f"), ("f", "k")), Context(spark)).frame("k")._jdf.queryExecution().toString()
    assert "GreaterThan(l_quantity,40.0)" in plan
    assert "ReadSchema: struct<l_orderkey:bigint,l_quantity:double>" in plan


def test_range_lookup_step(spark, source):
    spark.createDataFrame([(1, 2, "low"), (3, None, "high")], "a int, b int, name string").createOrReplaceTempView("bands")
    bands = node("bands", "DBInput", SQL="SELECT * FROM bands")
    look = node("r", "RangeLookup", ValueField="id", LowField="a", HighField="b")
    flow = build(spec([source, bands, look], ("src", "r"), ("bands", "r")), Context(spark))
    assert rows(flow.frame("r").select("id", "name")) == [(1, "low"), (2, "low"), (3, "high")]
    with pytest.raises(ValueError):
        build(spec([source, look], ("src", "r")), Context(spark)).frame("r")
