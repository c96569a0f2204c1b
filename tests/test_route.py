from datetime import datetime

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rowloom.operators.route import (
    branch_counts,
    filter_rows,
    filter_split,
    filter_tag,
    parse_cases,
    switch,
    switch_ports,
    switch_tag,
)


def texts(spark, *values):
    return spark.createDataFrame([(v,) for v in values], "v string")


def passing(df, op, value="", right=""):
    return [r[0] for r in rows(filter_rows(df, "v", op, value, right).select("v"))]


def test_equality_ignores_case(spark):
    df = texts(spark, "active", "inactive", "ACTIVE", None)
    assert passing(df, "equals", "active") == ["ACTIVE", "active"]
    assert passing(df, "notEquals", "active") == ["inactive"]
    assert passing(texts(spark, "1", "1.0"), "equals", "1") == ["1"]


def test_contains(spark):
    assert passing(texts(spark, "John Doe", "Jane Doe", None), "contains", "john") == ["John Doe"]


def test_order_on_text_numbers(spark):
    df = texts(spark, "90", "60", "85", "80", "x", None)
    assert passing(df, "greaterThan", "80") == ["85", "90", "x"]
    assert passing(df, "greaterOrEqual", "80") == ["80", "85", "90", "x"]
    assert passing(df, "lessThan", "80") == ["60"]
    assert passing(df, "lessOrEqual", "80.0") == ["60", "80"]


def test_null_tests_and_missing_column(spark):
    df = texts(spark, None, "something")
    assert passing(df, "isNull") == [None]
    assert passing(df, "isNotNull") == ["something"]
    for op in ("isNull", "isNotNull", "equals"):
        assert filter_rows(df, "missing", op, "x").count() == 0
    assert filter_rows(df, "v", "equals", right="missing").count() == 0
    with pytest.raises(ValueError, match="unknown filter operator"):
        filter_rows(df, "v", "like", "x")


def test_field_to_field(spark):
    df = spark.createDataFrame(
        [("hello", "HELLO"), ("hello", "world"), (None, None), ("9", "10"), ("2026/01/02", "2026-1-2")], "v string, w string"
    )
    assert passing(df, "equals", "ignored", "w") == ["2026/01/02", "hello"]
    assert passing(df, "lessThan", "", "w") == ["9", "hello"]
    assert passing(df, "notEquals", "", "w") == ["9", "hello"]


def test_dates(spark):
    df = spark.createDataFrame(
        [(1, datetime(2026, 1, 1), "2026/01/01"), (2, datetime(2026, 6, 1, 12), "2026-06-01 12:00:00"), (3, None, "later")],
        "id int, t timestamp_ntz, s string",
    )
    ids = lambda *a, **k: [r[0] for r in rows(filter_rows(df, *a, **k).select("id"))]
    assert ids("t", "greaterThan", "2026/03/01") == [2]
    assert ids("t", "equals", "2026-1-1") == [1]
    assert ids("s", "lessThan", "2026/3/1") == [1]
    assert ids("t", "equals", right="s") == [1, 2]
    assert ids("t", "contains", "2026/01/01") == []
    assert ids("s", "contains", "2026") == [1, 2]


def test_number_columns(spark):
    df = spark.createDataFrame([(1, 5.0), (2, 7.5), (3, None)], "id int, d double")
    ids = lambda *a, **k: [r[0] for r in rows(filter_rows(df, *a, **k).select("id"))]
    assert ids("d", "equals", "5") == [1]
    assert ids("d", "greaterThan", "5") == [2]
    assert ids("d", "equals", "5.0") == ids("id", "equals", "01") == ids("id", "equals", " 1") == []
    assert ids("d", "notEquals", "5.0") == [1, 2] and ids("d", "notEquals", "7.5") == [1]
    assert ids("d", "equals", "7.5") == [2] and ids("id", "greaterThan", "1e400") == []
    assert ids("d", "contains", ".5") == [2]
    assert ids("id", "lessThan", right="d") == [1, 2]


def test_split_is_complete(spark):
    df = spark.createDataFrame([("ok", 1), ("bad", 2), ("ok", 3), (None, 4)], "v string, id int")
    ports = filter_split(df, "v", "notEquals", "ok")
    assert rows(ports["pass"]) == [("bad", 2)]
    assert [r[1] for r in rows(ports["fail"])] == [4, 1, 3]
    assert rows(ports["pass"].union(ports["fail"])) == rows(df)
    assert rows(branch_counts(filter_tag(df, "v", "notEquals", "ok"))) == [("fail", 3), ("pass", 1)]


def test_predicate_reaches_the_scan(spark, sf_dir):
    df = spark.read.parquet(f"{sf_dir}/lineitem.parquet")
    plan = filter_rows(df, "l_quantity", "greaterThan", "45")._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_quantity), GreaterThan(l_quantity,45.0)]" in plan
    orders = spark.read.parquet(f"{sf_dir}/orders.parquet")
    plan = filter_rows(orders, "o_orderdate", "lessThan", "1996/01/01")._jdf.queryExecution().toString()
    assert "LessThan(o_orderdate,1996-01-01T00:00)" in plan


REGIONS = [("東京", 1), ("大阪", 2), ("名古屋", 3), ("東京", 4), (None, 5)]


def test_switch(spark):
    df = spark.createDataFrame(REGIONS, "Region string, X int")
    cases = "東京|tokyo\n大阪|osaka|Osaka"
    tagged = switch_tag(df, "Region", cases)
    assert [r[2] for r in tagged.orderBy("X").collect()] == ["tokyo", "osaka", "default", "tokyo", "default"]
    ports = switch(df, "Region", cases)
    assert {k: v.count() for k, v in ports.items()} == {"tokyo": 2, "osaka": 1, "default": 2}
    kept = switch(df, "Region", cases, include_default=False)
    assert {k: v.count() for k, v in kept.items()} == {"tokyo": 2, "osaka": 1}
    assert switch_tag(df, "Region", cases, include_default=False).count() == 3


def test_switch_cases():
    cases = parse_cases("A|first\r\nA|second\nalpha\n|x\nB|Default|Label\n")
    assert [(c.value, c.key, c.label) for c in cases] == [
        ("A", "first", "first (= A)"),
        ("A", "second", "second (= A)"),
        ("alpha", "alpha", "alpha (= alpha)"),
        ("B", "Default_case", "Label"),
    ]
    assert switch_ports("A|k\nB|k") == ["k", "default"]
    assert switch_ports("", include_default=False) == ["default"]


def test_first_case_of_a_value_wins(spark):
    df = texts(spark, "A", "B", "a")
    tagged = switch_tag(df, "v", "A|first\nA|second\nB|first")
    assert rows(tagged) == [("A", "first"), ("B", "first"), ("a", "default")]
    assert switch(df, "v", "A|first\nA|second\nB|first")["second"].count() == 0


def test_switch_on_numbers(spark):
    df = spark.range(3).withColumn("d", F.col("id").cast("double"))
    assert rows(switch_tag(df, "d", "1|one").select("id", "branch")) == [(0, "default"), (1, "one"), (2, "default")]
    assert rows(switch_tag(df, "missing", "1|one").select("branch")) == [("default",)] * 3
