import random
from datetime import date, datetime, timedelta
from decimal import Decimal

import pytest
from pyspark.sql import functions as F

from conftest import rows
from rowloom.operators.ranges import range_join


def brute(left, right, low_open=False, high_open=False, outer=False):
    out = []
    for i, k, v in left:
        hits = [
            (i, k, v, a, b)
            for g, a, b in right
            if v is not None and k is not None and k == g
            and (a is None or (v > a if low_open else v >= a)) and (b is None or (v < b if high_open else v <= b))
        ]
        out += hits or ([(i, k, v, None, None)] if outer else [])
    return sorted(out, key=lambda r: tuple(map(str, r)))


def given(kind, seed):
    rand = random.Random(seed)
    make = {
        "bigint": lambda: rand.choice([rand.randrange(-50, 50), rand.randrange(-(10**18), 10**18), 2**63 - 1, -(2**63)]),
        "double": lambda: rand.choice([rand.uniform(-1, 1), rand.uniform(-1e6, 1e6), 1e300, -1e300, 0.5]),
        "decimal(12,2)": lambda: Decimal(rand.randrange(-10**6, 10**6)).scaleb(-2),
        "date": lambda: date(2020, 1, 1) + timedelta(rand.randrange(-400, 4000)),
        "timestamp": lambda: datetime(2021, 1, 1) + timedelta(microseconds=rand.randrange(10**rand.randrange(1, 15))),
        "timestamp_ntz": lambda: datetime(2021, 1, 1) + timedelta(seconds=rand.randrange(10**6)),
    }[kind]
    some = lambda: None if rand.random() < 0.1 else make()
    key = lambda: rand.choice([None, 1, 1, 1, 2])
    left = [(i, key(), some()) for i in range(120)]
    right = []
    for _ in range(60):
        a, b = some(), some()
        if a is not None and b is not None and a > b and rand.random() < 0.9:
            a, b = b, a
        right.append((key(), a, b))
    right += [(1, v, v) for _, _, v in left[:10]] + right[:5]
    return left + left[:7], right


@pytest.mark.parametrize("kind", ["bigint", "double", "decimal(12,2)", "date", "timestamp", "timestamp_ntz"])
@pytest.mark.parametrize("how", ["INNER", "LEFT OUTER"])
def test_equals_all_pairs(spark, kind, how):
    left, right = given(kind, len(kind))
    l = spark.createDataFrame(left, f"i int, k int, v {kind}")
    r = spark.createDataFrame(right, f"k int, a {kind}, b {kind}")
    for opened in ((False, False), (True, True)):
        got = range_join(l, r, "v", "a", "b", "k", how, *opened)
        assert rows(got) == brute(left, right, *opened, how == "LEFT OUTER")


def test_no_nested_loop_and_no_key(spark):
    l = spark.range(1000).selectExpr("id AS v")
    r = spark.createDataFrame([(0, 9, "low"), (5, 700, "wide"), (None, 2, "open"), (9, 0, "none")], "a long, b long, name string")
    out = range_join(l, r, "v", "a", "b")
    plan = out._jdf.queryExecution().executedPlan().toString()
    assert "NestedLoop" not in plan and "CartesianProduct" not in plan
    assert out.groupBy("name").count().orderBy("name").collect() == [("low", 10), ("open", 3), ("wide", 696)]


def test_a_unit_changes_no_result(spark):
    l = spark.range(500).selectExpr("id / 1000 AS v")
    r = spark.range(20).selectExpr("id / 50 AS a", "id / 50 + 0.03 AS b")
    r = r.selectExpr("cast(a as double) a", "cast(b as double) b")
    expected = rows(l.join(r, F.expr("v BETWEEN a AND b")).select("v", "a", "b"))
    for unit in (None, 0.001, 7.0):
        assert rows(range_join(l, r, "v", "a", "b", unit=unit)) == expected


def test_empty_inputs_and_mistakes(spark):
    l = spark.createDataFrame([(1,), (None,)], "v long")
    r = spark.createDataFrame([], "a long, b long")
    assert rows(range_join(l, r, "v", "a", "b")) == []
    assert rows(range_join(l, r, "v", "a", "b", how="LEFT OUTER")) == [(1, None, None), (None, None, None)]
    assert rows(range_join(l.limit(0), r, "v", "a", "b", how="LEFT OUTER")) == []
    with pytest.raises(ValueError):
        range_join(l, r, "v", "a", "c")
    with pytest.raises(ValueError):
        range_join(l, r, "v", "a", "b", how="FULL OUTER")
    with pytest.raises(ValueError):
        range_join(l.withColumnRenamed("v", "a"), r, "a", "a", "b")
    with pytest.raises(ValueError):
        range_join(l.selectExpr("cast(v as string) v"), r.selectExpr("cast(a as string) a", "cast(b as string) b"), "v", "a", "b")


def test_nan_is_larger_than_any_number(spark):
    l = spark.createDataFrame([(float("nan"),), (1.0,), (float("inf"),), (-float("inf"),)], "v double")
    r = spark.createDataFrame([(0.0, None), (None, 2.0), (float("nan"), float("nan")), (0.0, float("inf"))], "a double, b double")
    on = F.expr("(a IS NULL OR v >= a) AND (b IS NULL OR v <= b)")
    found = [list(map(str, r)) for r in rows(range_join(l, r, "v", "a", "b"))]
    assert found == [list(map(str, r)) for r in rows(l.join(r, on).select("v", "a", "b"))]
