"""Comparison by digests against the ordinary comparison."""

import pytest
from pyspark.sql import functions as F

import conftest
from rowloom.operators import digests
from rowloom.operators.compare import table_compare
from rowloom.plans.flow import build
from rowloom.plans.steps import Context



def rows(df):
    """As text, in which NaN equals itself."""
    return [str(r) for r in conftest.rows(df)]


SCHEMA = "id long, name string, amount double, memo string"


@pytest.fixture
def sides(spark):
    left = [(i, f"n{i % 7}", i / 3, None if i % 11 == 0 else "m") for i in range(500)]
    right = [(i, n.upper() if i % 50 == 0 else n, a + (i % 60 == 1), m) for i, n, a, m in left if i % 40 != 3] + [(-i, "x", 1.0, None) for i in range(1, 5)]
    left += [(None, "none", float("nan"), None), (700, "twice", 1.0, "m"), (700, "twice", 1.0, "m"), (701, "t", float("nan"), "m")]
    right += [(None, "none", 1.0, None), (700, "twice", 1.0, "m"), (701, "t", float("nan"), "m"), (701, "second", 0.0, "z")]
    return spark.createDataFrame(left, SCHEMA).repartition(3), spark.createDataFrame(right, SCHEMA).repartition(2)


@pytest.mark.parametrize("rules", [{}, {"ignore_case": True}, {"nulls_equal": False}, {"trim": True, "nulls_equal": False}])
@pytest.mark.parametrize("sizes", [{}, {"coarse": 3, "leaf_rows": 1}, {"coarse": 1, "leaf_rows": 10_000}])
def test_same_rows_as_the_comparison(sides, rules, sizes):
    options = {"keys": "id", "order_by": ["amount", "name"], **rules}
    assert rows(digests.digest_compare(*sides, **options, **sizes)) == rows(table_compare(*sides, **options))


def test_other_types_and_missing_columns(spark):
    left = spark.createDataFrame([(1, 100, "a"), (2, 5, "b"), (3, None, "c")], "id int, v long, only string")
    right = spark.createDataFrame([("1", "100", 1), ("2", "6", 2), ("3", None, 3)], "ID string, v string, more int")
    options = {"keys": "id", "assume_unique": True}
    assert rows(digests.digest_compare(left, right, **options)) == rows(table_compare(left, right, **options))
    assert rows(digests.digest_compare(left, right, columns="v", **options)) == rows(table_compare(left, right, columns="v", **options)) != []


def test_empty_sides(spark, sides):
    left, _ = sides
    none = spark.createDataFrame([], SCHEMA)
    for a, b in ((left, none), (none, left), (none, none)):
        options = {"keys": "id", "order_by": "name"}
        assert rows(digests.digest_compare(a, b, **options)) == rows(table_compare(a, b, **options))


def test_needs_keys_and_order(sides):
    with pytest.raises(ValueError):
        digests.digest_compare(*sides, keys="", assume_unique=True)
    with pytest.raises(ValueError):
        digests.digest_compare(*sides, keys="id")


def test_few_rows_are_joined(spark):
    """Of 200,000 rows with one changed in a thousand, under 2 % are joined."""
    left = spark.range(200_000).select(F.col("id"), F.sha2(F.col("id").cast("string"), 256).alias("v"))
    right = left.withColumn("v", F.when(F.col("id") % 1000 == 7, F.lit("changed")).otherwise(F.col("v")))
    for some in digests.differing_rows(left, right, ["id"], ["v"]):
        assert 200 <= some.count() < 4_000
    assert digests.digest_compare(left, right, "id", assume_unique=True).count() == 200


def test_flow_setting(spark, sides):
    for name, df in zip(("one", "two"), sides):
        df.createOrReplaceTempView(name)
    read = lambda i: {"Id": i, "StepType": "DBInput", "Settings": {"SQL": f"SELECT * FROM {i}"}}
    found = []
    for asked in ("true", "false"):
        compare = {"Id": "c", "StepType": "TableCompare", "Settings": {"KeyFields": "id", "OrderFields": "amount,name", "Digests": asked}}
        spec = {"Steps": [read("one"), read("two"), compare], "Connections": [{"SourceStepId": s, "TargetStepId": "c"} for s in ("one", "two")]}
        found.append(rows(build(spec, Context(spark)).frame("c")))
    assert found[0] == found[1] != []
