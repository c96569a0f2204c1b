import pytest
from pyspark.sql import functions as F

from conftest import dicts, rows
from rowloom.operators.join import merge_join, merge_join_inputs, union_inputs


def left(spark):
    return spark.createDataFrame([("1", "a"), ("2", "b")], "ID string, L string")


def right(spark, *values):
    return spark.createDataFrame(list(values), "ID string, R string")


@pytest.mark.parametrize(
    "how,other,expected",
    [
        ("INNER", [("1", "x")], [("1", "a", "x")]),
        ("INNER", [("9", "x")], []),
        ("LEFT OUTER", [("1", "x")], [("1", "a", "x"), ("2", "b", None)]),
        ("RIGHT OUTER", [("2", "y"), ("9", "z")], [("2", "b", "y"), ("9", None, "z")]),
        ("FULL OUTER", [("2", "y"), ("9", "z")], [("1", "a", None), ("2", "b", "y"), ("9", None, "z")]),
    ],
)
def test_join_types(spark, how, other, expected):
    out = merge_join(left(spark), right(spark, *other), "ID", how)
    assert out.columns == ["ID", "L", "R"]
    assert rows(out) == expected


def test_cross(spark):
    assert merge_join(left(spark), right(spark, ("1", "x"), ("2", "y")), "").count() == 4


def test_null_key_matches_empty_text(spark):
    l = spark.createDataFrame([(None, 1), ("", 2), ("a", 3)], "k string, l int")
    r = spark.createDataFrame([("", 10), (None, 20)], "k string, r int")
    out = merge_join(l, r, "k", "FULL OUTER")
    assert rows(out.select("l", "r")) == [(1, 10), (1, 20), (2, 10), (2, 20), (3, None)]


def test_null_number_key_matches_null(spark):
    l = spark.createDataFrame([(None, 1), (5, 2)], "k long, l int")
    r = spark.createDataFrame([(None, 10), (5, 20)], "k int, r int")
    assert rows(merge_join(l, r, "k").select("l", "r")) == [(1, 10), (2, 20)]


def test_composite_keys_do_not_run_together(spark):
    l = spark.createDataFrame([("a|b", "c")], "x string, y string")
    r = spark.createDataFrame([("a", "b|c")], "x string, y string")
    assert merge_join(l, r, "x, y").count() == 0


def test_missing_key_column_reads_as_empty(spark):
    l = spark.createDataFrame([("", 1), ("a", 2)], "k string, l int")
    r = spark.createDataFrame([(10,)], "r int")
    assert rows(merge_join(l, r, "k").select("l", "r")) == [(1, 10)]


def test_mixed_key_types(spark):
    l = spark.createDataFrame([(1, "n"), (2, "m")], "k int, l string")
    r = spark.createDataFrame([(1.0, "d")], "k double, r string")
    assert rows(merge_join(l, r, "k").select("l", "r")) == [("n", "d")]
    t = spark.createDataFrame([("1", "t")], "k string, r string")
    assert rows(merge_join(l, t, "k").select("l", "r")) == [("n", "t")]


def test_right_overwrites_even_with_null(spark):
    l = spark.createDataFrame([(1, "old"), (2, "keep")], "k int, v string")
    r = spark.createDataFrame([(1, None)], "k int, v string")
    assert rows(merge_join(l, r, "k", "LEFT OUTER")) == [(1, None), (2, "keep")]
    assert rows(merge_join(l, r, "k", "FULL OUTER")) == [(1, None), (2, "keep")]
    assert rows(merge_join(l, r, "k")) == [(1, None)]


def test_many_to_many(spark):
    l = spark.createDataFrame([(1, i) for i in range(3)], "k int, l int")
    r = spark.createDataFrame([(1, i) for i in range(4)], "k int, r int")
    assert merge_join(l, r, "k").count() == 12


def test_self_join(spark):
    df = left(spark)
    assert rows(merge_join(df, df, "ID", "FULL OUTER")) == [("1", "a"), ("2", "b")]


def test_hot_keys_take_the_same_rows(spark):
    l = spark.range(50).select((F.col("id") % 7).alias("k"), F.col("id").alias("l"))
    r = spark.range(200).select(F.when(F.col("id") < 120, F.lit(3)).when(F.col("id") < 150, F.lit(99)).otherwise(F.col("id")).alias("k"), F.col("id").alias("r"))
    for how in ("LEFT OUTER", "FULL OUTER"):
        assert rows(merge_join(l, r, "k", how, hot_rows=20)) == rows(merge_join(l, r, "k", how, hot_rows=None))
    assert rows(merge_join(r, l, "k", "RIGHT OUTER", hot_rows=20)) == rows(merge_join(r, l, "k", "RIGHT OUTER", hot_rows=None))
    plan = merge_join(l, r, "k", "LEFT OUTER", hot_rows=20)._jdf.queryExecution().toString()
    assert "LeftSemi" in plan and "LeftAnti" in plan


def test_arguments_are_checked(spark):
    df = left(spark)
    with pytest.raises(ValueError, match="unknown join type"):
        merge_join(df, df, "ID", "LEFT")
    with pytest.raises(ValueError, match="two inputs"):
        merge_join_inputs([df, df, df], "ID")
    twice = df.withColumnRenamed("L", "id")
    with pytest.raises(ValueError, match="differ only by case"):
        merge_join(twice, df, "ID")


def test_union(spark):
    a = spark.createDataFrame([(1, "x")], "id int, v string")
    b = spark.createDataFrame([("y", 2**40)], "V string, id long")
    c = spark.createDataFrame([(True,)], "w boolean")
    out = union_inputs([a, b, c])
    assert out.columns == ["id", "v", "w"]
    assert rows(out) == [(1, "x", None), (2**40, "y", None), (None, None, True)]
    assert union_inputs([a]) is a
    texts = union_inputs([a.select("id"), a.select(F.col("v").alias("id"))])
    assert rows(texts) == [("1",), ("x",)]
    assert dicts(union_inputs([a, a])) == [{"id": 1, "v": "x"}] * 2
