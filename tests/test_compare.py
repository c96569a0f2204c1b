import pytest

from conftest import rows
from rowloom.operators.compare import compare_summary, right_duplicates, table_compare


def both(spark, a, b, schema, other=None):
    return spark.createDataFrame(a, schema), spark.createDataFrame(b, other or schema)


def compare(spark, a, b, schema, keys="id", other=None, **options):
    """The comparison by two joins, after checking that one full join agrees."""
    options.setdefault("assume_unique", True)
    sides = both(spark, a, b, schema, other)
    out = table_compare(*sides, keys, **options)
    single = table_compare(*sides, keys, split_hot=True, **options)
    assert single.schema == out.schema and rows(single) == rows(out)
    return out


def test_match_is_hidden_unless_asked_for(spark):
    row = [(1, "A")]
    assert compare(spark, row, row, "id int, name string").count() == 0
    out = compare(spark, row, row, "id int, name string", include_matched=True)
    assert out.columns == ["id", "name_L", "name_R", "_status", "_diff_columns"]
    assert rows(out) == [(1, "A", "A", "MATCH", "")]


def test_diff_names_its_columns(spark):
    out = compare(spark, [(1, "A", "OK", 5)], [(1, "A", "NG", 6)], "id int, name string, status string, n int")
    assert rows(out) == [(1, "A", "A", "OK", "NG", 5, 6, "DIFF", "status,n")]


def test_one_sided_rows(spark):
    assert rows(compare(spark, [(99, "Alone")], [], "id int, name string")) == [(99, "Alone", None, "ONLY_LEFT", "")]
    assert rows(compare(spark, [], [(7, "Extra")], "id int, name string")) == [(7, None, "Extra", "ONLY_RIGHT", "")]


def test_chosen_columns(spark):
    a, b = [(1, "A", "OK")], [(1, "A", "NG")]
    assert compare(spark, a, b, "id int, name string, status string", columns="name").count() == 0


def test_composite_key(spark):
    out = compare(spark, [(1, 100, 10), (2, 200, 20)], [(1, 100, 10), (2, 200, 99)], "dept int, emp int, v int", "dept,emp")
    assert rows(out) == [(2, 200, 20, 99, "DIFF", "v")]


def test_numbers_of_different_types(spark):
    out = compare(spark, [(1, 100)], [(1, 100.0)], "id int, amt int", other="id int, amt double", include_matched=True)
    assert [r[3] for r in rows(out)] == ["MATCH"]
    doubles = compare(spark, [(1, 0.1 + 0.2), (2, 1.0)], [(1, 0.3), (2, 1.0000001)], "id int, v double")
    assert [r[0] for r in rows(doubles)] == [2]
    texts = compare(spark, [(1, "1,000"), (2, "10"), (3, "1x")], [(1, "1000.0"), (2, "11"), (3, "1x ")], "id int, v string")
    assert [r[0] for r in rows(texts)] == [2, 3]


def test_null_option(spark):
    a = [(1, None)]
    assert compare(spark, a, a, "id int, memo string").count() == 0
    assert [r[3] for r in rows(compare(spark, a, a, "id int, memo string", nulls_equal=False))] == ["DIFF"]
    assert [r[3] for r in rows(compare(spark, a, [(1, "")], "id int, memo string"))] == ["DIFF"]


def test_case_and_trim_options(spark):
    a, b = [(1, "  Alice  ")], [(1, "aLICE")]
    schema = "id int, name string"
    assert compare(spark, a, b, schema).count() == 1
    assert compare(spark, a, b, schema, ignore_case=True).count() == 1
    assert compare(spark, a, b, schema, ignore_case=True, trim=True).count() == 0


def test_null_key_matches_null_but_not_empty(spark):
    out = compare(spark, [(None, 1), ("", 2)], [(None, 1)], "id string, v int", include_matched=True)
    assert [(r[0], r[3]) for r in rows(out)] == [("", "ONLY_LEFT"), (None, "MATCH")]


def test_summary(spark):
    a, b = both(spark, [(1, "x"), (2, "x"), (3, "x")], [(1, "x"), (2, "y"), (9, "z")], "id int, v string")
    counts = dict(rows(compare_summary(a, b, "id", assume_unique=True)))
    assert counts == {"MATCH": 1, "DIFF": 1, "ONLY_LEFT": 1, "ONLY_RIGHT": 1}


def test_repeated_keys(spark):
    a, b = both(spark, [(1, "x", 0), (1, "y", 0)], [(1, "x", 2), (1, "y", 1), (5, "q", 1), (5, "p", 2)], "id int, v string, n int")
    out = table_compare(a, b, "id", "v", order_by="n", include_matched=True)
    assert rows(out) == [
        (1, "x", "y", "DIFF", "v"),
        (1, "y", "y", "MATCH", ""),
        (5, None, "q", "ONLY_RIGHT", ""),
    ]
    assert right_duplicates(b, "id").first()[0] == 2


def test_columns_of_one_side_only(spark):
    out = table_compare(
        spark.createDataFrame([(1, "a", 5)], "id int, v string, only_l int"),
        spark.createDataFrame([(1, "a", 6)], "id int, v string, only_r int"),
        "id",
        assume_unique=True,
    )
    assert out.columns == ["id", "v_L", "v_R", "only_l_L", "only_l_R", "only_r_L", "only_r_R", "_status", "_diff_columns"]
    assert rows(out) == [(1, "a", "a", 5, None, None, 6, "DIFF", "only_l,only_r")]


def test_arguments_are_checked(spark):
    df = spark.createDataFrame([(1, "a")], "id int, v string")
    with pytest.raises(ValueError, match="key column"):
        table_compare(df, df, "")
    with pytest.raises(ValueError, match="order"):
        table_compare(df, df, "id")
