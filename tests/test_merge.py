import pytest

from conftest import rows
from rowloom.operators import merge


def products(spark):
    return spark.createDataFrame([("A1", "Apple", 100), ("B2", "Banana", 200)], "sku string, name string, price long")


def change(spark, *values, schema="sku string, name string, price long"):
    return spark.createDataFrame(list(values), schema)


ONCE = {"assume_unique": True}


def test_upsert_updates_and_inserts(spark):
    out = merge.upsert(products(spark), change(spark, ("A1", "Apple-Premium", 150), ("C3", "Cherry", 300)), "sku", "name,price", **ONCE)
    assert rows(out) == [("A1", "Apple-Premium", 150), ("B2", "Banana", 200), ("C3", "Cherry", 300)]


def test_upsert_only_named_fields(spark):
    out = merge.upsert(products(spark), change(spark, ("B2", "New", 999), ("D4", "Date", 1)), "SKU", "name", **ONCE)
    assert rows(out) == [("A1", "Apple", 100), ("B2", "New", 200), ("D4", "Date", None)]


def test_upsert_without_fields_inserts_unknown_keys(spark):
    out = merge.upsert(products(spark), change(spark, ("A1", "x", 1), ("Z", "z", 2)), "sku", [], **ONCE)
    assert rows(out) == [("A1", "Apple", 100), ("B2", "Banana", 200), ("Z", None, None)]


def test_upsert_composite_key(spark):
    schema = "tenant string, sku string, qty long"
    target = change(spark, ("t1", "X", 10), schema=schema)
    out = merge.upsert(target, change(spark, ("t1", "X", 99), ("t1", "Y", 5), schema=schema), "tenant,sku", **ONCE)
    assert rows(out) == [("t1", "X", 99), ("t1", "Y", 5)]


@pytest.mark.parametrize("target_unique", [True, False])
def test_last_row_of_a_key_wins_and_null_keys_are_inserted(spark, target_unique):
    schema = "sku string, name string, price long, step int"
    source = change(spark, ("A1", "late", 2, 2), ("A1", "early", 1, 1), (None, "n", 3, 1), (None, "n", 3, 2), schema=schema)
    target = products(spark).union(change(spark, (None, "old", 0)))
    out = merge.upsert(target, source, "sku", order_by="step", target_unique=target_unique)
    assert rows(out) == [
        ("A1", "late", 2),
        ("B2", "Banana", 200),
        (None, "n", 3),
        (None, "n", 3),
        (None, "old", 0),
    ]


def test_null_value_overwrites(spark):
    out = merge.upsert(products(spark), change(spark, ("A1", None, None)), "sku", **ONCE)
    assert rows(out)[0] == ("A1", None, None)


def test_upsert_first_column(spark):
    out = merge.upsert_first_column(products(spark), change(spark, ("A1", "x", 1), ("Q", "q", 2)), **ONCE)
    assert rows(out) == [("A1", "x", 1), ("B2", "Banana", 200), ("Q", "q", 2)]


def test_merge_arguments_are_checked(spark):
    with pytest.raises(ValueError, match="key column"):
        merge.upsert(products(spark), products(spark), "", **ONCE)
    with pytest.raises(ValueError, match="order"):
        merge.upsert(products(spark), products(spark), "sku")
    with pytest.raises(ValueError, match="not a column"):
        merge.upsert(products(spark), change(spark, ("A", 1), schema="sku string, other int"), "sku", **ONCE)


def items(spark):
    return spark.createDataFrame([(1, "one", 10), (2, "two", 20), (3, "three", 30)], "id long, label string, qty long")


def test_update(spark):
    source = spark.createDataFrame([(2, "TWO"), (999, "none")], "ID int, label string")
    assert rows(merge.update_matched(items(spark), source, "ID", "label", **ONCE)) == [
        (1, "one", 10),
        (2, "TWO", 20),
        (3, "three", 30),
    ]


def test_update_absent_field_becomes_null(spark):
    source = spark.createDataFrame([(2,)], "id int")
    assert rows(merge.update_matched(items(spark), source, "id", "label", **ONCE))[1] == (2, None, 20)
    assert rows(merge.update_matched(items(spark), source, "id", **ONCE)) == rows(items(spark))


def test_update_matches_no_null_and_every_repeat(spark):
    target = spark.createDataFrame([(1, "a"), (1, "b"), (None, "c")], "k int, v string")
    source = spark.createDataFrame([(1, "x", 1), (1, "y", 2), (None, "z", 1)], "k int, v string, step int")
    assert rows(merge.update_matched(target, source, "k", order_by="step")) == [(1, "y"), (1, "y"), (None, "c")]
    no_key = spark.createDataFrame([("x",)], "v string")
    assert rows(merge.update_matched(target, no_key, "k", **ONCE)) == rows(target)


def test_delete(spark):
    source = spark.createDataFrame([(2,), (2,), (77,), (None,)], "ID int")
    target = items(spark).union(spark.createDataFrame([(None, "n", 0)], "id long, label string, qty long"))
    assert [r[0] for r in rows(merge.delete_by_key(target, source, "id"))] == [1, 3, None]
    with pytest.raises(ValueError, match="key column"):
        merge.delete_by_key(target, source, "")


def test_insert(spark):
    source = spark.createDataFrame([(7, 4)], "qty int, id int")
    assert rows(merge.insert_rows(items(spark), source))[-1] == (4, None, 7)


def test_counts(spark):
    schema = "id long, label string, qty long, step int"
    source = spark.createDataFrame(
        [(1, "one", 10, 1), (2, "x", 20, 1), (2, "y", 20, 2), (9, "n", 1, 1), (None, "m", 1, 1)], schema
    )
    got = merge.upsert_counts(items(spark), source, "id", "label,qty", order_by="step").first().asDict()
    assert got == {"processed": 5, "inserted": 2, "updated": 1, "unchanged": 1}
    assert merge.update_counts(items(spark), source, "id").first().asDict() == {"processed": 5, "updated": 2, "unmatched": 2}
    empty = source.limit(0)
    assert merge.upsert_counts(items(spark), empty, "id", "label", order_by="step").first()["processed"] == 0


def test_matching_rows(spark):
    other = spark.createDataFrame([(2,), (2,), (None,)], "ID int")
    target = items(spark).union(spark.createDataFrame([(None, "n", 0), (2, "again", 1)], "id long, label string, qty long"))
    assert rows(merge.matching_rows(target, other, "id")) == [(2, "again", 1), (2, "two", 20)]
