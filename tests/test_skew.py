"""A key with a third of all rows: adaptive execution must be able to split it."""

import pytest
from pyspark.sql import functions as F

from rowloom.operators import compare, join, merge

SETTINGS = {
    "spark.sql.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.autoBroadcastJoinThreshold": "-1",
    "spark.sql.adaptive.advisoryPartitionSizeInBytes": "64kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionThresholdInBytes": "100kb",
    "spark.sql.adaptive.skewJoin.skewedPartitionFactor": "2",
    "spark.sql.shuffle.partitions": "16",
}


@pytest.fixture(scope="module")
def sides(spark):
    before = {k: spark.conf.get(k, None) for k in SETTINGS}
    for k, v in SETTINGS.items():
        spark.conf.set(k, v)
    n = F.col("id")
    key = F.when(n % 3 == 0, F.lit(7)).otherwise(n % 20_000)
    many = spark.range(0, 60_000, 1, 8).select(key.alias("k"), F.sha2(n.cast("string"), 256).alias("v"), n.alias("n"))
    few = spark.range(0, 20_000, 1, 4).select(n.alias("k"), F.sha2((n + 1).cast("string"), 256).alias("v"), n.alias("n"))
    yield many, few
    for k, v in before.items():
        spark.conf.unset(k) if v is None else spark.conf.set(k, v)


def renamed(df):
    """No shared column but the key, so that both sides carry their values."""
    return df.select("k", F.col("v").alias("w"))


def splits(df):
    df.collect()
    return df._jdf.queryExecution().executedPlan().toString().count("skew=true")


@pytest.mark.parametrize("how", ["INNER", "LEFT OUTER"])
def test_hot_left_key(sides, how):
    many, few = sides
    assert splits(join.merge_join(many, renamed(few), "k", how)) == 1


@pytest.mark.parametrize("how", ["INNER", "RIGHT OUTER"])
def test_hot_right_key(sides, how):
    many, few = sides
    assert splits(join.merge_join(renamed(few), many, "k", how)) == 1


def test_hot_optional_side(sides):
    many, few = sides
    assert splits(join.merge_join(renamed(few), many, "k", "LEFT OUTER", hot_rows=None)) == 0
    assert splits(join.merge_join(renamed(few), many, "k", "LEFT OUTER", hot_rows=5_000)) == 1
    assert splits(join.merge_join(renamed(few), many, "k", "FULL OUTER", hot_rows=5_000)) == 2
    assert splits(join.merge_join(many, renamed(few), "k", "RIGHT OUTER", hot_rows=5_000)) == 1


def test_merges_into_a_target_with_a_hot_key(sides):
    many, few = sides
    assert splits(merge.update_matched(many, few, "k", "v", order_by="n")) == 1
    assert splits(merge.upsert(many, few, "k", "v", order_by="n", target_unique=False)) == 1
    assert splits(merge.delete_by_key(many, few.where("k % 2 = 0"), "k")) == 1
    assert splits(merge.matching_rows(many, few.where("k % 2 = 1"), "k")) == 1


def test_comparison_with_a_hot_left_key(sides):
    many, few = sides
    assert splits(compare.table_compare(many, few, "k", "v", order_by="n", include_matched=True, split_hot=True)) == 1


def test_hot_source_keys_collapse_before_the_shuffle(sides):
    """20,000 copies of one key leave every map task as a single row."""
    many, few = sides
    out = merge.upsert(few, many, "k", "v", order_by="n")
    out.collect()
    assert out.count() == few.count()
    plan = merge.upsert(few, many, "k", "v", order_by="n")._jdf.queryExecution().executedPlan().toString()
    assert "partial_max_by" in plan


@pytest.mark.parametrize("hot_side", ["left", "right"])
def test_full_outer_join_is_split_by_default(sides, hot_side):
    """Inner join and rows without a partner; the result is that of one full outer join."""
    many, few = sides
    left, right = (many, renamed(few)) if hot_side == "left" else (renamed(few), many)
    left, right = left.where("k % 5 <> 1"), right.where("k % 5 <> 3")
    out = join.merge_join(left, right, "k", "FULL OUTER")
    assert splits(out) >= 1
    plain = left.alias("l").join(right.alias("r"), F.col("l.k").eqNullSafe(F.col("r.k")), "full")
    columns = [F.coalesce("l.k", "r.k").alias("k"), *[F.col(c) for c in out.columns if c != "k"]]
    assert out.exceptAll(plain.select(*columns)).count() == plain.select(*columns).exceptAll(out).count() == 0


def test_comparison_is_split_by_default(sides):
    many, few = sides
    assert splits(compare.table_compare(many, few, "k", "v", order_by="n", include_matched=True)) == 1


def test_flow_upsert_into_a_hot_target_is_split(spark, sides):
    from rowloom.plans.spaces import SessionSpace

    many, few = sides
    many.createOrReplaceTempView("hot_target")
    space = SessionSpace(spark)
    space.upsert("hot_target", few, ["k"], "v", ["n"], 100)
    assert splits(space.states["hot_target"]) >= 1
