from datetime import datetime, timedelta

import pytest
from pyspark.sql import Window, functions as F

from conftest import rows
from rowloom.operators.compare import table_compare
from rowloom.operators.intervals import event_intervals, event_pivot, overlap_split, previous_event, within_period
from rowloom.operators.join import merge_join
from rowloom.operators.ordered import _cut, global_row_number, with_next, with_previous, with_running_count
from rowloom.operators.skew import hot_hashes, hot_keys


@pytest.fixture(scope="module")
def skewed(spark):
    """One key holds most rows; its times are bunched, tied and partly missing."""
    n = F.col("id")
    t = F.when(n % 97 == 0, None).when(n < 700, F.lit(5)).otherwise((n * 37) % 1000)
    return (
        spark.range(3000)
        .select(
            F.when(n % 10 < 7, F.lit("hot")).when(n % 10 == 7, None).otherwise(F.concat(F.lit("k"), n % 50)).alias("k"),
            t.cast("long").alias("t"),
            n.alias("i"),
        )
        .repartition(7)
        .cache()
    )


def windowed(df, fn):
    return rows(df.select("k", "t", "i", fn.over(Window.partitionBy("k").orderBy("t", "i")).alias("x")))


@pytest.mark.parametrize("group_rows", [None, 50, 300, 10**9])
def test_neighbours_equal_the_plain_window(skewed, group_rows):
    before = with_previous(skewed, ["k"], ["t", "i"], {"i": "x"}, group_rows)
    assert rows(before) == windowed(skewed, F.lag("i"))
    after = with_next(skewed, ["k"], ["t", "i"], {"i": "x"}, group_rows)
    assert rows(after) == windowed(skewed, F.lead("i"))


@pytest.mark.parametrize("group_rows", [None, 100])
def test_running_count_equals_the_plain_window(skewed, group_rows):
    odd = F.col("i") % 2 == 1
    got = with_running_count(skewed, ["k"], ["t", "i"], "x", odd, group_rows)
    w = Window.partitionBy("k").orderBy("t", "i").rowsBetween(Window.unboundedPreceding, 0)
    assert rows(got) == rows(skewed.withColumn("x", F.count(F.when(odd, 1)).over(w)))


def test_hot_group_is_cut(skewed):
    plan = with_previous(skewed, ["k"], ["t", "i"], {"i": "x"}, 100)._jdf.queryExecution().toString()
    assert "__cell" in plan
    plan = with_previous(skewed, ["k"], ["t", "i"], {"i": "x"})._jdf.queryExecution().toString()
    assert "__cell" not in plan and plan.count("Exchange") == 1 or "AdaptiveSparkPlan" in plan


def cell_sizes(df, group_rows):
    cut = _cut(df, ["k"], ["t", "i"], group_rows)
    return cut.cells, [r["count"] for r in cut.hot.groupBy("k", *cut.cells).count().collect()]


def test_cells_are_bounded_even_where_one_value_fills_a_group(skewed, spark):
    cells, sizes = cell_sizes(skewed, 100)
    assert sum(sizes) >= 2100 and max(sizes) <= 250
    one = spark.range(5000).select(F.lit("k").alias("k"), F.lit(5).alias("t"), F.col("id").alias("i"))
    cells, sizes = cell_sizes(one, 500)
    assert len(cells) == 2 and sum(sizes) == 5000 and max(sizes) <= 1100
    for missing in (F.lit(None).cast("int"), F.when(F.col("i") % 2 == 0, 7)):
        df = one.withColumn("t", missing)
        assert max(cell_sizes(df, 300)[1]) <= 1300
        assert rows(with_previous(df, ["k"], ["t", "i"], {"i": "x"}, 300)) == windowed(df, F.lag("i"))


def test_text_order_is_cut(skewed):
    df = skewed.withColumn("t", F.col("t").cast("string"))
    got = with_previous(df, ["k"], ["t", "i"], {"i": "x"}, 100)
    assert rows(got) == windowed(df, F.lag("i"))
    cells, sizes = cell_sizes(df, 100)
    assert max(sizes) <= 250


def test_groups_that_follow_one_another_are_cut(spark):
    """Each key covers a range of its own: 20 keys of 5,000 rows."""
    df = spark.range(100_000).select(F.floor(F.col("id") / 5000).alias("k"), (F.col("id") * 3).alias("t"), F.col("id").alias("i"))
    cells, sizes = cell_sizes(df, 500)
    assert sum(sizes) == 100_000 and max(sizes) <= 1000
    assert rows(with_previous(df, ["k"], ["t"], {"i": "x"}, 500)) == windowed(df, F.lag("i"))


def test_no_job_runs_while_planning(skewed):
    sc = skewed.sparkSession.sparkContext
    sc.setJobGroup("planning", "planning")
    try:
        with_previous(skewed, ["k"], ["t", "i"], {"i": "x"})
        with_running_count(skewed, ["k"], ["t", "i"], "x")
        other = skewed.withColumnRenamed("t", "u")
        for how in ("LEFT OUTER", "RIGHT OUTER", "FULL OUTER"):
            merge_join(skewed, other, "k", how)
        table_compare(skewed, other, "i", order_by="u")
        assert list(sc.statusTracker().getJobIdsForGroup("planning")) == []
    finally:
        sc.setLocalProperty("spark.jobGroup.id", None)


def test_hot_keys(skewed):
    hot = hot_hashes(skewed, [F.col("k")], 1000)
    assert list(hot.counts.values()) == [2100] and hot.limit == 1000
    assert rows(hot_keys(skewed, [F.col("k")], 1000)) == [("hot",)]
    assert rows(hot_keys(skewed, [F.col("k")], 250)) == [(None,), ("hot",)]
    assert hot_hashes(skewed, [F.col("k")], None) is None


def test_sampling_finds_large_keys(spark):
    """A key far above the limit is found, and its size is about right."""
    df = spark.range(400_000).select(F.when(F.col("id") % 3 == 0, F.lit(-1)).otherwise(F.col("id") % 1000).alias("k"))
    hot = hot_hashes(df, [F.col("k")], 20_000)
    assert len(hot.counts) == 1 and abs(hot.rows - 133_333) < 15_000
    ordered = df.withColumn("i", F.monotonically_increasing_id())
    got = with_running_count(ordered, ["k"], ["i"], "n", group_rows=20_000)
    top = got.groupBy("k").agg(F.max("n").alias("m"), F.countDistinct("n").alias("d"), F.count("*").alias("c"))
    assert top.where("m <> c OR d <> c").count() == 0


def test_global_row_number(skewed):
    got = global_row_number(skewed, ["k", "t", "i"])
    expected = skewed.withColumn("ROWNUM", F.row_number().over(Window.orderBy("k", "t", "i")))
    assert rows(got) == rows(expected)
    assert got.schema["ROWNUM"].dataType.simpleString() == "bigint"


def test_previous_event_equals_join_on_row_numbers(spark, sf_dir):
    """Row k joined to row k-1, as two numbered inputs and a join."""
    events = spark.read.parquet(f"{sf_dir}/events.parquet").select("user_id", "event_id", "ts")
    numbered = events.withColumn("ROWNUM", F.row_number().over(Window.orderBy("user_id", "ts", "event_id")))
    before = numbered.select("user_id", F.col("ts").alias("PREVIOUS_ts"), (F.col("ROWNUM") + 1).alias("ROWNUM"))
    joined = merge_join(numbered, before, "ROWNUM,user_id").select("user_id", "event_id", "ts", "PREVIOUS_ts")
    for group_rows in (None, 20):
        mine = previous_event(events, ["user_id"], ["ts", "event_id"], ["ts"], group_rows=group_rows)
        assert rows(mine) == rows(joined)


T0 = datetime(2026, 1, 1, 9, 0)


def at(minutes):
    return T0 + timedelta(minutes=minutes)


def test_intervals(spark):
    df = spark.createDataFrame([("a", at(0), at(10)), ("a", at(25), at(30)), ("b", at(5), at(6))], "k string, s timestamp_ntz, e timestamp_ntz")
    out = event_intervals(df, ["k"], "s", "e")
    assert rows(out.select("k", "s", "PREVIOUS_e", "INTERVAL_MIN")) == [("a", at(25), at(10), 15.0)]


def test_overlaps(spark):
    spans = [(1, 0, 30), (2, 10, 40), (3, 50, 60), (4, 55, 60), (5, 58, 70)]
    df = spark.createDataFrame([("w", i, at(s), at(e)) for i, s, e in spans], "w string, i int, s timestamp_ntz, e timestamp_ntz")
    ports = overlap_split(df, ["w"], "s", "e", ["e", "i"])
    assert rows(ports["pass"].select("i", "INTERVAL_MIN")) == [(2, 10.0), (5, 10.0)]
    assert rows(ports["fail"].select("i")) == [(3,), (4,)]


EVENTS = [
    ("x", 3, at(0), "e1"),
    ("x", 4, at(1), "e2"),
    ("x", 5, at(2), "e3"),
    ("x", 6, at(3), "e4"),
    ("y", 3, at(0), "e1"),
    ("y", 6, at(9), "e9"),
    ("x", 7, at(99), "no"),
]
NAMES = {3: {"t": "work_start", "emp": "by"}, 6: {"t": "work_end"}, 5: {"t": "proc_end"}}


def test_pivot_equals_self_join(spark):
    df = spark.createDataFrame(EVENTS, "lot string, ev int, t timestamp_ntz, emp string")
    one = {v: df.where(F.col("ev") == v) for v in (3, 5, 6)}
    joined = (
        one[3].selectExpr("lot", "t AS work_start", "emp AS by")
        .join(one[6].selectExpr("lot", "t AS work_end"), "lot")
        .join(one[5].selectExpr("lot", "t AS proc_end"), "lot")
    )
    out = event_pivot(df, ["lot"], "ev", NAMES, "t")
    assert out.columns == ["lot", "work_start", "by", "work_end", "proc_end"]
    assert rows(out) == rows(joined)
    partial = event_pivot(df, ["lot"], "ev", NAMES, "t", complete=False)
    assert rows(partial)[1] == ("y", at(0), "e1", at(9), None)
    wide = event_pivot(df, ["lot"], "ev", {3: {"emp": "a", "ev": "b"}}, "t")
    assert rows(wide) == [("x", "e1", 3), ("y", "e1", 3)]


def test_within_period(spark):
    df = spark.createDataFrame(
        [(1, at(0), "2026/01/01", "2026/01/02"), (2, datetime(2026, 1, 2), "2026/01/01", "2026/01/02"), (3, at(2000), "2026/01/01", "2026/01/02")],
        "i int, t timestamp_ntz, lo string, hi string",
    )
    assert rows(within_period(df, "t", "lo", "hi").select("i")) == [(1,), (2,)]
