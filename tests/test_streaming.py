import pytest
from pyspark.sql import functions as F

from conftest import rows
from rowloom.operators.compare import table_compare
from rowloom.operators.join import merge_join
from rowloom.operators.project import calculate
from rowloom.operators.route import filter_rows, filter_tag, switch
from rowloom.sinks.tables import write_routed, write_state
from rowloom.streaming.batches import UpsertStream, append_stream, route_stream
from rowloom.streaming.static import CompareStream, JoinStream


@pytest.fixture()
def stream(spark, tmp_path):
    """Three files, read one per batch."""
    for i in range(3):
        df = spark.range(i * 10, i * 10 + 10).selectExpr("id", "id % 4 AS k", "CAST(id AS STRING) AS v")
        df.coalesce(1).write.mode("append").parquet(str(tmp_path / "in"))
    schema = "id long, k long, v string"
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))


def batch(spark):
    return spark.range(30).selectExpr("id", "id % 4 AS k", "CAST(id AS STRING) AS v")


def test_row_wise_steps(spark, stream, tmp_path):
    def steps(df):
        return calculate(switch(filter_rows(df, "id", "greaterThan", "4"), "k", "1|one\n2|two")["one"], "add", "id", "v", "s")

    out, check = str(tmp_path / "out"), str(tmp_path / "check")
    append_stream(steps(stream), out, check).awaitTermination()
    got = spark.read.parquet(out)
    assert rows(got.drop("batch_id")) == rows(steps(batch(spark)))
    assert got.select("batch_id").distinct().count() == 3


def test_every_row_goes_to_one_port(spark, stream, tmp_path):
    tag = lambda df: filter_tag(df, "v", "contains", "1")
    out = str(tmp_path / "out")
    route_stream(stream, tag, out, str(tmp_path / "check")).awaitTermination()
    got = spark.read.parquet(out).groupBy("branch").count()
    assert rows(got) == rows(tag(batch(spark)).groupBy("branch").count())


def test_upsert_is_idempotent(spark, stream, tmp_path):
    initial = spark.createDataFrame([(0, 0, "old"), (99, 0, "kept")], "k long, id long, v string")
    sink = UpsertStream(spark, initial, str(tmp_path / "state"), ["k"], ["id"])
    sink.start(stream, str(tmp_path / "check")).awaitTermination()
    assert sink.latest == 2
    before = rows(sink.state())
    again = batch(spark).where("id >= 20")
    files = rows(sink.state(1))
    assert len(files) == 5
    assert [r for r in before if r[0] == 99] == [(99, 0, "kept")]
    sink.apply(again, 2)
    assert len(rows(sink.state())) == 5 and rows(sink.state(-1)) == rows(initial)


def test_a_new_process_goes_on_from_the_last_version(spark, stream, tmp_path):
    initial = spark.createDataFrame([], "k long, id long, v string")
    args = (spark, initial, str(tmp_path / "state"), ["k"], ["id"])
    UpsertStream(*args).start(stream, str(tmp_path / "check")).awaitTermination()
    spark.sql("SELECT 100L AS id, 1L AS k, 'new' AS v").write.mode("append").parquet(str(tmp_path / "in"))
    second = UpsertStream(*args)
    second.start(stream, str(tmp_path / "check")).awaitTermination()
    assert second.latest == 3
    got = {r["k"]: (r["id"], r["v"]) for r in second.state().collect()}
    assert set(got) == {0, 1, 2, 3} and got[1] == (100, "new")


def test_stream_meets_static_table(spark, stream, tmp_path):
    static = spark.createDataFrame([(1, "one", "x"), (2, "two", None)], "k int, name string, v string")
    out = str(tmp_path / "out")
    append_stream(merge_join(stream, static, "k", "LEFT OUTER"), out, str(tmp_path / "check")).awaitTermination()
    assert rows(spark.read.parquet(out).drop("batch_id")) == rows(merge_join(batch(spark), static, "k", "LEFT OUTER"))


def test_state_is_never_overwritten(spark, tmp_path):
    df = spark.range(3)
    write_state(df, str(tmp_path / "s"))
    with pytest.raises(Exception, match="(?i)exists"):
        write_state(df, str(tmp_path / "s"))


def test_ports_are_written_in_one_pass(spark, tmp_path):
    df = spark.range(10).withColumn("branch", F.when(F.col("id") < 3, "a").otherwise("b"))
    write_routed(df, str(tmp_path / "p"))
    assert sorted(p.name for p in (tmp_path / "p").glob("branch=*")) == ["branch=a", "branch=b"]
    assert spark.read.parquet(str(tmp_path / "p/branch=a")).count() == 3


def test_a_batch_of_one_key_writes_one_bucket(spark, tmp_path):
    initial = spark.range(200).selectExpr("id AS k", "id", "'old' AS v")
    sink = UpsertStream(spark, initial, str(tmp_path / "state"), ["k"], ["id"], buckets=16)
    one = lambda k, v: spark.sql(f"SELECT {k} AS k, 1000L AS id, '{v}' AS v")
    sink.apply(one(7, "first"), 0)
    assert len(list((tmp_path / "state/version=0").glob("bucket=*"))) == 16
    for ident, value in ((1, "second"), (1, "again"), (2, "third")):
        sink.apply(one(7, value), ident)
        assert len(list((tmp_path / f"state/version={ident}").glob("bucket=*"))) == 1
    found = {r["k"]: r["v"] for r in sink.state().collect()}
    assert len(found) == 200 and found[7] == "third" and found[8] == "old"
    assert {r["v"] for r in sink.state(1).where("k = 7").collect()} == {"again"}
    sink.apply(one("CAST(NULL AS BIGINT)", "loose"), 3)
    sink.apply(spark.sql("SELECT 500 AS k, 1L AS id, 'new' AS v").where("false"), 4)
    assert sink.state().count() == 201 and sink.state().where("k IS NULL").count() == 1


def test_held_rows_compete(spark, tmp_path):
    initial = spark.createDataFrame([], "k long, seen long, v string")
    held = lambda df: df.withColumn("newest", F.col("seen"))
    sink = UpsertStream(spark, initial, str(tmp_path / "state"), ["k"], ["newest"], ["seen", "v"], held=held)
    for ident, (seen, v) in enumerate([(5, "five"), (3, "three"), (9, "nine")]):
        sink.apply(spark.createDataFrame([(1, seen, v, seen)], "k long, seen long, v string, newest long"), ident)
        assert rows(sink.state()) == [(1, max(5, seen), "nine" if seen == 9 else "five")]


@pytest.fixture()
def static(spark):
    """Keys with and without a partner, repeated, and NULL."""
    return spark.createDataFrame([(0, "a"), (1, "b"), (1, "c"), (7, "d"), (7, "e"), (None, "f")], "k long, w string")


@pytest.mark.parametrize("how", ["INNER", "LEFT OUTER", "RIGHT OUTER", "FULL OUTER"])
def test_a_stream_joins_like_a_table(spark, stream, static, tmp_path, how):
    join = JoinStream(static, str(tmp_path / "out"), "k", how, stream.schema)
    before = rows(join.result())
    assert before == rows(merge_join(batch(spark).limit(0), static, "k", how))
    join.start(stream, str(tmp_path / "check")).awaitTermination()
    expected = rows(merge_join(batch(spark), static, "k", how))
    assert rows(join.result()) == expected
    join.apply(batch(spark).where("id >= 20"), 2)  # a batch that runs again
    again = JoinStream(static, str(tmp_path / "out"), "k", how, stream.schema)
    assert rows(again.result()) == expected


def test_null_keys_of_a_stream_meet_null_keys(spark, static, tmp_path):
    given = spark.createDataFrame([(1, None, "x"), (2, 9, "y")], "id long, k long, v string")
    for how in ("RIGHT OUTER", "FULL OUTER"):
        join = JoinStream(static, str(tmp_path / how), "k", how, given.schema)
        join.apply(given.limit(0), 0)
        join.apply(given, 1)
        assert rows(join.result()) == rows(merge_join(given, static, "k", how))


def test_a_stream_compares_like_a_table(spark, stream, tmp_path):
    right = batch(spark).where("id % 7 <> 0").selectExpr("id + 2 AS id", "(id + 2) % 4 AS k", "if(id % 5 = 0, 'new', CAST(id + 2 AS STRING)) AS v")
    right = right.union(right.where("id < 9").selectExpr("id", "k", "'zz'"))
    for n, options in enumerate(({"order_by": "v"}, {"order_by": "v", "include_matched": True})):
        compare = CompareStream(right, str(tmp_path / f"out{n}"), "id", stream.schema, options)
        compare.start(stream, str(tmp_path / f"check{n}")).awaitTermination()
        assert rows(compare.result()) == rows(table_compare(batch(spark), right, "id", **options))


def test_stream_joins_need_a_key_and_a_known_type(static):
    for keys, how in (("", "INNER"), ("k", "CROSS")):
        with pytest.raises(ValueError):
            JoinStream(static, "nowhere", keys, how, static.schema)
