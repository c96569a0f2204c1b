"""Sinks of a flow that change tables of the catalog, and the order of effects."""

import uuid

import pytest

from conftest import rows
from rowloom.plans.flow import build
from rowloom.plans.steps import Context


@pytest.fixture
def table(spark):
    name = f"t_{uuid.uuid4().hex}"
    spark.createDataFrame([(1, "a"), (2, "b")], "k long, v string").write.saveAsTable(name)
    spark.createDataFrame([(2, "x"), (3, "y")], "k long, v string").createOrReplaceTempView("fresh")
    yield name
    spark.sql(f"DROP TABLE IF EXISTS {name}")


def step(ident, kind, **settings):
    return {"Id": ident, "Name": ident, "StepType": kind, "Settings": settings}


def flow(*steps):
    ids = [s["Id"] for s in steps]
    return {"Steps": list(steps), "Connections": [{"SourceStepId": a, "TargetStepId": b} for a, b in zip(ids, ids[1:])]}


READ = step("Read", "DBInput", SQL="SELECT k, v FROM fresh")


def test_insert_appends(spark, table):
    before = len(spark.table(table).inputFiles())
    build(flow(READ, step("Out", "DBOutput", TableName=table)), Context(spark)).run()
    assert rows(spark.table(table)) == [(1, "a"), (2, "b"), (2, "x"), (3, "y")]
    assert len(spark.table(table).inputFiles()) > before


@pytest.mark.parametrize("qualified", [False, True])
def test_upsert_replaces(spark, table, qualified):
    name = f"default.{table}" if qualified else table
    build(flow(READ, step("Out", "InsertUpdate", TableName=name, KeyFields="k")), Context(spark)).run()
    assert rows(spark.table(table)) == [(1, "a"), (2, "x"), (3, "y")]


def test_later_steps_read_the_change(spark, table):
    steps = flow(READ, step("Out", "DBDelete", TableName=table, KeyFields="k"), step("Again", "DBInput", SQL=f"SELECT count(*) AS n FROM {table}"))
    built = build(steps, Context(spark))
    assert rows(built.frame("Again")) == [(1,)]
    assert spark.table(f"default.{table}").count() == 2
    built.run()
    assert rows(spark.table(table)) == [(1, "a")]


def test_statement_before_a_read(spark, table):
    made = f"{table}_made"
    steps = flow(step("Make", "ExecSQL", SQL=f"CREATE TABLE {made} USING parquet AS SELECT 7 AS n"), step("Read", "DBInput", SQL=f"SELECT n FROM {made}"))
    try:
        assert rows(build(steps, Context(spark)).frame("Read")) == [(7,)]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {made}")


def test_split_settings_reach_the_source(spark):
    seen = {}

    class Space:
        def query(self, sql, given, each_row, split=None):
            seen["split"] = split
            return spark.range(1)

    steps = flow(step("Read", "OracleInput", ConnectionId="c", SQL="SELECT 1", SplitColumn="id", SplitLower="0", SplitUpper="90", SplitParts="9"))
    build(steps, Context(spark, connections={"c": Space()}))
    assert (seen["split"].column, seen["split"].lower, seen["split"].upper, seen["split"].partitions) == ("id", "0", "90", 9)


def test_chained_inserts_are_each_written_once(spark, table):
    """Insert, read with what was inserted, insert again."""
    again = step("Again", "DBInput", SQL=f"SELECT k + 10 AS k, v FROM {table}")
    build(flow(READ, step("One", "DBOutput", TableName=table), again, step("Two", "DBOutput", TableName=table)), Context(spark)).run()
    assert rows(spark.table(table)) == sorted([(1, "a"), (2, "b"), (2, "x"), (3, "y"), (11, "a"), (12, "b"), (12, "x"), (13, "y")], key=lambda r: tuple(map(str, r)))


def test_second_table_is_filled_from_the_unchanged_first(spark, table):
    other = f"{table}_other"
    spark.sql(f"CREATE TABLE {other} (k BIGINT) USING parquet")
    try:
        steps = flow(
            step("Old", "DBInput", SQL=f"SELECT k, concat(v, v) AS v FROM {table}"), step("Up", "InsertUpdate", TableName=table, KeyFields="k"),
            step("Now", "DBInput", SQL=f"SELECT CAST(length(v) AS BIGINT) AS k FROM {table}"), step("Out", "DBOutput", TableName=other))
        build(steps, Context(spark)).run()
        assert rows(spark.table(other)) == [(2,), (2,)]
        assert rows(spark.table(table)) == [(1, "aa"), (2, "bb")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {other}")


def test_build_has_no_effects(spark, table):
    steps = flow(step("Gone", "ExecSQL", SQL=f"TRUNCATE TABLE {table}"), step("Read", "DBInput", SQL=f"SELECT k FROM {table}"), step("Out", "DBOutput", TableName=table))
    built = build(steps, Context(spark))
    assert spark.table(table).count() == 2 and len(built.waiting) == 3
    assert rows(built.frame("Read")) == [] and spark.table(table).count() == 0


def test_statements_run_in_step_order(spark, table):
    """An external write, a statement, and what follows it."""
    seen = []

    class Space:
        def query(self, sql, given, each_row, split=None):
            seen.append(sql)
            return spark.range(1)

        def insert(self, name, given, size):
            return [lambda: seen.append("insert")]

        def execute(self, sql, given, each_row):
            return [lambda: seen.append(sql)]

    steps = flow(step("A", "DBInput", ConnectionId="c", SQL="first"), step("B", "DBOutput", ConnectionId="c", TableName="t"), step("C", "ExecSQL", ConnectionId="c", SQL="statement"), step("D", "DBInput", ConnectionId="c", SQL="last"))
    built = build(steps, Context(spark, connections={"c": Space()}))
    assert seen == ["first"]
    built.run()
    assert seen == ["first", "insert", "statement", "last"]


def test_a_commit_that_was_cut_off_is_finished(spark, table, monkeypatch):
    from rowloom.plans import commit

    other = f"{table}_other"
    spark.sql(f"CREATE TABLE {other} (k BIGINT, v STRING) USING parquet")
    try:
        staged = commit.Commit(spark)
        assert not commit.recover(spark, staged.folder)
        staged.append(table, spark.table("fresh"))
        staged.append(table, spark.table("fresh").where("k = 3"))
        staged.replace(other, spark.table(table))
        real, calls = commit._write_text, []

        def failing(session, path, text):
            calls.append(path)
            if len(calls) == 3:  # the second append has landed, its mark has not
                raise OSError("lost")
            real(session, path, text)

        monkeypatch.setattr(commit, "_write_text", failing)
        with pytest.raises(OSError):
            staged.run()
        assert spark.table(other).count() == 0
        monkeypatch.setattr(commit, "_write_text", real)
        for _ in range(2):
            assert commit.recover(spark, staged.folder)
            assert rows(spark.table(table)) == [(1, "a"), (2, "b"), (2, "x"), (3, "y"), (3, "y")]
            assert rows(spark.table(other)) == [(1, "a"), (2, "b")]
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {other}")


def test_writes_are_counted_on_the_way(spark, table):
    """Processed, inserted, updated, unchanged and deleted rows of each sink, in a chain."""
    more = [(2, "x"), (2, "z"), (3, "y"), (1, "a"), (None, "n")]
    spark.createDataFrame(more, "k long, v string").createOrReplaceTempView("more")
    steps = flow(
        step("Read", "DBInput", SQL="SELECT k, v FROM more"),
        step("Up", "InsertUpdate", TableName=table, KeyFields="k"),
        step("Some", "DBInput", SQL=f"SELECT k, 'b' AS v FROM {table} WHERE k > 1"),
        step("Change", "DBUpdate", TableName=table, KeyFields="k"),
        step("Third", "Filter", FieldName="k", Operator="equals", Value="3"),
        step("Out", "DBDelete", TableName=table, KeyFields="k"),
    )
    built = build(steps, Context(spark))
    assert built.write_counts() == {}
    built.run()
    assert rows(spark.table(table)) == [(1, "a"), (2, "b"), (None, "n")]
    assert built.write_counts() == {
        "Up": {"processed": 5, "inserted": 2, "updated": 1, "unchanged": 1},
        "Change": {"processed": 2, "updated": 2, "unchanged": 0},
        "Out": {"processed": 1, "deleted": 1},
    }


def test_inserts_are_counted(spark, table):
    built = build(flow(READ, step("Out", "DBOutput", TableName=table), step("Again", "DBOutput", TableName=table)), Context(spark))
    built.run()
    assert spark.table(table).count() == 6
    assert built.write_counts() == {"Out": {"processed": 2, "inserted": 2}, "Again": {"processed": 2, "inserted": 2}}


def test_counts_of_a_target_with_repeated_keys(spark, table):
    spark.createDataFrame([(2, "b"), (2, "c")], "k long, v string").write.insertInto(table)
    built = build(flow(READ, step("Out", "InsertUpdate", TableName=table, KeyFields="k")), Context(spark))
    built.run()
    assert rows(spark.table(table)) == [(1, "a"), (2, "x"), (2, "x"), (2, "x"), (3, "y")]
    assert built.write_counts() == {"Out": {"processed": 2, "inserted": 1, "updated": 3, "unchanged": 0}}
