"""Statements for external databases, checked with a recording connection."""

import json
import sys
import uuid
from functools import partial

import pytest
from pyspark import cloudpickle

from rowloom.plans.flow import build
from rowloom.plans.spaces import JdbcSpace
from rowloom.plans.steps import Context
from rowloom.sinks import external
from rowloom.sinks.external import Statements
from rowloom.sinks.tables import append_table, jdbc_write_options
from rowloom.sources.jdbc import JdbcConnection, Split, read_options


cloudpickle.register_pickle_by_value(sys.modules[__name__])


class Recorder:
    """Writes what it is sent to a file of its own, as tasks run elsewhere."""

    def __init__(self, folder, fail=False):
        self.path, self.pending, self.fail = f"{folder}/{uuid.uuid4().hex}.jsonl", [], fail

    def cursor(self):
        return self

    def execute(self, statement):
        self.pending.append([statement, []])

    def executemany(self, statement, rows):
        if self.fail:
            raise RuntimeError("refused")
        self.pending.append([statement, rows])

    def _log(self, kind):
        with open(self.path, "a", encoding="utf-8") as f:
            f.write(json.dumps([kind, self.pending]) + "\n")
        self.pending = []

    def commit(self):
        self._log("commit")

    def rollback(self):
        self._log("rollback")

    def close(self):
        pass


def recorded(folder):
    return [json.loads(line) for p in sorted(folder.iterdir()) for line in p.read_text(encoding="utf-8").splitlines()]


def sent(folder):
    return sorted([row for kind, batches in recorded(folder) for _, rows in batches for row in rows], key=str)


def items(spark):
    return spark.createDataFrame(
        [(1, "a", 10, 1), (1, "b", 20, 2), (2, "c", 30, 1), (None, "n", 0, 1)], "id int, name string, qty int, step int"
    ).repartition(3)


def test_upsert_statements():
    args = ("t", ["id", "v"], ["id"], ["v"])
    assert Statements("postgresql").upsert(*args) == (
        'INSERT INTO "t" ("id", "v") VALUES (%s, %s) ON CONFLICT ("id") DO UPDATE SET "v" = excluded."v"'
    )
    assert Statements("sqlite").upsert("t", ["id"], ["id"], []) == 'INSERT INTO "t" ("id") VALUES (?) ON CONFLICT ("id") DO NOTHING'
    assert Statements("mysql").upsert(*args) == (
        "INSERT INTO `t` (`id`, `v`) VALUES (%s, %s) ON DUPLICATE KEY UPDATE `v` = VALUES(`v`)"
    )
    assert Statements("mariadb").upsert("t", ["id"], ["id"], []).endswith("ON DUPLICATE KEY UPDATE `id` = `id`")
    assert Statements("oracle").upsert(*args) == (
        "MERGE INTO t t USING (SELECT :1 AS id, :2 AS v FROM DUAL) s ON (t.id = s.id) "
        "WHEN MATCHED THEN UPDATE SET t.v = s.v WHEN NOT MATCHED THEN INSERT (id, v) VALUES (s.id, s.v)"
    )
    assert Statements("sqlserver").upsert("t", ["id"], ["id"], []) == (
        "MERGE INTO [t] AS t USING (SELECT ? AS [id]) AS s ON (t.[id] = s.[id]) WHEN NOT MATCHED THEN INSERT ([id]) VALUES (s.[id]);"
    )


def test_other_statements():
    assert Statements("oracle").update("t", ["a", "b"], ["v", "w"]) == "UPDATE t SET v = :1, w = :2 WHERE a = :3 AND b = :4"
    assert Statements("sqlserver").delete("t", ["a", "b"]) == "DELETE FROM [t] WHERE [a] = ? AND [b] = ?"
    assert Statements("mysql").insert("t", ["a", "b"]) == "INSERT INTO `t` (`a`, `b`) VALUES (%s, %s)"


def test_upsert_sends_one_row_per_key(spark, tmp_path):
    df = items(spark)
    out = external.upsert_external(df, partial(Recorder, str(tmp_path)), "sqlite", "t", "ID", "name,qty", order_by="step")
    assert out is df
    assert sent(tmp_path) == [[1, "b", 20], [2, "c", 30], [None, "n", 0]]
    assert {s for _, batches in recorded(tmp_path) for s, _ in batches} == {Statements("sqlite").upsert("t", ["id", "name", "qty"], ["id"], ["name", "qty"])}


def test_update_binds_updates_then_keys(spark, tmp_path):
    external.update_external(items(spark), partial(Recorder, str(tmp_path)), "sqlite", "t", "id", "qty,absent", order_by="step")
    assert sent(tmp_path) == [[0, None, None], [20, None, 1], [30, None, 2]]


def test_delete_sends_distinct_keys(spark, tmp_path):
    external.delete_external(items(spark), partial(Recorder, str(tmp_path)), "sqlite", "t", "id")
    assert sent(tmp_path) == [[1], [2]]


def test_each_row_commits_per_batch(spark, tmp_path):
    df = spark.range(25).coalesce(1)
    external.exec_each_row(df, partial(Recorder, str(tmp_path)), "CALL p(?)", commit_size=10)
    assert [len(rows) for _, batches in recorded(tmp_path) for _, rows in batches] == [10, 10, 5]


def test_failure_rolls_back_and_fails_the_job(spark, tmp_path):
    with pytest.raises(Exception, match="refused"):
        external.exec_each_row(spark.range(3).coalesce(1), partial(Recorder, str(tmp_path), True), "CALL p(?)")
    assert {kind for kind, _ in recorded(tmp_path)} == {"rollback"}


def test_order_is_required(spark):
    with pytest.raises(ValueError, match="order"):
        external.upsert_external(items(spark), None, "sqlite", "t", "id")


PG = JdbcConnection("jdbc:postgresql://db/app", {"user": "u"})


def test_read_options():
    assert read_options(PG, table="t") == {
        "url": "jdbc:postgresql://db/app",
        "driver": "org.postgresql.Driver",
        "user": "u",
        "dbtable": "t",
        "fetchsize": "10000",
    }
    split = read_options(PG, sql="SELECT 1 ; ", split=Split("id", "1", "100", 4))
    assert split["dbtable"] == "(SELECT 1) q"
    assert (split["partitionColumn"], split["lowerBound"], split["upperBound"], split["numPartitions"]) == ("id", "1", "100", "4")
    with pytest.raises(ValueError, match="either"):
        read_options(PG)
    assert jdbc_write_options(PG, "t", 50)["batchsize"] == "50"


def test_database_kinds():
    kinds = {
        "jdbc:oracle:thin:@x": "oracle",
        "jdbc:mysql://x": "mysql",
        "jdbc:mariadb://x": "mariadb",
        "jdbc:sqlserver://x": "sqlserver",
        "jdbc:sqlite:/x.db": "sqlite",
    }
    for url, kind in kinds.items():
        assert JdbcConnection(url).kind == kind
    with pytest.raises(ValueError, match="unknown database"):
        JdbcConnection("jdbc:foo:bar").kind


def test_flow_writes_to_an_external_database(spark, tmp_path):
    items(spark).createOrReplaceTempView("ext_items")
    space = JdbcSpace(spark, PG, partial(Recorder, str(tmp_path)))

    def node(ident, kind, **s):
        return {"Id": ident, "StepType": kind, "Settings": {"ConnectionId": "pg", "TableName": "t", **s}}

    steps = [
        {"Id": "r", "StepType": "DBInput", "Settings": {"SQL": "SELECT * FROM ext_items"}},
        node("u", "InsertUpdate", KeyFields="id", UpdateFields="qty", OrderFields="step"),
        node("d", "DBDelete", KeyFields="id"),
        node("x", "ExecSQL", SQL="ANALYZE t"),
    ]
    edges = [{"SourceStepId": a, "TargetStepId": b} for a, b in (("r", "u"), ("u", "d"), ("d", "x"))]
    flow = build({"Name": "e", "Steps": steps, "Connections": edges}, Context(spark, {"pg": space}))
    assert not recorded(tmp_path)
    flow.run()
    texts = {s for _, batches in recorded(tmp_path) for s, _ in batches}
    assert texts == {
        Statements("postgresql").upsert("t", ["id", "qty"], ["id"], ["qty"]),
        Statements("postgresql").delete("t", ["id"]),
        "ANALYZE t",
    }


def test_append_table(spark):
    name = "t_" + uuid.uuid4().hex
    try:
        df = spark.createDataFrame([(1, "a")], "id int, v string")
        assert append_table(df, name) is df
        append_table(spark.createDataFrame([("b", 2)], "V string, id int"), name)
        append_table(spark.createDataFrame([(3,)], "id int"), name)
        assert sorted(map(tuple, spark.table(name).collect())) == [(1, "a"), (2, "b"), (3, None)]
        with pytest.raises(ValueError, match="lacks"):
            append_table(spark.createDataFrame([(3, 4)], "id int, w int"), name)
    finally:
        spark.sql(f"DROP TABLE IF EXISTS {name}")


class Answers(Recorder):
    """Answers every question with two rows made of its parameters."""

    def execute(self, statement, params):
        self._log([statement, params])
        self.rows = [(params[0] * 10, "x"), (params[0] * 10 + 1, None)] if params[0] != 2 else []

    def fetchmany(self, n):
        out, self.rows = self.rows[:n], self.rows[n:]
        return out


def test_lookup_asks_once_per_row(spark, tmp_path):
    from rowloom.sources.jdbc import lookup_each_row

    rows = spark.createDataFrame([(1, "a"), (2, "b"), (3, None)], "id long, w string")
    sql = "SELECT v, s FROM t WHERE w = :{w} AND id = :{id};"
    got = lookup_each_row(rows.select("id", "w"), partial(Answers, str(tmp_path)), "oracle", "SELECT v, s FROM t WHERE id = ? AND w = ?;", "v long, s string", fetch=1)
    assert sorted(map(tuple, got.collect())) == [(10, "x"), (11, None), (30, "x"), (31, None)]
    asked = [kind for kind, _ in recorded(tmp_path)]
    assert sorted(asked, key=str)[0] == ["SELECT v, s FROM t WHERE id = :1 AND w = :2", [1, "a"]]
    named = lookup_each_row(rows.selectExpr("w", "id"), partial(Answers, str(tmp_path)), "mysql", sql.replace("w = :{w} AND ", ""), "v long, s string")
    assert named.count() == 4


def test_literals_for_jdbc_queries():
    from datetime import datetime

    from rowloom.sources.jdbc import bound_sql, literal

    at = datetime(2026, 1, 2, 3, 4, 5)
    assert literal(at, "oracle") == "TIMESTAMP '2026-01-02 03:04:05'"
    assert literal(at, "sqlserver") == "'2026-01-02T03:04:05'"
    assert literal("it's \\", "mysql") == "'it''s \\\\'" and literal("it's \\", "oracle") == "'it''s \\'"
    assert (literal(None, "sqlite"), literal(True, "sqlite"), literal(2.5, "sqlite")) == ("NULL", "1", "2.5")
    sql = "SELECT '?', ':{a}' FROM t WHERE a > :{a} AND b = :{b}"
    assert bound_sql(sql, {"a": 1, "b": "x"}, "oracle") == "SELECT '?', ':{a}' FROM t WHERE a > 1 AND b = 'x'"
    assert bound_sql("SELECT '?' FROM t WHERE a = ? AND b = ?", [1, "y'"], "oracle") == "SELECT '?' FROM t WHERE a = 1 AND b = 'y'''"
    assert read_options(PG, sql="SELECT * FROM t WHERE a = :{a};", params={"a": 7})["dbtable"] == "(SELECT * FROM t WHERE a = 7) q"
    assert bound_sql("SELECT 1", None, "oracle") == "SELECT 1"


class Telling(Recorder):
    """A connection whose driver tells how many rows a batch has changed."""

    def executemany(self, statement, rows):
        super().executemany(statement, rows)
        self.rowcount = sum(row[0] is not None for row in rows)


@pytest.mark.parametrize("kind, affected", [(Recorder, None), (Telling, 2)])
def test_external_writes_are_counted(spark, tmp_path, kind, affected):
    counted = external.Sent(spark)
    assert counted.counts() is None
    external.upsert_external(items(spark), partial(kind, str(tmp_path)), "sqlite", "t", "id", order_by="step", commit_size=1, sent=counted)
    assert counted.counts() == {"sent": 3, "affected": affected}

    items(spark).createOrReplaceTempView("ext_items")
    space = JdbcSpace(spark, PG, partial(kind, str(tmp_path)))
    settings = {"ConnectionId": "pg", "TableName": "t", "KeyFields": "id"}
    flow = {
        "Steps": [
            {"Id": "r", "StepType": "DBInput", "Settings": {"SQL": "SELECT * FROM ext_items"}},
            {"Id": "d", "StepType": "DBDelete", "Settings": settings},
        ],
        "Connections": [{"SourceStepId": "r", "TargetStepId": "d"}],
    }
    built = build(flow, Context(spark, {"pg": space}))
    assert built.write_counts() == {}
    built.run()
    assert built.write_counts() == {"d": {"sent": 2, "affected": affected}}
