import pytest

from conftest import rows
from rowloom.sources import sqlstep

USERS = [(1, "Alice", "active"), (2, "Bob", "active"), (3, "Carol", "inactive"), (4, "Dave", None)]


@pytest.fixture()
def users(spark):
    df = spark.createDataFrame(USERS, "id long, name string, status string")
    df.createOrReplaceTempView("users")
    return df


def test_plain(spark, users):
    assert sqlstep.sql_input(spark, "SELECT * FROM users; ").count() == 4


def test_named_uses_first_row(spark, users):
    params = spark.createDataFrame([("active", 2), ("inactive", 9)], "st string, lim int").coalesce(1)
    out = sqlstep.sql_input(spark, "SELECT name FROM users WHERE status = :{st} AND id < :{lim}", params)
    assert rows(out) == [("Alice",)]


def test_positional(spark, users):
    sql = "SELECT name, 'why?' AS w FROM users WHERE status = ? AND id < ?"
    assert rows(sqlstep.sql_input(spark, sql, ["active", 2])) == [("Alice", "why?")]


def test_named_wins_over_positional(spark, users):
    out = sqlstep.sql_input(spark, "SELECT name, '?' AS q FROM users WHERE id = :{i}", {"i": 2})
    assert rows(out) == [("Bob", "?")]


def test_values_are_bound_not_pasted(spark, users):
    assert sqlstep.sql_input(spark, "SELECT * FROM users WHERE name = :{n}", {"n": "x' OR '1'='1"}).count() == 0


def test_each_row(spark, users):
    ids = spark.createDataFrame([(1,), (3,), (3,), (77,)], "userId long")
    out = sqlstep.sql_each_row(spark, "SELECT name FROM users WHERE id = :{userId};", ids)
    assert out.columns == ["name"]
    assert rows(out) == [("Alice",), ("Carol",), ("Carol",)]
    out = sqlstep.sql_each_row(spark, "SELECT name FROM users WHERE id = ? AND status = ?", ids.selectExpr("userId", "'active' AS s"))
    assert rows(out) == [("Alice",)]
    plan = sqlstep.sql_each_row(spark, "SELECT name FROM users WHERE id = ?", ids)._jdf.queryExecution().optimizedPlan().toString()
    assert "Join Inner" in plan and "Lateral" not in plan


def test_empty_parameter_rows(spark, users):
    none = spark.createDataFrame([], "a int")
    with pytest.raises(ValueError, match="no row"):
        sqlstep.sql_input(spark, "SELECT * FROM users WHERE id = :{a}", none)
    with pytest.raises(ValueError, match="no row"):
        sqlstep.sql_each_row(spark, "SELECT * FROM users WHERE id = ?", none)


def test_discovery(spark, users):
    assert "users" in sqlstep.list_tables(spark)
    assert sqlstep.list_columns(spark, "users") == ["id", "name", "status"]
    assert sqlstep.sql_columns(spark, "SELECT id + 1 AS n, name FROM users") == [("n", "bigint"), ("name", "string")]
    assert sqlstep.preview(users, 2).count() == 2


def test_exec_passes_rows_on(spark, users):
    assert sqlstep.exec_sql(spark, "CREATE OR REPLACE TEMP VIEW v1 AS SELECT 1 AS one;", users) is users
    assert rows(spark.table("v1")) == [(1,)]
