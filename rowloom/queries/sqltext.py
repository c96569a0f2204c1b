"""SQL steps with parameters, and the SQL patterns that flows send to them."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.merge import matching_rows
from rowloom.queries.registry import plain, query
from rowloom.sources.sqlstep import preview, sql_each_row, sql_input

BOUNDS = """SELECT date_format(max(o_orderdate) - INTERVAL '200' DAY, 'yyyy/MM/dd') AS start_date,
                   date_format(max(o_orderdate), 'yyyy/MM/dd') AS end_date, 'O' AS status FROM {orders}"""


@query(
    "sql_plain",
    "SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total FROM orders GROUP BY 1",
)
def sql_plain(t):
    t.views("orders")
    return sql_input(
        t.spark,
        """SELECT o_orderstatus, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
           FROM orders GROUP BY o_orderstatus;""",
    )


@query(
    "sql_named",
    """SELECT o_orderkey, o_orderdate FROM orders, (SELECT date_trunc('day', max(o_orderdate)) AS hi FROM orders)
       WHERE o_orderstatus = 'O' AND o_orderdate > date_trunc('day', hi - INTERVAL 200 DAY) AND o_orderdate <= hi""",
)
def sql_named(t):
    t.views("orders")
    return sql_input(
        t.spark,
        """SELECT o_orderkey, o_orderdate FROM orders WHERE o_orderstatus = :{status}
           AND o_orderdate > to_timestamp(:{start_date}, 'yyyy/MM/dd')
           AND o_orderdate <= to_timestamp(:{end_date}, 'yyyy/MM/dd')""",
        t.sql(BOUNDS),
    )


@query(
    "sql_positional",
    """SELECT c_custkey, c_mktsegment, '?' AS mark FROM customer
       WHERE c_acctbal > (SELECT avg(c_acctbal) FROM customer) AND c_mktsegment = (SELECT max(c_mktsegment) FROM customer)""",
)
def sql_positional(t):
    """A question mark inside a literal stays as it is."""
    t.views("customer")
    row = t.customer.agg(F.avg("c_acctbal").alias("a"), F.max("c_mktsegment").alias("m"))
    text = "SELECT c_custkey, c_mktsegment, '?' AS mark FROM customer WHERE c_acctbal > ? AND c_mktsegment = ?"
    return sql_input(t.spark, text, row)


@query(
    "sql_each_row",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM orders JOIN lineitem ON l_orderkey = o_orderkey
       WHERE o_orderpriority = '1-URGENT' AND l_quantity > 30""",
)
def sql_each_row_query(t):
    t.views("lineitem")
    rows = t.orders.where("o_orderpriority = '1-URGENT'").select("o_orderkey")
    text = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_orderkey = :{o_orderkey} AND l_quantity > 30"
    return sql_each_row(t.spark, text, rows)


@query(
    "sql_each_row_twice",
    "SELECT n_name, r_name FROM supplier JOIN nation ON n_nationkey = s_nationkey JOIN region ON r_regionkey = n_regionkey",
)
def sql_each_row_twice(t):
    """Input rows that repeat repeat their result; ``?`` binds by column order."""
    t.views("nation", "region")
    text = "SELECT n_name, r_name FROM nation, region WHERE r_regionkey = n_regionkey AND n_nationkey = ?"
    return sql_each_row(t.spark, text, t.supplier.select("s_nationkey", "s_suppkey"))


@query(
    "sql_each_row_literal",
    "SELECT n_name, '?' AS mark, ':{s_nationkey}' AS note FROM supplier JOIN nation ON n_nationkey = s_nationkey",
)
def sql_each_row_literal(t):
    """What looks like a parameter inside a literal, once per row."""
    t.views("nation")
    text = "SELECT n_name, '?' AS mark, ':{s_nationkey}' AS note FROM nation WHERE n_nationkey = ? -- why?\n"
    return sql_each_row(t.spark, text, t.supplier.select("s_nationkey", "s_suppkey"))


@query(
    "sql_named_literal",
    "SELECT c_custkey, ':{top}' AS mark, '?' AS more FROM customer WHERE c_nationkey = (SELECT max(n_nationkey) FROM nation)",
)
def sql_named_literal(t):
    t.views("customer")
    row = t.nation.agg(F.max("n_nationkey").alias("top"))
    text = "SELECT c_custkey, ':{top}' AS mark, \"?\" AS more FROM customer /* :{none} */ WHERE c_nationkey = :{top}"
    return sql_input(t.spark, text, row)


# --- patterns ---------------------------------------------------------------


@query("distinct_keys", "SELECT DISTINCT l_suppkey, l_returnflag, l_linestatus FROM lineitem")
def distinct_keys(t):
    return t.lineitem.select("l_suppkey", "l_returnflag", "l_linestatus").distinct()


@query("distinct_by_group", "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey, l_returnflag")
def distinct_by_group(t):
    t.views("lineitem")
    return sql_input(
        t.spark, "SELECT l_partkey, l_returnflag FROM lineitem WHERE l_quantity > 25 GROUP BY l_partkey, l_returnflag"
    )


SUMS = """SELECT l_suppkey, l_partkey, l_returnflag, l_linestatus, l_linenumber, year(l_shipdate) AS y,
                 CAST(sum(CAST(l_quantity AS DECIMAL(18, 2))) AS DOUBLE) AS qty, count(*) AS n
          FROM {lineitem} GROUP BY l_suppkey, l_partkey, l_returnflag, l_linestatus, l_linenumber, year(l_shipdate)"""


@query("group_sum_count", plain(SUMS))
def group_sum_count(t):
    return t.sql(SUMS).withColumn("y", F.col("y").cast("bigint"))


SEMI = """SELECT a.o_orderkey, a.o_custkey FROM {orders} a,
            (SELECT o_custkey FROM {orders} WHERE o_orderdate > TIMESTAMP '2000-06-01' AND o_orderstatus = 'F' GROUP BY o_custkey) b
          WHERE a.o_custkey = b.o_custkey"""


@query("semi_recent", plain(SEMI))
def semi_recent(t):
    """Rows whose key occurs in a filtered part of the table, as a semi-join."""
    recent = t.orders.where("o_orderdate > TIMESTAMP_NTZ '2000-06-01' AND o_orderstatus = 'F'")
    return matching_rows(t.orders, recent, "o_custkey").select("o_orderkey", "o_custkey")


LEFT_AGG = """SELECT c_custkey, n, total FROM {customer} LEFT JOIN (
                SELECT o_custkey, count(*) AS n, CAST(sum(CAST(o_totalprice AS DECIMAL(18, 2))) AS DOUBLE) AS total
                FROM {orders} WHERE o_orderstatus = 'P' GROUP BY o_custkey) e ON e.o_custkey = c_custkey"""


@query("left_agg", plain(LEFT_AGG))
def left_agg(t):
    return t.sql(LEFT_AGG)


@query(
    "case_decode",
    """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END AS big,
              CASE o_orderstatus WHEN 'O' THEN 'open' WHEN 'F' THEN 'done' ELSE o_orderpriority END AS word FROM orders""",
)
def case_decode(t):
    return t.sql(
        """SELECT o_orderkey, CASE WHEN o_orderstatus = 'O' AND o_totalprice > 100000 THEN 1 ELSE 0 END AS big,
                  decode(o_orderstatus, 'O', 'open', 'F', 'done', o_orderpriority) AS word FROM {orders}"""
    )


@query(
    "range_null_literals",
    """SELECT o_orderkey, 'H1' AS line_id FROM orders WHERE o_orderdate >= TIMESTAMP '1996-03-01'
       AND o_orderdate < TIMESTAMP '1998-03-01' AND NULLIF(o_orderstatus, 'P') IS NULL""",
)
def range_null_literals(t):
    t.views("orders")
    text = """SELECT o_orderkey, 'H1' AS line_id FROM orders WHERE o_orderdate >= TIMESTAMP_NTZ '1996-03-01'
              AND o_orderdate < TIMESTAMP_NTZ '1998-03-01' AND NULLIF(o_orderstatus, 'P') IS NULL"""
    return sql_input(t.spark, text)


@query("topk", "SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 100")
def topk(t):
    ordered = t.orders.orderBy(F.desc("o_totalprice"), "o_orderkey")
    return preview(ordered, 100).select("o_orderkey", "o_totalprice")


@query("order_rows", "SELECT c_custkey, c_name, c_acctbal FROM customer ORDER BY c_acctbal, c_custkey")
def order_rows(t):
    return t.customer.orderBy("c_acctbal", "c_custkey").select("c_custkey", "c_name", "c_acctbal")


@query(
    "date_texts",
    """SELECT event_id, strftime(ts, '%Y/%m/%d %H:%M:%S') AS txt,
              round(CAST(epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-01') AS DOUBLE) / 60000000.0::DOUBLE, 2) AS m FROM events""",
)
def date_texts(t):
    """Time to text, text to time, and a difference in minutes, in SQL."""
    return t.sql(
        """SELECT event_id, date_format(ts, 'yyyy/MM/dd HH:mm:ss') AS txt,
                  round((unix_micros(CAST(ts AS TIMESTAMP)) - unix_micros(to_timestamp('2024/01/01', 'yyyy/MM/dd'))) / 60000000D, 2) AS m
           FROM {events}"""
    )
