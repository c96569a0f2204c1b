"""Filters and switches."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.route import (
    FAIL,
    branch_counts,
    filter_rows,
    filter_split,
    filter_tag,
    switch,
    switch_tag,
)
from rowloom.queries.registry import query

CASES = "BUILDING|build|Building\nMACHINERY|mach\nFURNITURE|build\nBUILDING|late\nAUTOMOBILE"


@query("filter_eq_ci", "SELECT c_custkey, c_mktsegment FROM customer WHERE lower(c_mktsegment) = 'building'")
def filter_eq_ci(t):
    return filter_rows(t.customer, "c_mktsegment", "equals", "Building").select("c_custkey", "c_mktsegment")


@query("filter_ne", "SELECT o_orderkey, o_orderstatus FROM orders WHERE lower(o_orderstatus) <> 'f'")
def filter_ne(t):
    return filter_rows(t.orders, "o_orderstatus", "notEquals", "f").select("o_orderkey", "o_orderstatus")


@query("filter_contains", "SELECT p_partkey, p_name FROM part WHERE contains(lower(p_name), 'ring')")
def filter_contains(t):
    return filter_rows(t.part, "p_name", "contains", "RING").select("p_partkey", "p_name")


@query(
    "filter_num_gt",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM lineitem WHERE l_quantity > 45",
)
def filter_num_gt(t):
    rows = filter_rows(t.lineitem, "l_quantity", "greaterThan", "45")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_quantity")


@query(
    "filter_num_range",
    """SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_quantity FROM lineitem
       WHERE l_discount >= 0.05 AND l_discount <= 0.07 AND l_quantity < 24""",
)
def filter_num_range(t):
    rows = filter_rows(t.lineitem, "l_discount", "greaterOrEqual", "0.05")
    rows = filter_rows(rows, "l_discount", "lessOrEqual", "0.07")
    rows = filter_rows(rows, "l_quantity", "lessThan", "24")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_quantity")


@query(
    "filter_num_eq",
    "SELECT p_partkey, p_size FROM part WHERE p_size = 10",
)
def filter_num_eq(t):
    return filter_rows(t.part, "p_size", "equals", "10").select("p_partkey", "p_size")


@query(
    "filter_text_number",
    """SELECT event_id, k FROM (SELECT event_id, regexp_extract(props, '[0-9]+', 0) AS k FROM events)
       WHERE CAST(k AS DOUBLE) > 50""",
)
def filter_text_number(t):
    """Texts that are numbers compare as numbers, so '7' is not above '50'."""
    rows = t.events.select("event_id", F.regexp_extract("props", "[0-9]+", 0).alias("k"))
    return filter_rows(rows, "k", "greaterThan", "50")


@query("filter_text_order", "SELECT c_custkey, c_name FROM customer WHERE c_name > 'Customer#000000500'")
def filter_text_order(t):
    return filter_rows(t.customer, "c_name", "greaterThan", "Customer#000000500").select("c_custkey", "c_name")


@query(
    "filter_date_range",
    """SELECT o_orderkey, o_orderdate FROM orders
       WHERE o_orderdate >= TIMESTAMP '1996-01-01' AND o_orderdate < TIMESTAMP '1997-01-01 12:00:00'""",
)
def filter_date_range(t):
    rows = filter_rows(t.orders, "o_orderdate", "greaterOrEqual", "1996/01/01")
    return filter_rows(rows, "o_orderdate", "lessThan", "1997-01-01 12:00:00").select("o_orderkey", "o_orderdate")


@query(
    "filter_date_text",
    """SELECT o_orderkey, strftime(o_orderdate, '%Y/%m/%d') AS d FROM orders
       WHERE o_orderdate < TIMESTAMP '1997-06-01'""",
)
def filter_date_text(t):
    """Texts that are dates compare as dates, whatever their separator."""
    rows = t.orders.select("o_orderkey", F.date_format("o_orderdate", "yyyy/MM/dd").alias("d"))
    return filter_rows(rows, "d", "lessThan", "1997-6-1")


@query(
    "filter_field_field",
    "SELECT l_orderkey, l_linenumber, l_partkey, l_discount, l_tax FROM lineitem WHERE l_discount > l_tax",
)
def filter_field_field(t):
    rows = filter_rows(t.lineitem, "l_discount", "greaterThan", right="l_tax")
    return rows.select("l_orderkey", "l_linenumber", "l_partkey", "l_discount", "l_tax")


def _with_nulls(t):
    return t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("5-LOW")).alias("p"))


@query(
    "filter_null",
    "SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NULL",
)
def filter_null(t):
    return filter_rows(_with_nulls(t), "p", "isNull")


@query(
    "filter_not_null",
    "SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders WHERE NULLIF(o_orderpriority, '5-LOW') IS NOT NULL",
)
def filter_not_null(t):
    return filter_rows(_with_nulls(t), "p", "isNotNull")


@query(
    "filter_fail_port",
    """SELECT o_orderkey, NULLIF(o_orderpriority, '5-LOW') AS p FROM orders
       WHERE NOT coalesce(lower(NULLIF(o_orderpriority, '5-LOW')) <> '2-high', false)""",
)
def filter_fail_port(t):
    """NULL passes no comparison, so it leaves by the fail port."""
    return filter_split(_with_nulls(t), "p", "notEquals", "2-HIGH")[FAIL]


@query(
    "filter_split_counts",
    """SELECT CASE WHEN contains(event_type, 'c') THEN 'pass' ELSE 'fail' END AS branch, count(*) AS n
       FROM events GROUP BY 1""",
)
def filter_split_counts(t):
    return branch_counts(filter_tag(t.events, "event_type", "contains", "C"))


BRANCH = """CASE WHEN c_mktsegment = 'BUILDING' THEN 'build' WHEN c_mktsegment = 'MACHINERY' THEN 'mach'
            WHEN c_mktsegment = 'FURNITURE' THEN 'build' WHEN c_mktsegment = 'AUTOMOBILE' THEN 'AUTOMOBILE' """


@query("switch_route", f"SELECT c_custkey, {BRANCH} ELSE 'default' END AS branch FROM customer")
def switch_route(t):
    return switch_tag(t.customer, "c_mktsegment", CASES).select("c_custkey", "branch")


@query("switch_port", "SELECT c_custkey, c_mktsegment FROM customer WHERE c_mktsegment IN ('BUILDING', 'FURNITURE')")
def switch_port(t):
    return switch(t.customer, "c_mktsegment", CASES)["build"].select("c_custkey", "c_mktsegment")


@query("switch_counts", f"SELECT {BRANCH} ELSE 'default' END AS branch, count(*) AS n FROM customer GROUP BY 1")
def switch_counts(t):
    return branch_counts(switch_tag(t.customer, "c_mktsegment", CASES))


@query(
    "switch_no_default",
    f"SELECT c_custkey, branch FROM (SELECT c_custkey, {BRANCH} END AS branch FROM customer) WHERE branch IS NOT NULL",
)
def switch_no_default(t):
    return switch_tag(t.customer, "c_mktsegment", CASES, include_default=False).select("c_custkey", "branch")
