"""Joins and unions."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.join import merge_join, merge_join_inputs, union_inputs
from rowloom.operators.project import select_values
from rowloom.operators.ranges import range_join
from rowloom.queries.registry import query

ORDER_SIDE = "SELECT o_custkey AS id, o_orderkey, o_totalprice AS amount FROM orders"
CUSTOMER_SIDE = "SELECT c_custkey AS id, c_name, c_acctbal AS amount FROM customer"


def _orders(t):
    return select_values(t.orders, "o_custkey|id\no_orderkey\no_totalprice|amount")


def _customers(t):
    return select_values(t.customer, "c_custkey|id\nc_name\nc_acctbal|amount")


@query(
    "join_inner",
    f"SELECT r.id, o_orderkey, r.amount, c_name FROM ({ORDER_SIDE}) l JOIN ({CUSTOMER_SIDE}) r ON l.id = r.id",
)
def join_inner(t):
    return merge_join(_orders(t), _customers(t), "id")


RICH = "c_acctbal > 5000"


@query(
    "join_left",
    f"""SELECT l.id, o_orderkey, CASE WHEN r.id IS NOT NULL THEN r.amount ELSE l.amount END AS amount, c_name
        FROM ({ORDER_SIDE}) l LEFT JOIN ({CUSTOMER_SIDE} WHERE {RICH}) r ON l.id = r.id""",
)
def join_left(t):
    """The right row overwrites shared columns, but only where there is one."""
    return merge_join(_orders(t), _customers(t).where("amount > 5000"), "id", "LEFT OUTER")


@query(
    "join_right",
    f"""SELECT r.id, o_orderkey, r.amount, c_name FROM ({ORDER_SIDE} WHERE o_totalprice > 300000) l
        RIGHT JOIN ({CUSTOMER_SIDE}) r ON l.id = r.id""",
)
def join_right(t):
    return merge_join(_orders(t).where("amount > 300000"), _customers(t), "id", "RIGHT OUTER")


@query(
    "join_full",
    f"""SELECT coalesce(r.id, l.id) AS id, o_orderkey,
               CASE WHEN r.id IS NOT NULL THEN r.amount ELSE l.amount END AS amount, c_name
        FROM ({ORDER_SIDE} WHERE o_totalprice > 200000) l
        FULL JOIN ({CUSTOMER_SIDE} WHERE {RICH}) r ON l.id = r.id""",
)
def join_full(t):
    left = _orders(t).where("amount > 200000")
    return merge_join(left, _customers(t).where("amount > 5000"), "id", "FULL OUTER")


@query(
    "join_null_text_keys",
    """SELECT l.o_orderkey, r.p AS p, r.word FROM
         (SELECT o_orderkey, NULLIF(o_orderpriority, '1-URGENT') AS p FROM orders) l
         JOIN (SELECT DISTINCT CASE WHEN o_orderpriority = '1-URGENT' THEN '' ELSE o_orderpriority END AS p,
                      lower(o_orderpriority) AS word FROM orders) r
         ON coalesce(l.p, '') = r.p""",
)
def join_null_text_keys(t):
    """A NULL text key matches an empty one."""
    left = t.orders.select("o_orderkey", F.nullif("o_orderpriority", F.lit("1-URGENT")).alias("p"))
    name = F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_orderpriority"))
    right = t.orders.select(name.alias("p"), F.lower("o_orderpriority").alias("word")).distinct()
    return merge_join(left, right, "p")


@query(
    "join_null_number_keys",
    """SELECT l.o_orderkey, r.k, r.n FROM (SELECT o_orderkey, NULLIF(o_custkey, 7) AS k FROM orders) l
       JOIN (SELECT NULLIF(c_custkey, 7) AS k, c_name AS n FROM customer) r ON l.k IS NOT DISTINCT FROM r.k""",
)
def join_null_number_keys(t):
    left = t.orders.select("o_orderkey", F.nullif("o_custkey", F.lit(7)).alias("k"))
    right = t.customer.select(F.nullif("c_custkey", F.lit(7)).alias("k"), F.col("c_name").alias("n"))
    return merge_join(left, right, "k")


@query(
    "join_mixed_keys",
    "SELECT c_custkey, n_name, CAST(n_nationkey AS DOUBLE) AS k FROM customer JOIN nation ON c_nationkey = n_nationkey",
)
def join_mixed_keys(t):
    """An integer key meets a floating one as a number."""
    left = select_values(t.customer, "c_custkey\nc_nationkey|k")
    return merge_join(left, select_values(t.nation, "n_nationkey|k|double\nn_name"), "k")


@query(
    "join_overwrite_null",
    """SELECT l.o_orderkey, l.id, CASE WHEN r.id IS NOT NULL THEN r.note ELSE l.note END AS note
       FROM (SELECT o_orderkey, o_custkey AS id, o_orderpriority AS note FROM orders) l
       LEFT JOIN (SELECT c_custkey AS id, NULLIF(c_mktsegment, 'BUILDING') AS note FROM customer WHERE c_acctbal > 0) r
       ON l.id = r.id""",
)
def join_overwrite_null(t):
    """A NULL of the right row overwrites the left value."""
    left = select_values(t.orders, "o_orderkey\no_custkey|id\no_orderpriority|note")
    right = t.customer.where("c_acctbal > 0").select(
        F.col("c_custkey").alias("id"), F.nullif("c_mktsegment", F.lit("BUILDING")).alias("note")
    )
    return merge_join(left, right, "id", "LEFT OUTER")


@query("join_cross", "SELECT s_suppkey, s_name, r_regionkey, r_name FROM supplier, region")
def join_cross(t):
    """No keys: the product, here with a right side of five fixed rows."""
    left = select_values(t.supplier, "s_suppkey\ns_name")
    return merge_join_inputs([left, t.region], "")


@query(
    "union_inputs",
    """SELECT c_custkey AS id, c_name AS name, c_acctbal AS bal, c_mktsegment AS seg, NULL::VARCHAR AS code FROM customer
       UNION ALL SELECT s_suppkey, s_name, s_acctbal, NULL, NULL FROM supplier
       UNION ALL SELECT p_partkey, p_name, p_retailprice, NULL, CAST(p_size AS VARCHAR) FROM part""",
)
def union_query(t):
    """By name; absent columns are NULL."""
    a = select_values(t.customer, "c_custkey|id\nc_name|name\nc_acctbal|bal\nc_mktsegment|seg")
    b = select_values(t.supplier, "s_acctbal|bal\ns_name|name\ns_suppkey|id")
    c = select_values(t.part, "p_partkey|id\np_name|name\np_retailprice|bal\np_size|code|string")
    return union_inputs([a, b, c])


@query(
    "union_widened",
    """SELECT CAST(n_nationkey AS BIGINT) AS k, n_name AS v FROM nation
       UNION ALL SELECT c_custkey, CAST(c_nationkey AS VARCHAR) FROM customer""",
)
def union_widened(t):
    """Integers widen; a number beside a text becomes text."""
    return union_inputs(
        [select_values(t.nation, "n_nationkey|k\nn_name|v"), select_values(t.customer, "c_custkey|k\nc_nationkey|v")]
    )


@query(
    "range_lookup",
    """SELECT c_custkey, c_nationkey, c_acctbal, s_suppkey FROM customer
       LEFT JOIN supplier ON s_nationkey = c_nationkey AND c_acctbal BETWEEN s_acctbal - 100 AND s_acctbal + 100""",
)
def range_lookup(t):
    """Suppliers of the customer's nation whose balance is about the same; customers
    without one stay."""
    ranges = t.supplier.selectExpr("s_nationkey AS c_nationkey", "s_suppkey", "s_acctbal - 100 AS low", "s_acctbal + 100 AS high")
    customers = t.customer.select("c_custkey", "c_nationkey", "c_acctbal")
    return range_join(customers, ranges, "c_acctbal", "low", "high", "c_nationkey", "LEFT OUTER").drop("low", "high")


@query(
    "range_lookup_events",
    """SELECT e.event_id, f.event_id AS error_id FROM events e
       JOIN events f ON f.event_type = 'error' AND e.user_id = f.user_id AND e.ts > f.ts AND e.ts <= f.ts + INTERVAL 6 HOUR""",
)
def range_lookup_events(t):
    """What a user did within six hours after each error."""
    after = t.events.where("event_type = 'error'").selectExpr("user_id", "event_id AS error_id", "ts AS since", "ts + INTERVAL 6 HOURS AS until")
    events = t.events.select("event_id", "user_id", "ts")
    return range_join(events, after, "ts", "since", "until", "user_id", low_open=True).select("event_id", "error_id")


@query(
    "range_lookup_below",
    """SELECT c_custkey, s_nationkey FROM customer
       JOIN (SELECT s_nationkey, min(s_acctbal) AS low, max(s_acctbal) AS high FROM supplier GROUP BY 1) s
       ON c_nationkey = s_nationkey AND c_acctbal < (CASE WHEN s_nationkey % 2 = 0 THEN low ELSE high END)""",
)
def range_lookup_below(t):
    """Customers below a bound of their nation: ranges without a start."""
    bounds = t.sql(
        """SELECT s_nationkey AS nation, s_nationkey, cast(NULL AS double) AS low,
                  CASE WHEN s_nationkey % 2 = 0 THEN min(s_acctbal) ELSE max(s_acctbal) END AS high
           FROM {supplier} GROUP BY s_nationkey"""
    )
    customers = t.customer.selectExpr("c_custkey", "c_nationkey AS nation", "c_acctbal")
    return range_join(customers, bounds, "c_acctbal", "low", "high", "nation", high_open=True).select("c_custkey", "s_nationkey")
