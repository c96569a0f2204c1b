"""Keyed changes of the orders table."""

from __future__ import annotations

from rowloom.operators import merge
from rowloom.queries.registry import plain, query

COLUMNS = "o_orderkey, o_custkey, o_orderstatus, o_totalprice, o_orderdate, o_orderpriority"
# Known keys (twice, in two steps), new keys, and rows without a key.
CHANGES = """SELECT o_orderkey, 'X' AS o_orderstatus, o_totalprice + 1 AS o_totalprice, o_custkey, 1 AS step
               FROM {orders} WHERE o_orderstatus = 'P'
     UNION ALL SELECT o_orderkey, 'Y', o_totalprice + 2, o_custkey, 2 FROM {orders} WHERE o_orderpriority = '2-HIGH'
     UNION ALL SELECT o_orderkey + 1000000000, 'N', o_totalprice, o_custkey, 1 FROM {orders} WHERE o_orderpriority = '1-URGENT'
     UNION ALL SELECT o_orderkey + 1000000000, 'M', o_totalprice * 2, o_custkey, 3 FROM {orders}
               WHERE o_orderpriority = '1-URGENT' AND o_orderstatus = 'F'
     UNION ALL SELECT NULL, 'Z', o_totalprice, o_custkey, 1 FROM {orders} WHERE o_orderpriority = '5-LOW' AND o_orderstatus = 'F'"""
# Half a year of orders have lost their key.
TARGET = f"""SELECT CASE WHEN o_orderdate < TIMESTAMP '1995-07-01' THEN NULL ELSE o_orderkey END AS o_orderkey,
              {COLUMNS.split(', ', 1)[1]} FROM {{orders}}"""
LAST = "SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY o_orderkey ORDER BY step DESC) AS i FROM c) WHERE i = 1 AND o_orderkey IS NOT NULL"
WITH = plain(f"WITH c AS ({CHANGES}), t AS ({TARGET}), s AS ({LAST})")


def _change_set(t, *drop: str):
    return t.sql(CHANGES).drop(*drop)


UPSERT_ALL = f"""{WITH} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey,
    CASE WHEN s.step IS NOT NULL THEN s.o_custkey ELSE t.o_custkey END AS o_custkey,
    CASE WHEN s.step IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
    CASE WHEN s.step IS NOT NULL THEN s.o_totalprice ELSE t.o_totalprice END AS o_totalprice,
    t.o_orderdate, t.o_orderpriority
  FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey
  UNION ALL SELECT NULL, o_custkey, o_orderstatus, o_totalprice, NULL, NULL FROM c WHERE o_orderkey IS NULL"""


@query("upsert_keyed", UPSERT_ALL)
def upsert_keyed(t):
    fields = "o_custkey,o_orderstatus,o_totalprice"
    return merge.upsert(t.sql(TARGET), _change_set(t), "o_orderkey", fields, order_by="step")


@query("upsert_repeated_target", UPSERT_ALL)
def upsert_repeated_target(t):
    """The plan for targets whose keys may repeat."""
    fields = "o_custkey,o_orderstatus,o_totalprice"
    return merge.upsert(t.sql(TARGET), _change_set(t), "o_orderkey", fields, order_by="step", target_unique=False)


@query(
    "upsert_fields",
    f"""{WITH} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_custkey,
          CASE WHEN s.step IS NOT NULL THEN s.o_orderstatus ELSE t.o_orderstatus END AS o_orderstatus,
          t.o_totalprice, t.o_orderdate, t.o_orderpriority
        FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey
        UNION ALL SELECT NULL, NULL, o_orderstatus, NULL, NULL, NULL FROM c WHERE o_orderkey IS NULL""",
)
def upsert_fields(t):
    """Only the named fields are written, also in inserted rows."""
    return merge.upsert(t.sql(TARGET), _change_set(t), "o_orderkey", "o_orderstatus,unknown", order_by="step")


@query(
    "upsert_insert_only",
    f"""{WITH} SELECT coalesce(t.o_orderkey, s.o_orderkey) AS o_orderkey, t.o_custkey, t.o_orderstatus, t.o_totalprice,
               t.o_orderdate, t.o_orderpriority FROM t FULL JOIN s ON t.o_orderkey = s.o_orderkey
        UNION ALL SELECT NULL, NULL, NULL, NULL, NULL, NULL FROM c WHERE o_orderkey IS NULL""",
)
def upsert_insert_only(t):
    """No field to update: unknown keys are inserted, known rows stay."""
    return merge.upsert(t.sql(TARGET), _change_set(t), "o_orderkey", "unknown", order_by="step")


@query(
    "upsert_first_col",
    """SELECT coalesce(t.p_partkey, s.p_partkey) AS p_partkey, coalesce(s.p_name, t.p_name) AS p_name, t.p_brand, t.p_type, t.p_size,
              coalesce(s.p_retailprice, t.p_retailprice) AS p_retailprice
       FROM part t FULL JOIN (SELECT p_partkey * 2 AS p_partkey, upper(p_name) AS p_name, p_retailprice * 2 AS p_retailprice FROM part) s
       ON t.p_partkey = s.p_partkey""",
)
def upsert_first_col(t):
    changes = t.sql("SELECT p_partkey * 2 AS p_partkey, upper(p_name) AS p_name, p_retailprice * 2 AS p_retailprice FROM {part}")
    return merge.upsert_first_column(t.part, changes, assume_unique=True)


@query(
    "update_keyed",
    f"""{WITH} SELECT t.o_orderkey, t.o_custkey, coalesce(s.o_orderstatus, t.o_orderstatus) AS o_orderstatus,
          coalesce(s.o_totalprice, t.o_totalprice) AS o_totalprice, t.o_orderdate, t.o_orderpriority
        FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey""",
)
def update_keyed(t):
    return merge.update_matched(t.sql(TARGET), _change_set(t), "O_ORDERKEY", "o_orderstatus,O_TOTALPRICE", order_by="step")


@query(
    "update_absent_field",
    f"""{WITH} SELECT t.o_orderkey, t.o_custkey, t.o_orderstatus, t.o_totalprice, t.o_orderdate,
          CASE WHEN s.step IS NULL THEN t.o_orderpriority END AS o_orderpriority
        FROM t LEFT JOIN s ON t.o_orderkey = s.o_orderkey""",
)
def update_absent_field(t):
    """A named field the source lacks is set to NULL."""
    return merge.update_matched(t.sql(TARGET), _change_set(t), "o_orderkey", "o_orderpriority", order_by="step")


@query(
    "update_many_rows",
    """SELECT l_orderkey, l_partkey, l_linenumber, coalesce(o_orderstatus, l_linestatus) AS l_linestatus
       FROM lineitem LEFT JOIN (SELECT * FROM orders WHERE o_totalprice > 250000) ON l_orderkey = o_orderkey""",
)
def update_many_rows(t):
    """Every target row with the key is updated."""
    target = t.lineitem.select("l_orderkey", "l_partkey", "l_linenumber", "l_linestatus")
    source = t.orders.where("o_totalprice > 250000").selectExpr("o_orderkey AS l_orderkey", "o_orderstatus AS l_linestatus")
    return merge.update_matched(target, source, "l_orderkey", assume_unique=True)


@query(
    "delete_keyed",
    f"{WITH} SELECT * FROM t WHERE NOT EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)",
)
def delete_keyed(t):
    return merge.delete_by_key(t.sql(TARGET), _change_set(t), "o_orderkey")


@query(
    "insert_rows",
    f"SELECT {COLUMNS} FROM orders UNION ALL SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice, NULL, NULL FROM ({plain(CHANGES)})",
)
def insert_rows(t):
    return merge.insert_rows(t.orders, _change_set(t, "step"))


@query(
    "merge_counts",
    f"""{WITH}, j AS (SELECT s.*, t.o_orderkey AS k, t.o_orderstatus AS ts, t.o_totalprice AS tp
                      FROM s LEFT JOIN t ON t.o_orderkey = s.o_orderkey)
        SELECT (SELECT count(*) FROM c) AS processed,
               (SELECT count(*) FROM j WHERE k IS NULL) + (SELECT count(*) FROM c WHERE o_orderkey IS NULL) AS inserted,
               (SELECT count(*) FROM j WHERE k IS NOT NULL AND (ts <> o_orderstatus OR tp <> o_totalprice)) AS updated,
               (SELECT count(*) FROM j WHERE k IS NOT NULL AND ts = o_orderstatus AND tp = o_totalprice) AS unchanged""",
)
def merge_counts(t):
    return merge.upsert_counts(t.sql(TARGET), _change_set(t), "o_orderkey", "o_orderstatus,o_totalprice", order_by="step")


@query(
    "update_counts",
    f"""{WITH} SELECT (SELECT count(*) FROM c) AS processed,
          (SELECT count(*) FROM t WHERE EXISTS (SELECT 1 FROM s WHERE s.o_orderkey = t.o_orderkey)) AS updated,
          (SELECT count(*) FROM c WHERE NOT EXISTS (SELECT 1 FROM t WHERE t.o_orderkey = c.o_orderkey)) AS unmatched""",
)
def update_counts(t):
    return merge.update_counts(t.sql(TARGET), _change_set(t), "o_orderkey")
