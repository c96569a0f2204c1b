"""Table comparison: parts against an altered copy of parts."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.compare import compare_summary, right_duplicates, table_compare
from rowloom.operators.digests import digest_compare
from rowloom.queries.registry import plain, query

ALTERED = """SELECT p_partkey,
       CASE WHEN p_size = 20 THEN upper(p_name) WHEN p_size = 21 THEN ' ' || p_name || ' ' ELSE p_name END AS p_name,
       CASE WHEN p_size = 22 THEN NULL ELSE p_brand END AS p_brand,
       CASE WHEN p_size = 10 THEN p_retailprice + 1 ELSE p_retailprice END AS p_retailprice
     FROM {part} WHERE p_size <> 30
     UNION ALL SELECT p_partkey + 1000000000, p_name, p_brand, p_retailprice FROM {part} WHERE p_size = 40"""
BASE = "SELECT p_partkey, p_name, CASE WHEN p_size = 23 THEN NULL ELSE p_brand END AS p_brand, p_retailprice FROM {part}"


def _oracle(equal: str, statuses: str) -> str:
    """Full join of both sides; ``equal`` holds one condition per column."""
    return plain(
        f"""WITH l AS ({BASE}), r AS ({ALTERED}), j AS (
          SELECT coalesce(l.p_partkey, r.p_partkey) AS p_partkey,
                 l.p_name AS p_name_L, r.p_name AS p_name_R, l.p_brand AS p_brand_L, r.p_brand AS p_brand_R,
                 l.p_retailprice AS p_retailprice_L, r.p_retailprice AS p_retailprice_R,
                 l.p_partkey IS NULL AS no_l, r.p_partkey IS NULL AS no_r, {equal}
          FROM l FULL JOIN r ON l.p_partkey = r.p_partkey),
        k AS (SELECT *, CASE WHEN no_l OR no_r THEN '' ELSE
                 concat_ws(',', CASE WHEN NOT e1 THEN 'p_name' END, CASE WHEN NOT e2 THEN 'p_brand' END,
                           CASE WHEN NOT e3 THEN 'p_retailprice' END) END AS _diff_columns FROM j),
        s AS (SELECT *, CASE WHEN no_r THEN 'ONLY_LEFT' WHEN no_l THEN 'ONLY_RIGHT'
                             WHEN _diff_columns = '' THEN 'MATCH' ELSE 'DIFF' END AS _status FROM k)
        {statuses}"""
    )


EXACT = """coalesce(l.p_name = r.p_name, false) AS e1, l.p_brand IS NOT DISTINCT FROM r.p_brand AS e2,
           coalesce(l.p_retailprice = r.p_retailprice, false) AS e3"""
LOOSE = EXACT.replace("l.p_name = r.p_name", "lower(trim(l.p_name)) = lower(trim(r.p_name))")
STRICT_NULLS = EXACT.replace("l.p_brand IS NOT DISTINCT FROM r.p_brand", "coalesce(l.p_brand = r.p_brand, false)")
COLUMNS = """p_partkey, p_name_L, p_name_R, p_brand_L, p_brand_R, p_retailprice_L, p_retailprice_R, _status, _diff_columns"""
ALL = f"SELECT {COLUMNS} FROM s"
SHOWN = f"{ALL} WHERE _status <> 'MATCH'"


def _sides(t):
    return t.sql(BASE), t.sql(ALTERED)


@query("compare_diff", _oracle(EXACT, SHOWN))
def compare_diff(t):
    return table_compare(*_sides(t), "p_partkey", assume_unique=True)


@query("compare_both_unique", _oracle(EXACT, ALL))
def compare_both_unique(t):
    """Keys repeat on neither side: one full outer join."""
    return table_compare(*_sides(t), "p_partkey", assume_unique=True, include_matched=True)


@query("compare_all", _oracle(EXACT, ALL))
def compare_all(t):
    return table_compare(*_sides(t), "p_partkey", order_by="p_retailprice,p_name", include_matched=True)


@query("compare_summary", _oracle(EXACT, "SELECT _status, count(*) AS n FROM s GROUP BY 1"))
def compare_summary_query(t):
    return compare_summary(*_sides(t), "p_partkey", assume_unique=True)


@query("compare_ci_trim", _oracle(LOOSE, SHOWN))
def compare_ci_trim(t):
    return table_compare(*_sides(t), "p_partkey", assume_unique=True, ignore_case=True, trim=True)


@query("compare_nulls_differ", _oracle(STRICT_NULLS, SHOWN))
def compare_nulls_differ(t):
    return table_compare(*_sides(t), "p_partkey", assume_unique=True, nulls_equal=False)


@query(
    "compare_number_text",
    """SELECT p_partkey, p_size AS p_size_L, p_size || CASE WHEN p_size > 25 THEN '.00' ELSE 'x' END AS p_size_R,
              CASE WHEN p_size > 25 THEN 'MATCH' ELSE 'DIFF' END AS _status,
              CASE WHEN p_size > 25 THEN '' ELSE 'p_size' END AS _diff_columns FROM part""",
)
def compare_number_text(t):
    """A number equals a text that reads as the same number."""
    tail = F.when(F.col("p_size") > 25, F.lit(".00")).otherwise(F.lit("x"))
    right = t.part.select("p_partkey", F.concat(F.col("p_size").cast("string"), tail).alias("p_size"))
    left = t.part.select("p_partkey", "p_size")
    return table_compare(left, right, "p_partkey", "p_size", assume_unique=True, include_matched=True)


SOLD = "SELECT l_orderkey, l_linenumber, l_partkey, l_quantity FROM {lineitem}"


@query(
    "compare_dups",
    """WITH r AS (SELECT l_orderkey, l_quantity, row_number() OVER (
                    PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_extendedprice) AS i
                  FROM lineitem WHERE l_quantity > 10),
            f AS (SELECT l_orderkey, l_quantity FROM r WHERE i = 1),
            l AS (SELECT l_orderkey, l_quantity FROM lineitem WHERE l_quantity < 40)
       SELECT l.l_orderkey, l.l_quantity AS l_quantity_L, f.l_quantity AS l_quantity_R,
              CASE WHEN f.l_orderkey IS NULL THEN 'ONLY_LEFT' WHEN l.l_quantity = f.l_quantity THEN 'MATCH' ELSE 'DIFF' END AS _status,
              CASE WHEN f.l_orderkey IS NULL OR l.l_quantity = f.l_quantity THEN '' ELSE 'l_quantity' END AS _diff_columns
       FROM l LEFT JOIN f ON l.l_orderkey = f.l_orderkey
       UNION ALL SELECT f.l_orderkey, NULL, f.l_quantity, 'ONLY_RIGHT', '' FROM f
       WHERE NOT EXISTS (SELECT 1 FROM l WHERE l.l_orderkey = f.l_orderkey)""",
)
def compare_dups(t):
    """Repeated keys: every left row, and the first right row."""
    left = t.lineitem.where("l_quantity < 40").select("l_orderkey", "l_quantity")
    right = t.lineitem.where("l_quantity > 10")
    order = "l_shipdate,l_linenumber,l_partkey,l_suppkey,l_extendedprice"
    return table_compare(left, right, "l_orderkey", "l_quantity", order_by=order, include_matched=True)


@query(
    "compare_dup_count",
    "SELECT CAST(count(*) - count(DISTINCT l_orderkey) AS BIGINT) AS duplicates FROM lineitem",
)
def compare_dup_count(t):
    return right_duplicates(t.lineitem, "l_orderkey")


@query(
    "compare_long_decimal",
    """SELECT CAST(9007199254740993 + o_orderkey * 2 AS DECIMAL(38, 2)) AS k, o_orderkey AS "v_L",
              CAST(o_orderkey + o_orderkey % 2 AS DECIMAL(38, 0)) AS "v_R",
              CASE WHEN o_orderkey % 2 = 0 THEN 'MATCH' ELSE 'DIFF' END AS _status,
              CASE WHEN o_orderkey % 2 = 0 THEN '' ELSE 'v' END AS _diff_columns FROM orders""",
)
def compare_long_decimal(t):
    """Keys beyond what a double holds, integers against decimals."""
    left = t.sql("SELECT 9007199254740993 + o_orderkey * 2 AS k, o_orderkey AS v FROM {orders}")
    right = t.sql(
        """SELECT CAST(9007199254740993 + o_orderkey * 2 AS DECIMAL(38, 2)) AS k,
                  CAST(o_orderkey + o_orderkey % 2 AS DECIMAL(38, 0)) AS v FROM {orders}"""
    )
    return table_compare(left, right, "k", "v", assume_unique=True, include_matched=True)


CHANGED = """SELECT o_orderkey, o_custkey, o_orderstatus, CASE WHEN o_orderkey % 991 = 0 THEN o_totalprice + 1 ELSE o_totalprice END AS o_totalprice
     FROM {orders} WHERE o_orderkey % 997 <> 1
     UNION ALL SELECT -o_orderkey - 1, o_custkey, o_orderstatus, o_totalprice FROM {orders} WHERE o_orderkey % 983 = 0"""


@query(
    "compare_digest",
    plain(f"""WITH l AS (SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders), r AS ({CHANGED})
       SELECT coalesce(l.o_orderkey, r.o_orderkey) AS o_orderkey, l.o_custkey AS "o_custkey_L", r.o_custkey AS "o_custkey_R",
              l.o_orderstatus AS "o_orderstatus_L", r.o_orderstatus AS "o_orderstatus_R", l.o_totalprice AS "o_totalprice_L", r.o_totalprice AS "o_totalprice_R",
              CASE WHEN r.o_orderkey IS NULL THEN 'ONLY_LEFT' WHEN l.o_orderkey IS NULL THEN 'ONLY_RIGHT' ELSE 'DIFF' END AS _status,
              CASE WHEN r.o_orderkey IS NULL OR l.o_orderkey IS NULL THEN '' ELSE 'o_totalprice' END AS _diff_columns
       FROM l FULL JOIN r ON l.o_orderkey = r.o_orderkey WHERE l.o_orderkey IS NULL OR r.o_orderkey IS NULL OR l.o_totalprice <> r.o_totalprice"""),
)
def compare_digest(t):
    """Nearly equal tables: only buckets with different digests are joined."""
    left = t.orders.select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice")
    return digest_compare(left, t.sql(CHANGED), "o_orderkey", assume_unique=True)
