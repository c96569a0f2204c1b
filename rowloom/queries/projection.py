"""Select, cast, calculate, date variables."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.functions.dates import variable_columns
from rowloom.operators.project import auto_mappings, calculate, pass_through, select_values
from rowloom.queries.registry import query

LINE = ["l_orderkey", "l_linenumber", "l_partkey"]
LINE_SQL = "l_orderkey, l_linenumber, l_partkey"


@query("calc_add", f"SELECT {LINE_SQL}, l_extendedprice + l_quantity AS total FROM lineitem")
def calc_add(t):
    return calculate(t.lineitem, "add", "l_extendedprice", "l_quantity", "total").select(*LINE, "total")


@query("calc_sub", f"SELECT {LINE_SQL}, l_extendedprice - l_quantity AS rest FROM lineitem")
def calc_sub(t):
    return calculate(t.lineitem, "subtract", "l_extendedprice", "l_quantity", "rest").select(*LINE, "rest")


@query("calc_mul", f"SELECT {LINE_SQL}, l_extendedprice * l_discount AS off FROM lineitem")
def calc_mul(t):
    return calculate(t.lineitem, "multiply", "l_extendedprice", "l_discount", "off").select(*LINE, "off")


@query(
    "calc_div_zero",
    f"SELECT {LINE_SQL}, CASE WHEN l_tax <> 0 THEN l_extendedprice / l_tax END AS q FROM lineitem",
)
def calc_div_zero(t):
    return calculate(t.lineitem, "divide", "l_extendedprice", "l_tax", "q").select(*LINE, "q")


@query(
    "calc_text_number",
    """SELECT event_id, CASE event_type WHEN 'error' THEN 0 WHEN 'view' THEN 0
              ELSE CAST(regexp_extract(props, '[0-9]+', 0) AS DOUBLE) END + value AS s FROM events""",
)
def calc_text_number(t):
    """NULL and text that is no number count as zero."""
    digits = F.regexp_extract("props", "[0-9]+", 0)
    k = F.when(F.col("event_type") == "error", F.lit("n/a")).when(F.col("event_type") != "view", digits)
    return calculate(t.events.withColumn("k", k), "add", "k", "value", "s").select("event_id", "s")


@query("calc_concat", "SELECT c_custkey, coalesce(NULLIF(c_mktsegment, 'BUILDING'), '') || CAST(c_nationkey AS VARCHAR) AS tag FROM customer")
def calc_concat(t):
    rows = t.customer.withColumn("seg", F.nullif("c_mktsegment", F.lit("BUILDING")))
    return calculate(rows, "concat", "seg", "c_nationkey", "tag").select("c_custkey", "tag")


@query(
    "calc_concat_double",
    r"SELECT o_orderkey, o_orderpriority || regexp_replace(CAST(o_totalprice AS VARCHAR), '\.0$', '') AS tag FROM orders",
)
def calc_concat_double(t):
    return calculate(t.orders, "concat", "o_orderpriority", "o_totalprice", "tag").select("o_orderkey", "tag")


@query("calc_const", "SELECT o_orderkey, 42.0::DOUBLE AS num, 'N/A' AS word FROM orders")
def calc_const(t):
    rows = calculate(t.orders, "constant", output="num", value="42")
    return calculate(rows, "constant", output="word", value="N/A").select("o_orderkey", "num", "word")


@query(
    "calc_datediff",
    f"""SELECT {LINE_SQL}, round_even((epoch_us(l_shipdate) - epoch_us(o_orderdate)) / 60000000.0::DOUBLE, 2) AS m
        FROM lineitem JOIN orders ON l_orderkey = o_orderkey""",
)
def calc_datediff(t):
    rows = t.lineitem.join(t.orders, F.col("l_orderkey") == F.col("o_orderkey"))
    return calculate(rows, "dateDiffMinutes", "l_shipdate", "o_orderdate", "m").select(*LINE, "m")


@query(
    "calc_day_numbers",
    "SELECT p_partkey, round_even((p_retailprice - p_size) * 24 * 60, 2) AS m FROM part",
)
def calc_day_numbers(t):
    """Numbers count as days."""
    rows = calculate(t.part, "dateDiffMinutes", "p_retailprice", "p_size", "m")
    return rows.select("p_partkey", "m")


@query(
    "select_values",
    """SELECT p_partkey AS id, p_name, CAST(p_size AS VARCHAR) AS size, CAST(p_size AS DOUBLE) AS size_d,
              'x|y' AS note FROM part""",
)
def select_values_query(t):
    mappings = "p_partkey|id\np_name\np_size|size|string\np_size|size_d|double\np_brand|b||false\nnone|gone\n|note|string|true|x|y"
    return select_values(t.part, mappings)


TEXTS = """CASE event_type WHEN 'click' THEN {k} || '.0' WHEN 'view' THEN {k} || '.5'
           WHEN 'error' THEN {k} || 'e2' WHEN 'signup' THEN '1,' || lpad({k}, 3, '0') ELSE 'abc' END"""


@query(
    "select_cast_null",
    """WITH e AS (SELECT event_id, event_type, CAST(regexp_extract(props, '[0-9]+', 0) AS INTEGER) AS k FROM events)
       SELECT event_id,
              CAST(CASE event_type WHEN 'click' THEN k WHEN 'error' THEN k * 100 WHEN 'signup' THEN 1000 + k END AS INTEGER) AS i,
              CAST(CASE event_type WHEN 'click' THEN k WHEN 'view' THEN k + 0.5 WHEN 'error' THEN k * 100
                                   WHEN 'signup' THEN 1000 + k END AS DOUBLE) AS d
       FROM e""",
)
def select_cast_null(t):
    """Whole numbers in any notation are integers; fractions and words are NULL."""
    text = F.expr(TEXTS.format(k="regexp_extract(props, '[0-9]+', 0)"))
    return select_values(t.events.withColumn("s", text), "event_id\ns|i|int\ns|d|double")


@query(
    "select_cast_flags",
    """SELECT event_id, CASE event_type WHEN 'click' THEN true WHEN 'view' THEN false END AS b,
              CASE WHEN event_type IN ('error', 'signup') THEN date_trunc('second', ts) END AS at FROM events""",
)
def select_cast_flags(t):
    flag = F.expr("CASE event_type WHEN 'click' THEN 'TRUE' WHEN 'view' THEN ' false ' WHEN 'error' THEN 'yes' ELSE '1' END")
    at = F.expr(
        """CASE event_type WHEN 'error' THEN date_format(ts, 'yyyy/MM/dd HH:mm:ss')
           WHEN 'signup' THEN date_format(ts, 'yyyy-MM-dd HH:mm:ss') WHEN 'view' THEN 'soon' END"""
    )
    return select_values(t.events.withColumns({"f": flag, "a": at}), "event_id\nf|b|bool\na|at|datetime")


@query("select_const", "SELECT r_regionkey, 7 AS seven, 'k' AS word, CAST(NULL AS INTEGER) AS bad FROM region, nation WHERE n_regionkey = r_regionkey")
def select_const(t):
    rows = t.nation.withColumnRenamed("n_regionkey", "r_regionkey")
    return select_values(rows, "r_regionkey\n|seven|int|true|7\n|word||true|k\n|bad|int|true|x")


@query("select_twice", "SELECT s_suppkey, s_nationkey AS v FROM supplier")
def select_twice(t):
    """Two mappings to one name: the later one wins."""
    return select_values(t.supplier, "s_suppkey\ns_name|v\ns_nationkey|v")


@query("select_auto", "SELECT * FROM customer")
def select_auto(t):
    return pass_through(select_values(t.customer, auto_mappings(t.customer)))


VARIABLES = """today = TODAY
now=NOW
yesterday=yesterday
back=TODAY-45
ahead=TODAY+10
m0=MONTH_START
m1=MONTH_END
y0=YEAR_START
y1=YEAR_END
t0=TODAY_START
t1=TODAY_END
d0=YESTERDAY_START
d1=YESTERDAY_END
md0=MONTH_START_DT
md1=MONTH_END_DT
p0=PREV_MONTH_START
p1=PREV_MONTH_END
dept=01"""


@query(
    "vars_per_date",
    """WITH o AS (SELECT o_orderkey, o_orderdate AS moment, CAST(o_orderdate AS DATE) AS d FROM orders)
       SELECT o_orderkey,
         strftime(d, '%Y/%m/%d') AS today,
         strftime(moment, '%Y/%m/%d %H:%M:%S') AS now,
         strftime(d - 1, '%Y/%m/%d') AS yesterday,
         strftime(d - 45, '%Y/%m/%d') AS back,
         strftime(d + 10, '%Y/%m/%d') AS ahead,
         strftime(date_trunc('month', d), '%Y/%m/%d') AS m0,
         strftime(last_day(d), '%Y/%m/%d') AS m1,
         strftime(d, '%Y') || '/01/01' AS y0,
         strftime(d, '%Y') || '/12/31' AS y1,
         strftime(d, '%Y/%m/%d') || ' 00:00:00' AS t0,
         strftime(d, '%Y/%m/%d') || ' 23:59:59' AS t1,
         strftime(d - 1, '%Y/%m/%d') || ' 00:00:00' AS d0,
         strftime(d - 1, '%Y/%m/%d') || ' 23:59:59' AS d1,
         strftime(date_trunc('month', d), '%Y/%m/%d') || ' 00:00:00' AS md0,
         strftime(last_day(d), '%Y/%m/%d') || ' 23:59:59' AS md1,
         strftime(date_trunc('month', d) - INTERVAL 1 MONTH, '%Y/%m/%d') AS p0,
         strftime(CAST(date_trunc('month', d) AS DATE) - 1, '%Y/%m/%d') AS p1,
         '01' AS dept
       FROM o""",
)
def vars_per_date(t):
    """Every variable as seen at the time of each order."""
    return t.orders.select("o_orderkey", *variable_columns(VARIABLES, F.col("o_orderdate")))
