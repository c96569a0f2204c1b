"""Round trips of the tables through files."""

from __future__ import annotations

from pyspark.sql import functions as F

from rowloom.operators.project import select_values
from rowloom.queries.registry import query
from rowloom.queries.workbook_fixture import workbooks
from rowloom.sinks.files import write_delimited
from rowloom.sources.files import read_delimited
from rowloom.sources.scratch import scratch_path
from rowloom.sources.workbooks import list_sheets, parse_workbooks, workbook_table

TYPES = "c_custkey|c_custkey|long\nc_name\nc_nationkey|c_nationkey|int\nc_acctbal|c_acctbal|double\nnote"
ORACLE = "SELECT c_custkey, c_name, c_nationkey, c_acctbal, {note} AS note FROM customer"
QUOTED = """CASE WHEN c_nationkey = 1 THEN 'a,b' WHEN c_nationkey = 2 THEN 'say "x"' WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END"""
BARE = """CASE WHEN c_nationkey = 1 THEN 'a b' WHEN c_nationkey = 2 THEN 'one "' WHEN c_nationkey = 3 THEN '' ELSE c_mktsegment END"""


def _round_trip(t, note: str, **options):
    rows = t.customer.select("c_custkey", "c_name", "c_nationkey", "c_acctbal", F.expr(note).alias("note"))
    path = scratch_path(t.spark, "text")
    write_delimited(rows, path, **options)
    return select_values(read_delimited(t.spark, path, **options), TYPES)


@query("csv_round_trip", ORACLE.format(note=QUOTED))
def csv_round_trip(t):
    return _round_trip(t, QUOTED, format="CSV")


@query("tsv_round_trip", ORACLE.format(note=BARE))
def tsv_round_trip(t):
    return _round_trip(t, BARE, format="TSV")


@query("txt_round_trip", ORACLE.format(note="c_mktsegment"))
def txt_round_trip(t):
    return _round_trip(t, "c_mktsegment", format="TXT", delimiter="||")


@query("txt_no_header", "SELECT CAST(n_nationkey AS VARCHAR) AS \"Column1\", n_name AS \"Column2\" FROM nation, supplier WHERE s_nationkey = n_nationkey")
def txt_no_header(t):
    rows = t.supplier.join(t.nation, F.col("s_nationkey") == F.col("n_nationkey")).select("n_nationkey", "n_name")
    path = scratch_path(t.spark, "text")
    write_delimited(rows, path, format="TXT", delimiter=";", header=False)
    return read_delimited(t.spark, path, format="TXT", delimiter=";", header=False)


CONTROL = "CASE WHEN c_nationkey = 4 THEN 'x' || chr(1) || 'y' ELSE c_mktsegment END"


@query("tsv_control_text", ORACLE.format(note=CONTROL))
def tsv_control_text(t):
    """Control characters are text like any other."""
    return _round_trip(t, CONTROL, format="TSV")


@query("txt_control_delimiter", ORACLE.format(note="c_mktsegment"))
def txt_control_delimiter(t):
    return _round_trip(t, "c_mktsegment", format="TXT", delimiter="\u0001")


BOOKS = "CAST(c_nationkey AS VARCHAR(9)) || '-' || CAST(CAST(floor(c_custkey / 1000) AS BIGINT) AS VARCHAR(20))"


def _books(t):
    rows = t.customer.withColumn("book", F.expr(BOOKS))
    return workbooks(rows, "book", ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"], order_by="c_custkey")


@query(
    "workbook_table",
    f"""SELECT {BOOKS} AS path, row_number() OVER (PARTITION BY {BOOKS} ORDER BY c_custkey) AS row_no,
               c_custkey, c_name, c_acctbal, c_mktsegment FROM customer""",
)
def workbook_table_query(t):
    """One workbook per nation and thousand customers, read back as a table."""
    cells = parse_workbooks(_books(t), "Data")
    table = workbook_table(cells, ["c_custkey", "c_name", "c_acctbal", "c_mktsegment"])
    typed = select_values(
        table, "path\nrow_no|row_no|long\nc_custkey|c_custkey|long\nc_name\nc_acctbal|c_acctbal|double\nc_mktsegment"
    )
    return typed


@query(
    "workbook_kinds",
    f"""SELECT path, kind, count(*) AS n FROM (SELECT {BOOKS} AS path FROM customer),
        (VALUES ('number'), ('text'), ('number'), ('text')) v(kind) GROUP BY 1, 2""",
)
def workbook_kinds(t):
    cells = parse_workbooks(_books(t), "Data")
    return cells.groupBy("path", "kind").agg(F.count(F.lit(1)).alias("n"))


@query(
    "workbook_sheets",
    f"SELECT DISTINCT {BOOKS} AS path, sheet_no, sheet FROM customer, (VALUES (1, 'Info'), (2, 'Data')) v(sheet_no, sheet)",
)
def workbook_sheets(t):
    return list_sheets(_books(t))
