"""The operators on a stream of the events table, run until it is drained."""

from __future__ import annotations

from pyspark.sql import DataFrame, functions as F

from rowloom.operators.join import merge_join
from rowloom.operators.project import calculate, select_values
from rowloom.operators.route import branch_counts, filter_rows, switch_tag
from rowloom.queries.registry import Tables, query
from rowloom.sources.scratch import scratch_path
from rowloom.streaming.batches import UpsertStream, append_stream, route_stream
from rowloom.streaming.static import CompareStream, JoinStream


def _stream(t: Tables, name: str) -> DataFrame:
    reader = t.spark.readStream.schema(getattr(t, name).schema).option("pathGlobFilter", f"{name}.parquet")
    return reader.parquet(t.folder)


def _drain(query) -> None:
    query.awaitTermination()


@query(
    "stream_row_wise",
    "SELECT event_id, upper(event_type) || CAST(user_id AS VARCHAR) AS tag, value * user_id AS product FROM events WHERE value > 10",
)
def stream_row_wise(t):
    """Filter, calculate and select on a stream, inserted into a table."""
    rows = filter_rows(_stream(t, "events"), "value", "greaterThan", "10")
    rows = calculate(rows, "multiply", "value", "user_id", "product").withColumn("event_type", F.upper("event_type"))
    rows = calculate(rows, "concat", "event_type", "user_id", "tag")
    rows = select_values(rows, "event_id\ntag\nproduct")
    out = scratch_path(t.spark, "stream")
    _drain(append_stream(rows, out + "/rows", out + "/checkpoint"))
    return t.spark.read.parquet(out + "/rows").select("event_id", "tag", "product")


@query(
    "stream_routed",
    """SELECT CASE WHEN event_type IN ('click', 'view') THEN 'web' WHEN event_type = 'error' THEN 'bad' ELSE 'default' END AS branch,
              count(*) AS n FROM events GROUP BY 1""",
)
def stream_routed(t):
    out = scratch_path(t.spark, "stream")
    tag = lambda batch: switch_tag(batch, "event_type", "click|web\nview|web\nerror|bad")
    _drain(route_stream(_stream(t, "events"), tag, out + "/ports", out + "/checkpoint"))
    return branch_counts(t.spark.read.parquet(out + "/ports"))


@query(
    "stream_upsert",
    """SELECT user_id, event_type, arg_max(ts, event_id) AS ts, arg_max(value, event_id) AS value
       FROM events GROUP BY user_id, event_type""",
)
def stream_upsert(t):
    """The latest event of every user and type, kept up by four batches."""
    source = scratch_path(t.spark, "stream")
    t.events.repartitionByRange(4, "event_id").write.parquet(source + "/in")
    stream = t.spark.readStream.schema(t.events.schema).option("maxFilesPerTrigger", 1).parquet(source + "/in")
    seen = F.col("event_id").alias("seen")
    empty = t.events.select("user_id", "event_type", "ts", "value", seen).limit(0)
    # files may arrive in any order, so the row already held competes too
    newest = lambda held: held.withColumn("newest", F.col("seen"))
    state = UpsertStream(t.spark, empty, source + "/state", ["user_id", "event_type"], ["newest"], ["ts", "value", "seen"], buckets=8, held=newest)
    rows = stream.select("user_id", "event_type", "ts", "value", seen, F.col("event_id").alias("newest"))
    _drain(state.start(rows, source + "/checkpoint"))
    return state.state().select("user_id", "event_type", "ts", "value")


@query(
    "stream_static_join",
    """SELECT o_orderkey, c_custkey AS id, c_name FROM orders LEFT JOIN customer ON o_custkey = c_custkey AND c_acctbal > 5000""".replace(
        "c_custkey AS id", "o_custkey AS id"
    ),
)
def stream_static_join(t):
    """A stream of orders against the customer table."""
    left = select_values(_stream(t, "orders"), "o_orderkey\no_custkey|id")
    right = select_values(filter_rows(t.customer, "c_acctbal", "greaterThan", "5000"), "c_custkey|id\nc_name")
    out = scratch_path(t.spark, "stream")
    _drain(append_stream(merge_join(left, right, "id", "LEFT OUTER"), out + "/rows", out + "/checkpoint"))
    return t.spark.read.parquet(out + "/rows").select("o_orderkey", "id", "c_name")


def _in_batches(t: Tables, rows: DataFrame, order: str, place: str) -> DataFrame:
    """The rows as a stream of four batches."""
    rows.repartitionByRange(4, order).write.parquet(place)
    return t.spark.readStream.schema(rows.schema).option("maxFilesPerTrigger", 1).parquet(place)


DEAR_ORDERS = "SELECT o_orderkey, o_custkey AS id, o_totalprice AS amount FROM orders WHERE o_totalprice > 200000"
BALANCES = "SELECT c_custkey AS id, c_name, c_acctbal AS amount FROM customer WHERE c_acctbal > 2000"


def _stream_join(t: Tables, how: str) -> DataFrame:
    place = scratch_path(t.spark, "stream")
    orders = select_values(t.orders.where("o_totalprice > 200000"), "o_orderkey\no_custkey|id\no_totalprice|amount")
    customers = select_values(t.customer.where("c_acctbal > 2000"), "c_custkey|id\nc_name\nc_acctbal|amount")
    stream = _in_batches(t, orders, "o_orderkey", place + "/in")
    join = JoinStream(customers, place + "/out", "id", how, stream.schema)
    _drain(join.start(stream, place + "/checkpoint"))
    return join.result()


@query("stream_join_right", f"SELECT o_orderkey, r.id, r.amount, c_name FROM ({DEAR_ORDERS}) l RIGHT JOIN ({BALANCES}) r ON l.id = r.id")
def stream_join_right(t):
    """A stream of orders; customers that it never named come at its end."""
    return _stream_join(t, "RIGHT OUTER")


@query(
    "stream_join_full",
    f"""SELECT o_orderkey, coalesce(r.id, l.id) AS id, CASE WHEN r.id IS NOT NULL THEN r.amount ELSE l.amount END AS amount, c_name
        FROM ({DEAR_ORDERS}) l FULL JOIN ({BALANCES}) r ON l.id = r.id""",
)
def stream_join_full(t):
    return _stream_join(t, "FULL OUTER")


@query(
    "stream_compare",
    """SELECT coalesce(l.id, r.id) AS id, l.kind AS kind_L, r.kind AS kind_R, l.n AS n_L, r.n AS n_R,
              CASE WHEN r.id IS NULL THEN 'ONLY_LEFT' WHEN l.id IS NULL THEN 'ONLY_RIGHT' ELSE 'DIFF' END AS _status,
              CASE WHEN l.id IS NULL OR r.id IS NULL THEN ''
                   ELSE concat_ws(',', CASE WHEN l.kind IS DISTINCT FROM r.kind THEN 'kind' END, CASE WHEN l.n IS DISTINCT FROM r.n THEN 'n' END) END AS _diff_columns
       FROM (SELECT event_id AS id, event_type AS kind, user_id AS n FROM events WHERE user_id % 3 <> 0) l
       FULL JOIN (SELECT event_id AS id, CASE WHEN event_id % 50 = 0 THEN upper(event_type) ELSE event_type END AS kind,
                         CASE WHEN event_id % 70 = 0 THEN -1 ELSE user_id END AS n FROM events WHERE user_id % 5 <> 0) r ON l.id = r.id
       WHERE l.id IS NULL OR r.id IS NULL OR l.kind IS DISTINCT FROM r.kind OR l.n IS DISTINCT FROM r.n""",
)
def stream_compare(t):
    """Events as they come against a changed copy of the table."""
    place = scratch_path(t.spark, "stream")
    columns = ["event_id AS id", "event_type AS kind", "user_id AS n"]
    stream = _in_batches(t, t.events.where("user_id % 3 <> 0").selectExpr(*columns), "id", place + "/in")
    changed = ["event_id AS id", "if(event_id % 50 = 0, upper(event_type), event_type) AS kind", "if(event_id % 70 = 0, -1L, user_id) AS n"]
    copy = t.events.where("user_id % 5 <> 0").selectExpr(*changed)
    compare = CompareStream(copy, place + "/out", "id", stream.schema, {"assume_unique": True})
    _drain(compare.start(stream, place + "/checkpoint"))
    return compare.result()
