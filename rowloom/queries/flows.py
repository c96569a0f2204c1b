"""Whole flows from JSON descriptions, on the events table."""

from __future__ import annotations

import uuid

from pyspark.sql import functions as F

from rowloom.plans.flow import build
from rowloom.plans.steps import Context
from rowloom.queries.registry import query


def _step(ident: str, kind: str, **settings: str) -> dict:
    return {"Id": ident, "Name": ident, "StepType": kind, "Settings": settings}


def _edges(*pairs: str) -> list[dict]:
    out = []
    for pair in pairs:
        source, target = pair.split(">")
        source, _, port = source.partition(":")
        edge = {"SourceStepId": source, "TargetStepId": target}
        out.append({**edge, "SourceBranchKey": port} if port else edge)
    return out


# How long each user was idle before each event of the last ten days: the gap to the
# event before, kept for a period, and written into a table of gaps.
RECENT = [
    {"name": "from_day", "sql": "date_format(max(ts) - INTERVAL '{days}' DAY, 'yyyy/MM/dd')"},
    {"name": "to_day", "sql": "date_format(max(ts), 'yyyy/MM/dd')"},
]


def _bounds(days: int) -> str:
    return "SELECT " + ", ".join(f"{c['sql'].format(days=days)} AS {c['name']}" for c in RECENT) + " FROM events"


IDLE = {
    "Name": "idle minutes",
    "Steps": [
        _step("Bounds", "DBInput", SQL=_bounds(10)),
        _step("Read", "DBInput", SQL="SELECT user_id, event_id, ts, :{from_day} AS from_day, :{to_day} AS to_day FROM events"),
        _step("Before", "PreviousEvent", KeyFields="user_id", OrderFields="ts,event_id", Columns="ts", Prefix="last_"),
        _step("Later", "Filter", FieldName="ts", Operator="greaterThan", RightField="from_day"),
        _step("Within", "Filter", FieldName="ts", Operator="lessOrEqual", RightField="to_day"),
        _step("Gap", "Calculation", OutputFieldName="idle_min", ExpressionType="dateDiffMinutes", Field1="ts", Field2="last_ts"),
        _step("Slim", "SelectValues", FieldMappings="user_id\nevent_id\nidle_min"),
        _step("Store", "DBUpdate", TableName="gaps", KeyFields="USER_ID,EVENT_ID", UpdateFields="idle_min"),
    ],
    "Connections": _edges("Bounds>Read", "Read>Before", "Before>Later", "Later>Within", "Within>Gap", "Gap>Slim", "Slim>Store"),
}


@query(
    "work_wait_flow",
    """WITH p AS (SELECT date_trunc('day', max(ts) - INTERVAL 10 DAY) AS lo, date_trunc('day', max(ts)) AS hi FROM events),
        x AS (SELECT user_id, event_id, ts, lag(ts) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS before FROM events)
       SELECT user_id, event_id, CASE WHEN ts > lo AND ts <= hi
           THEN round_even((epoch_us(ts) - epoch_us(before)) / 60000000.0::DOUBLE, 2) END AS idle_min FROM x, p""",
)
def work_wait_flow(t):
    """The event before in the user's order, a period, and an update of a table."""
    t.views("events")
    gaps = t.events.select("user_id", "event_id", F.lit(None).cast("double").alias("idle_min"))
    gaps.createOrReplaceTempView("gaps")
    context = Context(t.spark)
    build(IDLE, context)
    return context.session.states["gaps"]


# The visits of a user and day that went from view over click and purchase to signup:
# when each happened, how long the visit took, and what failed that day.
STAGES = {"view": "began", "click": "tried", "purchase": "paid", "signup": "ended"}
VISITS = {
    "Name": "visits",
    "Steps": [
        _step("Bounds", "DBInput", SQL=_bounds(25)),
        _step(
            "Read",
            "DBInput",
            SQL="""SELECT user_id, date_trunc('day', ts) AS day, event_type, ts, value,
                       :{from_day} AS from_day, :{to_day} AS to_day FROM events""",
        ),
        _step(
            "Pivot",
            "EventPivot",
            KeyFields="user_id,day,from_day,to_day",
            EventField="event_type",
            OrderField="ts",
            Events="\n".join(f"{event}|ts|{name}" for event, name in STAGES.items()),
        ),
        _step("Later", "Filter", FieldName="ended", Operator="greaterOrEqual", RightField="from_day"),
        _step("Within", "Filter", FieldName="ended", Operator="lessThan", RightField="to_day"),
        _step("Took", "Calculation", OutputFieldName="took_min", ExpressionType="dateDiffMinutes", Field1="ended", Field2="began"),
        _step("Slim", "SelectValues", FieldMappings="user_id\nday\nbegan\ntried\npaid\nended\ntook_min"),
        _step(
            "Failed",
            "DBInput",
            SQL="""SELECT user_id, date_trunc('day', ts) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18, 4))) AS total
                   FROM events WHERE event_type = 'error' GROUP BY ALL""",
        ),
        _step("Beside", "MergeJoin", KeyFields="user_id,day", JoinType="LEFT OUTER"),
        _step("Store", "InsertUpdate", TableName="visits", KeyFields="user_id,day", UpdateFields="user_id,day,began,tried,paid,ended,took_min,n,total"),
    ],
    "Connections": _edges("Bounds>Read", "Read>Pivot", "Pivot>Later", "Later>Within", "Within>Took", "Took>Slim", "Slim>Beside", "Failed>Beside", "Beside>Store"),
}


@query(
    "process_time_flow",
    """WITH p AS (SELECT date_trunc('day', max(ts) - INTERVAL 25 DAY) AS lo, date_trunc('day', max(ts)) AS hi FROM events),
        v AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day,
                max(ts) FILTER (event_type = 'view') AS began, max(ts) FILTER (event_type = 'click') AS tried,
                max(ts) FILTER (event_type = 'purchase') AS paid, max(ts) FILTER (event_type = 'signup') AS ended
              FROM events GROUP BY ALL),
        s AS (SELECT v.* FROM v, p WHERE began IS NOT NULL AND tried IS NOT NULL AND paid IS NOT NULL AND ended >= lo AND ended < hi),
        f AS (SELECT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day, count(*) AS n, sum(CAST(value AS DECIMAL(18, 4))) AS total
              FROM events WHERE event_type = 'error' GROUP BY ALL),
        t AS (SELECT DISTINCT user_id, CAST(date_trunc('day', ts) AS TIMESTAMP) AS day FROM events WHERE event_type = 'signup')
       SELECT coalesce(t.user_id, s.user_id) AS user_id, coalesce(t.day, s.day) AS day, began, tried, paid, ended,
              round_even((epoch_us(ended) - epoch_us(began)) / 60000000.0::DOUBLE, 2) AS took_min,
              f.n, CAST(f.total AS DECIMAL(28, 4)) AS total
       FROM t FULL JOIN s ON t.user_id = s.user_id AND t.day = s.day LEFT JOIN f ON f.user_id = s.user_id AND f.day = s.day""",
)
def process_time_flow(t):
    """Four events of a visit side by side in one aggregation, upserted."""
    t.views("events")
    day = F.date_trunc("day", "ts").cast("timestamp_ntz").alias("day")
    known = t.events.where("event_type = 'signup'").select("user_id", day).distinct()
    empty = [F.lit(None).cast("timestamp_ntz").alias(c) for c in STAGES.values()]
    missing = [F.lit(None).cast("bigint").alias("n"), F.lit(None).cast("decimal(28,4)").alias("total")]
    known.select("user_id", "day", *empty, F.lit(None).cast("double").alias("took_min"), *missing).createOrReplaceTempView("visits")
    context = Context(t.spark)
    build(VISITS, context)
    return context.session.states["visits"]


ROUTES = {
    "Name": "routes",
    "Steps": [
        _step("Read", "DBInput", SQL="SELECT event_id, user_id, event_type, value FROM events"),
        _step("Big", "Filter", FieldName="value", Operator="greaterThan", Value="20"),
        _step("Kind", "Switch", FieldName="event_type", Cases="click|web\nview|web\nerror|bad"),
        _step("Web", "Calculation", ExpressionType="constant", Constant="web", OutputFieldName="place"),
        _step("Bad", "Calculation", ExpressionType="constant", Constant="bad", OutputFieldName="place"),
        _step("Rest", "Calculation", ExpressionType="constant", Constant="rest", OutputFieldName="place"),
        _step("Small", "Calculation", ExpressionType="constant", Constant="small", OutputFieldName="place"),
        _step("All", "Dummy"),
    ],
    "Connections": _edges(
        "Read>Big", "Big>Kind", "Big:fail>Small", "Kind:web>Web", "Kind:bad>Bad", "Kind:default>Rest",
        "Web>All", "Bad>All", "Rest>All", "Small>All",
    ),
}


@query(
    "routed_flow",
    """SELECT event_id, user_id, event_type, value, CASE WHEN NOT value > 20 THEN 'small' WHEN event_type IN ('click', 'view') THEN 'web'
              WHEN event_type = 'error' THEN 'bad' ELSE 'rest' END AS place FROM events""",
)
def routed_flow(t):
    """Filter and switch ports, joined again by a union."""
    t.views("events")
    return build(ROUTES, Context(t.spark)).frame("All")


FAN_OUT = {
    "Name": "fan out",
    "Steps": [
        _step("Read", "DBInput", SQL="SELECT c_custkey, c_name, c_acctbal, c_nationkey FROM customer"),
        _step("Doubled", "Calculation", ExpressionType="multiply", Field1="c_acctbal", Field2="two", OutputFieldName="c_acctbal"),
        _step("Two", "Calculation", ExpressionType="constant", Constant="2", OutputFieldName="two"),
        _step("Left", "SelectValues", FieldMappings="c_custkey\nc_name\nc_acctbal"),
        _step("Right", "SelectValues", FieldMappings="c_custkey\nc_name\nc_acctbal"),
        _step("Compare", "TableCompare", KeyFields="c_custkey", CompareFields="c_acctbal", IncludeMatched="true"),
    ],
    "Connections": _edges("Read>Left", "Read>Two", "Two>Doubled", "Doubled>Right", "Left>Compare", "Right>Compare"),
}


@query(
    "fan_out_flow",
    """SELECT c_custkey, c_acctbal AS "c_acctbal_L", c_acctbal * 2 AS "c_acctbal_R",
              CASE WHEN c_acctbal = 0 THEN 'MATCH' ELSE 'DIFF' END AS _status,
              CASE WHEN c_acctbal = 0 THEN '' ELSE 'c_acctbal' END AS _diff_columns FROM customer""",
)
def fan_out_flow(t):
    """One source with two consumers, compared with each other."""
    t.views("customer")
    return build(FAN_OUT, Context(t.spark)).frame("Compare")


def _stored(name: str) -> dict:
    """Changes of a table of the catalog, which later steps of the flow see."""
    return {
        "Name": "stored",
        "Steps": [
            _step("Fresh", "ExecSQL", SQL=f"REFRESH TABLE {name}"),
            _step("Read", "DBInput", SQL="SELECT s_suppkey AS k, s_acctbal + 1 AS v FROM supplier WHERE s_suppkey % 2 = 0"),
            _step("Upsert", "InsertUpdate", TableName=name, KeyFields="k", UpdateFields="k,v"),
            _step("Fifth", "Calculation", OutputFieldName="fifth", ExpressionType="divide", Field1="k", Field2="five"),
            _step("Five", "Calculation", OutputFieldName="five", ExpressionType="constant", Constant="5"),
            _step("Few", "Filter", FieldName="fifth", Operator="lessOrEqual", Value="1"),
            _step("Delete", "DBDelete", TableName=name, KeyFields="k"),
        ],
        "Connections": _edges("Fresh>Read", "Read>Upsert", "Upsert>Five", "Five>Fifth", "Fifth>Few", "Few:pass>Delete"),
    }


@query(
    "stored_table_flow",
    """SELECT s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_acctbal + 1 ELSE s_acctbal END AS v FROM supplier
       WHERE (s_suppkey % 3 <> 0 OR s_suppkey % 2 = 0) AND NOT (s_suppkey % 2 = 0 AND s_suppkey <= 5)""",
)
def stored_table_flow(t):
    """A flow that changes a table of the catalog; the table is read back."""
    name = f"flow_{uuid.uuid4().hex}"
    t.views("supplier")
    t.spark.sql("SELECT s_suppkey AS k, s_acctbal AS v FROM supplier WHERE s_suppkey % 3 <> 0").write.saveAsTable(name)
    build(_stored(name), Context(t.spark)).run()
    return t.spark.table(name)


@query(
    "chained_insert_flow",
    """SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 1 UNION ALL SELECT s_suppkey FROM supplier WHERE s_suppkey % 4 = 2
       UNION ALL SELECT s_suppkey + 1000000 FROM supplier WHERE s_suppkey % 4 IN (1, 2)""",
)
def chained_insert_flow(t):
    """Rows are inserted, the table is read with them, and more are inserted: each once."""
    name = f"flow_{uuid.uuid4().hex}"
    t.views("supplier")
    t.spark.sql("SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 1").write.saveAsTable(name)
    flow = {
        "Name": "chained",
        "Steps": [
            _step("New", "DBInput", SQL="SELECT s_suppkey AS k FROM supplier WHERE s_suppkey % 4 = 2"),
            _step("Store", "DBOutput", TableName=name),
            _step("Read", "DBInput", SQL=f"SELECT k + 1000000 AS k FROM {name}"),
            _step("Again", "DBOutput", TableName=name),
        ],
        "Connections": _edges("New>Store", "Store>Read", "Read>Again"),
    }
    build(flow, Context(t.spark)).run()
    return t.spark.table(name)


@query(
    "chained_upsert_flow",
    """SELECT 'first' AS place, s_suppkey AS k, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 ELSE s_nationkey END AS v FROM supplier
       UNION ALL SELECT 'second', s_suppkey, CASE WHEN s_suppkey % 2 = 0 THEN s_nationkey + 1 ELSE s_nationkey END FROM supplier""",
)
def chained_upsert_flow(t):
    """A table is changed from itself, and a second one is filled from what it became."""
    first, second = (f"flow_{uuid.uuid4().hex}" for _ in range(2))
    t.views("supplier")
    t.spark.sql("SELECT s_suppkey AS k, s_nationkey AS v FROM supplier").write.saveAsTable(first)
    t.spark.sql("SELECT s_suppkey AS k, s_nationkey AS v FROM supplier LIMIT 0").write.saveAsTable(second)
    flow = {
        "Name": "chained",
        "Steps": [
            _step("Old", "DBInput", SQL=f"SELECT k, v + 1 AS v FROM {first} WHERE k % 2 = 0"),
            _step("Change", "InsertUpdate", TableName=first, KeyFields="k", UpdateFields="v"),
            _step("Read", "DBInput", SQL=f"SELECT k, v FROM {first}"),
            _step("Fill", "DBOutput", TableName=second),
        ],
        "Connections": _edges("Old>Change", "Change>Read", "Read>Fill"),
    }
    build(flow, Context(t.spark)).run()
    tagged = lambda name, place: t.spark.table(name).select(F.lit(place).alias("place"), "k", "v")
    return tagged(first, "first").union(tagged(second, "second"))


@query(
    "write_counts_flow",
    """WITH s AS (SELECT c_custkey AS k FROM customer WHERE c_custkey % 5 <> 0)
       SELECT 'Up' AS step, count(*) AS processed, count(*) FILTER (k % 3 = 0) AS inserted, count(*) FILTER (k % 3 <> 0 AND k % 2 = 1) AS updated,
              count(*) FILTER (k % 3 <> 0 AND k % 2 = 0) AS unchanged, NULL::BIGINT AS deleted FROM s
       UNION ALL SELECT 'Change', count(*), NULL, count(*), 0, NULL FROM s
       UNION ALL SELECT 'Gone', count(*), NULL, NULL, NULL, count(*) FROM s WHERE k < 50""",
)
def write_counts_flow(t):
    """What the sinks of a flow have written, counted while they wrote."""
    name = f"flow_{uuid.uuid4().hex}"
    t.views("customer")
    t.spark.sql("SELECT c_custkey AS k, c_nationkey AS v FROM customer WHERE c_custkey % 3 <> 0").write.saveAsTable(name)
    flow = {
        "Name": "counted",
        "Steps": [
            _step("New", "DBInput", SQL="SELECT c_custkey AS k, c_nationkey + c_custkey % 2 AS v FROM customer WHERE c_custkey % 5 <> 0"),
            _step("Up", "InsertUpdate", TableName=name, KeyFields="k", UpdateFields="v"),
            _step("More", "DBInput", SQL=f"SELECT k, v + 1 AS v FROM {name} WHERE k % 5 <> 0"),
            _step("Change", "DBUpdate", TableName=name, KeyFields="k", UpdateFields="v"),
            _step("Few", "Filter", FieldName="k", Operator="lessThan", Value="50"),
            _step("Gone", "DBDelete", TableName=name, KeyFields="k"),
        ],
        "Connections": _edges("New>Up", "Up>More", "More>Change", "Change>Few", "Few:pass>Gone"),
    }
    built = build(flow, Context(t.spark))
    built.run()
    names = ["processed", "inserted", "updated", "unchanged", "deleted"]
    told = [(step, *[counts.get(n) for n in names]) for step, counts in built.write_counts().items()]
    return t.spark.createDataFrame(told, "step string, " + ", ".join(f"{n} long" for n in names))
