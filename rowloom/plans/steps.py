"""The step types of a flow: name -> (context, inputs, settings) -> frames per port.

Settings are texts, as in the JSON description.  Register further types with
``@step("Name")``.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping
from dataclasses import dataclass, field as default
from datetime import datetime

from pyspark.sql import DataFrame, SparkSession

from rowloom.operators import compare, digests, intervals, join, project, ranges, route
from rowloom.plans.spaces import SessionSpace
from rowloom.sinks.files import write_delimited
from rowloom.sources.files import read_delimited
from rowloom.sources.jdbc import Split
from rowloom.sources.variables import set_variables
from rowloom.sources.workbooks import parse_workbooks, workbook_files, workbook_headers, workbook_table

OUT = ""
Ports = dict[str, DataFrame]


@dataclass
class Context:
    """What steps may use.  A connection id that is not listed means the session."""

    spark: SparkSession
    connections: Mapping[str, object] = default(default_factory=dict)
    as_of: datetime | None = None
    actions: list[Callable[[], object]] = default(default_factory=list)
    session: SessionSpace | None = None
    read_later: bool = False

    def __post_init__(self) -> None:
        self.session = self.session or SessionSpace(self.spark)

    def space(self, settings: Mapping[str, str | None]):
        return self.connections.get(settings.get("ConnectionId") or "", self.session)


StepFn = Callable[[Context, list[DataFrame], Mapping[str, str | None]], Ports]
STEPS: dict[str, StepFn] = {}
TWO_INPUTS = {"MergeJoin", "RangeLookup", "TableCompare"}


def step(*names: str) -> Callable[[StepFn], StepFn]:
    def register(fn: StepFn) -> StepFn:
        STEPS.update({n: fn for n in names})
        return fn

    return register


def text(settings: Mapping[str, str | None], key: str, otherwise: str = "") -> str:
    value = settings.get(key)
    return otherwise if value is None else str(value)


def truth(settings: Mapping[str, str | None], key: str, otherwise: bool) -> bool:
    return {"true": True, "false": False}.get(text(settings, key).strip().lower(), otherwise)


def count(settings: Mapping[str, str | None], key: str, otherwise: int) -> int:
    value = text(settings, key).strip()
    return int(value) if value.isdigit() and int(value) > 0 else otherwise


def order_of(settings: Mapping[str, str | None], rows: DataFrame) -> list[str]:
    """The order that decides among rows with one key: ``OrderFields``, else all
    columns, so that the choice never depends on how rows are distributed."""
    return join.split_names(text(settings, "OrderFields")) or list(rows.columns)


def _one(inputs: list[DataFrame], what: str) -> DataFrame:
    if len(inputs) != 1:
        raise ValueError(f"{what} needs an input")
    return inputs[0]


@step("DBInput", "OracleInput", "MySQLInput", "PostgreSQLInput", "SqlServerInput", "SqliteInput")
def db_input(ctx, inputs, s):
    """``SplitColumn`` with ``SplitLower``, ``SplitUpper`` and ``SplitParts`` divides a
    read of an external database among tasks."""
    rows = inputs[0] if inputs else None
    split = None
    if text(s, "SplitColumn"):
        split = Split(text(s, "SplitColumn"), text(s, "SplitLower"), text(s, "SplitUpper"), count(s, "SplitParts", 16))
    return {OUT: ctx.space(s).query(text(s, "SQL"), rows, truth(s, "ExecuteEachRow", False), split)}


@step("DBOutput", "OracleOutput", "MySQLOutput", "PostgreSQLOutput", "SqlServerOutput", "SqliteOutput")
def db_output(ctx, inputs, s):
    rows, table, size = _one(inputs, "DBOutput"), text(s, "TableName"), count(s, "CommitSize", 100)
    if text(s, "Mode", "INSERT") == "UPSERT":
        ctx.actions += ctx.space(s).upsert(table, rows, None, None, order_of(s, rows), size)
    else:
        ctx.actions += ctx.space(s).insert(table, rows, size)
    return {OUT: rows}


@step("InsertUpdate")
def insert_update(ctx, inputs, s):
    rows = _one(inputs, "InsertUpdate")
    keys = join.split_names(text(s, "KeyFields"))
    if not keys:
        raise ValueError("InsertUpdate needs KeyFields")
    updates = text(s, "UpdateFields").strip() or None
    ctx.actions += ctx.space(s).upsert(
        text(s, "TableName"), rows, keys, updates, order_of(s, rows), count(s, "CommitSize", 100)
    )
    return {OUT: rows}


@step("DBUpdate")
def db_update(ctx, inputs, s):
    rows = _one(inputs, "DBUpdate")
    keys = join.split_names(text(s, "KeyFields"))
    updates = text(s, "UpdateFields").strip() or None
    ctx.actions += ctx.space(s).update(
        text(s, "TableName"), rows, keys, updates, order_of(s, rows), count(s, "CommitSize", 100)
    )
    return {OUT: rows}


@step("DBDelete")
def db_delete(ctx, inputs, s):
    rows = _one(inputs, "DBDelete")
    ctx.actions += ctx.space(s).delete(text(s, "TableName"), rows, text(s, "KeyFields"), count(s, "CommitSize", 100))
    return {OUT: rows}


@step("ExecSQL")
def exec_statement(ctx, inputs, s):
    """Steps that follow may read what the statement changes, so they are planned when it
    has run (see ``Flow``).  The statement sees tables without the flow's own changes."""
    rows = inputs[0] if inputs else None
    ctx.actions += ctx.space(s).execute(text(s, "SQL"), rows, truth(s, "ExecuteEachRow", False))
    if rows is None and not ctx.read_later:
        return {}
    return {OUT: rows if rows is not None else ctx.spark.range(1).select()}


@step("ExcelInput")
def file_input(ctx, inputs, s):
    path, kind = text(s, "FilePath"), text(s, "Format", "Excel")
    header, most = truth(s, "HasHeader", True), count(s, "MaxRows", 0)
    if kind != "Excel":
        return {
            OUT: read_delimited(
                ctx.spark, path, kind, header, text(s, "Delimiter"), text(s, "Encoding", "UTF-8"), most
            )
        }
    files, sheet = workbook_files(ctx.spark, path), text(s, "SheetName")
    columns = join.split_names(text(s, "Columns")) or workbook_headers(files, sheet, header)
    table = workbook_table(parse_workbooks(files, sheet, header), columns)
    if most:  # the first rows of the files in their order
        table = table.orderBy("path", "row_no").limit(most)
    return {OUT: table.drop("path", "row_no")}


@step("ExcelOutput")
def file_output(ctx, inputs, s):
    rows, kind = _one(inputs, "ExcelOutput"), text(s, "Format", "Excel")
    if kind == "Excel":
        raise ValueError("workbooks cannot be written; use CSV, TSV or TXT")
    ctx.actions.append(
        lambda: write_delimited(
            rows,
            text(s, "FilePath"),
            kind,
            truth(s, "IncludeHeader", True),
            text(s, "Delimiter"),
            text(s, "Encoding", "UTF-8"),
            at=ctx.as_of,
        )
    )
    return {OUT: rows}


@step("Filter")
def filter_step(ctx, inputs, s):
    return route.filter_split(
        _one(inputs, "Filter"),
        text(s, "FieldName"),
        text(s, "Operator", "equals"),
        text(s, "Value"),
        text(s, "RightField"),
    )


@step("Switch")
def switch_step(ctx, inputs, s):
    default_port = text(s, "IncludeDefault").lower() != "false"
    return route.switch(_one(inputs, "Switch"), text(s, "FieldName"), text(s, "Cases"), default_port)


@step("Calculation")
def calculation(ctx, inputs, s):
    return {
        OUT: project.calculate(
            _one(inputs, "Calculation"),
            text(s, "ExpressionType", "add"),
            text(s, "Field1"),
            text(s, "Field2"),
            text(s, "OutputFieldName", "Result"),
            text(s, "Constant", "0"),
        )
    }


@step("SelectValues")
def select_step(ctx, inputs, s):
    mappings = text(s, "FieldMappings")
    if not inputs:
        return {OUT: project.constant_row(ctx.spark, mappings)}
    return {OUT: project.select_values(inputs[0], mappings, emit_on_empty=truth(s, "EmitOnEmpty", False))}


@step("MergeJoin")
def merge_step(ctx, inputs, s):
    """``HotRows``: from how many rows on a key counts as hot on the side of an outer join
    that cannot be split; looking for such keys runs a job."""
    return {OUT: join.merge_join_inputs(inputs, text(s, "KeyFields"), text(s, "JoinType", "INNER"), count(s, "HotRows", 0) or None)}


@step("RangeLookup")
def range_step(ctx, inputs, s):
    """Rows of the first input with those of the second whose range ``LowField`` to
    ``HighField`` holds ``ValueField``; ``KeyFields`` must be equal too."""
    if len(inputs) != 2:
        raise ValueError(f"RangeLookup takes two inputs, got {len(inputs)}")
    value, low, high = (text(s, k) for k in ("ValueField", "LowField", "HighField"))
    opened = {"low_open": truth(s, "LowOpen", False), "high_open": truth(s, "HighOpen", False)}
    return {OUT: ranges.range_join(*inputs, value, low, high, text(s, "KeyFields"), text(s, "JoinType", "INNER"), **opened)}


@step("TableCompare")
def compare_step(ctx, inputs, s):
    """``Digests``: join only buckets of rows whose digests differ, for tables that are
    nearly the same; matching rows are not in its output."""
    if len(inputs) != 2:
        raise ValueError(f"TableCompare takes two inputs, got {len(inputs)}")
    if truth(s, "Digests", False) and not truth(s, "IncludeMatched", False):
        rules = {"ignore_case": truth(s, "IgnoreCase", False), "trim": truth(s, "TrimStrings", False), "nulls_equal": truth(s, "NullsEqual", True)}
        return {OUT: digests.digest_compare(*inputs, text(s, "KeyFields"), text(s, "CompareFields"), order_of(s, inputs[1]), **rules)}
    return {
        OUT: compare.table_compare(
            *inputs,
            text(s, "KeyFields"),
            text(s, "CompareFields"),
            order_by=order_of(s, inputs[1]),
            ignore_case=truth(s, "IgnoreCase", False),
            trim=truth(s, "TrimStrings", False),
            nulls_equal=truth(s, "NullsEqual", True),
            include_matched=truth(s, "IncludeMatched", False),
        )
    }


@step("PreviousEvent")
def previous_event_step(ctx, inputs, s):
    """``Columns`` of the row before in the group, under ``Prefix``.  Groups with more than
    ``GroupRows`` rows are cut; looking for them runs a job."""
    rows = _one(inputs, "PreviousEvent")
    names = {k: join.split_names(text(s, k)) for k in ("KeyFields", "OrderFields", "Columns")}
    out = intervals.previous_event(rows, names["KeyFields"], names["OrderFields"], names["Columns"], text(s, "Prefix", intervals.PREFIX), truth(s, "KeepFirst", False), count(s, "GroupRows", 0) or None)
    return {OUT: out}


@step("EventPivot")
def event_pivot_step(ctx, inputs, s):
    """One row per key; ``Events`` has lines ``event|column|output name``."""
    values: dict[str, dict[str, str]] = {}
    for line in text(s, "Events").splitlines():
        if line.strip():
            event, column, name = (part.strip() for part in line.split("|"))
            values.setdefault(event, {})[column] = name
    keys = join.split_names(text(s, "KeyFields"))
    rows = _one(inputs, "EventPivot")
    return {OUT: intervals.event_pivot(rows, keys, text(s, "EventField"), values, text(s, "OrderField"), truth(s, "Complete", True))}


@step("Overlap")
def overlap_step(ctx, inputs, s):
    """Spans that begin before the group's previous one has ended, and all others;
    ``GroupRows`` as for PreviousEvent."""
    rows = _one(inputs, "Overlap")
    keys, order = (join.split_names(text(s, k)) for k in ("KeyFields", "OrderFields"))
    return intervals.overlap_split(rows, keys, text(s, "StartField"), text(s, "EndField"), order, text(s, "OutputFieldName", "INTERVAL_MIN"), count(s, "GroupRows", 0) or None)


@step("SetVariable")
def variables(ctx, inputs, s):
    return {OUT: set_variables(ctx.spark, text(s, "Fields"), text(s, "DateFormat", "yyyy/MM/dd"), ctx.as_of)}


@step("Dummy")
def dummy(ctx, inputs, s):
    return {OUT: project.pass_through(inputs[0])} if inputs else {}
