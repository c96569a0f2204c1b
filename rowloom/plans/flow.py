"""Build DataFrames from a JSON description of steps and connections.

The description is only composed; Spark plans and runs the result.  A flow whose
frames are read together is one query to Catalyst, and ports that nobody reads
are never computed.
"""

from __future__ import annotations

import json
from collections.abc import Mapping
from dataclasses import dataclass, field as default
from graphlib import CycleError, TopologicalSorter
from pathlib import Path

from pyspark.sql import DataFrame, Observation, functions as F
from pyspark.storagelevel import StorageLevel

from rowloom.operators.join import union_inputs
from rowloom.operators.route import DEFAULT, PASS
from rowloom.plans.spaces import Counts, seen as _seen
from rowloom.plans.steps import OUT, STEPS, TWO_INPUTS, Context


def load_spec(source: str | Path | Mapping) -> Mapping:
    """A mapping as it is, or the JSON text or file it is given as."""
    if isinstance(source, Mapping):
        return source
    raw = str(source)
    return json.loads(raw if raw.lstrip().startswith("{") else Path(raw).read_text(encoding="utf-8-sig"))


@dataclass
class Flow:
    """The composed frames by (step id, port), and what is still to be run.

    ``waiting`` holds the steps that follow a statement: they can only be planned when it
    has run, which ``run`` does, or ``frame`` where it is asked for one of them.
    """

    spec: Mapping
    context: Context
    persist: bool = False
    observe: bool = False
    frames: dict[tuple[str, str], DataFrame] = default(default_factory=dict)
    persisted: list[DataFrame] = default(default_factory=list)
    observations: dict[tuple[str, str], Observation] = default(default_factory=dict)
    used: set[tuple[str, str]] = default(default_factory=set)
    waiting: list[str] = default(default_factory=list)
    acted: bool = False
    writes: dict[str, Counts] = default(default_factory=dict)

    def step_id(self, name: str) -> str:
        """The id of a step given by id or by (unique) name."""
        ids = [s["Id"] for s in self.spec["Steps"] if name in (s["Id"], s.get("Name"))]
        if len(ids) != 1:
            raise KeyError(f"{len(ids)} steps are called {name!r}")
        return ids[0]

    def frame(self, name: str, port: str = OUT) -> DataFrame:
        """A step's frame; statements before it are run if it waits for them."""
        ident = self.step_id(name)
        while ident in self.waiting:
            self._next()
        if (ident, port) not in self.frames and port == OUT and (ident, PASS) in self.frames:
            port = PASS
        return self.frames[(ident, port)]

    def _next(self) -> None:
        """Plans the first waiting step, and runs it if it is a statement."""
        ident = self.waiting.pop(0)
        before = len(self.context.actions)
        _compose(self, ident)
        if _is_statement(self.spec, ident):
            statement = self.context.actions[before:]
            del self.context.actions[before:]
            for action in statement:
                action()

    def _act(self) -> None:
        """Runs the external writes that are planned so far, in step order."""
        while self.context.actions:
            self.acted = True
            self.context.actions.pop(0)()

    def run(self) -> None:
        """Run external writes and statements in step order, read every other terminal
        step, and last commit the changed tables of the session."""
        sources = {c["SourceStepId"] for c in self.spec.get("Connections", [])}
        try:
            self._act()
            while self.waiting:
                self._next()
                self._act()
            for (ident, _), df in self.frames.items():
                if ident not in sources and not (self.acted and self._is_sink(ident)):
                    df.write.format("noop").mode("overwrite").save()
            self.context.session.flush()
        finally:
            for df in self.persisted:
                df.unpersist()

    def _is_sink(self, ident: str) -> bool:
        kind = next(s["StepType"] for s in self.spec["Steps"] if s["Id"] == ident)
        return kind.endswith("Output") or kind in ("InsertUpdate", "DBUpdate", "DBDelete", "ExecSQL")

    def row_counts(self) -> dict[tuple[str, str], int]:
        """Rows that passed each used port in ``run``; needs ``observe=True``.

        Counted on the way, without a job of their own.  A port that the plan did
        not execute has no count, and none is waited for.
        """
        return {key: seen.get["rows"] for key, seen in self.observations.items() if key in self.used and _seen(seen)}

    def write_counts(self) -> dict[str, dict[str, int | None]]:
        """What each step that changes a table has written in ``run``, by step id: rows
        ``processed`` and ``inserted``, ``updated``, ``unchanged``, ``deleted`` in tables of
        the catalog; rows ``sent`` and ``affected`` in an external database.

        Counted in the write itself.  Steps whose writes have not run, such as changes of a
        temporary view, which nothing writes, have none.
        """
        return {ident: counts for ident, told in self.writes.items() if (counts := told()) is not None}


def _ordered(spec: Mapping) -> list[str]:
    steps = {s["Id"]: s for s in spec["Steps"]}
    if len(steps) != len(spec["Steps"]):
        raise ValueError("two steps have one id")
    graph: dict[str, list[str]] = {i: [] for i in steps}
    for c in spec.get("Connections", []):
        for end in ("SourceStepId", "TargetStepId"):
            if c[end] not in steps:
                raise ValueError(f"a connection names the unknown step {c[end]!r}")
        graph[c["TargetStepId"]].append(c["SourceStepId"])
    for s in spec["Steps"]:
        if s["StepType"] not in STEPS:
            raise ValueError(f"step {s.get('Name')!r} has the unknown type {s['StepType']!r}")
    try:
        return list(TopologicalSorter(graph).static_order())
    except CycleError as e:
        raise ValueError(f"the steps form a cycle: {e.args[1]}") from e


def _port(ports: list[str], wanted: str | None, kind: str, name: str) -> str:
    """The port an edge reads: a filter's unnamed edge means ``pass``; a step with
    one port ignores the name; a switch's edge must name its port."""
    if ports == [OUT]:
        return OUT
    if not wanted and kind == "Filter":
        return PASS
    if wanted in ports:
        return wanted
    if not wanted and ports == [DEFAULT]:
        return DEFAULT
    raise ValueError(f"step {name!r} has no port {wanted!r}; ports: {ports}")


def build(
    source: str | Path | Mapping,
    context: Context,
    persist: bool = False,
    observe: bool = False,
) -> Flow:
    """Compose all steps; nothing is read, changed or run.  ``persist`` keeps frames with
    several readers (for costly steps; a plain scan is better read again, with its own
    filters).  ``observe`` counts rows per port while they pass."""
    flow = Flow(load_spec(source), context, persist, observe)
    order = _ordered(flow.spec)
    after: set[str] = set()
    targets: dict[str, list[str]] = {}
    for c in flow.spec.get("Connections", []):
        targets.setdefault(c["SourceStepId"], []).append(c["TargetStepId"])
    for ident in order:
        if ident in after or ident in targets and _is_statement(flow.spec, ident):
            after.update([ident, *targets.get(ident, [])])
            flow.waiting.append(ident)
        else:
            _compose(flow, ident)
    return flow


def _is_statement(spec: Mapping, ident: str) -> bool:
    return next(s["StepType"] for s in spec["Steps"] if s["Id"] == ident) == "ExecSQL"


def _compose(flow: Flow, ident: str) -> None:
    """Adds the frames of one step, whose inputs are there."""
    steps = {s["Id"]: s for s in flow.spec["Steps"]}
    edges = list(flow.spec.get("Connections", []))
    readers = sum(c["SourceStepId"] == ident for c in edges)
    me = steps[ident]
    inputs = []
    for c in edges:
        if c["TargetStepId"] != ident:
            continue
        origin = steps[c["SourceStepId"]]
        ports = [p for i, p in flow.frames if i == origin["Id"]]
        port = _port(ports, c.get("SourceBranchKey"), origin["StepType"], origin.get("Name", ""))
        flow.used.add((origin["Id"], port))
        inputs.append(flow.frames[(origin["Id"], port)])
    if len(inputs) > 1 and me["StepType"] not in TWO_INPUTS:
        inputs = [union_inputs(inputs)]
    settings = me.get("Settings") or {}
    flow.context.read_later = readers > 0
    space = flow.context.space(settings)
    before = len(getattr(space, "writes", ()))
    ports = STEPS[me["StepType"]](flow.context, inputs, settings)
    if len(getattr(space, "writes", ())) > before:
        flow.writes[ident] = space.writes[-1]
    for port, df in ports.items():
        if flow.observe:
            seen = Observation(f"{ident}/{port}/{id(flow)}")
            df = df.observe(seen, F.count(F.lit(1)).alias("rows"))
            flow.observations[(ident, port)] = seen
        if flow.persist and readers > 1 and me["StepType"] not in ("DBInput", "SetVariable"):
            df = df.persist(StorageLevel.MEMORY_AND_DISK)
            flow.persisted.append(df)
        flow.frames[(ident, port)] = df
        if readers == 0:
            flow.used.add((ident, port))
