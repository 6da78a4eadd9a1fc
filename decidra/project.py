"""Projects as forms (dictionaries, or YAML where it is installed), and the run of an audit."""

from __future__ import annotations

import datetime as dt
from collections.abc import Callable, Iterable
from dataclasses import dataclass
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .ledger import OverrideLedger, SampleLedger
from .operators.checks import Report, audit
from .operators.label import compute
from .operators.split import Split, purge_overlapping_train
from .schema import Availability, Cause, ColumnSpec, Comparison, DeclarationError, Grain, Missing, Outcome, Positive, Role, Schema, Simultaneous, Task, periods_from_days, validate_outcome
from .study import Assumption, Assumptions, Basis, Study, Unknowns, unknowns

SECTIONS = {"title", "observed_until", "observed_until_source", "assumptions", "columns", "outcome", "task", "split"}


@dataclass(frozen=True)
class Project:
    title: str
    observed_until: dt.datetime
    schema: Schema
    outcome: Outcome
    task: Task
    windows: tuple[tuple[str, float, float], ...]
    reserve_from_day: float | None = None
    reserve_until_day: float | None = None
    assumptions: tuple[Assumption, ...] = ()

    def unknowns(self, columns: Iterable[str]) -> Unknowns:
        """What the declarations claim and the columns that there are can't show."""
        return unknowns(self.schema, self.outcome, columns)


def _only(name: str, form: dict, known: set[str]) -> dict:
    if extra := sorted(set(form) - known):
        raise DeclarationError(f"{name}: unknown fields {extra}")
    return form


def parse(form: dict) -> Project:
    """A closed form: unknown fields are refused, and the outcome is validated against the schema."""
    _only("project", form, SECTIONS)
    columns = []
    for c in form["columns"]:
        _only(f"column {c.get('name')}", c, {"name", "role", "grain", "availability", "source", "measured_at", "window_days", "direction", "value_as_of", "clock"})
        columns.append(ColumnSpec(c["name"], Role(c["role"]), Grain[c["grain"].upper()] if c.get("grain") else None, Availability(c["availability"]) if c.get("availability") else None, c.get("source"), c.get("measured_at"), tuple(c["window_days"]) if c.get("window_days") else None, c.get("direction"), c.get("value_as_of"), c.get("clock")))
    schema, o = Schema(tuple(columns)), dict(form["outcome"])
    causes = tuple(Cause(x["name"], Missing(x["meaning"]), x.get("status"), x.get("assumption")) for x in o.pop("causes", []))
    _only("outcome", o, {"event", "deadline", "comparison", "positive", "primary_kind", "recurring", "expected_rate", "tolerance", "degenerate_below", "collapse_kinds"})
    outcome = Outcome(o.pop("event"), o.pop("deadline"), Comparison(o.pop("comparison")), Positive(o.pop("positive")), causes, **o)
    validate_outcome(outcome, schema)
    until = form["observed_until"]
    until = until if isinstance(until, dt.datetime) else dt.datetime.fromisoformat(str(until))
    parts = form["split"]
    return Project(form["title"], until, schema, outcome, _task(form.get("task", {})), tuple((w["name"], w["from_day"], w["to_day"]) for w in parts["windows"]), parts.get("reserve_from_day"), parts.get("reserve_until_day"), tuple(_assumption(a) for a in form.get("assumptions", ())))


def _assumption(form: dict) -> Assumption:
    _only("assumption", form, {"statement", "basis", "author", "consequence", "evidence"})
    return Assumption(form["statement"], Basis(form["basis"]), form["author"], form["consequence"], form.get("evidence"))


def _task(form: dict) -> Task:
    _only("task", form, {"binary", "delayed", "has_process", "is_stream", "competing", "simultaneous", "simultaneous_kind"})
    when = form.get("simultaneous")
    return Task(**(form | {"simultaneous": Simultaneous(when) if when else None}))


def load(path: str | Path) -> Project:
    import yaml

    return parse(yaml.safe_load(Path(path).read_text(encoding="utf-8")))


@dataclass
class Result:
    """What an audit gives; windows and reserve are handed out by ``samples`` only."""

    report: Report
    samples: SampleLedger
    study: Study


def built(project: Project, build: Callable[[SparkSession, str], DataFrame], spark: SparkSession, path: str, overrides: OverrideLedger | None = None) -> Result:
    """Runs a project on what its builder makes of the raw files at ``path``.

    The table is held against the declarations first: columns that are declared must be there, and a column that isn't
    declared is refused before anything is computed from it.
    """
    frame = build(spark, path)
    declared = {c.name for c in project.schema.columns}
    missing, extra = sorted(declared - set(frame.columns)), project.schema.undeclared(frame)
    if missing or extra:
        raise DeclarationError(f"the builder's table lacks {missing} and has {extra}, which isn't declared")
    return run(project, frame, overrides)


def run(project: Project, frame: DataFrame, overrides: OverrideLedger | None = None) -> Result:
    """Labels, splits, audits, and hands the samples to the ledger."""
    decision = project.schema.decision_time
    origin = frame.agg(F.min(decision)).first()[0]
    if origin is None:
        raise DeclarationError("the table has no decisions")
    day = lambda k: None if k is None else origin + dt.timedelta(days=k)
    labelled = compute(frame, project.outcome, project.schema, project.observed_until)
    split = Split(labelled, decision, tuple(periods_from_days(origin, project.windows)), day(project.reserve_from_day), day(project.reserve_until_day))
    report = audit(split, project.schema, project.outcome, project.task, overrides)
    ledger = SampleLedger(project.schema, overrides)
    unit, key = project.schema.one(Role.ENTITY_ID), project.schema.one(Role.NATURAL_KEY)
    look_back = max((c.window_days[1] for c in project.schema.by_role(Role.FEATURE) if c.window_days), default=None)
    for w in split.windows:
        train = split.train(w)
        if project.outcome.recurring and key and look_back is not None:
            train = purge_overlapping_train(train, split.evaluate(w), key, decision, look_back)
        ledger.register_window(w.name, w.start, split.evaluate(w), train, unit)
    if split.reserve_from is not None:
        ledger.register_window("reserve", split.reserve_from, split.reserved(), None, unit)
    estimand = project.outcome.estimand(project.title, project.observed_until)
    study = Study(project.title, estimand, report, ledger, repr(project), Assumptions(list(project.assumptions)), project.unknowns(frame.columns))
    return Result(report, ledger, study)
