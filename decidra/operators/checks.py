"""Data-quality, leakage and drift checks of a decision table.

A check is a rule over a few numbers, and declares the fragments of plans that give them (:mod:`.passes`).  An audit
unites the needs of all checks that apply and answers them in a handful of queries over one labelled table, kept or read from files,
whatever the number of checks: a check that is added brings its needs along, and shares the passes with all others.
Checks whose premise doesn't hold, or that lack what they need, are reported as skipped.
"""

from __future__ import annotations

import datetime as dt
import math
from collections import defaultdict
from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field
from functools import cached_property
from statistics import median

from pyspark import StorageLevel
from pyspark.sql import Column, DataFrame, Row
from pyspark.sql import functions as F
from pyspark.sql.types import NumericType, StringType

from ..schema import Availability, Comparison, Grain, Outcome, Role, Schema, Simultaneous, Task
from .label import IMMATURE, LABEL, REASON
from .passes import Answers, Facet, Needs, Part, Rank, answered, nothing
from .profile import SENTINELS
from .split import Split, group_candidates, lookback_overlaps
from .windows import MICROS_PER_DAY, micros

#: Rows below which a rate means nothing, and how many standard errors tell two of them apart.
MIN_ROWS, SIGMA = 100, 3.0
#: Rows that an association needs, and rows a level that a string feature needs.
LINK_ROWS, LEVEL_ROWS = 50, 50


@dataclass(frozen=True)
class Finding:
    requirement: str
    finding: str
    detail: str
    blocking: bool
    subject: str | None = None
    metrics: dict = field(default_factory=dict)


@dataclass(frozen=True)
class Skipped:
    requirement: str
    reason: str


@dataclass
class Report:
    findings: list[Finding]
    skipped: list[Skipped]
    limits: dict[str, str]

    @property
    def blocking(self) -> list[Finding]:
        return [f for f in self.findings if f.blocking]

    def frame(self, spark) -> DataFrame:
        rows = [(f.requirement, f.finding, f.detail, f.blocking, f.subject, {k: float(v) for k, v in f.metrics.items()}) for f in self.findings]
        return spark.createDataFrame(rows, "requirement string, finding string, detail string, blocking boolean, subject string, metrics map<string,double>")


class NotApplicable(Exception):
    """The check can't be made on this table."""


@dataclass(frozen=True)
class Context:
    """What is declared, and the columns that there are: all that needs are made from."""

    schema: Schema
    outcome: Outcome
    task: Task
    split: Split

    @cached_property
    def types(self) -> dict:
        return {f.name: f.dataType for f in self.split.labelled.schema.fields}

    @cached_property
    def columns(self) -> list[str]:
        return [c for c in self.split.labelled.columns if not c.startswith("__")]

    @property
    def decision(self) -> str:
        return self.schema.decision_time

    @property
    def features(self) -> list[str]:
        return [f for f in self.schema.usable_features() if f in self.types]

    @property
    def numeric(self) -> list[str]:
        return [f for f in self.features if isinstance(self.types[f], NumericType)]

    @property
    def strings(self) -> list[str]:
        return [f for f in self.features if isinstance(self.types[f], StringType)]

    @property
    def object_key(self) -> str | None:
        return self.schema.one(Role.NATURAL_KEY) or self.schema.one(Role.ENTITY_ID)

    @property
    def unit(self) -> str | None:
        """What may not be on both sides of a window."""
        return self.schema.one(Role.ENTITY_ID) if self.outcome.recurring else self.object_key

    def need(self, role: Role, what: str) -> str:
        name = self.schema.one(role)
        if name is None:
            raise NotApplicable(f"{what} isn't declared")
        return name


@dataclass(frozen=True)
class Facts:
    """The context, and the answers to all needs."""

    context: Context
    answers: Answers
    frames: Mapping[str, list[Row]] = field(default_factory=dict)

    @property
    def sums(self) -> dict:
        return self.answers.sums

    @property
    def days(self) -> list[tuple[dt.date, int]]:
        return [(dt.date.fromisoformat(k), m["n"]) for k, m in self.answers.facets["day"] if k is not None]

    def facet(self, name: str) -> list[tuple[str | None, dict[str, int]]]:
        return self.answers.facets[name]

    def rank(self, part: str, feature: str) -> Rank:
        return self.answers.ranks.get((part, feature), Rank(0, 0, None))

    def windows(self) -> list[str]:
        return [w.name for w in self.context.split.windows]


def no_frames(_context: Context) -> dict[str, DataFrame]:
    return {}


@dataclass(frozen=True)
class Check:
    """A requirement with its rule, its needs, and small tables of its own (``frames``) that the fused passes can't give."""

    requirement: str
    rule: Callable[[Facts], list[Finding]]
    premise: str | None = None
    needs: Callable[[Context], Needs] = nothing
    frames: Callable[[Context], dict[str, DataFrame]] = no_frames


CHECKS: dict[str, Check] = {}


def check(requirement: str, premise: str | None = None, needs=nothing, frames=no_frames):
    def keep(rule):
        CHECKS[requirement] = Check(requirement, rule, premise, needs, frames)
        return rule

    return keep


# --- fragments that several checks share -----------------------------------------------------------------------------

WINDOW_SUMS: dict[str, Callable[[Split, object], Column]] = {
    "train": lambda s, w: s.in_train(w),
    "evaluate": lambda s, w: s.in_evaluate(w),
    "labelled": lambda s, w: s.in_evaluate(w) & F.col(LABEL).isNotNull(),
    "positives": lambda s, w: s.in_evaluate(w) & (F.col(LABEL) == 1),
    "immature": lambda s, w: s.in_evaluate(w) & (F.col(REASON) == IMMATURE),
}
RESERVE_SUMS = {"evaluate": F.lit, "labelled": lambda _: F.col(LABEL).isNotNull(), "positives": lambda _: F.col(LABEL) == 1, "immature": lambda _: F.col(REASON) == IMMATURE}
RESERVE = "reserve"


def by_window(*names: str, reserve: bool = False):
    """Counts ``name:window`` for each window, and for the reserve."""

    def needs(c: Context) -> Needs:
        found = {f"{n}:{w.name}": F.count_if(WINDOW_SUMS[n](c.split, w)) for n in names for w in c.split.windows}
        if reserve and c.split.reserve_from is not None:
            found |= {f"{n}:{RESERVE}": F.count_if(c.split.in_reserve & RESERVE_SUMS[n](True)) for n in names if n in RESERVE_SUMS}
        return Needs(found)

    return needs


def labels(_c: Context) -> Needs:
    return Needs({"rows": F.count("*"), "labelled": F.count(LABEL), "positives": F.sum(LABEL)})


def by_day(c: Context) -> Needs:
    return Needs(facets={"day": Facet(F.to_date(c.decision), {"n": F.lit(1)})})


def pooled(c: Context) -> Needs:
    return Needs(parts={"pooled": Part(F.lit(True), F.col(LABEL))}, numbers=c.numeric, strings=c.strings, ranked_strings=("pooled",))


def window_ranks(c: Context) -> Needs:
    return Needs(parts={f"window:{w.name}": Part(c.split.in_evaluate(w), F.col(LABEL), (0.05, 0.95)) for w in c.split.windows}, numbers=c.numeric)


def all_of(*needs):
    def united(c: Context) -> Needs:
        out = Needs()
        for n in needs:
            out = out | n(c)
        return out

    return united


def _rate_error(rate: float, n: int) -> float:
    return math.sqrt(max(0.0, rate * (1 - rate)) / n) if n else math.inf


def _link_error(rows: int, positives: int) -> float:
    few = min(positives, rows - positives)
    return 0.29 / math.sqrt(few) if few > 0 else math.inf


# --- declarations ----------------------------------------------------------------------------------------------------


@check("A10")
def mixed_grains(f):
    o, s = f.context.outcome, f.context.schema
    e, d = s.spec(o.event), s.spec(o.deadline)
    if not e or not d or e.grain is None or d.grain is None:
        raise NotApplicable("a grain isn't declared")
    if Grain.MONTH in (e.grain, d.grain) and e.grain is not d.grain:
        return [Finding("A10", "mixed_temporal_grain", "a month isn't comparable with a finer grain", True)]
    if e.grain is not d.grain and o.comparison is Comparison.DIRECT:
        return [Finding("A10", "mixed_temporal_grain", f"{e.grain.name} is compared with {d.grain.name}", True)]
    return [Finding("A10", "coarse_temporal_grain", "both sides are months", False)] if e.grain is Grain.MONTH else []


def _outcome_columns(f):
    o, s = f.context.outcome, f.context.schema
    return [(c, s.spec(c)) for c in (o.event, o.deadline) if s.spec(c) is not None]


@check("A10b")
def no_grain(f):
    return [Finding("A10b", "missing_temporal_grain", f"{c} has no declared grain", True, c) for c, s in _outcome_columns(f) if s.grain is None]


@check("C6")
def outcome_as_feature(f):
    return [Finding("C6", "outcome_component_as_feature", f"{c} computes the outcome", True, c) for c, s in _outcome_columns(f) if s.role is Role.FEATURE]


@check("C1")
def known_later(f):
    late = [c.name for c in f.context.schema.by_role(Role.FEATURE) if c.availability is Availability.AFTER]
    return [Finding("C1", "feature_after_decision", f"{c} is known after the decision", True, c) for c in late]


@check("C2")
def unknown_availability(f):
    unknown = [c.name for c in f.context.schema.by_role(Role.FEATURE) if c.availability in (None, Availability.UNKNOWN)]
    return [Finding("C2", "unknown_availability", f"when {c} is known isn't declared", False, c) for c in unknown]


@check("S8")
def undeclared_columns(f):
    extra = sorted(set(f.context.columns) - {c.name for c in f.context.schema.columns})
    return [Finding("S8", "undeclared_column", f"{c} isn't declared", True, c) for c in extra]


@check("P10")
def overlapping_windows(f):
    ws = sorted(f.context.split.windows, key=lambda w: (w.start, w.stop))
    return [Finding("P10", "windows_overlap", f"{a.name} and {b.name} overlap", True, a.name) for a, b in zip(ws, ws[1:], strict=False) if b.start < a.stop]


# --- rows ------------------------------------------------------------------------------------------------------------


def _both_keys(c):
    names = c.need(Role.ENTITY_ID, "an id"), c.need(Role.NATURAL_KEY, "a natural key")
    return Needs(keys={n: F.col(n) for n in names})


@check("A2", needs=_both_keys)
def surrogate_key(f):
    ids, objects = (f.answers.keys[f.context.schema.one(r)].different for r in (Role.ENTITY_ID, Role.NATURAL_KEY))
    fewer = objects < ids and not f.context.outcome.recurring
    return [Finding("A2", "surrogate_entity", f"{ids} ids stand for {objects} objects", True)] if fewer else []


def _whole_rows(c):
    whole = F.concat_ws(":", F.xxhash64(*c.columns), F.hash(*c.columns))
    return labels(c) | Needs(keys={"whole row": whole})


@check("A3", needs=_whole_rows)
def duplicates(f):
    n = f.sums["rows"] - f.answers.keys["whole row"].different if f.sums["rows"] else 0
    return [Finding("A3", "duplicate_rows", f"{n} rows repeat others", False, metrics={"rows": n})] if n else []


def _by_status(columns):
    def needs(c):
        status = c.need(Role.STATUS, "a status")
        gone = {f"gone:{x}": F.col(x).isNull() for x in columns(c)}
        return Needs(facets={"status": Facet(F.col(status), {"n": F.lit(1), **gone})})

    return needs


@check("A5", "process", _by_status(lambda c: [c.outcome.event]))
def conflicting_status(f):
    name = f"gone:{f.context.outcome.event}"
    rows = [(s, m["n"], m[name]) for s, m in f.facet("status") if s is not None]
    return [
        Finding("A5", "status_conflicts_with_event", f"{s}: {gone} of {n} rows have no event", False, s, {"share": gone / n})
        for s, n, gone in rows if 0 < gone < n
    ]


@check("A11", "process", all_of(labels, _by_status(lambda c: c.features)))
def post_treatment_missing(f, least=30, share=0.8, times=1.5):
    total, out = f.sums["rows"], []
    for feature in f.context.features:
        gone = [(m[f"gone:{feature}"], m["n"], s) for s, m in f.facet("status")]
        if (all_gone := sum(g for g, *_ in gone)) >= least:
            most, n, status = max(gone, key=lambda x: (x[0], str(x[2])))
            if most / all_gone >= share and most / all_gone > times * n / total:
                out.append(Finding("A11", "missing_by_status", f"{most / all_gone:.0%} of {feature}'s gaps have the status {status}", False, feature, {"share": most / all_gone}))
    return out


@check("A6", "stream", by_day)
def truncated_tail(f, tail=14, ratio=0.35, least_days=42):
    days = f.days
    if len(days) < least_days:
        raise NotApplicable(f"fewer than {least_days} days")
    last, by = days[-1][0], dict(days)
    late = sum(by.get(last - dt.timedelta(days=k), 0) for k in range(tail)) / tail
    usual = median(n for d, n in days if d <= last - dt.timedelta(days=tail))
    return [Finding("A6", "truncated_tail", f"the last {tail} days have {late:.1f} rows a day, {usual} before", False, metrics={"ratio": late / usual})] if late < ratio * usual else []


@check("A7", "stream", by_day)
def missing_period(f, least=7):
    days = [d for d, _ in f.days]
    gaps = [(a, b, (b - a).days - 1) for a, b in zip(days, days[1:], strict=False)]
    return [Finding("A7", "missing_period", f"no rows between {a} and {b}", False, str(a), {"days": n}) for a, b, n in gaps if n >= least]


@check("A14", needs=lambda c: Needs({f"sentinel:{x}": F.count_if(F.col(x).isin(*SENTINELS)) for x in c.columns if isinstance(c.types[x], StringType)}))
def sentinels(f):
    found = [(k[9:], n) for k, n in f.sums.items() if k.startswith("sentinel:") and n]
    return [Finding("A14", "sentinel_as_value", f"{c} has {n} sentinels", True, c, {"rows": n}) for c, n in found]


def _before(c):
    event, decision = F.col(c.outcome.event), F.col(c.decision)
    worst = F.max(F.when(event < decision, F.floor((micros(c.decision) - micros(c.outcome.event)) / MICROS_PER_DAY)))
    return Needs({"before": F.count_if(event < decision), "equal": F.count_if(event == decision), "worst days before": worst})


@check("A13", needs=_before)
def event_before_decision(f):
    out, n, same, worst = [], f.sums["before"], f.sums["equal"], f.sums["worst days before"]
    if n:
        out.append(Finding("A13", "event_before_decision", f"{n} events lie before the decision, up to {worst} days", True, metrics={"rows": n, "worst_days": worst}))
    if same:
        out.append(Finding("A13", "event_at_decision", f"{same} events are at the decision", False, metrics={"rows": same}))
    return out


def _immaturity(c):
    return by_window("evaluate", "immature", reserve=True)(c)


@check("A12", "delayed", _immaturity)
def immature(f, least=0.01):
    names = [*f.windows(), *([RESERVE] if f"evaluate:{RESERVE}" in f.sums else [])]
    parts = [(w, f.sums[f"immature:{w}"], f.sums[f"evaluate:{w}"]) for w in names]
    return [
        Finding("A12", "immature_labels", f"{k} of {n} outcomes in {w} aren't mature", True, w, {"share": k / n})
        for w, k, n in parts if n and k / n >= least
    ]


# --- clocks and windows of features ----------------------------------------------------------------------------------


def _measured(c):
    sums = {}
    for x in c.schema.columns:
        if x.measured_at and x.window_days and x.measured_at in c.types:
            age = (micros(c.decision) - micros(x.measured_at)) / MICROS_PER_DAY
            low, high = x.window_days
            for name, over in (("new", low - age), ("old", age - high)):
                sums |= {f"{name}:{x.name}": F.count_if(over > 0), f"worst {name}:{x.name}": F.max(F.when(over > 0, over))}
    return Needs(sums)


@check("S7", needs=_measured)
def measured_outside_window(f):
    out = []
    for name, finding, says in (("new", "measured_too_new", "newer"), ("old", "measured_too_old", "older")):
        for x in f.context.schema.columns:
            if n := f.sums.get(f"{name}:{x.name}"):
                worst = f.sums[f"worst {name}:{x.name}"]
                out.append(Finding("S7", finding, f"{n} values of {x.name} are {says} than its window, by up to {worst:g} days", True, x.name, {"rows": n, "worst_days": worst}))
    return out


def _known_at(c: Context) -> str:
    """The column that says when a row is known: when it arrived, else when it was measured, else the decision."""
    return c.schema.one(Role.AVAILABLE_AT) or c.schema.one(Role.MEASURED_AT) or c.decision


def _clocked(c: Context):
    return [x for x in c.schema.by_role(Role.FEATURE) if x.availability is Availability.AT_DECISION and x.window_days and x.window_days[1] > 0]


def _clocks(c):
    known, sums = _known_at(c), {"rows": F.count("*")}
    for x in _clocked(c):
        if x.clock and x.clock != known and x.clock in c.types and known in c.types:
            sums[f"behind:{x.name}"] = F.count_if(F.col(x.clock) < F.col(known))
    return Needs(sums)


@check("S9", needs=_clocks)
def window_clock(f, share=0.05):
    out, rows, known = [], f.sums["rows"], _known_at(f.context)
    for x in _clocked(f.context):
        n = f.sums.get(f"behind:{x.name}")
        if not x.clock:
            out.append(Finding("S9", "window_clock_undeclared", f"the clock of {x.name}'s window isn't declared", True, x.name))
        elif n and n >= share * rows:
            out.append(Finding("S9", "window_clock_unknowable", f"{x.name}'s window counts by {x.clock}, which is before {known} in {n / rows:.1%} of rows", True, x.name, {"share": n / rows}))
    return out


def _dated(c: Context):
    return [*c.schema.by_role(Role.DEADLINE), *(x for x in c.schema.by_role(Role.FEATURE) if x.availability is Availability.AT_DECISION)]


def _fixed_later(c):
    sums = {"rows": F.count("*")}
    for x in _dated(c):
        if x.value_as_of and x.value_as_of in c.types and x.value_as_of != c.decision:
            sums[f"late:{x.name}"] = F.count_if(F.col(x.value_as_of) > F.col(c.decision))
    return Needs(sums)


@check("S10", needs=_fixed_later)
def revised_later(f, share=0.05):
    out, rows = [], f.sums["rows"]
    for x in _dated(f.context):
        n = f.sums.get(f"late:{x.name}")
        if x.value_as_of is None:
            out.append(Finding("S10", "value_as_of_undeclared", f"as of when {x.name} holds isn't declared", True, x.name))
        elif n and n >= share * rows:
            out.append(Finding("S10", "value_revised_after_decision", f"{x.name} was fixed later in {n / rows:.0%} of rows", True, x.name, {"share": n / rows}))
    return out


@check("S6", needs=by_day)
def premise_contradicted(f):
    out, days = [], f.days
    if f.context.task.has_process and f.context.schema.one(Role.STATUS) is None:
        out.append(Finding("S6", "premise_contradicted", "a process is declared, but no status", True, "process"))
    if f.context.task.is_stream and len(days) >= 4:
        gaps = sorted((b - a).days for (a, _), (b, _) in zip(days, days[1:], strict=False))
        if gaps[round(0.9 * (len(gaps) - 1))] > 3 * median(gaps):
            out.append(Finding("S6", "premise_contradicted", "rows don't arrive regularly", True, "stream"))
    return out


# --- splits ----------------------------------------------------------------------------------------------------------


@check("P8", needs=by_window("train"))
def small_train(f, least=MIN_ROWS):
    sizes = [(w, f.sums[f"train:{w}"]) for w in f.windows()]
    return [Finding("P8", "small_training_part", f"{w} trains on {n} rows", True, w, {"rows": n}) for w, n in sizes if n < least]


@check("P9", needs=by_window("labelled", reserve=True))
def small_evaluate(f, least=MIN_ROWS):
    names = [*f.windows(), *([RESERVE] if f"labelled:{RESERVE}" in f.sums else [])]
    sizes = [(w, f.sums[f"labelled:{w}"]) for w in names]
    return [Finding("P9", "small_evaluation_part", f"{w} observes {n} outcomes", True, w, {"rows": n}) for w, n in sizes if n < least]


def _beyond(c):
    if not c.split.windows:
        raise NotApplicable("no windows")
    last = F.lit(max(w.stop for w in c.split.windows)).cast("timestamp_ntz")
    return Needs({"beyond": F.count_if(F.col(c.decision) >= last)})


@check("P5", needs=_beyond)
def no_reserve(f):
    n = f.sums["beyond"]
    return [Finding("P5", "no_reserve", f"{n} rows lie beyond the windows, and none are reserved", True, metrics={"rows": n})] if n and f.context.split.reserve_from is None else []


def _unit_keys(c):
    return Needs(keys={c.unit: F.col(c.unit)}) if c.unit else Needs()


@check("N2", needs=_unit_keys)
def shared_objects(f):
    if f.context.unit is None or f.context.unit not in f.answers.keys:
        return []
    shared = f.answers.keys[f.context.unit].shared
    return [Finding("N2", "entity_overlap", f"{n} objects are in both parts of {w}", True, w, {"objects": n}) for w, n in shared.items() if n]


def _lookbacks(c):
    widest = max((x.window_days[1] for x in c.schema.by_role(Role.FEATURE) if x.window_days), default=None)
    if not c.outcome.recurring or widest is None or not c.object_key or not c.split.windows:
        return {}
    return {"look back": lookback_overlaps(c.split, c.object_key, widest)}


@check("N2i", frames=_lookbacks)
def shared_history(f):
    if not f.context.outcome.recurring:
        raise NotApplicable("objects don't recur")
    open_ = [c for c in f.context.features if f.context.schema.spec(c).window_days is None]
    out = [Finding("N2i", "feature_window_undeclared", f"{c}'s window isn't declared", True, c) for c in open_]
    hits = [(r.window, r.n) for r in f.frames.get("look back", []) if r.n]
    return out + [Finding("N2i", "feature_windows_overlap", f"{n} rows of {w} look back into training rows", True, w, {"rows": n}) for w, n in hits]


def _group_keys(c):
    group = c.schema.one(Role.GROUP_ID)
    return Needs(keys={group: F.col(group)}) if group else Needs()


def _candidates(c):
    if c.schema.one(Role.GROUP_ID) or not c.object_key:
        return {}
    return {"groups": group_candidates(c.split.labelled.select(c.columns), c.object_key)}


@check("N14", needs=_group_keys, frames=_candidates)
def shared_groups(f):
    out, group = [], f.context.schema.one(Role.GROUP_ID)
    if group and group in f.answers.keys:
        k = f.answers.keys[group]
        for w, n in k.shared_known.items():
            if n:
                touched = k.touched[w] / f.sums[f"evaluate:{w}"] if f.sums.get(f"evaluate:{w}") else k.touched[w] / max(1, k.rows[w])
                out.append(Finding("N14", "group_overlap", f"{n} groups are in both parts of {w}", True, w, {"groups": n, "touched": touched}))
    found = f.frames.get("groups", [])
    return out + [Finding("N14", "undeclared_group", f"{r.column} groups {r.share:.0%} of rows", True, r.column, {"groups": r.groups, "share": r.share}) for r in found]


# --- outcomes --------------------------------------------------------------------------------------------------------


@check("N6", "binary", pooled)
def separates_alone(f, least=0.35, sure=0.45, times=2.5):
    ranks = {c: f.rank("pooled", c).association for c in (*f.context.numeric, *f.context.strings)}
    strength, out = {c: abs(a) for c, a in ranks.items() if a is not None}, []
    for c, s in sorted(strength.items()):
        others = [v for k, v in strength.items() if k != c]
        typical = median(others) if others else 0.0
        if s >= least and (s >= sure or typical == 0 or s >= times * typical):
            out.append(Finding("N6", "feature_separates_outcome", f"{c} alone has an association of {s:.3f}", True, c, {"association": s}))
    return out


@check("N15", "binary", labels)
def degenerate(f):
    floor = f.context.outcome.degenerate_below
    if floor is None:
        return [Finding("N15", "degeneracy_undeclared", "no least share of the rarer outcome is declared", True)]
    if not f.sums["labelled"]:
        raise NotApplicable("no labels")
    rate = f.sums["positives"] / f.sums["labelled"]
    return [Finding("N15", "degenerate_outcome", f"{rate:.3f} are positive", True, metrics={"rate": rate})] if not floor <= rate <= 1 - floor else []


def _observed(c):
    seen = Part(F.lit(True), F.col(LABEL).isNotNull().cast("int"))
    gone = F.count_if(F.col(LABEL).isNull() & (F.col(REASON) != IMMATURE))
    return labels(c) | Needs({"unobserved": gone}, parts={"seen": seen}, numbers=c.numeric, strings=c.strings, ranked_strings=("seen",))


@check("N16", "binary", _observed)
def unobserved_outcomes(f, least=0.05, link=0.10):
    n, gone = f.sums["rows"], f.sums["unobserved"]
    if not n or gone / n < least or not f.sums["labelled"]:
        return []
    observed, rate = n - gone, f.sums["positives"] / f.sums["labelled"]
    low, high = rate * observed / n, (rate * observed + gone) / n
    ranks = [(c, f.rank("seen", c)) for c in sorted((*f.context.numeric, *f.context.strings))]
    tied = [c for c, r in ranks if r.association is not None and abs(r.association) > max(link, SIGMA * _link_error(r.rows, r.positives))]
    more = f"; observation depends on {', '.join(tied)}" if tied else ""
    return [Finding("N16", "unobserved_share", f"{gone / n:.0%} unobserved: the rate lies in [{low:.3f}, {high:.3f}]{more}", bool(tied), metrics={"low": low, "high": high})]


def _by_reason(c):
    reason = c.need(Role.OBSERVATION_REASON, "a reason")
    y = F.col(LABEL)
    return Needs(facets={"reason": Facet(F.col(reason), {"n": y.isNotNull(), "p": y == 1})})


@check("N17", "binary", _by_reason)
def rate_by_reason(f, ratio=1.5):
    rates = sorted(((m["p"] / m["n"], m["n"], r) for r, m in f.facet("reason") if m["n"] >= MIN_ROWS), key=lambda x: (x[0], str(x[2])))
    if len(rates) < 2:
        raise NotApplicable("fewer than two reasons with enough rows")
    (a, n, low), (b, m, high) = rates[0], rates[-1]
    apart = b - a > SIGMA * math.hypot(_rate_error(a, n), _rate_error(b, m)) and (a == 0 or b / a >= ratio)
    return [Finding("N17", "rate_depends_on_reason", f"{low}: {a:.3f}, {high}: {b:.3f}", True, metrics={"low": a, "high": b})] if apart else []


def _pair_sums(f, name):
    n = f.sums.get(f"labelled:{name}", 0)
    return (f.sums[f"positives:{name}"] / n if n else 0.0), n


def _beyond_last(f, last: float, rising: bool) -> str:
    """What the rate does after the last window, by the reserve: unknown, flat, continues or reverses."""
    after, n = _pair_sums(f, RESERVE)
    if n < MIN_ROWS:
        return "unknown"
    if abs(after - last) <= SIGMA * _rate_error(after, n):
        return "flat"
    return "continues" if (after > last) == rising else "reverses"


@check("N3", "binary", by_window("labelled", "positives", reserve=True))
def rate_drift(f, ratio=1.5):
    """Windows against each other, their trend and what the reserve makes of it, and the reserve against all windows.

    The reserve needs no ratio: what is measured on another population is off by any difference that can be told from noise.
    """
    rates = [(w, *_pair_sums(f, w)) for w in f.windows()]
    rates = [(w, r, n) for w, r, n in rates if n >= MIN_ROWS]
    if len(rates) < 2:
        raise NotApplicable("fewer than two windows with enough labels")
    out = []
    total = sum(n for *_, n in rates)
    whole = sum(f.sums[f"positives:{w}"] for w, *_ in rates) / total
    after, m = _pair_sums(f, RESERVE)
    if m >= MIN_ROWS and abs(after - whole) > SIGMA * math.hypot(_rate_error(whole, total), _rate_error(after, m)):
        out.append(Finding("N3", "reserve_rate_differs", f"{after:.3f} in the reserve, {whole:.3f} in the windows", True, RESERVE, {"windows": whole, "reserve": after}))
    values = [r for _, r, _ in rates]
    steps = [b - a for a, b in zip(values, values[1:], strict=False)]
    if len(values) >= 3 and (all(s > 0 for s in steps) or all(s < 0 for s in steps)):
        spread = math.hypot(_rate_error(values[0], rates[0][2]), _rate_error(values[-1], rates[-1][2]))
        if abs(values[-1] - values[0]) > SIGMA * spread:
            beyond = _beyond_last(f, values[-1], steps[0] > 0)
            shown = " -> ".join(f"{v:.3f}" for v in values)
            out.append(Finding("N3", "rate_trend", f"{shown}; beyond the last window: {beyond}", True, beyond, {"first": values[0], "last": values[-1]}))
    (_, a, n), (_, b, m) = min(rates, key=lambda x: x[1]), max(rates, key=lambda x: x[1])
    if b > 0 and (a == 0 or b / a >= ratio) and b - a > SIGMA * math.hypot(_rate_error(a, n), _rate_error(b, m)):
        out.append(Finding("N3", "rate_drift", f"from {a:.3f} to {b:.3f}", True, metrics={"low": a, "high": b}))
    return out


def _disjoint(f, least=0.5):
    out = {}
    for c in f.context.numeric:
        spans = [r.quantiles for w in f.windows() if (r := f.rank(f"window:{w}", c)).valued >= MIN_ROWS]
        if len(spans) >= 2:
            narrow = min(hi - lo for lo, hi in spans)
            common = min(hi for _, hi in spans) - max(lo for lo, _ in spans)
            share = max(0.0, common) / narrow if narrow > 0 else float(common >= 0)
            if share < least:
                out[c] = share
    return out


@check("N5", needs=window_ranks)
def disjoint_support(f):
    return [Finding("N5", "disjoint_support", f"{c}'s windows share {s:.0%} of the narrowest range", True, c, {"share": s}) for c, s in _disjoint(f).items()]


@check("N4", "binary", window_ranks)
def relation_drift(f, least=0.05, ratio=3.0, strong=0.15):
    out, apart = [], _disjoint(f)
    for c in f.context.numeric:
        ranks = [f.rank(f"window:{w}", c) for w in f.windows()]
        got = [(r.association, _link_error(r.rows, r.positives)) for r in ranks if r.association is not None and r.rows >= MIN_ROWS]
        if c in apart or len(got) < 2:
            continue
        (low, e), (high, g) = min(got), max(got)
        if low < 0 < high and abs(low) >= max(least, SIGMA * e) and high >= max(least, SIGMA * g):
            out.append(Finding("N4", "relation_flips", f"{c}'s association goes from {low:.3f} to {high:.3f}", True, c, {"low": low, "high": high}))
            continue
        (weak, e), (top, g) = min((abs(a), x) for a, x in got), max((abs(a), x) for a, x in got)
        if top >= strong and (weak == 0 or top / weak >= ratio) and top - weak >= SIGMA * math.hypot(e, g):
            out.append(Finding("N4", "relation_weakens", f"{c}'s association goes from {weak:.3f} to {top:.3f}", True, c, {"low": weak, "high": top}))
    return out


@check("N8", "binary", pooled)
def declared_direction(f, least=0.05):
    out = []
    for c in f.context.schema.by_role(Role.FEATURE):
        r = f.rank("pooled", c.name) if c.name in f.context.numeric else Rank(0, 0, None)
        if c.direction and r.association is not None and r.association * c.direction < 0 and abs(r.association) >= max(least, SIGMA * _link_error(r.rows, r.positives)):
            out.append(Finding("N8", "direction_contradicted", f"{c.name}'s association is {r.association:.3f}", True, c.name, {"association": r.association}))
    return out


def _kinds(c):
    return Needs(facets={"kind": Facet(F.col(c.need(Role.EVENT_KIND, "a column of kinds")), {"n": F.lit(1)})})


def _at_one_instant(c):
    """(moments, rows): instants at which one object has events of several kinds, and their rows."""
    kind, key = c.schema.one(Role.EVENT_KIND), c.object_key
    if not c.task.competing or c.task.simultaneous is not Simultaneous.NOT_POSSIBLE or kind is None or key is None:
        return {}
    rows = c.split.labelled.where(F.col(c.outcome.event).isNotNull() & F.col(kind).isNotNull() & F.col(key).isNotNull())
    moments = rows.groupBy(key, c.outcome.event).agg((F.min(kind) < F.max(kind)).alias("several"), F.count("*").alias("n"))
    return {"at one instant": moments.where("several").agg(F.count("*").alias("moments"), F.coalesce(F.sum("n"), F.lit(0)).alias("rows"))}


@check("N12", needs=_kinds, frames=_at_one_instant)
def collapsed_kinds(f):
    kinds = [k for k, _ in f.facet("kind") if k is not None]
    task, outcome = f.context.task, f.context.outcome
    if len(kinds) < 2:
        raise NotApplicable("fewer than two kinds of events")
    if task.competing:
        if task.simultaneous is None:
            return [Finding("N12", "simultaneity_undeclared", "what several kinds at one instant mean isn't declared", True)]
        out, value = [], task.simultaneous_kind
        never = task.simultaneous is Simultaneous.NOT_POSSIBLE
        if value is not None and never and value in kinds:
            out.append(Finding("N12", "simultaneity_contradicted", f"several kinds at one instant are declared impossible, but {value} is in the data", True, value))
        if value is not None and not never and value not in kinds:
            out.append(Finding("N12", "simultaneity_contradicted", f"{value} should mark several kinds at one instant, but isn't in the data", True, value))
        for r in f.frames.get("at one instant", []):
            if r.moments:
                out.append(Finding("N12", "kinds_at_one_instant", f"{r.moments} instants have events of several kinds of one object", True, metrics={"moments": r.moments, "rows": r.rows}))
        return out
    if outcome.primary_kind is None and not outcome.collapse_kinds:
        return [Finding("N12", "kinds_collapsed", f"{len(kinds)} kinds of events are taken for one", True, metrics={"kinds": len(kinds)})]
    return []


@check("N13", "binary", labels)
def unexpected_rate(f):
    o = f.context.outcome
    if o.expected_rate is None or o.tolerance is None or not f.sums["labelled"]:
        raise NotApplicable("no expected rate is declared")
    rate = f.sums["positives"] / f.sums["labelled"]
    return [Finding("N13", "rate_not_expected", f"{rate:.3f} instead of {o.expected_rate:.3f}", True, metrics={"rate": rate})] if abs(rate - o.expected_rate) > o.tolerance else []


def _by_month(c):
    ripe = F.col(REASON) != IMMATURE
    return Needs(facets={"month": Facet(F.date_trunc("month", c.decision).cast("date"), {"n": ripe, "k": ripe & F.col(c.outcome.event).isNotNull()})})


@check("N18", "delayed", _by_month)
def recording_stops(f, least=0.25):
    fills = [(m["k"] / m["n"], m["n"], month[:7]) for month, m in f.facet("month") if month is not None and m["n"] >= MIN_ROWS]
    if len(fills) < 2:
        raise NotApplicable("fewer than two months with enough rows")
    (a, n, worst), (b, m, _) = min(fills), max(fills)
    if b - a < max(least, SIGMA * math.hypot(_rate_error(a, n), _rate_error(b, m))):
        return []
    struck = sum(b - x >= least for x, *_ in fills)
    return [Finding("N18", "event_recording_stops", f"events fill {a:.0%} of {worst} and {b:.0%} at best; {struck} months are struck", True, metrics={"low": a, "high": b, "months": struck})]


_PREMISES = {"process": lambda t: t.has_process, "stream": lambda t: t.is_stream, "binary": lambda t: t.binary, "delayed": lambda t: t.delayed}


def gather(context: Context, checks: Sequence[Check]) -> tuple[Facts, list[Check], list[Skipped]]:
    """The answers to the needs of all checks that apply, those checks, and the others with their reasons."""
    needs, frames, live, skipped = Needs(), {}, [], []
    for c in checks:
        if c.premise and not _PREMISES[c.premise](context.task):
            skipped.append(Skipped(c.requirement, f"the premise {c.premise!r} isn't declared"))
            continue
        try:
            own, small = c.needs(context), c.frames(context)
        except NotApplicable as e:
            skipped.append(Skipped(c.requirement, str(e)))
            continue
        needs, frames = needs | own, frames | small
        live.append(c)
    sides = {w.name: (context.split.in_train(w), context.split.in_evaluate(w)) for w in context.split.windows}
    answers = answered(context.split.labelled, needs, sides, LINK_ROWS, LEVEL_ROWS)
    return Facts(context, answers, {name: df.collect() for name, df in frames.items()}), live, skipped


def audit(split: Split, schema: Schema, outcome: Outcome, task: Task, overrides=None, more: Sequence[Check] = (), keep: bool = True) -> Report:
    """All checks, and ``more`` of one's own.  An override makes a requirement's findings advisory.

    The labelled table is kept while the passes run; without ``keep`` each reads its columns anew, which suits a table of files:
    tasks that read a kept table carry the figures of the plan that made it, and send them to the driver."""
    context = Context(schema, outcome, task, split)
    if keep:
        split.labelled.persist(StorageLevel.MEMORY_AND_DISK)
    try:
        facts, live, skipped = gather(context, [*CHECKS.values(), *more])
    finally:
        if keep:
            split.labelled.unpersist()
    report = Report([], skipped, {})
    for c in live:
        try:
            found = c.rule(facts)
        except NotApplicable as e:
            report.skipped.append(Skipped(c.requirement, str(e)))
            continue
        allowed = overrides is not None and overrides.allows(c.requirement)
        report.findings += [Finding(x.requirement, x.finding, x.detail, x.blocking and not allowed, x.subject, x.metrics) for x in found]
    errors = defaultdict(float)
    for (part, c), r in facts.answers.ranks.items():
        if part.startswith("window:") and r.association is not None:
            errors[c] = max(errors[c], SIGMA * _link_error(r.rows, r.positives))
    if errors:
        report.limits["N4"] = "associations below these can't be told from none: " + ", ".join(f"{c} {e:.3f}" for c, e in sorted(errors.items()))
    return report
