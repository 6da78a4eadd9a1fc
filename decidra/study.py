"""What an analysis rests on and what it came to: assumptions with their grounds, open questions, and conclusions that are bound to
the state in which they were drawn."""

from __future__ import annotations

import datetime as dt
import hashlib
from collections.abc import Iterable
from dataclasses import dataclass, field
from enum import Enum

from .ledger import OverrideLedger, SampleLedger
from .operators.checks import Report
from .schema import Availability, DeclarationError, Outcome, Role, Schema


class Basis(Enum):
    """What an assumption is taken from."""

    DATA = "data"
    OWNER = "owner"
    DOCUMENT = "document"
    DOMAIN = "domain_knowledge"


#: What must be shown: a computation, or a page.  What someone must be asked about on a new site: reading a document isn't knowing.
NEEDS_EVIDENCE, NEEDS_ASKING = (Basis.DATA, Basis.DOCUMENT), (Basis.DOMAIN, Basis.OWNER, Basis.DOCUMENT)


@dataclass(frozen=True)
class Assumption:
    """A statement, where it comes from, and what breaks if it is wrong."""

    statement: str
    basis: Basis
    author: str
    consequence: str
    evidence: str | None = None

    def __post_init__(self) -> None:
        for name in ("statement", "author", "consequence"):
            if not getattr(self, name).strip():
                raise DeclarationError(f"an assumption has no {name}")
        if self.basis in NEEDS_EVIDENCE and not (self.evidence or "").strip():
            raise DeclarationError(f"{self.statement}: taken from {self.basis.value}, so it needs evidence")

    @property
    def question(self) -> str | None:
        """What to ask on a new site; None where the data show it."""
        if self.basis not in NEEDS_ASKING:
            return None
        return f"Does it hold that {self.statement.rstrip('.')}? (else {self.consequence})"


@dataclass
class Assumptions:
    items: list[Assumption] = field(default_factory=list)

    def record(self, statement: str, basis: Basis, author: str, consequence: str, evidence: str | None = None) -> Assumption:
        self.items.append(Assumption(statement, basis, author, consequence, evidence))
        return self.items[-1]

    def by_basis(self, basis: Basis) -> list[Assumption]:
        return [a for a in self.items if a.basis is basis]

    def questions(self) -> list[str]:
        """They are made from what the analysis rests on, so they can't differ from it."""
        return [a.question for a in self.items if a.question]

    def section(self) -> str:
        lines = ["## Assumptions", ""]
        if not self.items:
            return "\n".join([*lines, "None recorded."])
        lines += ["| basis | statement | if it is wrong |", "|-|-|-|"]
        lines += [f"| {a.basis.value} | {a.statement} | {a.consequence} |" for a in self.items]
        asked = self.questions()
        return "\n".join([*lines, *(["", "To be asked on a new site:", "", *(f"- {q}" for q in asked)] if asked else [])])


@dataclass(frozen=True)
class Unknowns:
    """What the declarations claim and no data can show."""

    questions: tuple[str, ...]
    #: Of the features, the share whose availability at the decision only the declaration shows.
    uncertain: float | None
    #: Questions about causes of missing events: their number is the source's, not the author's, so it has no limit.
    of_causes: int


def unknowns(schema: Schema, outcome: Outcome, columns: Iterable[str]) -> Unknowns:
    """A feature's availability can be shown where a column says when its value was fixed, or by what clock its window counts."""
    there, asked, open_ = set(columns), [], 0
    features = schema.by_role(Role.FEATURE)
    for c in features:
        if c.availability in (None, Availability.UNKNOWN):
            asked.append(f"Is it known at the decision what {c.name} is?")
            open_ += 1
        elif c.availability is Availability.AT_DECISION and not {c.value_as_of, c.clock, c.measured_at} & there:
            asked.append(f"Is {c.name} the value of the decision's moment, as {c.source} says?")
            open_ += 1
    causes = [f"Does it hold that {a}?" for a in outcome.taken_on_trust()]
    causes += [f"Does the status {c.status} mean that the event {c.meaning.value.replace('_', ' ')}?" for c in outcome.distinguishable]
    return Unknowns((*asked, *causes), open_ / len(features) if features else None, len(causes))


@dataclass(frozen=True)
class Conclusion:
    statement: str
    protocol: str
    at: dt.datetime = field(default_factory=lambda: dt.datetime.now(dt.UTC))


@dataclass
class Study:
    """Findings, samples, assumptions and conclusions, rendered as Markdown."""

    title: str
    estimand: str
    report: Report
    samples: SampleLedger
    declarations: str = ""
    assumptions: Assumptions = field(default_factory=Assumptions)
    unknowns: Unknowns = field(default_factory=lambda: Unknowns((), None, 0))
    measurements: list[str] = field(default_factory=list)
    conclusions: list[Conclusion] = field(default_factory=list)

    @property
    def overrides(self) -> OverrideLedger:
        return self.samples.overrides

    def digest(self) -> str:
        """Changes with whatever can change a conclusion: declarations, measurements, uses of samples, overrides and findings."""
        uses = [f"{a.sample} {a.purpose.value} {a.decision}" for a in self.samples.accesses]
        passed = [f"{o.requirement} {o.author} {o.reason}" for o in self.overrides.entries]
        found = sorted({x.finding for x in self.report.findings})
        parts = [self.declarations, *self.measurements, "uses", *uses, "overrides", *passed, "findings", *found]
        return hashlib.sha256("\n".join(parts).encode()).hexdigest()[:12]

    def measured(self, verdict) -> None:
        self.measurements.append(verdict.text())

    def conclude(self, statement) -> Conclusion:
        """Draws a conclusion, from words or from a verdict, which counts as measured.  Earlier ones stay: they are part of the report."""
        if not isinstance(statement, str):
            self.measured(statement)
            statement = statement.text()
        self.conclusions.append(Conclusion(statement, self.digest()))
        return self.conclusions[-1]

    @property
    def stale(self) -> bool:
        """Whether something changed after the last conclusion."""
        return bool(self.conclusions) and self.conclusions[-1].protocol != self.digest()

    @property
    def follows_the_protocol(self) -> bool:
        """Whether the conclusion ever changed along with what it was drawn from."""
        pairs = zip(self.conclusions, self.conclusions[1:], strict=False)
        return any(a.statement != b.statement and a.protocol != b.protocol for a, b in pairs)

    def _concluded(self) -> list[str]:
        out = ["## Conclusion", ""]
        if not self.conclusions:
            return [*out, "None yet."]
        out += [self.conclusions[-1].statement, "", f"Protocol: `{self.conclusions[-1].protocol}`"]
        if self.stale:
            out += ["", "**The protocol changed after this was concluded; it holds for the state before.**"]
        if len(self.conclusions) > 1:
            out += ["", "### Earlier conclusions", "", *(f"{k}. {c.statement} (`{c.protocol}`)" for k, c in enumerate(self.conclusions, 1))]
            out += ["", "The conclusion changed together with the protocol."] if self.follows_the_protocol else []
        return out

    def _found(self) -> list[str]:
        out = ["## Findings", ""]
        out += [f"- **{f.requirement}** {'blocking' if f.blocking else 'advisory'}: {f.detail}" for f in self.report.findings] or ["None."]
        if self.report.limits:
            out += ["", "What went unseen:", "", *(f"- {k}: {v}" for k, v in self.report.limits.items())]
        return [*out, "", "## Not checked", "", *([f"- {s.requirement}: {s.reason}" for s in self.report.skipped] or ["None."])]

    def _asked(self) -> list[str]:
        out = ["## Questions to the owner of the data", ""]
        if self.unknowns.uncertain is not None:
            out += [f"Features whose availability only the declaration shows: {self.unknowns.uncertain:.0%}. Questions about causes of missing events: {self.unknowns.of_causes}.", ""]
        return [*out, *(f"- {q}" for q in self.unknowns.questions)]

    def render(self) -> str:
        passed = [f"- {o.requirement}, {o.author}: {o.reason}" for o in self.overrides.entries] or ["None."]
        parts = [[f"# {self.title}", "", f"Estimand: {self.estimand}"], self._concluded(), self._found(), *([["## Measured", "", *self.measurements]] if self.measurements else []), self._asked(), [self.samples.section()], [self.assumptions.section()], ["## Overrides", "", *passed]]
        return "\n\n".join("\n".join(p) for p in parts) + "\n"
