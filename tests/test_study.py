"""Assumptions, questions, and conclusions that are bound to what they were drawn from."""

import pytest

from decidra.ledger import OverrideLedger, Purpose, SampleLedger
from decidra.operators.checks import Finding, Report, Skipped
from decidra.schema import Availability, Cause, ColumnSpec, Comparison, DeclarationError, Missing, Outcome, Positive, Role
from decidra.study import Assumption, Assumptions, Basis, Study, unknowns

from .test_decisions import columns


def test_assumptions_need_grounds():
    known = Assumptions()
    known.record("ids are never used again", Basis.OWNER, "me", "histories mix")
    known.record("deadlines are never revised", Basis.DATA, "me", "labels are circular", "count of changes, 3 May")
    assert known.questions() == ["Does it hold that ids are never used again? (else histories mix)"]
    assert len(known.by_basis(Basis.DATA)) == 1 and "| data |" in known.section() and "To be asked" in known.section()
    for basis in (Basis.DATA, Basis.DOCUMENT):
        with pytest.raises(DeclarationError):
            Assumption("x", basis, "me", "y")
    for empty in (("", "me", "y"), ("x", " ", "y"), ("x", "me", "")):
        with pytest.raises(DeclarationError):
            Assumption(empty[0], Basis.DOMAIN, *empty[1:])
    assert "None recorded" in Assumptions().section()


def test_questions_come_from_declarations():
    f = lambda n, **k: ColumnSpec(n, Role.FEATURE, **({"availability": Availability.AT_DECISION, "source": "the form"} | k))
    schema = columns(f("dated", value_as_of="decided_at"), f("undated"), f("elsewhere", value_as_of="gone"), f("open", availability=None), f("later", availability=Availability.AFTER))
    out = Outcome("event_at", "deadline_on", Comparison.DIRECT, Positive.AFTER, (Cause("a", Missing.NOT_OCCURRED, "A"), Cause("b", Missing.UNOBSERVED, assumption="losses are random")))
    got = unknowns(schema, out, ["decided_at", "dated", "undated", "elsewhere", "open", "later", "size", "lead_days", "region"])
    assert got.uncertain == 3 / 8 and got.of_causes == 2
    assert [q.split()[-6 if "Is it" in q else 1] for q in got.questions[:3]] and sum("undated" in q or "elsewhere" in q or "open" in q for q in got.questions) == 3
    assert "Does it hold that losses are random?" in got.questions and any("status A" in q for q in got.questions)


def study():
    report = Report([Finding("A3", "duplicate_rows", "2 rows repeat others", False)], [Skipped("N14", "no groups")], {"N4": "below 0.1"})
    return Study("Title", "a probability", report, SampleLedger(columns(), OverrideLedger()), "declared")


def test_conclusions_are_bound_to_their_protocol(spark):
    s = study()
    assert not s.stale and "None yet." in s.render()
    first = s.conclude("the model isn't better")
    assert not s.stale and first.protocol == s.digest() and not s.follows_the_protocol
    s.samples.register("a", spark.range(3).withColumnRenamed("id", "entity_id"), "entity_id")
    assert not s.stale  # registering uses nothing
    s.samples.checkout("a", Purpose.FITTING, "a second model")
    assert s.stale and "changed after" in s.render()
    s.conclude("the model isn't better")
    assert not s.stale and not s.follows_the_protocol
    for change in (lambda: s.overrides.add("P1", "a reason of some length", "me"), lambda: s.report.findings.append(Finding("A6", "truncated_tail", "thin", True)), lambda: setattr(s, "declarations", "other"), lambda: s.measurements.append("auc 0.7")):
        before = s.digest()
        change()
        assert s.digest() != before and s.stale
    s.conclude("the model is better")
    text = s.render()
    assert s.follows_the_protocol and "changed together" in text and "Earlier conclusions" in text and len(s.conclusions) == 3
    for part in ("Estimand: a probability", "**A3** advisory", "N14: no groups", "N4: below 0.1", "a, fitting: a second model", "P1, me", "auc 0.7"):
        assert part in text
