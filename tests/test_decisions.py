import datetime as dt
from fractions import Fraction

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra import governance as g
from decidra.functions import stats
from decidra.operators import label, split
from decidra.operators.checks import audit
from decidra.operators.split import Split
from decidra.project import built, parse, run
from decidra.schema import Availability, Cause, ColumnSpec, Comparison, DeclarationError, Grain, Missing, Outcome, Period, Positive, Role, Schema, Task

ORIGIN = dt.datetime(2024, 1, 1)


def world(spark, rows=3000, days=540, seed=7, **change):
    """A clean decision table; ``change`` maps columns to functions of the column dictionary."""
    r = np.random.default_rng(seed)
    at = np.sort(r.integers(0, days * 24, rows))
    lead = r.integers(3, 40, rows)
    late = r.random(rows) < 0.55 / (1 + lead / 6)
    cols = {"entity_id": [f"e{k:06d}" for k in range(rows)], "decided_at": [ORIGIN + dt.timedelta(hours=int(a)) for a in at], "lead_days": lead.tolist(), "size": np.round(r.gamma(2, 30, rows), 2).tolist(), "region": r.choice(["north", "south", "east", "west"], rows).tolist()}
    cols["deadline_on"] = [dt.datetime.combine(d.date(), dt.time()) + dt.timedelta(days=int(k)) for d, k in zip(cols["decided_at"], lead, strict=True)]
    cols["event_at"] = [max(d + dt.timedelta(hours=1), e + dt.timedelta(hours=12, days=int(r.integers(1, 8)) if x else -int(r.integers(0, 3)))) for d, e, x in zip(cols["decided_at"], cols["deadline_on"], late, strict=True)]
    cols["status"] = ["completed"] * rows
    for name, f in change.items():
        cols[name] = f(cols)
    kinds = {"lead_days": "int", "size": "double", "decided_at": "timestamp_ntz", "deadline_on": "timestamp_ntz", "event_at": "timestamp_ntz"}
    return spark.createDataFrame(list(zip(*cols.values(), strict=True)), ", ".join(f"{c} {kinds.get(c, 'string')}" for c in cols))


def columns(*more, **features):
    f = lambda n: ColumnSpec(n, Role.FEATURE, availability=Availability.AT_DECISION, source="form", value_as_of="decided_at", **features.get(n, {}))
    return Schema((ColumnSpec("entity_id", Role.ENTITY_ID), ColumnSpec("decided_at", Role.DECISION_TIME, Grain.INSTANT), ColumnSpec("deadline_on", Role.DEADLINE, Grain.DATE, value_as_of="decided_at"), ColumnSpec("event_at", Role.OUTCOME_COMPONENT, Grain.INSTANT), ColumnSpec("status", Role.STATUS), f("lead_days"), f("size"), f("region"), *more))


OUTCOME = Outcome("event_at", "deadline_on", Comparison.BY_DATE, Positive.AFTER, (Cause("pending", Missing.NOT_OCCURRED, "pending"), Cause("aborted", Missing.EXCLUDED, "aborted")), degenerate_below=0.01)
TASK = Task(has_process=True, is_stream=True)


def split_of(df, schema, outcome=OUTCOME):
    snapshot = dt.datetime(2026, 1, 1)
    day = lambda k: ORIGIN + dt.timedelta(days=k)
    windows = tuple(Period(f"w{k}", day(297 + 43 * k), day(297 + 43 * (k + 1))) for k in range(3))
    return Split(label.compute(df, outcome, schema, snapshot), "decided_at", windows, day(475))


def found(spark, schema=None, outcome=OUTCOME, **change):
    schema = schema or columns()
    return {f.finding for f in audit(split_of(world(spark, **change), schema, outcome), schema, outcome, TASK).findings}


def test_clean_world_has_no_findings(spark):
    assert found(spark) == set()


CASES = {
    "sentinel_as_value": {"region": lambda c: ["N/A" if k % 50 == 0 else v for k, v in enumerate(c["region"])]},
    "event_before_decision": {"event_at": lambda c: [d - dt.timedelta(days=1) if k % 40 == 0 else e for k, (d, e) in enumerate(zip(c["decided_at"], c["event_at"], strict=True))]},
    "event_at_decision": {"event_at": lambda c: [d if k % 40 == 0 else e for k, (d, e) in enumerate(zip(c["decided_at"], c["event_at"], strict=True))]},
    "feature_separates_outcome": {"size": lambda c: [float(e.date() > d.date()) * 100 + k % 7 for k, (e, d) in enumerate(zip(c["event_at"], c["deadline_on"], strict=True))]},
    "disjoint_support": {"size": lambda c: [s + 1000.0 * ((d - ORIGIN).days // 40) for s, d in zip(c["size"], c["decided_at"], strict=True)]},
    "missing_period": {"decided_at": lambda c: [d if not 200 <= (d - ORIGIN).days < 212 else ORIGIN + dt.timedelta(days=199) for d in c["decided_at"]]},
    "undeclared_column": {"extra": lambda c: [str(k) for k in range(len(c["size"]))]},
    "status_conflicts_with_event": {"event_at": lambda c: [None if k % 5 == 0 else e for k, e in enumerate(c["event_at"])], "status": lambda c: ["pending" if k % 5 == 0 or k % 11 == 0 else s for k, s in enumerate(c["status"])]},
}


@pytest.mark.parametrize("finding", list(CASES))
def test_planted_defects_are_found(spark, finding):
    assert finding in found(spark, **CASES[finding])


def test_declarations_are_checked(spark):
    late = ColumnSpec("size", Role.FEATURE, availability=Availability.AFTER, source="form")
    schema = Schema(tuple(late if c.name == "size" else c for c in columns().columns))
    assert "feature_after_decision" in found(spark, schema)
    assert "direction_contradicted" in found(spark, columns(lead_days={"direction": 1}))
    assert "degeneracy_undeclared" in found(spark, outcome=Outcome("event_at", "deadline_on", Comparison.BY_DATE, Positive.AFTER, OUTCOME.causes))
    with pytest.raises(DeclarationError):
        label.compute(world(spark, rows=10), Outcome("event_at", "deadline_on", Comparison.DIRECT, Positive.AFTER, ()), columns())
    with pytest.raises(DeclarationError):
        label.compute(world(spark, rows=10, event_at=lambda c: [None] * 10, status=lambda c: ["odd"] * 10), OUTCOME, columns())
    for bad in (lambda: ColumnSpec("x", Role.FEATURE, availability=Availability.AT_DECISION), lambda: ColumnSpec("x", Role.DEADLINE), lambda: Schema((ColumnSpec("x", Role.IGNORED),)), lambda: Cause("x", Missing.EXCLUDED)):
        with pytest.raises(DeclarationError):
            bad()


def test_label_traps(spark):
    t = lambda d, h=0: dt.datetime(2024, 1, d, h)
    rows = [
        ("late", t(1), t(5), t(6), "completed"), ("same day", t(1), t(5), t(5, 13), "completed"), ("mature", t(1), t(5), None, "pending"), ("immature", t(1), t(10), None, "pending"), ("aborted", t(1), t(5), None, "aborted"), ("before", t(4), t(5), t(3), "completed"), ("no deadline", t(1), None, t(3), "completed"), ("no status", t(1), t(5), None, None),
    ]
    df = spark.createDataFrame(rows, "entity_id string, decided_at timestamp_ntz, deadline_on timestamp_ntz, event_at timestamp_ntz, status string")
    got = {r.entity_id: (r[label.LABEL], r[label.REASON], r[label.KNOWN_AT]) for r in label.compute(df, OUTCOME, columns(), t(10)).collect()}
    assert got["late"] == (1, "observed", t(6)) and got["same day"] == (0, "observed", t(5, 13))
    assert got["mature"] == (1, "observed", t(6)) and got["immature"] == (None, "immature", t(11))
    assert got["aborted"][:2] == (None, "excluded") and got["before"][:2] == (None, "before_decision")
    assert got["no deadline"] == (None, "observed", None) and got["no status"][:2] == (None, "conflated")


def test_split_is_strict_and_partition_invariant(spark):
    schema, df = columns(), world(spark)
    s = split_of(df, schema)
    w = s.windows[1]
    assert s.train(w).where(F.col(label.KNOWN_AT) >= F.lit(w.start).cast("timestamp_ntz")).count() == 0
    again = split_of(df.repartition(13), schema)
    assert sorted(map(tuple, s.counts().collect())) == sorted(map(tuple, again.counts().collect()))
    assert all(r.shared == 0 for r in split.overlap(s, "entity_id").collect())
    with pytest.raises(DeclarationError):
        Split(s.labelled, "decided_at", s.windows, s.windows[0].start)


def form():
    role = lambda n, r, **k: {"name": n, "role": r, **k}
    feature = {"availability": "at_decision", "source": "form", "value_as_of": "decided_at"}
    return {
        "title": "Late deliveries", "observed_until": "2026-01-01T00:00:00",
        "columns": [role("entity_id", "entity_id"), role("decided_at", "decision_time", grain="instant"), role("deadline_on", "deadline", grain="date", value_as_of="decided_at"), role("event_at", "outcome_component", grain="instant"), role("status", "status"), role("lead_days", "feature", **feature), role("size", "feature", **feature), role("region", "feature", **feature)],
        "outcome": {"event": "event_at", "deadline": "deadline_on", "comparison": "by_date", "positive": "event_after_deadline", "degenerate_below": 0.01, "causes": [{"name": "pending", "meaning": "not_occurred", "status": "pending"}]},
        "task": {"has_process": True, "is_stream": True},
        "split": {"windows": [{"name": f"w{k}", "from_day": 297 + 43 * k, "to_day": 340 + 43 * k} for k in range(3)], "reserve_from_day": 475},
    }


def lead_score(frame, sign=1, base=0.0):
    return frame.select("entity_id", (base + sign * 0.55 / (1 + F.col("lead_days") / 6)).alias("score"))


def test_project_run_and_measurement(spark):
    with pytest.raises(DeclarationError):
        parse(form() | {"odd": 1})
    result = run(parse(form()), world(spark))
    samples = result.samples
    assert not result.report.blocking and set(samples.unspent()) == {"w0", "w1", "w2", "reserve"}
    with pytest.raises(g.Blocked):
        samples.training("w2", ["event_at"])
    fit = samples.training("w2", ["lead_days"])
    assert g.known_before(fit.frame, ORIGIN + dt.timedelta(days=383)) and samples.features == ("lead_days",)
    reserve = samples.checkout("reserve", g.Purpose.AUDIT, "to score it")
    scores = lead_score(reserve)
    with pytest.raises(g.Blocked):
        g.measure_against_baseline(samples, "reserve", scores.where("entity_id > 'e002900'"), g.Rule(constant=0.3), fit)
    assert not samples.was_measured("reserve")
    verdict = g.measure_against_baseline(samples, "reserve", scores, g.Rule(constant=0.3), fit, g.Costs(Fraction(1), Fraction(4)), draws=60)
    by = {c.metric: c for c in verdict.comparisons}
    assert by["auc"].rule == 0.5 and by["auc"].model > 0.55 and by["auc"].low > 0 and by["brier"].high < 0.01
    assert list(by) == ["auc", "ece", "ap", "brier", "log_loss", "net_benefit"]
    known = reserve.select(label.LABEL, (0.55 / (1 + F.col("lead_days") / 6)).alias("s")).where(F.col(label.LABEL).isNotNull())
    assert by["ece"].model == pytest.approx(stats.calibration_error(known, "s", label.LABEL).first().ece)
    assert by["ap"].model == pytest.approx(stats.average_precision(known, "s", label.LABEL).first().ap)
    assert by["ece"].low <= by["ece"].difference <= by["ece"].high or by["ece"].decisive
    result.study.conclude(verdict)
    assert "auc" in result.study.render() and "or not at all" in result.study.render() and "reserve" not in samples.unspent()
    for purpose in (g.Purpose.MEASUREMENT, g.Purpose.SELECTION):
        with pytest.raises(g.Blocked):
            samples.checkout("reserve", purpose, "again")
    assert "reserve, measurement" in samples.section() and samples.frame(spark).count() == 3


def test_gate_refuses(spark):
    with pytest.raises(g.Blocked):
        g.gate(spark.createDataFrame([(dt.date(2024, 1, 1), 1)], "s date, y int"), "s", "y")
    with pytest.raises(g.Blocked):
        g.gate(spark.createDataFrame([(0.1, 2)], "s double, y int"), "s", "y")
    assert g.paired(spark.createDataFrame([(0.1, 0.2, 1)], "m double, r double, y int"), "m", "r", "y", "auc").reason == "a single class"
    assert "finite" in g.paired(spark.createDataFrame([(float("nan"), 0.2, 1)], "m double, r double, y int"), "m", "r", "y", "brier").reason


def test_contrast_and_stability(spark):
    result = run(parse(form()), world(spark))
    samples, names = result.samples, [f"w{k}" for k in range(3)]
    predictions = {w: lead_score(samples._sample(w).frame, 0.8, 0.5) for w in names}
    fits = {w: samples.training(w, ["lead_days"]) for w in names}
    rule = g.Rule(constant=0.5)
    for wrong in ({}, {"w0": fits["w2"]}, {"w0": None}):  # not named, from the future, none of the ledger's
        with pytest.raises(g.Blocked):
            g.stability_across_windows(samples, {"w0": predictions["w0"]}, rule, wrong, draws=5)
    assert set(samples.unspent()) == {*names, "reserve"}
    stable = g.stability_across_windows(samples, predictions, rule, fits, draws=40)
    assert stable.stable and stable.signs == {1} and samples.unspent() == ["reserve"]
    reserve = samples._sample("reserve").frame
    both = (fits["w2"], g.External("the vendor's model of 2020"))
    verdict = g.measure_contrast(samples, "reserve", lead_score(reserve, 0.8, 0.5), lead_score(reserve, -0.8, 0.5), both, ["auc"], draws=40)
    assert verdict.comparisons[0].low > 0


def test_builders_are_held_against_the_declarations(spark, tmp_path):
    project, path = parse(form()), str(tmp_path / "raw")
    world(spark, rows=600).write.parquet(path)
    result = built(project, lambda s, p: s.read.parquet(p), spark, path)
    assert set(result.samples.unspent()) == {"w0", "w1", "w2", "reserve"}
    for odd in (lambda s, p: s.read.parquet(p).drop("size"), lambda s, p: s.read.parquet(p).withColumn("later", F.lit(1))):
        with pytest.raises(DeclarationError):
            built(project, odd, spark, path)
