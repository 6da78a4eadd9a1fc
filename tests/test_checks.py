"""Needs of checks, the passes that answer them, and rules over planted answers."""

import datetime as dt
from dataclasses import replace

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import stats
from decidra.operators import passes
from decidra.operators.checks import CHECKS, Check, Context, Facts, Finding, audit
from decidra.operators.label import LABEL
from decidra.operators.passes import Answers, Facet, Needs, NeedsDiffer, Part, Rank
from decidra.operators.split import EVALUATE, overlap
from decidra.schema import Availability, ColumnSpec, DeclarationError, Grain, Role, Schema, Simultaneous, Task

from .test_decisions import ORIGIN, OUTCOME, TASK, columns, split_of, world


def executions(spark, act):
    """What ``act`` gives, and how many queries ran for it."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    before = store.executionsCount()
    out = act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty(30_000)
    return out, store.executionsCount() - before


def heavy(f):
    n = f.sums["heavy"]
    days = [d for d, m in f.facet("day") if m["big"]]
    return [Finding("Z1", "heavy_rows", f"{n} rows", False, metrics={"rows": n, "days": len(days), "regions": f.answers.keys["region"].different})]


def test_a_check_of_ones_own_joins_the_passes(spark):
    def needs(c):
        big = F.col("size") > 100
        return Needs({"heavy": F.count_if(big)}, {"day": Facet(F.to_date(c.decision), {"big": big})}, {"region": F.col("region")})

    df, schema = world(spark), columns()
    without, usual = executions(spark, lambda: audit(split_of(df, schema), schema, OUTCOME, TASK))
    own, more = executions(spark, lambda: audit(split_of(df, schema), schema, OUTCOME, TASK, more=[Check("Z1", heavy, needs=needs)]))
    assert usual == more <= 8
    assert "Z1" not in CHECKS and without.findings == own.findings[:-1]
    want = df.where("size > 100").agg(F.count("*"), F.count_distinct(F.to_date("decided_at"))).first()
    assert tuple(own.findings[-1].metrics.values()) == (*want, 4)


def test_needs_unite_and_must_agree(spark):
    a = Needs({"x": F.count("*")}, {"day": Facet(F.col("d"), {"n": F.lit(1)})}, parts={"p": Part(F.lit(True), F.col("y"), (0.5,))}, numbers=("u",))
    b = Needs({"x": F.count("*")}, {"day": Facet(F.col("d"), {"k": F.col("e")})}, parts={"p": Part(F.lit(True), F.col("y"), (0.9,))}, numbers=("v", "u"))
    both = a | b
    assert set(both.facets["day"].measures) == {"n", "k"} and both.parts["p"].shares == (0.5, 0.9) and both.numbers == ("u", "v")
    for other in (Needs({"x": F.count("y")}), Needs(facets={"day": Facet(F.col("e"), {})}), Needs(parts={"p": Part(F.col("z"), F.col("y"))})):
        with pytest.raises(NeedsDiffer):
            a | other


def _level_strength(values, labels):
    """Brute force: levels by the rate of their labels, then the pairs that are ordered rightly."""
    kept = [(v, y) for v, y in zip(values, labels, strict=True) if v is not None and y is not None]
    rate = {v: np.mean([y for w, y in kept if w == v]) for v in {v for v, _ in kept}}
    one, zero = ([rate[v] for v, y in kept if y == k] for k in (1, 0))
    return sum((a > b) + (a == b) / 2 for a in one for b in zero) / (len(one) * len(zero)) - 0.5


def test_passes_equal_the_single_statistics(spark):
    schema, r = columns(), np.random.default_rng(3)
    s = split_of(world(spark, rows=1200, region=lambda c: [[None, "a", "b", "c"][min(3, k % 7)] if k % 7 < 5 else ("b" if x > 30 else "d") for k, x in enumerate(c["lead_days"])], size=lambda c: [None if x < 0.1 else float(np.round(x, 2)) for x in r.random(len(c["size"]))]), schema)
    windows = {f"window:{w.name}": Part(s.in_evaluate(w), F.col(LABEL), (0.05, 0.95)) for w in s.windows}
    sides = {w.name: (s.in_train(w), s.in_evaluate(w)) for w in s.windows}
    needs = Needs(parts=windows | {"pooled": Part(F.lit(True), F.col(LABEL))}, numbers=("lead_days", "size"), strings=("region", "entity_id"), ranked_strings=("pooled",), keys={"region": F.col("region")})
    got = passes.answered(s.labelled, needs, sides, 50, 50)
    rows = s.tagged().where(F.col("side") == EVALUATE)
    for x in stats.association(rows, ["lead_days", "size"], LABEL, ["window"]).collect():
        mine = got.ranks[f"window:{x.window}", x.feature]
        assert (mine.rows, mine.positives) == (x.rows, x.positives) and mine.association == pytest.approx(x.association, abs=1e-12)
    for w in s.windows:
        values = [v[0] for v in s.evaluate(w).select("size").collect() if v[0] is not None]
        rank = got.ranks[f"window:{w.name}", "size"]
        assert rank.valued == len(values) and np.allclose(rank.quantiles, np.quantile(values, [0.05, 0.95]))
    pairs = s.labelled.select("region", LABEL).collect()
    assert got.ranks["pooled", "region"].association == pytest.approx(_level_strength(*zip(*pairs, strict=True)), abs=1e-12)
    assert ("pooled", "entity_id") not in got.ranks  # a level for each row
    assert got.keys["region"].shared == {x.window: x.shared for x in overlap(s, "region").collect()}
    empty = passes.answered(s.labelled.limit(0), needs, sides, 50, 50)
    assert not empty.ranks and not empty.keys


def test_string_leaks_are_found(spark):
    from .test_decisions import found

    leak = {"region": lambda c: ["late" if e.date() > d.date() else "in time" for e, d in zip(c["event_at"], c["deadline_on"], strict=True)]}
    assert found(spark, **leak) == {"feature_separates_outcome"}


def facts(sums=None, facets=None, ranks=None, task=TASK, schema=None, windows=3, reserve=True, frames=None):
    class Declared(Context):
        types = {"lead_days": None}
        columns = []

    class Parts:
        pass

    split = Parts()
    split.windows = [type("W", (), {"name": f"w{k}"})() for k in range(windows)]
    split.reserve_from = ORIGIN if reserve else None
    return Facts(Declared(schema or columns(), OUTCOME, task, split), Answers(sums or {}, facets or {}, {}, ranks or {}), frames or {})


def rates(*pairs, reserve=None):
    out = {}
    for k, (p, n) in enumerate(pairs):
        out |= {f"positives:w{k}": p, f"labelled:w{k}": n}
    if reserve:
        out |= {"positives:reserve": reserve[0], "labelled:reserve": reserve[1]}
    return out


def n3(*pairs, reserve=None):
    return {(x.finding, x.subject) for x in CHECKS["N3"].rule(facts(rates(*pairs, reserve=reserve), windows=len(pairs)))}


def test_rates_of_windows_and_reserve():
    rising = ((459, 1000), (476, 1000), (600, 1000))
    assert n3(*rising) == {("rate_trend", "unknown")}
    assert n3(*rising, reserve=(30, 50)) == {("rate_trend", "unknown")}  # too small
    assert n3(*rising, reserve=(600, 1000)) == {("rate_trend", "flat"), ("reserve_rate_differs", "reserve")}
    assert n3(*rising, reserve=(800, 1000)) == {("rate_trend", "continues"), ("reserve_rate_differs", "reserve")}
    assert n3(*rising, reserve=(300, 1000)) == {("rate_trend", "reverses"), ("reserve_rate_differs", "reserve")}
    assert n3(*rising[::-1], reserve=(300, 1000)) == {("rate_trend", "continues"), ("reserve_rate_differs", "reserve")}
    assert n3((87, 1000), (91, 1000), (88, 1000), reserve=(89, 1000)) == set()
    assert n3((8700, 100_000), (9100, 100_000), (8800, 100_000), reserve=(11_900, 100_000)) == {("reserve_rate_differs", "reserve")}
    assert n3((0, 1000), (50, 1000)) == {("rate_drift", None)}  # an infinite ratio
    assert n3((1000, 1000), (1000, 1000), reserve=(1000, 1000)) == set()
    assert n3((2, 1000), (3, 1000)) == set()  # noise
    assert n3((100, 1000), (100, 1000), (400, 1000)) == {("rate_drift", None)}  # not strictly rising


def test_small_reserves_are_named():
    out = CHECKS["P9"].rule(facts(rates((10, 500), (10, 99), (10, 200), reserve=(5, 40))))
    assert [(x.subject, x.metrics["rows"]) for x in out] == [("w1", 99), ("reserve", 40)]


def kinds(simultaneous, value=None, **more):
    task = Task(competing=True, simultaneous=simultaneous, simultaneous_kind=value)
    f = facts(facets={"kind": [("both", {"n": 3}), ("fire", {"n": 5}), ("flood", {"n": 9}), (None, {"n": 1})]}, task=task, **more)
    return {x.finding for x in CHECKS["N12"].rule(f)}


def test_simultaneity_is_held_against_the_data():
    assert kinds(None) == {"simultaneity_undeclared"}
    assert kinds(Simultaneous.NOT_POSSIBLE, "both") == {"simultaneity_contradicted"}
    assert kinds(Simultaneous.OWN_KIND, "both") == set() == kinds(Simultaneous.NOT_POSSIBLE, "storm") == kinds(Simultaneous.EXCLUDED)
    assert kinds(Simultaneous.EXCLUDED, "storm") == {"simultaneity_contradicted"}
    moments = [type("R", (), {"moments": 2, "rows": 5})()]
    assert kinds(Simultaneous.NOT_POSSIBLE, frames={"at one instant": moments}) == {"kinds_at_one_instant"}


def test_events_of_one_object_at_one_instant(spark):
    t = lambda k: ORIGIN + dt.timedelta(days=k)
    rows = [("a", t(0), t(9), t(3), "fire"), ("a", t(1), t(9), t(3), "flood"), ("a", t(2), t(9), t(4), "fire"), ("b", t(0), t(9), t(3), "flood"), ("c", t(0), t(9), None, None), ("c", t(0), t(9), None, "fire")]
    schema = Schema((ColumnSpec("k", Role.ENTITY_ID), ColumnSpec("decided_at", Role.DECISION_TIME, Grain.INSTANT), ColumnSpec("deadline_on", Role.DEADLINE, Grain.INSTANT, value_as_of="decided_at"), ColumnSpec("event_at", Role.OUTCOME_COMPONENT, Grain.INSTANT), ColumnSpec("kind", Role.EVENT_KIND)))
    df = spark.createDataFrame(rows, "k string, decided_at timestamp_ntz, deadline_on timestamp_ntz, event_at timestamp_ntz, kind string")
    task = Task(competing=True, simultaneous=Simultaneous.NOT_POSSIBLE)
    out = audit(split_of(df, schema), schema, OUTCOME, task)
    assert [x.metrics for x in out.findings if x.finding == "kinds_at_one_instant"] == [{"moments": 1, "rows": 2}]


def clocked(clock, *stamps):
    feature = ColumnSpec("lead_days", Role.FEATURE, availability=Availability.AT_DECISION, source="form", window_days=(0.0, 30.0), clock=clock, value_as_of="decided_at")
    return replace(columns(), columns=(*(c for c in columns().columns if c.name != "lead_days"), feature, *stamps))


def test_clocks_of_windows(spark):
    stamps = ColumnSpec("reported", Role.AVAILABLE_AT, Grain.INSTANT), ColumnSpec("taken", Role.MEASURED_AT, Grain.INSTANT)
    late = {"reported": lambda c: [str(d + dt.timedelta(days=k % 4 == 0)) for k, d in enumerate(c["decided_at"])], "taken": lambda c: [str(d - dt.timedelta(days=k % 50 == 0)) for k, d in enumerate(c["decided_at"])]}

    def s9(schema, **change):
        df = world(spark, rows=400, **change)
        df = df.withColumns({c: F.col(c).cast("timestamp_ntz") for c in ("reported", "taken") if c in df.columns})
        return [(x.finding, x.metrics) for x in audit(split_of(df, schema), schema, OUTCOME, TASK).findings if x.requirement == "S9"]

    assert s9(clocked(None)) == [("window_clock_undeclared", {})]
    assert s9(clocked("decided_at", *stamps), **late) == [("window_clock_unknowable", {"share": 0.25})]
    assert s9(clocked("decided_at", stamps[1]), taken=late["taken"]) == []  # measured before the decision
    assert s9(clocked("taken"), taken=late["taken"]) == []  # known at the decision: 2 % lie before it
    assert s9(clocked("elsewhere")) == []  # the clock isn't in the table
    with pytest.raises(DeclarationError):
        ColumnSpec("x", Role.FEATURE, clock="decided_at")


def test_revised_values(spark):
    schema = Schema(tuple(replace(c, value_as_of={"size": None, "lead_days": "event_at"}.get(c.name, c.value_as_of)) for c in columns().columns))
    out = [(x.finding, x.subject) for x in audit(split_of(world(spark, rows=300), schema), schema, OUTCOME, TASK).findings if x.requirement == "S10"]
    assert out == [("value_revised_after_decision", "lead_days"), ("value_as_of_undeclared", "size")]


def test_worst_days(spark):
    early = lambda c: [d - dt.timedelta(days=k % 41) if k % 40 == 0 else e for k, (d, e) in enumerate(zip(c["decided_at"], c["event_at"], strict=True))]
    schema = columns()
    found = [x for x in audit(split_of(world(spark, rows=500, event_at=early), schema), schema, OUTCOME, TASK).findings if x.finding == "event_before_decision"]
    assert found[0].metrics == {"rows": 12, "worst_days": 40}

