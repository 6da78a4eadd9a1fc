"""Isotonic fits, thresholds by cost, and bounds by cause against brute force."""

import datetime as dt
import itertools

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import calibration as c
from decidra.operators import label
from decidra.schema import Cause, Comparison, DeclarationError, Missing, Outcome, Positive

T = dt.datetime(2024, 1, 10)


def isotonic(s, y):
    """The largest over all starts of the least over all ends of the mean between."""
    values = sorted(set(s))
    n = [sum(x == v for x in s) for v in values]
    p = [sum(z for x, z in zip(s, y, strict=True) if x == v) for v in values]
    rate = lambda j, k: sum(p[j : k + 1]) / sum(n[j : k + 1])
    return {v: max(min(rate(j, k) for k in range(i, len(values))) for j in range(i + 1)) for i, v in enumerate(values)}


def test_isotonic_fit_equals_brute_force(spark):
    r = np.random.default_rng(4)
    s = np.concatenate([np.round(r.normal(size=150), 1), [0.0, -0.0, 1e300, -5e-324, 0.5, 0.5000001]])
    y = (r.random(len(s)) < 1 / (1 + np.exp(-s))).astype(int)
    df = spark.createDataFrame([*((float(a), int(b)) for a, b in zip(s, y, strict=True)), (None, 1), (0.3, None)], "s double, y int").repartition(6)
    want = isotonic((s + 0.0).tolist(), y.tolist())
    blocks = c.isotonic(df, "s", "y")
    rates = [x.rate for x in blocks.orderBy("lo").collect()]
    assert rates == sorted(set(rates)) and blocks.agg(F.sum("rows"), F.sum("positives")).first() == (len(s), int(y.sum()))
    got = {x.s: x.calibrated for x in c.calibrated(df.where("y IS NOT NULL"), "s", blocks).collect()}
    assert got.pop(None) is None and set(got) == set(want)
    for v, rate in want.items():
        assert got[v] == pytest.approx(rate, abs=1e-12)
    assert c.isotonic(df.limit(0), "s", "y").count() == 0


def test_calibrated_scores_between_and_beyond_blocks(spark):
    df = spark.createDataFrame([(1.0, 0), (2.0, 0), (4.0, 1), (3.0, 1), (3.0, 0)], "s double, y int")
    blocks = c.isotonic(df, "s", "y")
    assert [tuple(x)[:2] for x in blocks.orderBy("lo").collect()] == [(1.0, 2.0), (3.0, 3.0), (4.0, 4.0)]
    xs = [-7.0, 1.5, 2.5, 3.5, 9.0]
    got = {x.s: x.calibrated for x in c.calibrated(spark.createDataFrame([(x, 1) for x in xs] * 2, "s double, k int"), "s", blocks).collect()}
    knots = ([1, 2, 3, 4], [0, 0, 0.5, 1])
    assert got == pytest.approx({x: float(np.interp(x, *knots)) for x in xs})
    assert c.calibrated(df, "s", blocks.limit(0)).where("calibrated IS NOT NULL").count() == 0


def test_blocks_of_stretches_merge_to_those_of_the_whole():
    r = np.random.default_rng(9)
    for _ in range(300):
        cells = [(float(k), float(k), int(n), int(r.integers(0, n + 1))) for k, n in enumerate(r.integers(1, 5, r.integers(1, 20)))]
        cut = int(r.integers(0, len(cells) + 1))
        assert c.pooled(c.pooled(cells[:cut]) + c.pooled(cells[cut:])) == c.pooled(cells)


def test_costs_of_misses(spark):
    r = np.random.default_rng(5)
    s, y = r.random(300), (r.random(300) < 0.3).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)] + [(0.9, None), (None, 1)], "s double, y int")
    grid = c.threshold_grid(df.where("y IS NOT NULL"), "s", 20)
    assert len(grid) == 20 and np.allclose(grid, np.round(np.quantile(s, np.linspace(0.5, 0.999, 20)), 6))
    for row in c.miss_cost_sensitivity(df, "s", "y", grid, [1.5, 4, 20]).collect():
        cost = [((s >= t).sum() + ((s < t) & (y == 1)).sum() * row.miss_cost, t) for t in grid]
        assert (row.cost, row.threshold) == min(cost)
        assert row.do_nothing == y.sum() * row.miss_cost and row.act_on_all == 300 and row.gain == min(row.do_nothing, 300) - row.cost
    assert c.threshold_grid(df.limit(0), "s") == []


OPTIONS = {Missing.UNOBSERVED: lambda after, mature: (0, 1), Missing.EXCLUDED: lambda after, mature: (None,), Missing.NOT_OCCURRED: lambda after, mature: (int(after),) if mature else (None,)}


@pytest.mark.parametrize("positive", list(Positive))
@pytest.mark.parametrize("means", [m for k in (1, 2, 3) for m in itertools.combinations(Missing, k)])
def test_bounds_hold_every_way_to_read_missing_events(spark, positive, means):
    """All choices of a meaning and a label for each row without an event."""
    after = positive is Positive.AFTER
    out = Outcome("e", "d", Comparison.DIRECT, positive, tuple(Cause(f"c{k}", m, assumption="it is so") for k, m in enumerate(means)))
    day = lambda k: T + dt.timedelta(days=k)
    rows = [(day(-9), day(-5), day(-6)), (day(-9), day(-5), day(-4)), (day(-9), day(-5), day(-7)), (day(-9), day(-5), None), (day(-9), day(-4), None), (day(-9), day(5), None)]
    df = spark.createDataFrame(rows, "t timestamp_ntz, d timestamp_ntz, e timestamp_ntz")
    got = label.cause_bounds(df, out, "t", F.lit(T).cast("timestamp_ntz")).first()
    n, p = 3, sum((e > d) == after for _, d, e in rows[:3])
    choices = [[x for m in means for x in OPTIONS[m](after, d < T)] for _, d, e in rows[3:]]
    rates = [(p + sum(x for x in pick if x is not None)) / (n + sum(x is not None for x in pick)) for pick in itertools.product(*choices)]
    assert (got.low, got.high) == (pytest.approx(min(rates)), pytest.approx(max(rates)))
    assert got["class"] == "indistinguishable" and got.rows == 3 and got.conflated == (len(means) > 1) and sorted(got.meanings) == sorted(m.value for m in means)


def test_causes_and_estimand():
    causes = (Cause("open", Missing.NOT_OCCURRED, "O"), Cause("lost", Missing.UNOBSERVED, assumption="losses are random"), Cause("void", Missing.EXCLUDED, assumption="voids are silent"))
    out = Outcome("e", "d", Comparison.BY_DATE, Positive.AFTER, causes)
    assert out.conflated and out.fallback() is None and out.by_status() == {"O": Missing.NOT_OCCURRED}
    assert set(out.classes()) == {"O", None} and out.classes()[None] == causes[1:] and out.taken_on_trust() == ("losses are random", "voids are silent")
    said = out.estimand("orders of 2024", T)
    for part in ("e comes after d, or not at all", "calendar date", "among orders of 2024", "until 2024-01-10", "open means not_occurred", "lost means unobserved", "void means excluded"):
        assert part in said
    assert "or not at all" not in Outcome("e", "d", Comparison.DIRECT, Positive.WITHIN, ()).estimand()
    with pytest.raises(DeclarationError):
        Outcome("e", "d", Comparison.DIRECT, Positive.WITHIN, (causes[0], Cause("shut", Missing.EXCLUDED, "O")))
