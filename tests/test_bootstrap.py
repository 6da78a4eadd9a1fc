"""The paired bootstrap against one that weighs all rows of each draw."""

import numpy as np
import pytest

from decidra import governance as g
from decidra.functions import bootstrap as b

DRAWS, SEED = 90, 5


def auc(s, y, w):
    order = np.argsort(s, kind="stable")
    s, y, w = s[order], y[order], w[order]
    n = np.array([w[s == v].sum() for v in np.unique(s)])
    p = np.array([(w * y)[s == v].sum() for v in np.unique(s)])
    below = np.cumsum(n - p) - (n - p)
    return (p * (below + (n - p) / 2)).sum() / (p.sum() * (n - p).sum())


def ap(s, y, w):
    values = np.unique(s)[::-1]
    n, p = (np.array([x[s == v].sum() for v in values]) for x in (w, w * y))
    with np.errstate(all="ignore"):
        return np.where(p > 0, np.cumsum(p) / np.cumsum(n) * p, 0).sum() / p.sum()


def brute(m, r, y, keys, cost):
    """All metrics of both scores, by cells with their weights."""
    cells = {}
    for a, c, z, k in zip(m, r, y, keys, strict=True):
        cells.setdefault((a, c, z), [0, k])[0] += 1
    mm, rr, yy = (np.array([c[j] for c in cells]) for j in range(3))
    w = b.weights(np.array([v[1] for v in cells.values()]), np.array([v[0] for v in cells.values()]), DRAWS, SEED)
    out = {}
    for name, s, all_s in (("m", mm, m), ("r", rr, r)):
        edges = np.quantile(all_s, np.linspace(0, 1, 11))
        place = np.clip(np.searchsorted(edges, s, side="right") - 1, 0, 9)
        for d in range(DRAWS + 1):
            x = w[:, d]
            act = s >= cost
            out.setdefault((name, "auc"), []).append(auc(s, yy, x))
            out.setdefault((name, "ap"), []).append(ap(s, yy, x))
            out.setdefault((name, "brier"), []).append((x * (s - yy) ** 2).sum() / x.sum())
            out.setdefault((name, "log_loss"), []).append(-(x * np.where(yy == 1, np.log(s), np.log1p(-s))).sum() / x.sum())
            out.setdefault((name, "net_benefit"), []).append((x * act * np.where(yy == 1, 1, -cost / (1 - cost))).sum() / x.sum())
            out.setdefault((name, "ece"), []).append(sum(abs((x * (s - yy))[place == k].sum()) for k in range(10)) / x.sum())
    return {k: np.array(v) for k, v in out.items()}


@pytest.mark.parametrize("heavy", [b.HEAVY, 3])
def test_bootstrap_equals_brute_force(spark, heavy):
    r = np.random.default_rng(8)
    n = 700
    y = (r.random(n) < 0.3).astype(int)
    m = np.clip(np.round(0.3 * y + r.random(n) * 0.6 + 0.02, 3), 0.02, 0.98)
    rule = np.where(m + r.normal(size=n) * 0.2 > 0.5, 0.75, np.where(r.random(n) < 0.5, 0.25, 0.2501))
    df = spark.createDataFrame([(float(a), float(c), int(z)) for a, c, z in zip(m, rule, y, strict=True)] + [(0.5, 0.5, None)], "a double, c double, y int").repartition(5)
    keys = {(x.m, x.r, x.y): x.k for x in b.cells(df, "a", "c", "y").collect()}
    want = brute(m, rule, y, [keys[float(a), float(c), int(z)] for a, c, z in zip(m, rule, y, strict=True)], 0.4)
    metrics = ["auc", "ece", "ap", "brier", "log_loss", "net_benefit"]
    got = b.bootstrapped(df, "a", "c", "y", metrics, 0.4, DRAWS, SEED, heavy)
    assert list(got) == metrics
    for metric, v in got.items():
        for side, point, draws in (("m", v.model, v.draws_model), ("r", v.rule, v.draws_rule)):
            np.testing.assert_allclose(np.concatenate([[point], draws]), want[side, metric], rtol=1e-9, atol=1e-12, err_msg=f"{metric} {side}")


def test_weights_are_poisson_numbers_of_each_cell():
    keys, counts = np.arange(3000) * 7919, np.repeat([1, 4, 900], 1000)
    w = b.weights(keys, counts, 200, 1)
    assert (w[:, 0] == counts).all() and (w >= 0).all() and (w == np.floor(w)).all()
    for n in (1, 4, 900):
        part = w[counts == n, 1:]
        assert abs(part.mean() / n - 1) < 0.01 and abs(part.var() / n - 1) < 0.02
    assert abs(np.mean(w[:1000, 1:] == 0) - np.exp(-1)) < 0.003
    assert abs(np.corrcoef(w[:1000, 1:].T)[0, 1]) < 0.1
    assert (b.weights(keys[5:6], counts[5:6], 200, 1) == w[5]).all()
    assert (b.weights(keys[:5], counts[:5], 9, 2)[:, 1:] != w[:5, 1:10]).any()


def test_intervals_and_reasons(spark):
    r = np.random.default_rng(2)
    y = (r.random(900) < 0.4).astype(int)
    good = 0.5 * y + r.random(900) * 0.5
    df = spark.createDataFrame([(float(a), 0.4, int(z)) for a, z in zip(good, y, strict=True)], "m double, r double, y int")
    got = {c.metric: c for c in g.paired_all(df, "m", "r", "y", ["auc", "ap", "brier"], draws=100)}
    assert got["auc"].rule == 0.5 and got["auc"].low <= got["auc"].difference <= got["auc"].high and got["auc"].better and got["brier"].better
    loss = {"absolute": lambda s, y: abs(s - y)}  # a metric of one's own
    mine = g.paired_all(df, "m", "r", "y", ["absolute", "brier"], draws=100, own=loss)[0]
    assert mine.model == pytest.approx(np.abs(good - y).mean()) and mine.rule == pytest.approx(np.abs(0.4 - y).mean()) and mine.low < mine.difference < mine.high
    one = spark.createDataFrame([(0.2, 0.4, 1)], "m double, r double, y int")
    assert [c.reason for c in g.paired_all(one, "m", "r", "y", ["auc"])] == ["a single class"]
    few = spark.createDataFrame([(0.2, 0.4, 1), (0.7, 0.1, 0)], "m double, r double, y int")
    assert "draws leave it undefined" in g.paired(few, "m", "r", "y", "auc", draws=50).reason
    sure = spark.createDataFrame([(0.0, 0.4, 1), (0.7, 0.1, 0)] * 20, "m double, r double, y int")
    assert g.paired(sure, "m", "r", "y", "log_loss", draws=20).reason == "a sure score is wrong"
    wide = spark.createDataFrame([(3.0, 0.4, 1), (0.7, 0.1, 0)] * 20, "m double, r double, y int")
    assert "probabilities" in g.paired(wide, "m", "r", "y", "brier", draws=20).reason and isinstance(g.paired(wide, "m", "r", "y", "auc", draws=20), g.Comparison)
    assert g.paired(df.limit(0), "m", "r", "y", "auc").reason == "no rows"
