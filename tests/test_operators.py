import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import stats
from decidra.operators.joins import Cardinality, Direction, JoinRefused, asof_join, check_cardinality, guarded_join, join_losses, prior_count
from decidra.operators.profile import distinct_with_null, loss_counts, profile, row_balance, sentinel_counts
from decidra.operators.windows import average_rank, history, keep_first, rolling


@pytest.fixture(scope="module")
def parents(spark):
    return spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "k string, size int")


@pytest.fixture(scope="module")
def children(spark):
    return spark.createDataFrame([("a", 10.0), ("a", 20.0), ("b", 5.0), (None, 1.0)], "k string, amount double")


class Allows:
    def allows(self, requirement):
        return requirement == "A8"


def test_guarded_join(parents, children):
    assert check_cardinality(parents, children, ["k"], Cardinality.ONE_TO_MANY) == []
    assert "right" in check_cardinality(parents, children, ["k"], Cardinality.ONE_TO_ONE)[0]
    assert guarded_join(parents, children, on=["k"], expect=Cardinality.ONE_TO_MANY).count() == 3
    for expect, on in ((None, ["k"]), (Cardinality.MANY_TO_ONE, ["k"]), (Cardinality.ONE_TO_MANY, [])):
        with pytest.raises(JoinRefused):
            guarded_join(parents, children, on=on, expect=expect)
    assert guarded_join(parents, children, on=["k"], expect=Cardinality.MANY_TO_ONE, overrides=Allows()).count() == 3
    assert tuple(join_losses(parents, children, ["k"]).first()) == (1, 1)


@pytest.mark.parametrize("direction", list(Direction))
@pytest.mark.parametrize("strict", [False, True])
@pytest.mark.parametrize("bucket", [None, 3])
def test_asof_equals_brute_force(spark, direction, strict, bucket):
    r = np.random.default_rng(5)
    at = lambda: dt.datetime(2024, 1, 1) + dt.timedelta(hours=int(r.integers(0, 400)))
    left = [(k, f"k{r.integers(0, 4)}" if k % 11 else None, at() if k % 13 else None) for k in range(120)]
    right = [(f"k{r.integers(0, 4)}" if k % 7 else None, at(), k) for k in range(90)]
    got = asof_join(spark.createDataFrame(left, "id int, k string, t timestamp_ntz"), spark.createDataFrame(right, "k string, u timestamp_ntz, v int"), left_on="t", right_on="u", by=["k"], direction=direction, strict=strict, values=["v"], tiebreak=["v"], bucket_days=bucket)
    want = {}
    for i, k, t in left:
        if direction is Direction.BACKWARD:
            fit = [(u, v) for key, u, v in right if k is not None and t is not None and key == k and (u < t or (u == t and not strict))]
            want[i] = max(fit, default=(None, None))[1]
        else:
            fit = [(u, v) for key, u, v in right if k is not None and t is not None and key == k and (u > t or (u == t and not strict))]
            want[i] = min(fit, default=(None, None))[1]
    rows = got.collect()
    assert len(rows) == len(left) and {x.id: x.v for x in rows} == want
    assert got.columns == ["id", "k", "t", "u", "v"]


def test_asof_refuses_one_name(parents):
    with pytest.raises(JoinRefused):
        asof_join(parents, parents, left_on="size", right_on="size", by=["k"], direction=Direction.FORWARD, values=[])


def test_prior_count_is_strict_by_default(spark):
    day = lambda k: dt.datetime(2024, 1, k)
    d = spark.createDataFrame([("a", day(3)), ("a", day(1)), ("b", day(9))], "k string, t timestamp_ntz")
    e = spark.createDataFrame([("a", day(1)), ("a", day(3)), ("a", day(4))], "k string, u timestamp_ntz")
    got = {(x.k, x.t.day): x.prior for x in prior_count(d, e, by=["k"], decision_time="t", event_time="u").collect()}
    assert got == {("a", 3): 1, ("a", 1): 0, ("b", 9): 0}
    got = {(x.k, x.t.day): x.prior for x in prior_count(d, e, by=["k"], decision_time="t", event_time="u", same_instant_counts=True).collect()}
    assert got == {("a", 3): 2, ("a", 1): 1, ("b", 9): 0}


def test_rolling_frames(spark):
    rows = [(0, dt.datetime(2024, 1, 1)), (1, dt.datetime(2024, 1, 8)), (2, dt.datetime(2024, 1, 8, 0, 0, 0, 1)), (3, dt.datetime(2024, 1, 8, 0, 0, 0, 1))]
    df = spark.createDataFrame([(i, "k", t) for i, t in rows], "i int, k string, t timestamp_ntz")
    got = df.select("i", F.count("*").over(rolling(["k"], "t", 7)).alias("r"), F.count("*").over(rolling(["k"], "t", 7, "left")).alias("l")).collect()
    assert {x.i: (x.r, x.l) for x in got} == {0: (1, 0), 1: (1, 1), 2: (3, 1), 3: (3, 1)}


def test_history_and_keep_first(spark):
    df = spark.createDataFrame([("a", 1, 5), ("a", 2, 7), (None, 1, 1), (None, 2, 2)], "k string, t int, v int")
    got = {(x.k, x.t): (x.previous_v, x.next_v, x.prior_v, x.n_prior) for x in history(df, by=["k"], order=["t"], previous=["v"], following=["v"], sums=["v"]).collect()}
    assert got["a", 2] == (5, None, 5, 1) and got["a", 1] == (None, 7, 0, 0)
    assert sorted((x.k or "", x.t) for x in keep_first(df, ["k"], [F.desc("t")]).collect()) == [("", 2), ("a", 2)]


def test_profile_and_balance(spark):
    df = spark.createDataFrame([("x", 1), ("NA", None), (" ", 2), (None, 2)], "s string, n int")
    assert {x.column: (x.rows, x.nulls, x.distinct) for x in profile(df).collect()} == {"s": (4, 1, 4), "n": (4, 1, 3)}
    assert {x.column: x.n for x in sentinel_counts(df).collect()} == {"s": 2}
    assert df.agg(distinct_with_null("n")).first()[0] == 3
    losses = {"null": F.col("n").isNull(), "big": F.col("n") > 1}
    assert tuple(loss_counts(df, losses).first()) == (4, 1, 1, 2, True) and row_balance(df, losses).count() == 1


def test_metrics_equal_numpy(spark):
    r = np.random.default_rng(2)
    s = r.integers(0, 60, 700) / 60
    y = (r.random(700) < s).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)] + [(None, 1), (0.5, None)], "s double, y int").repartition(7)
    clean = df.where("s is not null and y is not null")
    pos, neg = s[y == 1], s[y == 0]
    auc = ((pos[:, None] > neg).sum() + 0.5 * (pos[:, None] == neg).sum()) / (len(pos) * len(neg))
    assert stats.auc(df, "s", "y").first().auc == pytest.approx(auc)
    assert stats.association(df, ["s"], "y").first().association == pytest.approx(auc - 0.5)
    edges = np.quantile(s, np.linspace(0, 1, 11))
    at = np.clip(np.searchsorted(edges, s, "right") - 1, 0, 9)
    ece = sum((at == k).mean() * abs(s[at == k].mean() - y[at == k].mean()) for k in range(10) if (at == k).any())
    assert stats.calibration_error(df, "s", "y").first().ece == pytest.approx(ece)
    ap, hits, seen = 0.0, 0, 0
    for v in sorted(set(s), reverse=True):
        mine = y[s == v]
        hits, seen = hits + mine.sum(), seen + len(mine)
        ap += mine.sum() / y.sum() * hits / seen
    assert stats.average_precision(df, "s", "y").first().ap == pytest.approx(ap)
    got = clean.agg(stats.brier("s", "y").alias("b"), stats.net_benefit("s", "y", 0.4).alias("n")).first()
    assert got.b == pytest.approx(((s - y) ** 2).mean())
    act = s >= 0.4
    assert got.n == pytest.approx(((act & (y == 1)).sum() - (act & (y == 0)).sum() * 0.4 / 0.6) / 700)
    ranks = {x.s: x.average_rank for x in average_rank(clean, "s").collect()}
    order = np.sort(s)
    assert all(ranks[v] == pytest.approx((np.searchsorted(order, v, "left") + np.searchsorted(order, v, "right") + 1) / 2) for v in ranks)


def test_log_loss_is_not_clipped(spark):
    df = lambda rows: spark.createDataFrame(rows, "s double, y int")
    assert df([(0.0, 1), (0.5, 1)]).agg(stats.log_loss("s", "y")).first()[0] == float("inf")
    assert df([(1.0, 1), (0.0, 0)]).agg(stats.log_loss("s", "y")).first()[0] == 0
    assert np.isnan(df([(1.5, 1)]).agg(stats.brier("s", "y")).first()[0])


def test_single_class_has_no_auc(spark):
    assert stats.auc(spark.createDataFrame([(0.1, 1), (0.2, 1)], "s double, y int"), "s", "y").first().auc is None
