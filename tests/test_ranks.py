"""Two-step ranks, quantiles, tiles and rolling sums against plain computations."""

import datetime as dt
import math

import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.functions import stats
from decidra.functions.ranks import bucket, quantiles, tiles
from decidra.operators.joins import prior_count
from decidra.operators.windows import average_rank, rolled, rolling

T0 = dt.datetime(2024, 1, 1)


def numbers(seed=3, n=400):
    rng = np.random.default_rng(seed)
    return np.concatenate([rng.normal(size=n), np.exp2(rng.integers(-40, 40, n)), -np.exp2(rng.integers(-40, 40, n) + 1e-13), np.zeros(20), np.nextafter(np.exp2(np.arange(-20.0, 20.0)), 0)])


def test_buckets_rise_with_values(spark):
    values = [*sorted([float(x) for x in numbers()] + [5e-324, -5e-324, 1.7976931348623157e308, -1.7976931348623157e308])]
    values = [-math.inf, *values, math.inf, math.nan]
    got = [r.b for r in spark.createDataFrame(list(enumerate(values)), "i int, x double").select("i", bucket(F.col("x")).alias("b")).orderBy("i").collect()]
    assert got == sorted(got)
    assert spark.createDataFrame([(None,)], "x double").select(bucket(F.col("x")).alias("b")).first().b is None


def test_quantiles_interpolate(spark):
    x, shares = numbers(), [0, 0.05, 0.37, 0.5, 0.95, 1.0]
    rows = [(k, float(v)) for k in ("a", None) for v in (x if k else x[:7])] + [("nulls", None), ("one", 2.0)]
    got = {r.k: (r.rows, r.quantiles) for r in quantiles(spark.createDataFrame(rows, "k string, v double"), "v", shares, ["k"]).collect()}
    assert set(got) == {"a", None, "one"} and got["one"] == (1, [2.0] * 6)
    assert got["a"][1] == pytest.approx(np.quantile(x, shares)) and got[None][1] == pytest.approx(np.quantile(x[:7], shares))
    assert quantiles(spark.createDataFrame([], "v double"), "v", [0.5]).first().quantiles == [None]


def test_ranks_and_metrics_over_many_buckets(spark):
    s = numbers(5)
    y = (np.random.default_rng(6).random(len(s)) < 1 / (1 + np.exp(-np.clip(s, -5, 5)))).astype(int)
    df = spark.createDataFrame([(float(a), int(b)) for a, b in zip(s, y, strict=True)], "s double, y int")
    pos, neg = s[y == 1], s[y == 0]
    auc = np.mean([(p > neg).mean() + (p == neg).mean() / 2 for p in pos])
    assert stats.auc(df, "s", "y").first().auc == pytest.approx(auc)
    ap = sum(y[s >= t].sum() / (s >= t).sum() * y[s == t].sum() for t in np.unique(s)) / y.sum()
    assert stats.average_precision(df, "s", "y").first().ap == pytest.approx(ap)
    ranks = {r.s: r.average_rank for r in average_rank(df, "s").collect()}
    assert all(ranks[float(v)] == (s < v).sum() + ((s == v).sum() + 1) / 2 for v in s[:50])


@pytest.mark.parametrize("n", [0, 3, 10, 57])
def test_tiles_equal_ntile(spark, n):
    rows = [(k, float(k % 5) if k % 7 else None) for k in range(n)]
    df = spark.createDataFrame(rows, "k long, v double")
    got = {r.k: r.tile for r in tiles(df, "v", "k", 10).collect()}
    order = sorted(rows, key=lambda r: (r[1] is not None, r[1] or 0, r[0]))
    size, more = divmod(n, 10)
    sizes = [size + (k < more) for k in range(10)]
    assert got == dict(zip((k for k, _ in order), (t + 1 for t, m in enumerate(sizes) for _ in range(m)), strict=True))


@pytest.mark.parametrize("closed", ["left", "right"])
@pytest.mark.parametrize("bucket_days", [None, 2, 9.5])
def test_rolled_equals_a_rolling_frame(spark, closed, bucket_days):
    rng = np.random.default_rng(8)
    rows = [(k, None if k % 9 == 0 else int(k % 2), T0 - dt.timedelta(days=3) + dt.timedelta(hours=int(rng.integers(0, 24 * 20))), int(rng.integers(0, 9))) for k in range(300)]
    rows += [(300 + k, 1, T0 + dt.timedelta(days=k), 1) for k in range(12)]  # on the borders of windows and buckets
    df = spark.createDataFrame(rows, "i int, k int, t timestamp_ntz, v int")
    w = rolling(["k"], "t", 2, closed)
    want = {r.i: (r.n, r.s or 0) for r in df.select("i", F.count("*").over(w).alias("n"), F.sum("v").over(w).alias("s")).collect()}
    got = rolled(df, by=["k"], time="t", days=2, sums={"n": F.lit(1), "s": F.col("v")}, closed=closed, bucket_days=bucket_days)
    assert got.columns == ["i", "k", "t", "v", "n", "s"]
    assert {r.i: (r.n, r.s) for r in got.collect()} == want
    assert rolled(df.where("false"), by=["k"], time="t", days=2, sums={"n": F.lit(1)}).count() == 0


def test_rolled_without_time_is_zero(spark):
    df = spark.createDataFrame([(1, None), (1, T0)], "k int, t timestamp_ntz")
    assert {r.t: r.n for r in rolled(df, by=["k"], time="t", days=1, sums={"n": F.lit(1)}).collect()} == {None: 0, T0: 1}


@pytest.mark.parametrize("same", [False, True])
def test_prior_count_in_buckets(spark, same):
    rng = np.random.default_rng(9)
    at = lambda: T0 + dt.timedelta(hours=int(rng.integers(0, 240)))
    d = spark.createDataFrame([(k, int(k % 3) if k % 11 else None, at() if k % 13 else None) for k in range(200)], "i int, k int, t timestamp_ntz")
    e = spark.createDataFrame([(int(k % 2) if k % 5 else None, at() if k % 7 else None) for k in range(200)], "k int, u timestamp_ntz")
    one, many = (prior_count(d, e, by=["k"], decision_time="t", event_time="u", same_instant_counts=same, bucket_days=b).orderBy("i").collect() for b in (None, 2))
    assert one == many
