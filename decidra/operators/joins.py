"""Joins whose cardinality is declared and checked, and as-of joins."""

from __future__ import annotations

from collections.abc import Sequence
from enum import Enum

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from ..functions.ranks import before_buckets, same


class Cardinality(Enum):
    ONE_TO_ONE = "one_to_one"
    MANY_TO_ONE = "many_to_one"
    ONE_TO_MANY = "one_to_many"


class Direction(Enum):
    BACKWARD = "backward"
    FORWARD = "forward"


class JoinRefused(ValueError):
    """The join's declaration is missing or the data contradict it."""


def rows_per_key(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows, different keys without nulls, rows of the largest key, and the mean rows of a key."""
    keys = df.dropna(subset=list(on)).groupBy(*on).agg(F.count("*").alias("n"))
    return keys.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("keys"), F.coalesce(F.max("n"), F.lit(0)).alias("most"), F.coalesce(F.avg("n"), F.lit(0.0)).alias("mean"))


def repeated_keys(df: DataFrame, on: Sequence[str]) -> DataFrame:
    """Keys that more than one row has."""
    return df.dropna(subset=list(on)).groupBy(*on).agg(F.count("*").alias("n")).where("n > 1")


def check_cardinality(left: DataFrame, right: DataFrame, on: Sequence[str], expect: Cardinality) -> list[str]:
    """What contradicts the declaration; empty if nothing does.  A side is aggregated only if its keys must be unique."""
    sides = {Cardinality.ONE_TO_ONE: (("left", left), ("right", right)), Cardinality.MANY_TO_ONE: (("right", right),), Cardinality.ONE_TO_MANY: (("left", left),)}[expect]
    found = []
    for name, df in sides:
        if repeated_keys(df, on).limit(1).count():
            about = rows_per_key(df, on).first()
            found.append(f"{name} has {about.rows} rows of {about.keys} keys {list(on)}: a join inflates rows by {about.mean:.2f} on average, by {about.most} at most")
    return found


def guarded_join(left: DataFrame, right: DataFrame, *, on: Sequence[str], expect: Cardinality | None, how: str = "inner", overrides=None) -> DataFrame:
    """An equi-join that is refused without keys or declared cardinality, or if the data contradict it.

    ``overrides``: a ledger (``allows(requirement)``) that may let a contradiction pass as requirement A8.
    """
    if not on:
        raise JoinRefused("no join keys are named")
    if expect is None:
        raise JoinRefused("no cardinality is declared")
    found = check_cardinality(left, right, on, expect)
    if found and not (overrides is not None and overrides.allows("A8")):
        raise JoinRefused("; ".join(found))
    return left.join(right, list(on), how)


def join_losses(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """One row: rows of each side that find no partner (null keys never do)."""
    lost = lambda a, b: a.join(b.select(*on).distinct(), list(on), "left_anti").agg(F.count("*").alias("n"))
    return lost(left, right).select(F.col("n").alias("left_lost")).join(lost(right, left).select(F.col("n").alias("right_lost")), how="full", on=F.lit(True))


def asof_join(left: DataFrame, right: DataFrame, *, left_on: str, right_on: str, by: Sequence[str], direction: Direction, values: Sequence[str], strict: bool = False, tiebreak: Sequence[str] = (), prefix: str = "", bucket_days: int | None = None) -> DataFrame:
    """``left`` with ``right_on`` and ``values`` of the nearest row of ``right`` of the same ``by``.

    BACKWARD takes the last row at or before ``left_on``, FORWARD the first at or after it; with ``strict`` equal
    instants don't count.  Among rows of one instant, ordered by ``tiebreak``, BACKWARD takes the last and FORWARD the
    first.  Every left row is kept once.  Both sides are united and read by one window; no pair of rows is made.

    ``bucket_days`` splits the rows of a key that has too many for one task: each bucket of days is its own
    partition, and what a bucket doesn't find is looked up in one row per earlier (or later) bucket.
    """
    if left_on == right_on:
        raise JoinRefused("the columns of time must differ in name")
    back = direction is Direction.BACKWARD
    found = F.struct(F.col(right_on).alias(f"{prefix}{right_on}"), *(F.col(v).alias(f"{prefix}{v}") for v in values))
    ties = F.struct(*(F.col(t) for t in tiebreak)) if tiebreak else F.struct(F.lit(0).alias("none"))
    # of equal instants: rows that may be found come before the left row when looking back, after it when looking ahead
    right_side = 0 if back != strict else 1
    keep = F.struct(*(F.col(c) for c in left.columns))
    lefts = left.select(*by, F.col(left_on).alias("_t"), F.lit(1 - right_side).alias("_side"), keep.alias("_left"))
    rights = right.where(F.col(right_on).isNotNull()).select(*by, F.col(right_on).alias("_t"), F.lit(right_side).alias("_side"), ties.alias("_ties"), found.alias("_found"))
    both = lefts.unionByName(rights, allowMissingColumns=True)
    part: list[str | Column] = list(by)
    if bucket_days:
        both = both.withColumn("_bucket", F.floor(F.datediff(F.to_date("_t"), F.lit("1970-01-01").cast("date")) / bucket_days))
        part.append("_bucket")
    order = Window.partitionBy(*part).orderBy("_t", "_side", "_ties")
    pick = F.last if back else F.first
    frame = order.rowsBetween(Window.unboundedPreceding, 0) if back else order.rowsBetween(0, Window.unboundedFollowing)
    out = both.withColumn("_hit", pick("_found", ignorenulls=True).over(frame))
    if bucket_days:
        edge = (F.max_by if back else F.min_by)("_found", F.struct("_t", "_side", "_ties"))
        edges = both.where("_found is not null").groupBy(*part).agg(edge.alias("_edge"))
        every = both.select(*part).distinct().join(edges, part, "left")
        far = Window.partitionBy(*by).orderBy("_bucket")
        beyond = pick("_edge", ignorenulls=True).over(far.rowsBetween(Window.unboundedPreceding, -1) if back else far.rowsBetween(1, Window.unboundedFollowing))
        out = out.join(every.select(*part, beyond.alias("_beyond")), part, "left").withColumn("_hit", F.coalesce("_hit", "_beyond"))
    hit = lambda c: F.when(F.col("_left")[left_on].isNotNull() & _all_set(by), F.col("_hit")[c]).alias(c)
    names = [f"{prefix}{right_on}", *(f"{prefix}{v}" for v in values)]
    return out.where("_left is not null").select(*(F.col("_left")[c].alias(c) for c in left.columns), *(hit(n) for n in names))


def _all_set(by: Sequence[str]) -> Column:
    out = F.lit(True)
    for c in by:
        out = out & F.col("_left")[c].isNotNull()
    return out


def prior_count(decisions: DataFrame, events: DataFrame, *, by: Sequence[str], decision_time: str, event_time: str, same_instant_counts: bool = False, name: str = "prior", bucket_days: int | None = None) -> DataFrame:
    """``decisions`` with the number of earlier ``events`` of the same key, by one window over both streams.

    ``bucket_days`` splits the rows of a key that has too many for one task: each bucket of days counts its own events
    and adds the totals of the buckets before it.  Decisions without time count nothing.
    """
    keep = F.struct(*(F.col(c) for c in decisions.columns))
    event_side = 0 if same_instant_counts else 1
    both = decisions.select(*by, F.col(decision_time).alias("_t"), F.lit(1 - event_side).alias("_side"), keep.alias("_left"), F.lit(0).alias("_one")).unionByName(
        events.where(F.col(event_time).isNotNull()).select(*by, F.col(event_time).alias("_t"), F.lit(event_side).alias("_side"), F.lit(1).alias("_one")), allowMissingColumns=True
    )
    days = F.floor(F.datediff(F.to_date("_t"), F.lit("1970-01-01").cast("date")) / bucket_days) if bucket_days else F.lit(0)
    both = both.withColumn("_bucket", days)
    upto = Window.partitionBy(*by, "_bucket").orderBy("_t", "_side").rowsBetween(Window.unboundedPreceding, 0)
    out = both.withColumn("_n", F.sum("_one").over(upto)).where("_left is not null")
    if bucket_days:
        out = same(out, before_buckets(both, ["_one"], by), [*by, "_bucket"]).withColumn("_n", F.col("_n") + F.col("_before_one"))
    return out.select(*(F.col("_left")[c].alias(c) for c in decisions.columns), F.col("_n").cast("long").alias(name))
