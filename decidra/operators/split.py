"""Temporal splits by the moment at which a label became known, with a reserved measurement sample.

Windows are range predicates on one labelled table; counts of all windows come from one aggregation, and sets of
objects are never collected.
"""

from __future__ import annotations

import datetime as dt
from collections.abc import Sequence
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

from ..schema import DeclarationError, Period
from .label import IMMATURE, KNOWN_AT, LABEL, REASON
from .windows import MICROS_PER_DAY, micros

TRAIN, EVALUATE = "train", "evaluate"


def _at(moment: dt.datetime) -> Column:
    return F.lit(moment).cast("timestamp_ntz")


@dataclass(frozen=True)
class Split:
    """A labelled table, its windows, and the reserve [reserve_from, reserve_until)."""

    labelled: DataFrame
    decision: str
    windows: tuple[Period, ...]
    reserve_from: dt.datetime | None = None
    reserve_until: dt.datetime | None = None

    def __post_init__(self) -> None:
        late = [w.name for w in self.windows if self.reserve_from is not None and w.stop > self.reserve_from]
        if late:
            raise DeclarationError(f"the windows {late} reach into the reserve")

    @property
    def seen(self) -> Column:
        """Rows that windows may see."""
        return F.col(self.decision) < _at(self.reserve_from) if self.reserve_from else F.lit(True)

    def in_train(self, w: Period) -> Column:
        return self.seen & F.col(LABEL).isNotNull() & (F.col(KNOWN_AT) < _at(w.start))

    def in_evaluate(self, w: Period) -> Column:
        return self.seen & (F.col(self.decision) >= _at(w.start)) & (F.col(self.decision) < _at(w.stop))

    @property
    def in_reserve(self) -> Column:
        if self.reserve_from is None:
            return F.lit(False)
        late = F.col(self.decision) >= _at(self.reserve_from)
        return late & (F.col(self.decision) < _at(self.reserve_until)) if self.reserve_until else late

    def train(self, w: Period) -> DataFrame:
        return self.labelled.where(self.in_train(w))

    def evaluate(self, w: Period) -> DataFrame:
        return self.labelled.where(self.in_evaluate(w))

    def reserved(self) -> DataFrame:
        """Not filtered by what was observed."""
        return self.labelled.where(self.in_reserve)

    def tagged(self) -> DataFrame:
        """The labelled rows once for each (window, side) that holds them."""
        parts = [F.when(condition(w), F.struct(F.lit(w.name).alias("window"), F.lit(side).alias("side"))) for w in self.windows for side, condition in ((TRAIN, self.in_train), (EVALUATE, self.in_evaluate))]
        return self.labelled.withColumn("_part", F.explode(F.filter(F.array(*parts), lambda p: p.isNotNull()))).select("*", "_part.window", "_part.side").drop("_part")

    def counts(self) -> DataFrame:
        """(window, train, evaluate, labelled, positives, immature, dropped_not_yet_known): one aggregation for all windows."""
        rows = []
        for w in self.windows:
            late = self.seen & (F.col(self.decision) < _at(w.start)) & (F.col(KNOWN_AT) >= _at(w.start))
            rows.append((w.name, F.count_if(self.in_train(w)), F.count_if(self.in_evaluate(w)), F.count_if(self.in_evaluate(w) & F.col(LABEL).isNotNull()), F.count_if(self.in_evaluate(w) & (F.col(LABEL) == 1)), F.count_if(self.in_evaluate(w) & (F.col(REASON) == IMMATURE)), F.count_if(late)))
        names = ("train", "evaluate", "labelled", "positives", "immature", "dropped_not_yet_known")
        wide = self.labelled.agg(*(c.alias(f"_{k}_{n}") for k, (_, *cs) in enumerate(rows) for n, c in zip(names, cs, strict=True)))
        return wide.select(F.inline(F.array(*(F.struct(F.lit(name).alias("window"), *(F.col(f"_{k}_{n}").alias(n) for n in names)) for k, (name, *_) in enumerate(rows)))))

    def reserve_counts(self) -> DataFrame:
        """(reserved, reserved_immature, outside, outside_immature)."""
        beyond = F.col(self.decision) >= _at(self.reserve_until) if self.reserve_until else F.lit(False)
        late = F.col(REASON) == IMMATURE
        return self.labelled.agg(F.count_if(self.in_reserve).alias("reserved"), F.count_if(self.in_reserve & late).alias("reserved_immature"), F.count_if(beyond).alias("outside"), F.count_if(beyond & late).alias("outside_immature"))


def overlap(split: Split, key: str, nulls_shared: bool = True) -> DataFrame:
    """(window, shared): different keys that a window's training and evaluation rows share; a null may be a key."""
    rows = split.tagged().select("window", "side", key)
    rows = rows if nulls_shared else rows.where(F.col(key).isNotNull())
    both = rows.groupBy("window", key).agg(F.count_if(F.col("side") == TRAIN).alias("t"), F.count_if(F.col("side") == EVALUATE).alias("e"))
    return both.groupBy("window").agg(F.count_if((F.col("t") > 0) & (F.col("e") > 0)).alias("shared"))


def group_overlap(split: Split, key: str) -> DataFrame:
    """(window, shared, touched): shared groups, and the share of evaluation rows that belong to one."""
    both = split.tagged().where(F.col(key).isNotNull()).groupBy("window", key).agg(F.count_if(F.col("side") == TRAIN).alias("t"), F.count_if(F.col("side") == EVALUATE).alias("e"))
    rows = split.tagged().where(F.col("side") == EVALUATE).groupBy("window").agg(F.count("*").alias("n"))
    shared = both.groupBy("window").agg(F.count_if((F.col("t") > 0) & (F.col("e") > 0)).alias("shared"), F.coalesce(F.sum(F.when(F.col("t") > 0, F.col("e"))), F.lit(0)).alias("hit"))
    return rows.join(shared, "window", "left").select("window", F.coalesce("shared", F.lit(0)).alias("shared"), (F.coalesce("hit", F.lit(0)) / F.col("n")).alias("touched"))


def group_candidates(df: DataFrame, objects: str, least_groups: int = 50, least_share: float = 0.10, exclude: Sequence[str] = ()) -> DataFrame:
    """(column, groups, share) of string columns that look like groups of objects: at least so many values but fewer
    than objects, and at least such a share of rows in values with several objects.  All columns in one unpivoted pass."""
    names = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType) and f.name not in {objects, *exclude}]
    if not names:
        return df.sparkSession.createDataFrame([], "column string, groups long, share double")
    rows = df.select(F.col(objects).cast("string").alias("_o"), F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(c).alias("value")) for c in names))))
    pairs = rows.groupBy("column", "value", "_o").agg(F.count("*").alias("n"))
    groups = pairs.groupBy("column", "value").agg(F.count("*").alias("objects"), F.sum("n").alias("n"))
    counted = groups.groupBy("column").agg(F.count("*").alias("groups"), (F.sum(F.when((F.col("objects") > 1) & F.col("value").isNotNull(), F.col("n")).otherwise(0)) / F.sum("n")).alias("share"), F.count_if(F.col("value").isNull()).alias("_null"))
    total = pairs.groupBy("column").agg(F.count_distinct("_o").alias("objects"))
    return counted.join(total, "column").where((F.col("groups") >= least_groups) & (F.col("groups") < F.col("objects")) & (F.col("share") >= least_share)).select("column", "groups", "share")


def lookback_overlap(train: DataFrame, evaluate: DataFrame, key: str, decision: str, lookback_days: float) -> DataFrame:
    """(n): evaluation rows whose look back reaches the object's last training row."""
    last = train.groupBy(key).agg(F.max(micros(decision)).alias("_last"))
    return evaluate.join(last, key).where(micros(decision) <= F.col("_last") + round(lookback_days * MICROS_PER_DAY)).agg(F.count("*").alias("n"))


def lookback_overlaps(split: Split, key: str, lookback_days: float) -> DataFrame:
    """(window, n): :func:`lookback_overlap` of all windows, by one join of the rows with each object's last training rows."""
    moment, span = micros(split.decision), round(lookback_days * MICROS_PER_DAY)
    last = split.labelled.groupBy(key).agg(*(F.max(F.when(split.in_train(w), moment)).alias(f"_last{k}") for k, w in enumerate(split.windows)))
    held = F.lit(False)
    for w in split.windows:
        held = held | split.in_evaluate(w)
    rows = split.labelled.where(held).join(last, key)
    counts = rows.agg(*(F.count_if(split.in_evaluate(w) & (moment <= F.col(f"_last{k}") + span)).alias(f"_n{k}") for k, w in enumerate(split.windows)))
    return counts.select(F.inline(F.array(*(F.struct(F.lit(w.name).alias("window"), F.col(f"_n{k}").alias("n")) for k, w in enumerate(split.windows)))))


def purge_overlapping_train(train: DataFrame, evaluate: DataFrame, key: str, decision: str, lookback_days: float) -> DataFrame:
    """Training rows outside the look back of the object's first evaluation row; objects without one stay."""
    first = evaluate.groupBy(key).agg(F.min(micros(decision)).alias("_first"))
    return train.join(first, key, "left").where(F.col("_first").isNull() | (micros(decision) < F.col("_first") - round(lookback_days * MICROS_PER_DAY))).select(train.columns)
