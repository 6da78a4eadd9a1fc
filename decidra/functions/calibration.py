"""Isotonic calibration and thresholds by cost.

The isotonic fit pools neighbours whose rates fall while the score rises.  Pooling the pooled blocks of two stretches that follow
each other gives the blocks of both, so stretches are pooled on their own and merged: first the different scores of a
narrow bucket, then the buckets' blocks of an octave, then all.  What meets in the end are blocks of rising rates, of
which even a sample of N rows has no more than about N^(2/3).
"""

from __future__ import annotations

from collections.abc import Sequence
from fractions import Fraction

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import STEPS, bucket, quantiles, same

_BLOCKS = "lo double, hi double, n long, p long"


def pooled(blocks: Sequence[tuple[float, float, int, int]]) -> list[tuple[float, float, int, int]]:
    """Blocks (lo, hi, rows, positives) in the order of scores, neighbours pooled until rates rise strictly."""
    out: list[tuple[float, float, int, int]] = []
    for block in blocks:
        while out and out[-1][3] * block[2] >= block[3] * out[-1][2]:  # the rate before isn't below
            lo, _, n, p = out.pop()
            block = (lo, block[1], n + block[2], p + block[3])
        out.append(block)
    return out


def _pool(frame: pd.DataFrame) -> pd.DataFrame:
    rows = frame.sort_values("lo")[["lo", "hi", "n", "p"]]
    got = pooled(list(zip(rows.lo.tolist(), rows.hi.tolist(), rows.n.tolist(), rows.p.tolist(), strict=True)))
    return pd.DataFrame(got, columns=["lo", "hi", "n", "p"])


def isotonic(df: DataFrame, score: str, label: str) -> DataFrame:
    """(lo, hi, rows, positives, rate): the isotonic fit of a 0/1 label, a row for each block of scores.

    Rows without a score or a label don't count; without any there are no blocks.
    """
    s = F.col(score).cast("double")
    each = df.where(s.isNotNull() & F.col(label).isNotNull()).groupBy(s.alias("lo")).agg(F.count("*").alias("n"), F.sum(F.col(label).cast("long")).alias("p"))
    rows = each.withColumn("hi", F.col("lo")).withColumn("_b", bucket(F.col("lo")))
    near = rows.groupBy("_b").applyInPandas(_pool, _BLOCKS)
    wide = near.groupBy(F.floor(bucket(F.col("lo")) / STEPS).alias("_b")).applyInPandas(_pool, _BLOCKS)
    whole = wide.groupBy(F.lit(0).alias("_b")).applyInPandas(_pool, _BLOCKS)  # rising blocks only, see the module
    return whole.select("lo", "hi", F.col("n").alias("rows"), F.col("p").alias("positives"), (F.col("p") / F.col("n")).alias("rate"))


def calibrated(df: DataFrame, score: str, blocks: DataFrame, name: str = "calibrated") -> DataFrame:
    """``df`` with the fitted rate of each score: a block's rate within it, a straight line between two blocks, and the first
    or last rate beyond them.  Null scores stay null.

    Blocks and different scores are united and read by a window over each narrow bucket; a bucket without a block start
    takes the last one before it.
    """
    after = Window.orderBy("lo")  # blocks only
    marks = blocks.select("lo", "hi", "rate", F.lead("lo").over(after).alias("next_lo"), F.lead("rate").over(after).alias("next_rate"), F.row_number().over(after).alias("_first"))
    s = F.col(score).cast("double")
    values = df.where(s.isNotNull()).select(s.alias("_s")).distinct()
    block = F.struct("lo", "hi", "rate", "next_lo", "next_rate")
    kind = block_type(marks)
    both = values.select("_s", F.lit(None).cast(kind).alias("_block")).unionByName(marks.select(F.col("lo").alias("_s"), block.alias("_block")))
    both = both.withColumn("_b", bucket(F.col("_s")))
    within = Window.partitionBy("_b").orderBy("_s").rangeBetween(Window.unboundedPreceding, Window.currentRow)
    ends = both.where("_block IS NOT NULL").groupBy("_b").agg(F.max_by("_block", "_s").alias("_last"))
    spread = both.select("_b").distinct().join(ends, "_b", "left")
    earlier = spread.withColumn("_before", F.last("_last", True).over(Window.orderBy("_b").rowsBetween(Window.unboundedPreceding, -1))).select("_b", "_before")  # buckets only
    found = both.withColumn("_mine", F.last("_block", True).over(within)).where("_block IS NULL")
    first = F.coalesce(F.col("_mine"), F.col("_before"))
    placed = same(found, earlier, ["_b"]).select("_s", first.alias("_at"))
    at = lambda c: F.col(f"_at.{c}")
    between = at("rate") + (at("next_rate") - at("rate")) * (F.col("_s") - at("hi")) / (at("next_lo") - at("hi"))
    lowest = marks.where("_first = 1").select(F.col("rate").alias("_low"))
    value = F.when(F.col("_at").isNull(), F.col("_low")).when((F.col("_s") <= at("hi")) | at("next_lo").isNull(), at("rate")).otherwise(between)
    table = placed.crossJoin(F.broadcast(lowest)).select("_s", value.alias(name))  # one row
    return df.join(table, s == F.col("_s"), "left").drop("_s")


def block_type(marks: DataFrame) -> str:
    return "struct<" + ",".join(f"{c}:{dict(marks.dtypes)[c]}" for c in ("lo", "hi", "rate", "next_lo", "next_rate")) + ">"


def threshold_grid(df: DataFrame, score: str, points: int = 60, low: float = 0.5, high: float = 0.999) -> list[float]:
    """Different quantiles of the score from ``low`` to ``high``, to six digits."""
    got = quantiles(df.where(F.col(score).isNotNull()), score, np.linspace(low, high, points).tolist()).first()
    return sorted({round(v, 6) for v in got.quantiles if v is not None}) if got and got.rows else []


def miss_cost_sensitivity(df: DataFrame, score: str, label: str, grid: Sequence[float], misses: Sequence[float | Fraction], act: float = 1.0) -> DataFrame:
    """(miss_cost, threshold, cost, do_nothing, act_on_all, gain): for each cost of a miss the threshold with the least cost (of
    equals the lowest), what never or always acting costs, and what is gained over the better of both.

    One aggregation counts all thresholds; costs of misses are applied to its one row.
    """
    s, y = F.col(score), F.col(label)
    known = df.where(s.isNotNull() & y.isNotNull())
    sums: list[Column] = [F.count("*").alias("n"), F.count_if(y == 1).alias("p")]
    for k, t in enumerate(grid):
        sums += [F.count_if(s >= t).alias(f"f{k}"), F.count_if((s >= t) & (y == 1)).alias(f"h{k}")]
    wide = known.agg(*sums)
    points = F.array(*(F.struct(F.lit(float(t)).alias("threshold"), F.col(f"f{k}").alias("flagged"), F.col(f"h{k}").alias("hits")) for k, t in enumerate(grid)))
    costs = F.explode(F.array(*(F.lit(float(m)) for m in misses))).alias("miss_cost")
    rows = wide.select("n", "p", points.alias("points"), costs)
    priced = F.transform("points", lambda x: F.struct((x["flagged"] * act + (F.col("p") - x["hits"]) * F.col("miss_cost")).alias("cost"), x["threshold"].alias("threshold")))
    best = F.array_min(priced)
    rows = rows.select("miss_cost", best["threshold"].alias("threshold"), best["cost"].alias("cost"), (F.col("p") * F.col("miss_cost")).alias("do_nothing"), (F.col("n") * F.lit(float(act))).alias("act_on_all"))
    return rows.withColumn("gain", F.least("do_nothing", "act_on_all") - F.col("cost"))
