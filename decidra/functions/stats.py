"""Rank statistics, calibration and cost metrics as aggregations.

Scores are grouped by value, and ordered within narrow buckets of values only (:mod:`.ranks`), so no task sees a whole
sample, however many different scores it has.
"""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .ranks import before_buckets, bucket, order_statistics, quantiles, running

LEAST_ROWS = 50


def _pairs(df: DataFrame, score: str, label: str, by: Sequence[str]) -> DataFrame:
    return df.where(F.col(score).isNotNull() & F.col(label).isNotNull()).groupBy(*by, F.col(score).alias("_s")).agg(F.count("*").alias("_n"), F.sum(F.col(label).cast("long")).alias("_p")).withColumn("_bucket", bucket(F.col("_s")))


def auc(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, positives, auc) with ties averaged; null for a single class."""
    return auc_of_counts(_pairs(df, score, label, by), by)


def auc_of_counts(groups: DataFrame, by: Sequence[str] = ()) -> DataFrame:
    """:func:`auc` of (by, _s, _n, _p): different scores with their rows and positives."""
    groups = groups if "_bucket" in groups.columns else groups.withColumn("_bucket", bucket(F.col("_s")))
    within = Window.partitionBy(*by, "_bucket").orderBy("_s")
    ranked = groups.withColumn("_r", (F.sum("_n").over(within) - (F.col("_n") - 1) / 2) * F.col("_p")).withColumn("_v", F.lit(1))
    # a bucket's positives rank above all rows of the buckets before
    buckets = before_buckets(ranked, ["_n", "_p", "_r", "_v"], by)
    sums = buckets.groupBy(*by).agg(F.sum("_in_n").cast("long").alias("rows"), F.sum("_in_p").cast("long").alias("positives"), F.sum(F.col("_in_r") + F.col("_before_n") * F.col("_in_p")).alias("_r"), F.sum("_in_v").alias("values"))
    p, n = F.col("positives"), F.col("rows") - F.col("positives")
    return sums.select(*by, "rows", "positives", "values", F.when((p > 0) & (n > 0), (F.col("_r") - p * (p + 1) / 2) / (p * n)).alias("auc"))


def association(df: DataFrame, features: Sequence[str], label: str, by: Sequence[str] = (), least_rows: int = LEAST_ROWS) -> DataFrame:
    """(by, feature, rows, association) of numeric features: AUC - 0.5, null below ``least_rows``, two values or two classes.

    All features go through one unpivoted pass.
    """
    rows = df.select(*by, label, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in features))))
    out = auc(rows, "value", label, [*by, "feature"])
    return out.select(*by, "feature", "rows", "positives", F.when((F.col("rows") >= least_rows) & (F.col("values") > 1), F.col("auc") - 0.5).alias("association"))


def average_precision(df: DataFrame, score: str, label: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, ap): the step definition, equal scores being one threshold."""
    upto = running(_pairs(df, score, label, by), ["_n", "_p"], by, descending=True)
    steps = upto.select(*by, "_p", (F.col("_upto_p") / F.col("_upto_n")).alias("_precision"), F.col("_all_p").alias("_all"))
    return steps.groupBy(*by).agg(F.when(F.max("_all") > 0, F.sum(F.col("_precision") * F.col("_p")) / F.max("_all")).alias("ap"))


def calibration_bins(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(bin, rows, mean_score, mean_label) of quantile bins; edges by linear interpolation, a value on an edge goes up."""
    rows = df.where(F.col(score).isNotNull() & F.col(label).isNotNull())
    edges = quantiles(rows, score, [k / bins for k in range(bins + 1)]).select(F.col("quantiles").alias("_edges"))
    at = F.greatest(F.lit(0), F.least(F.lit(bins - 1), F.size(F.filter("_edges", lambda e: e <= F.col(score))) - 1))
    return rows.join(F.broadcast(edges), how="cross").withColumn("bin", at).groupBy("bin").agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label"))


def calibration_error(df: DataFrame, score: str, label: str, bins: int = 10) -> DataFrame:
    """(ece): the bins' absolute differences, weighted by rows."""
    b = calibration_bins(df, score, label, bins)
    return b.agg((F.sum(F.col("rows") * F.abs(F.col("mean_score") - F.col("mean_label"))) / F.sum("rows")).alias("ece"))


def brier(score: str, label: str) -> Column:
    """The mean squared error; NaN unless all scores lie in [0, 1]."""
    s = F.col(score)
    return F.when(F.min(((s >= 0) & (s <= 1)).cast("int")) == 1, F.avg((s - F.col(label)) * (s - F.col(label)))).otherwise(F.lit(float("nan")))


def log_loss(score: str, label: str) -> Column:
    """Unclipped: a sure mistake is infinite."""
    s, y = F.col(score), F.col(label)
    wrong = ((y == 1) & (s == 0)) | ((y == 0) & (s == 1))
    return F.avg(F.when(wrong, F.lit(float("inf"))).when(y == 1, -F.ln(F.when(s > 0, s))).otherwise(-F.log1p(-F.when(s < 1, s))))


def net_benefit(score: str, label: str, threshold: float) -> Column:
    """(TP - FP * t / (1 - t)) / n for acting at scores from ``threshold``."""
    act = F.col(score) >= threshold
    return (F.count_if(act & (F.col(label) == 1)) - F.count_if(act & (F.col(label) == 0)) * (threshold / (1 - threshold))) / F.count("*")


def quantile_nearest(df: DataFrame, value: str, q: float, by: Sequence[str] = ()) -> DataFrame:
    """(by, quantile): the order statistic at round(q * (n - 1)), halves to even, without interpolation."""
    found = order_statistics(df, value, lambda n: [F.rint(F.lit(float(q)) * (n - 1))], by)
    return found.select(*by, F.map_values("found")[0].alias("quantile"))


def segment_bias(df: DataFrame, score: str, label: str, features: Sequence[str], least_rows: int = 200) -> DataFrame:
    """(feature, value, rows, mean_score, mean_label, bias) of segments that are large enough, largest bias first."""
    rows = df.where(F.col(label).isNotNull()).select(score, label, F.inline(F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("string").alias("value")) for f in features))))
    out = rows.groupBy("feature", "value").agg(F.count("*").alias("rows"), F.avg(score).alias("mean_score"), F.avg(F.col(label).cast("double")).alias("mean_label")).where(F.col("rows") >= least_rows)
    return out.withColumn("bias", F.col("mean_score") - F.col("mean_label")).orderBy(F.desc(F.abs("bias")), "feature", "value")
