"""Point-in-time history: rolling frames, running values, neighbours, ranks and keep-first dedup."""

from __future__ import annotations

from collections.abc import Sequence

from pyspark.sql import Column, DataFrame, Window, WindowSpec
from pyspark.sql import functions as F

from ..functions.ranks import counted, running

MICROS_PER_DAY = 86_400_000_000


def micros(column: str) -> Column:
    """Microseconds since 1970 of a timestamp, zoned or not, or a date."""
    return F.unix_micros(F.col(column).cast("timestamp"))


def rolling(by: Sequence[str], time: str, days: float, closed: str = "right") -> WindowSpec:
    """(t - days, t] if closed to the right; [t - days, t) if to the left, which sees strictly earlier rows only."""
    width = round(days * MICROS_PER_DAY)
    frame = {"right": (-width + 1, 0), "left": (-width, -1)}[closed]
    return Window.partitionBy(*by).orderBy(micros(time)).rangeBetween(*frame)


def rolled(df: DataFrame, *, by: Sequence[str], time: str, days: float, sums: dict[str, Column], closed: str = "right", bucket_days: float | None = None) -> DataFrame:
    """Adds sums over each row's last ``days`` (see :func:`rolling`; a count is the sum of 1), for keys with many rows.

    Each key is split into buckets of ``bucket_days``, by default ``days`` and never less; rows that the next bucket looks back to
    are dealt to it as well.  A sum is the difference of two running totals of a bucket, so its cost doesn't grow with
    the rows in a window; sums of doubles are exact but for rounding.  A row without time has the sum 0.
    """
    width = round(days * MICROS_PER_DAY)
    size = max(width, round((bucket_days or days) * MICROS_PER_DAY))
    low, high = {"right": (-width, 0), "left": (-width - 1, -1)}[closed]
    values = {f"_v_{n}": v for n, v in sums.items()}
    rows = df.withColumns(values | {"_t": micros(time)}).withColumn("_home", F.floor(F.col("_t") / size))
    near_end = F.col("_t") >= (F.col("_home") + 1) * size - width
    dealt = rows.withColumn("_bucket", F.explode(F.when(near_end, F.array("_home", F.col("_home") + 1)).otherwise(F.array("_home"))))
    order = Window.partitionBy(*by, "_bucket").orderBy("_t")
    total = lambda n, upto: F.coalesce(F.sum(f"_v_{n}").over(order.rangeBetween(Window.unboundedPreceding, upto)), F.lit(0))
    out = dealt.withColumns({n: total(n, high) - total(n, low) for n in sums}).where(F.col("_bucket").eqNullSafe(F.col("_home")))
    return out.drop("_t", "_home", "_bucket", *values)


def before(by: Sequence[str], order: Sequence[str]) -> WindowSpec:
    """All earlier rows in a total order."""
    return Window.partitionBy(*by).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)


def history(df: DataFrame, *, by: Sequence[str], order: Sequence[str], previous: Sequence[str] = (), following: Sequence[str] = (), sums: Sequence[str] = ()) -> DataFrame:
    """Adds previous_x, next_x, prior_x (sums over earlier rows, 0 for the first) and n_prior, all in one window."""
    ordered = Window.partitionBy(*by).orderBy(*order)
    return df.withColumns(
        {f"previous_{c}": F.lag(c).over(ordered) for c in previous}
        | {f"next_{c}": F.lead(c).over(ordered) for c in following}
        | {f"prior_{c}": F.coalesce(F.sum(c).over(before(by, order)), F.lit(0)) for c in sums}
        | {"n_prior": (F.row_number().over(ordered) - 1).cast("long")}
    )


def keep_first(df: DataFrame, subset: Sequence[str], order: Sequence[str | Column]) -> DataFrame:
    """The first row of each key in a total order; null keys are equal."""
    return df.withColumn("_rank", F.row_number().over(Window.partitionBy(*subset).orderBy(*order))).where("_rank = 1").drop("_rank")


def average_rank(df: DataFrame, value: str) -> DataFrame:
    """(value, n, average rank from 1) of a column of numbers; values are ordered within narrow buckets only."""
    upto = running(counted(df, value), ["_n"])
    return upto.select(F.col("_s").alias(value), F.col("_n").alias("n"), (F.col("_upto_n") - (F.col("_n") - 1) / 2).alias("average_rank"))
