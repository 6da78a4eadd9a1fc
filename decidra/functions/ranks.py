"""Ranks and quantiles in two steps, so that no task sees all values of a group.

A value's bucket rises with the value: 1,024 buckets for each power of two and sign.  Totals by bucket are ordered by one
window (at most a few thousand rows a group), values only within their bucket; so two values share a task only if they
differ by less than a thousandth.  Repeated values are counted before anything is ordered.
"""

from __future__ import annotations

from collections.abc import Callable, Sequence

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Buckets for each power of two.
STEPS = 1024
_ZERO = 1100 * STEPS  # more than the steps of the smallest double


def bucket(value: Column) -> Column:
    """A whole number that never falls while the value rises; null for null, NaN is greatest."""
    x = value.cast("double")
    size = F.abs(x)
    octave = F.least(F.floor(F.log2(size)), F.lit(1023))  # an octave too high or too low gives the same step
    step = octave * STEPS + F.floor(size / F.pow(F.lit(2.0), octave) * STEPS) - STEPS + _ZERO
    far = F.lit(3 * _ZERO)
    place = F.when(F.isnan(x), far + 1).when(size == float("inf"), far * F.signum(x)).when(x == 0, F.lit(0)).otherwise(step * F.signum(x))
    return F.when(x.isNotNull(), place.cast("long"))


def same(left: DataFrame, right: DataFrame, on: Sequence[str]) -> DataFrame:
    """An inner join in which null keys are equal; the keys are kept once."""
    renamed = right.select(*(F.col(c).alias(f"_r_{c}") if c in on else F.col(c) for c in right.columns))
    meets = F.lit(True)
    for c in on:
        meets = meets & F.col(c).eqNullSafe(F.col(f"_r_{c}"))
    return left.join(renamed, meets).drop(*(f"_r_{c}" for c in on))


def counted(df: DataFrame, value: str, by: Sequence[str] = ()) -> DataFrame:
    """(by, _s, _n, _bucket): different values that aren't null, with their rows and bucket."""
    return df.where(F.col(value).isNotNull()).groupBy(*by, F.col(value).alias("_s")).agg(F.count("*").alias("_n")).withColumn("_bucket", bucket(F.col("_s")))


def before_buckets(groups: DataFrame, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """(by, _bucket, _in_x, _before_x, _all_x) of the columns x: sums within, before and over all buckets of a group."""
    order = F.desc("_bucket") if descending else F.asc("_bucket")
    whole = Window.partitionBy(*by)
    earlier = whole.orderBy(order).rowsBetween(Window.unboundedPreceding, -1)
    totals = groups.groupBy(*by, "_bucket").agg(*(F.sum(x).alias(f"_in{x}") for x in sums))
    return totals.withColumns({f"_before{x}": F.coalesce(F.sum(f"_in{x}").over(earlier), F.lit(0)) for x in sums} | {f"_all{x}": F.sum(f"_in{x}").over(whole) for x in sums})


def running(groups: DataFrame, sums: Sequence[str], by: Sequence[str] = (), descending: bool = False) -> DataFrame:
    """``groups`` (by, _s, _bucket, ...) with _upto_x, the sum of x up to and with the row's value, and _all_x."""
    order = F.desc("_s") if descending else F.asc("_s")
    within = Window.partitionBy(*by, "_bucket").orderBy(order)
    local = groups.withColumns({f"_upto{x}": F.sum(x).over(within) for x in sums})
    out = same(local, before_buckets(groups, sums, by, descending), [*by, "_bucket"])
    return out.withColumns({f"_upto{x}": F.col(f"_upto{x}") + F.col(f"_before{x}") for x in sums}).drop(*(f"{p}{x}" for p in ("_in", "_before") for x in sums))


def order_statistics(df: DataFrame, value: str, places: Callable[[Column], Sequence[Column]], by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, found): a map from the places, counted from 0 and given by the number of rows, to the values there.

    Only the buckets that hold such a place are read again.  Nulls don't count; a group of nulls has no row.
    """
    groups = counted(df, value, by)
    wanted = F.array_distinct(F.array(*(p.cast("long") for p in places(F.col("_all_n")))))
    spots = before_buckets(groups, ["_n"], by).withColumn("_places", F.filter(wanted, lambda p: (p >= F.col("_before_n")) & (p < F.col("_before_n") + F.col("_in_n")))).where(F.size("_places") > 0)
    near = same(groups, spots, [*by, "_bucket"])
    upto = F.sum("_n").over(Window.partitionBy(*by, "_bucket").orderBy("_s")) + F.col("_before_n")
    ranked = near.withColumn("_upto", upto).withColumn("_places", F.filter("_places", lambda p: (p < F.col("_upto")) & (p >= F.col("_upto") - F.col("_n"))))
    hits = ranked.select(*by, "_all_n", "_s", F.explode("_places").alias("_place"))
    return hits.groupBy(*by).agg(F.max("_all_n").alias("rows"), F.map_from_entries(F.collect_list(F.struct("_place", "_s"))).alias("found"))


def quantiles(df: DataFrame, value: str, shares: Sequence[float], by: Sequence[str] = ()) -> DataFrame:
    """(by, rows, quantiles): exact, with linear interpolation between neighbours.

    Without ``by`` there is one row, of nulls for an empty table.
    """
    at = lambda q, n: F.lit(float(q)) * (n - 1)
    got = order_statistics(df, value, lambda n: [f(at(q, n)) for q in shares for f in (F.floor, F.ceil)], by)

    def interpolated(q: float) -> Column:
        place = at(q, F.col("rows"))
        low, high = (F.try_element_at("found", f(place).cast("long")).cast("double") for f in (F.floor, F.ceil))
        return F.when(low == high, low).otherwise(low + (high - low) * (place - F.floor(place)))

    return got.select(*by, "rows", F.array(*(interpolated(q) for q in shares)).alias("quantiles"))


def tiles(df: DataFrame, value: str, key: str, n: int, name: str = "tile") -> DataFrame:
    """``df`` with the tile, from 1 to ``n``, of each row in the order of (value, key), both numbers; nulls come first.

    Tiles are of equal size, the first ones a row larger.  Totals order the buckets, then the values with buckets of
    the key within them; rows are only numbered among those of one value and one bucket of keys.
    """
    rows = df.withColumns({"_bucket": bucket(F.col(value)), "_keys": bucket(F.col(key))})
    cells = rows.groupBy("_bucket", F.col(value).alias("_s"), "_keys").agg(F.count("*").alias("_n"))
    tops = before_buckets(cells, ["_n"]).drop("_in_n")
    inner = Window.partitionBy("_bucket").orderBy("_s", "_keys").rowsBetween(Window.unboundedPreceding, -1)
    starts = same(cells.withColumn("_start", F.coalesce(F.sum("_n").over(inner), F.lit(0))), tops, ["_bucket"]).select("_s", "_keys", (F.col("_start") + F.col("_before_n")).alias("_start"), F.col("_all_n").alias("_all"))
    local = rows.withColumn("_place", F.row_number().over(Window.partitionBy(value, "_keys").orderBy(key)) - 1).withColumn("_s", F.col(value))
    placed = same(local, starts, ["_s", "_keys"]).withColumn("_place", F.col("_place") + F.col("_start"))
    tile = F.expr(f"CASE WHEN _place < (_all % {n}) * (_all div {n} + 1) THEN _place div (_all div {n} + 1) ELSE _all % {n} + (_place - (_all % {n}) * (_all div {n} + 1)) div (_all div {n}) END") + 1
    return placed.withColumn(name, tile.cast("long")).select(*df.columns, name)
