"""Table functions and aggregates of one's own.

``window_days`` is a table function for lateral joins: the days of a span as rows, which no column expression of one row
gives with a running number and a share; it is a function of SQL, so rows never leave the JVM.  ``trimmed_mean`` is an aggregate whose parts merge: what a task has seen of a
group is a few sums and its extremes, so the groups' values never meet.
"""

from __future__ import annotations

from collections.abc import Iterator, Sequence

import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def register_window_days(spark: SparkSession, name: str = "window_days") -> str:
    """Registers the table function ``name(start, stop, step)``: (number, begins, ends, share) for each ``step`` days of
    [start, stop); the last piece may be shorter, ``share`` is its part of the span.  Nulls and empty spans give no rows."""
    whole = "datediff(stop, start)"
    last = f"least({whole}, first + step)"
    piece = f"named_struct('number', k, 'begins', date_add(start, first), 'ends', date_add(start, {last}), 'share', ({last} - first) / {whole})"
    spark.sql(
        f"""CREATE OR REPLACE TEMPORARY FUNCTION {name}(start DATE, stop DATE, step INT) RETURNS TABLE (number INT, begins DATE, ends DATE, share DOUBLE)
        RETURN SELECT w.number, w.begins, w.ends, w.share FROM inline(CASE WHEN start < stop AND step > 0 THEN transform(sequence(0, {whole} - 1, step), (first, k) -> {piece}) END) w(number, begins, ends, share)"""
    )
    return name


_PART = "n long, total double, least array<double>, most array<double>"


def trimmed_mean(df: DataFrame, value: str, by: Sequence[str], trim: int = 1) -> DataFrame:
    """(by, rows, trimmed_mean) without the ``trim`` smallest and largest values; null where none are left.

    Each task sends one row a group: the number, the sum and the ``trim`` extremes; merging adds and takes the extremes of
    both.  Nulls don't count.
    """
    import numpy as np

    keys = [f"{c} {dict(df.dtypes)[c]}" for c in by]

    def ends(values: np.ndarray) -> tuple[list[float], list[float]]:
        ordered = np.sort(values)
        return ordered[:trim].tolist(), ordered[max(0, len(ordered) - trim) :].tolist()

    def partial(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        seen: dict[tuple, list] = {}
        for f in frames:
            for key, g in f.groupby(list(by), dropna=False, sort=False):
                v = g[value].to_numpy(float)
                low, high = ends(v)
                s = seen.setdefault(key, [0, 0.0, [], []])
                s[0], s[1] = s[0] + len(v), s[1] + float(v.sum())
                s[2], s[3] = ends(np.array(s[2] + low))[0], ends(np.array(s[3] + high))[1]
            if len(seen) > 100_000:
                yield rows(seen)
                seen = {}
        if seen:
            yield rows(seen)

    def rows(seen: dict) -> pd.DataFrame:
        out = pd.DataFrame([k if isinstance(k, tuple) else (k,) for k in seen], columns=list(by)).astype(object)
        out = out.where(out.notna(), None)
        for k, c in enumerate(("n", "total", "least", "most")):
            out[c] = [s[k] for s in seen.values()]
        return out

    parts = df.where(F.col(value).isNotNull()).select(*by, F.col(value).cast("double").alias(value)).mapInPandas(partial, f"{', '.join(keys)}, {_PART}")
    merged = parts.groupBy(*by).agg(
        F.sum("n").alias("rows"), F.sum("total").alias("total"),
        F.slice(F.array_sort(F.flatten(F.collect_list("least"))), 1, trim).alias("least"), F.slice(F.reverse(F.array_sort(F.flatten(F.collect_list("most")))), 1, trim).alias("most"),
    )
    add = lambda c: F.aggregate(c, F.lit(0.0), lambda a, x: a + x)
    left = F.col("rows") - 2 * trim
    return merged.select(*by, "rows", F.when(left > 0, (F.col("total") - add("least") - add("most")) / left).alias("trimmed_mean"))
