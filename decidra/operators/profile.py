"""Profiles of tables: counts, sentinels, duplicates and row balances, each in one pass."""

from __future__ import annotations

from collections.abc import Mapping

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StringType

#: Strings that usually stand for a missing value.
SENTINELS = ("NA", "N/A", "NULL", "None", "none", "null", "nan", "NaN", "-", "--", "?", "", " ", "Unknown", "UNKNOWN", "unknown", "missing", "MISSING", "9999", "-1", "-999")


def distinct_with_null(column: str) -> Column:
    """Distinct values, null counted as one."""
    return (F.count_distinct(F.col(column)) + F.coalesce(F.max(F.col(column).isNull().cast("int")), F.lit(0))).cast("long")


def profile(df: DataFrame) -> DataFrame:
    """(column, type, rows, nulls, distinct) of each column; one aggregation, then a row for each."""
    named = df.columns
    wide = df.agg(F.count("*").alias("_rows"), *(F.count_if(F.col(c).isNull()).alias(f"n{k}") for k, c in enumerate(named)), *(distinct_with_null(c).alias(f"d{k}") for k, c in enumerate(named)))
    rows = F.array(*(F.struct(F.lit(c).alias("column"), F.lit(t).alias("type"), F.col("_rows").alias("rows"), F.col(f"n{k}").alias("nulls"), F.col(f"d{k}").alias("distinct")) for k, (c, t) in enumerate(df.dtypes)))
    return wide.select(F.inline(rows))


def sentinel_counts(df: DataFrame) -> DataFrame:
    """(column, n) of string columns: how often a sentinel stands for a value."""
    strings = [f.name for f in df.schema.fields if isinstance(f.dataType, StringType)]
    if not strings:
        return df.sparkSession.createDataFrame([], "column string, n long")
    wide = df.agg(*(F.count_if(F.col(c).isin(*SENTINELS)).alias(f"s{k}") for k, c in enumerate(strings)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(c).alias("column"), F.col(f"s{k}").alias("n")) for k, c in enumerate(strings)))))


def without_sentinels(df: DataFrame, tokens: Mapping[str, tuple[str, ...]] | tuple[str, ...] = SENTINELS) -> DataFrame:
    """Sentinels of string columns as nulls; ``tokens`` may differ by column."""
    out = {}
    for f in df.schema.fields:
        if isinstance(f.dataType, StringType):
            mine = tokens.get(f.name, ()) if isinstance(tokens, Mapping) else tokens
            if mine:
                out[f.name] = F.when(~F.col(f.name).isin(*mine), F.col(f.name))
    return df.withColumns(out) if out else df


def duplicate_rows(df: DataFrame) -> DataFrame:
    """One row: how many rows repeat an earlier one in all columns."""
    return df.groupBy(*df.columns).agg(F.count("*").alias("n")).agg(F.coalesce(F.sum(F.col("n") - 1), F.lit(0)).cast("long").alias("duplicates"))


class UnbalancedRows(ValueError):
    """Rows were lost that no declared reason explains."""


def row_balance(df: DataFrame, losses: Mapping[str, Column]) -> DataFrame:
    """The rows that no reason drops; raises unless each lost row has a reason.

    A row counts for the first reason that is true of it; a null reason is no reason.  One aggregation.
    """
    why = F.lit(None).cast("string")
    for name, reason in reversed(losses.items()):
        why = F.when(F.coalesce(reason, F.lit(False)), F.lit(name)).otherwise(why)
    return df.withColumn("_why", why).where("_why is null").drop("_why")


def loss_counts(df: DataFrame, losses: Mapping[str, Column]) -> DataFrame:
    """One row: rows read, kept, and lost by each reason (the first that holds); raises if they don't add up."""
    rest, columns = F.lit(True), []
    for name, reason in losses.items():
        mine = rest & F.coalesce(reason, F.lit(False))
        columns.append(F.count_if(mine).alias(name))
        rest = rest & ~F.coalesce(reason, F.lit(False))
    out = df.agg(F.count("*").alias("read"), F.count_if(rest).alias("kept"), *columns)
    return out.withColumn("balanced", F.col("read") == F.col("kept") + sum((F.col(c) for c in losses), F.lit(0)))
