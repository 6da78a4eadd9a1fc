"""Texts of raw files as times, parts of dates, and names."""

from __future__ import annotations

import re

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def two_digit_year(column: str, last_year: int) -> Column:
    """A date such as 7-Mar-98; two digits never mean a year after ``last_year``."""
    day = F.try_to_timestamp(column, F.lit("d-MMM-yy")).cast("date")
    return F.when(F.year(day) > last_year, F.add_months(day, -1200)).otherwise(day)


def partial_date(column: str) -> Column:
    """yyyy-MM-dd, or the last day of yyyy-MM; null for anything else."""
    return F.coalesce(F.try_to_timestamp(column, F.lit("yyyy-MM-dd")).cast("date"), F.last_day(F.try_to_timestamp(column, F.lit("yyyy-MM")).cast("date")))


def date_parts(column: str) -> dict[str, Column]:
    """Year, month and day of a date whose end may be missing (yyyy, yyyy-MM or yyyy-MM-dd)."""
    parts = F.split(F.col(column), "-")
    return {name: F.get(parts, F.lit(k)).try_cast("int") for k, name in enumerate(("year", "month", "day"))}


def normalised(df: DataFrame) -> DataFrame:
    """Column names in lower case, with one underscore for everything that is no letter or digit; equal names are refused."""
    names = [re.sub(r"[^a-z0-9]+", "_", c.strip().lower()).strip("_") for c in df.columns]
    if len(set(names)) < len(names) or "" in names:
        raise ValueError(f"column names can't be told apart: {names}")
    return df.toDF(*names)


def has_word(column: str, words: tuple[str, ...]) -> Column:
    """Whether one of ``words`` stands in the text as a word of its own, in any case; null texts give null."""
    return F.col(column).rlike(r"(?i)(?<![A-Za-z0-9_])(?:" + "|".join(re.escape(w) for w in words) + r")(?![A-Za-z0-9_])")
