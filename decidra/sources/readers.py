"""Readers of raw files: all-string and tolerant CSV, CSV in archives, JSON lines, and paged portals."""

from __future__ import annotations

import io
import zipfile
from collections.abc import Callable, Iterator, Sequence

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StringType, StructField, StructType

from ..operators.profile import without_sentinels


def csv_strings(spark: SparkSession, path: str, columns: Sequence[str] | None = None, sentinels: Sequence[str] = ()) -> DataFrame:
    """All columns as strings; an empty field stays an empty string, sentinels become nulls, columns are pruned."""
    df = spark.read.csv(path, header=True, inferSchema=False, nullValue="\0", emptyValue="", multiLine=False)
    df = df.select(*columns) if columns else df
    return without_sentinels(df, tuple(sentinels)) if sentinels else df


def csv_tolerant(spark: SparkSession, path: str, schema: StructType) -> tuple[DataFrame, DataFrame]:
    """Rows that fit ``schema``, typed, and those that don't, as strings.  An empty field is null."""
    raw = spark.read.csv(path, header=True, inferSchema=False, mode="PERMISSIVE")
    fits = F.lit(True)
    for f in schema.fields:
        fits = fits & (F.col(f.name).isNull() | F.col(f.name).try_cast(f.dataType).isNotNull())
    return raw.where(fits).select(*(F.col(f.name).try_cast(f.dataType).alias(f.name) for f in schema.fields)), raw.where(~fits)


def csv_inferred(spark: SparkSession, path: str, sampling: float = 0.1) -> DataFrame:
    return spark.read.csv(path, header=True, inferSchema=True, samplingRatio=sampling)


def csv_in_zips(spark: SparkSession, path: str, columns: Sequence[str], limit: int = 4 << 30) -> DataFrame:
    """Rows of all CSV files in all ZIP files of ``path`` as strings; missing columns are null.

    Each archive is one task; a member over ``limit`` bytes, or one that would leave the archive's folder, is refused.
    """
    import pandas as pd

    names = list(columns)

    def work(frames: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for frame in frames:
            for content in frame["content"]:
                with zipfile.ZipFile(io.BytesIO(content)) as archive:
                    for member in archive.infolist():
                        if member.is_dir() or not member.filename.lower().endswith(".csv"):
                            continue
                        check_member(member, limit)
                        with archive.open(member) as raw:
                            for part in pd.read_csv(raw, dtype=str, keep_default_na=False, chunksize=20_000, usecols=lambda c: c in names):
                                yield part.reindex(columns=names).astype(object).where(lambda x: x.notna(), None)

    return spark.read.format("binaryFile").load(path).select("content").mapInPandas(work, StructType([StructField(c, StringType()) for c in names]))


class UnsafeArchive(ValueError):
    """A member that mustn't be extracted."""


def check_member(member: zipfile.ZipInfo, limit: int) -> None:
    if member.filename.startswith(("/", "\\")) or ".." in member.filename.replace("\\", "/").split("/"):
        raise UnsafeArchive(f"{member.filename} leaves the folder")
    if member.file_size > limit:
        raise UnsafeArchive(f"{member.filename} has {member.file_size} bytes")


def json_lines(spark: SparkSession, path: str, schema: StructType | str, columns: dict[str, str | Column]) -> DataFrame:
    """Nested records as flat columns: names and paths such as ``a.b.c``, or expressions."""
    df = spark.read.schema(schema).json(path)
    return df.select(*((F.col(c) if isinstance(c, str) else c).alias(name) for name, c in columns.items()))
