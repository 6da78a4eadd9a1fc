"""Deterministic Parquet, and manifests of files."""

from __future__ import annotations

import hashlib
from collections.abc import Sequence
from pathlib import Path

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F


def write_sorted(df: DataFrame, path: str, order: Sequence[str]) -> None:
    """Parquet in a total order of rows; the commit protocol makes it appear at once.  Hash its content, not its files."""
    df.repartitionByRange(*order).sortWithinPartitions(*order).write.mode("error").option("compression", "none").parquet(path)


def write_parts(split, path: str) -> None:
    """The parts of a split's windows as Parquet, in folders ``window=.../side=...``."""
    split.tagged().write.mode("error").partitionBy("window", "side").parquet(path)


def content_digest(df: DataFrame) -> str:
    """A digest of the rows, whatever their order or files: sums of row hashes, and their number."""
    h = F.xxhash64(*df.columns)
    other = F.xxhash64(F.lit(1), *df.columns)
    got = df.agg(F.count("*").alias("n"), F.sum(F.pmod(h, F.lit(1 << 31))).alias("a"), F.sum(F.pmod(other, F.lit((1 << 31) - 1))).alias("b")).first()
    return hashlib.sha256(f"{got.n}:{got.a or 0}:{got.b or 0}:{','.join(f'{n} {t}' for n, t in df.dtypes)}".encode()).hexdigest()[:12]


def manifest(spark: SparkSession, path: str) -> DataFrame:
    """(name, bytes, sha256) of the files in ``path``, named from there on, hashed where they are read."""
    files = spark.read.format("binaryFile").option("recursiveFileLookup", "true").load(path)
    root = spark._jvm.org.apache.hadoop.fs.Path(path)
    root = root.getFileSystem(spark._jsparkSession.sessionState().newHadoopConf()).makeQualified(root).toString()
    return files.select(F.expr(f"substring(path, {len(root.rstrip('/')) + 2})").alias("name"), F.col("length").alias("bytes"), F.sha2("content", 256).alias("sha256"))


def verify(declared: DataFrame, found: DataFrame, strict: bool = True) -> DataFrame:
    """(name, problem): missing, changed, and with ``strict`` extra files."""
    both = declared.select("name", F.col("sha256").alias("d")).join(found.select("name", F.col("sha256").alias("f")), "name", "full_outer")
    problem = F.when(F.col("f").isNull(), "missing").when(F.col("d").isNull(), "extra" if strict else None).when(F.col("d") != F.col("f"), "changed")
    return both.select("name", problem.alias("problem")).where("problem is not null")


def dataset_digest(entries: DataFrame) -> str:
    """12 digits of the SHA-256 over sorted ``name:sha256``; manifests are small."""
    lines = sorted(f"{r.name}:{r.sha256}" for r in entries.select("name", "sha256").collect())
    return hashlib.sha256("\n".join(lines).encode()).hexdigest()[:12]


def write_report(path: str | Path, text: str) -> None:
    """A small report, written beside its place and then moved there."""
    part = Path(f"{path}.part")
    part.write_text(text, encoding="utf-8")
    part.replace(path)
