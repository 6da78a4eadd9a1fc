"""Query of the scan for secrets."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import secrets_scan
from .common import table, text_or_empty


def _joined(column: Column) -> Column:
    """kind:start:end, comma-joined, by start and then kind as listed."""
    rank = lambda s: F.array_position(F.array(*map(F.lit, secrets_scan.KINDS)), s["kind"])
    ordered = F.array_sort(F.transform(column, lambda s: F.struct(s["start"].alias("a"), rank(s).alias("k"), s["end"].alias("z"), s["kind"].alias("kind"))))
    return F.array_join(F.transform(ordered, lambda s: F.concat_ws(":", s["kind"], s["a"].cast("string"), s["z"].cast("string"))), ",")


def op6_secret_scan(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    count = lambda kind: F.size(F.filter("base", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    return secrets_scan.found(documents).select("doc_id", count("assign"), count("access"), count("hex"), F.sha2(_joined(F.col("base")), 256).alias("base_sha256"), _joined(F.concat("base", "added")).alias("spans"))


QUERIES = {"op6_secret_scan": op6_secret_scan}
ORACLE: dict[str, str] = {}
