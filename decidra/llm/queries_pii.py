"""Query of the search for personal data."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import pii, spans
from .common import table, text_or_empty


def _row(text: str, base: list, added: list) -> tuple:
    del text
    return (*(sum(s[0] == k for s in base) for k in pii.KINDS), spans.digest(base, pii.KINDS), spans.joined(base + added, pii.KINDS))


def op5_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return pii.found(documents, pii.fit(documents), _row, "n_email long, n_ip long, n_card long, n_phone long, base_sha256 string, spans string")


QUERIES = {"op5_pii": op5_pii}
ORACLE: dict[str, str] = {}
