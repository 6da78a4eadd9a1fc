"""Query of benchmark decontamination."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .decontamination import matches


def op1_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    return matches(table(spark, sf_dir, "documents").select("doc_id", "text"), table(spark, sf_dir, "benchmark"))


QUERIES = {"op1_decontamination": op1_decontamination}
ORACLE: dict[str, str] = {}
