"""Query of the n-gram Jaccard join."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .jaccard_join import Threshold, similar_components


def op7_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return similar_components(table(spark, sf_dir, "documents").select("doc_id", "text"), 4, Threshold(85, 100))


QUERIES = {"op7_ngram_jaccard_join": op7_ngram_jaccard_join}
ORACLE: dict[str, str] = {}
