"""Query of the toxicity operator."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import toxicity
from .common import table

THRESHOLD = 0.7


def op10_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text")
    net = toxicity.fit(documents, table(spark, sf_dir, "labels"))
    return toxicity.score(documents, net, "score").select("doc_id", toxicity.held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).cast("int").alias("predicted"))


QUERIES = {"op10_toxicity": op10_toxicity}
ORACLE: dict[str, str] = {}
