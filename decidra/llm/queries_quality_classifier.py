"""Query of the quality classifier: the labels of a third of the ids, chosen as for toxicity, are kept for measuring."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import quality_classifier
from .common import table
from .toxicity import held_out

THRESHOLD = 0.5


def op4_quality_classifier(spark: SparkSession, sf_dir: str) -> DataFrame:
    documents = table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source", "n_chars")
    model = quality_classifier.fit(documents, table(spark, sf_dir, "labels"), ~held_out())
    return quality_classifier.score(documents, model).select("doc_id", held_out().alias("held_out"), "score", (F.col("score") >= THRESHOLD).alias("kept"))


QUERIES = {"op4_quality_classifier": op4_quality_classifier}
ORACLE: dict[str, str] = {}
