"""Query of embedding whitening."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .whitening import whitened

COMPONENTS = 16


def op11_embedding_whitening(spark: SparkSession, sf_dir: str) -> DataFrame:
    return whitened(table(spark, sf_dir, "embeddings").select("vec_id", "embedding"), COMPONENTS)


QUERIES = {"op11_embedding_whitening": op11_embedding_whitening}
#: Eigenvectors are beyond SQL; tests compare with the exact covariance in fractions.
ORACLE: dict[str, str] = {}
