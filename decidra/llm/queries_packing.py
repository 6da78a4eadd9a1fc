"""Query of best-fit packing."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

from .common import table
from .packing import packed, pieces


def vocabulary() -> str:
    """The tokenizer's file on this machine."""
    import public_tokenizers

    return str(public_tokenizers.path("word_bpe_49k.json"))


def op9_best_fit_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packed(pieces(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary))


QUERIES = {"op9_best_fit_packing": op9_best_fit_packing}
ORACLE: dict[str, str] = {}
