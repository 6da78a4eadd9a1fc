"""Query of sharding."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import table, text_or_empty
from .sharding import sharded

SHARDS = 16


def op13_sharding(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", text_or_empty().alias("text"))
    rows = docs.select("doc_id", "text", F.crc32(F.encode("text", "UTF-8")).alias("text_crc32"))
    size = F.octet_length("text") + 1
    out = sharded(rows, F.col("text"), size, ["doc_id", "text_crc32"], SHARDS)
    return out.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", "slot", F.lit(None).cast("int").alias("grown_shard"))


QUERIES = {"op13_sharding": op13_sharding}
#: The splitters come from a sample; tests hold shards, slots and groups against what the law says.
ORACLE: dict[str, str] = {}
