"""Corpus pipeline: five stages over ``documents``, each written as Parquet and read again as the next one's input.

Null and empty texts pass all filters (they are no copies, leaks or insults) and are packed as end tokens.  Rows without
an id stay in the filters: they can't be named as copies or leaks.  Rows that repeat an id and a text are one row after the
second stage; other texts of that id stay.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from decidra.llm import decontamination, jaccard_join, packing, pii, toxicity
from decidra.llm.common import scratch, table, text_or_empty
from decidra.llm.queries_packing import vocabulary

TOXIC = 0.7
#: Near copies: five words and a similarity of 0.8.
WORDS, SIMILAR = 5, jaccard_join.Threshold(8, 10)


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the toxicity network scores below the threshold."""
    net = toxicity.fit(docs, table(spark, sf_dir, "labels"))
    return toxicity.score(docs, net, "_toxicity").where(F.coalesce(F.col("_toxicity"), F.lit(0.0)) < TOXIC).select(docs.columns)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near copies the document with the smallest id; of rows that repeat an id, one of each text (the smallest
    by the other columns, so that every run keeps the same)."""
    groups = jaccard_join.similar_components(docs, WORDS, SIMILAR)
    gone = groups.where("n_shingles > 0 and component_id < doc_id").select("doc_id").distinct()
    again = docs.groupBy("doc_id").count().where("doc_id is not null and count > 1").select("doc_id")
    kept = docs.join(gone, "doc_id", "left_anti")
    single = kept.join(again, "doc_id", "left_anti").select(docs.columns)
    rest = [c for c in docs.columns if c not in ("doc_id", "text")]
    one = kept.join(again, "doc_id", "left_semi").groupBy("doc_id", "text").agg(F.min(F.struct(F.lit(0).alias("k"), *(F.col(c).alias(f"c{j}") for j, c in enumerate(rest)))).alias("_row"))
    return single.unionByName(one.select("doc_id", "text", *(F.col(f"_row.c{j}").alias(c) for j, c in enumerate(rest))).select(docs.columns))


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that match no benchmark item."""
    return decontamination.without_leaks(docs, table(spark, sf_dir, "benchmark"))


def redact(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with personal data replaced by its kind and ``n_chars`` of the new text."""
    rows = docs.withColumn("_null", F.col("text").isNull()).withColumn("text", text_or_empty())
    made = pii.found(rows, pii.fit(rows), lambda text, base, added: (pii.redacted(text, base + added) if base or added else text,), "_new string")
    out = made.withColumn("text", F.when(~F.col("_null"), F.col("_new"))).withColumn("n_chars", F.when(F.col("_null"), F.col("n_chars")).otherwise(F.char_length("_new").cast("long")))
    return out.select(docs.columns)


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The pieces of all documents with their places in sequences."""
    return packing.packed(packing.pieces(docs, vocabulary))


STAGES = [("toxicity", drop_toxic), ("near_copies", drop_near_copies), ("decontamination", drop_leaks), ("pii", redact), ("packing", pack)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        path = scratch(spark, f"pipeline-{k}-{name}")
        stage(spark, docs, sf_dir).write.option("compression", "zstd").parquet(path)
        docs = spark.read.parquet(path)
    return docs


#: The network's scores and the tokenizer's ids are beyond SQL.
ORACLE_SQL = None
