from pyspark.sql import functions as F

import corpus_pipeline
from decidra.llm import registry
from decidra.llm.common import written

DATA = "/root/testdata/sf0.001"


def test_stages_on_the_smallest_tables(spark):
    docs = spark.read.parquet(f"{DATA}/documents.parquet")
    odd = spark.createDataFrame([(90001, None, None, None, None), (90002, "", "en", "s", 0), (None, "mail a@b.org now", "en", "s", 16)], docs.schema)
    docs = docs.unionByName(odd)
    counts = [docs.count()]
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = written(stage(spark, docs, DATA), f"test-{name}")
        assert out.columns == docs.columns
        counts.append(out.count())
        docs = out
    assert counts == sorted(counts, reverse=True) and counts[-1] > counts[0] / 2
    rows = {r.doc_id: r for r in docs.collect()}
    assert rows[90001].text is None and rows[90002].text == "" and rows[None].text == "mail [email] now"
    pieces = corpus_pipeline.pack(spark, docs, DATA).collect()
    assert {p.doc_id for p in pieces} == set(rows)


def test_registry_has_each_operator():
    assert {n.split("_")[0] for n in registry.queries()} == {f"op{k}" for k in range(1, 14)}


def test_repeated_ids_and_odd_rows_without_labels_or_benchmark(spark, tmp_path):
    """Empty side tables, repeated ids, equal rows, very long texts: nothing but copies goes, and every run keeps the same."""
    for name in ("labels", "benchmark"):
        spark.read.parquet(f"{DATA}/{name}.parquet").limit(0).write.parquet(str(tmp_path / f"{name}.parquet"))
    docs = spark.read.parquet(f"{DATA}/documents.parquet").limit(0)
    text = " ".join(f"word{k}" for k in range(60))
    rows = [(1, text, "en", "a", 9), (2, text, "en", "b", 9), (3, text + " more", "en", "a", 9), (4, "one text of an id that repeats", "en", "z", 1), (4, "one text of an id that repeats", "en", "a", 1), (4, "another text of the same id, quite unlike", None, None, None), (5, "long " * 200_000, "en", "a", None), (None, None, None, None, None), (None, None, None, None, None), (6, "", "en", "a", 0)]
    docs = docs.unionByName(spark.createDataFrame(rows, docs.schema)).withColumn("_first", F.lit("clash")).withColumn("component_id", F.lit(7))
    for stage in (corpus_pipeline.drop_toxic, corpus_pipeline.drop_leaks, corpus_pipeline.redact):
        out = stage(spark, docs, str(tmp_path))
        assert out.columns == docs.columns and out.count() == len(rows)
    kept = corpus_pipeline.drop_near_copies(spark, docs, str(tmp_path))
    assert kept.columns == docs.columns
    got = sorted((r.doc_id or 0, (r.text or "")[:7], r.source or "") for r in kept.collect())
    assert got == [(0, "", ""), (0, "", ""), (1, "word0 w", "a"), (4, "another", ""), (4, "one tex", "a"), (5, "long lo", "a"), (6, "", "a")]
    pieces = corpus_pipeline.pack(spark, kept, str(tmp_path)).collect()
    assert {p.doc_id for p in pieces} == {None, 1, 4, 5, 6} and sum(p.doc_id == 5 for p in pieces) > 1
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, docs.limit(0), str(tmp_path)).count() == 0, name
