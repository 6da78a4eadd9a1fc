"""Queries do the whole of their job, and no step of them grows faster than its input."""

from __future__ import annotations

DATA = "/root/testdata/sf0.001"


def test_approximate_counts_are_taken_of_a_column_with_many_values(spark):
    from decidra.plans.exchange import QUERIES

    exact = spark.read.parquet(f"{DATA}/lineitem.parquet").select("l_partkey").distinct().count()
    rows = {r.l_linestatus: r for r in QUERIES["ag14_approx_distinct"](spark, DATA).collect()}
    assert rows[None].parts == exact > 100 and all(r.near for r in rows.values()) and len(rows) == 3


def _scans(spark, act, name: str) -> int:
    """How many executed plans read a file of this name while ``act`` runs."""
    store = spark._jsparkSession.sharedState().statusStore()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    before = store.executionsCount()
    act()
    spark.sparkContext._jsc.sc().listenerBus().waitUntilEmpty()
    new = store.executionsList(before, store.executionsCount() - before)
    return sum(name in new.apply(k).physicalPlanDescription() for k in range(new.size()))


def test_a_measurement_labels_the_orders_once(spark):
    from decidra.plans.measures import QUERIES

    assert _scans(spark, lambda: QUERIES["met12_stability"](spark, DATA), "lineitem.parquet") == 1


def test_a_table_function_keeps_rows_in_the_jvm(spark):
    from decidra.functions import tables

    name = tables.register_window_days(spark, "years")
    plan = spark.sql(f"SELECT w.* FROM (SELECT date_add(DATE'2024-01-01', id::INT) AS z FROM range(3)) s, LATERAL {name}(DATE'2024-01-01', z, 365) w")
    assert "Python" not in plan._jdf.queryExecution().toString() and plan.count() == 2


def test_pages_of_a_sorted_table_read_their_row_groups_only(spark, tmp_path, monkeypatch):
    import random

    import pyarrow as pa
    import pyarrow.parquet as pq

    from decidra.sources import paged

    keys = list(range(1000))
    tables = {"sorted": keys, "mixed": random.Random(1).sample(keys, 1000), "null": [None, *keys[1:]], "tied": [k // 3 for k in keys]}
    read = []
    for name, ks in tables.items():
        pq.write_table(pa.table({"k": ks, "m": [None if k is None else k % 7 for k in ks]}), tmp_path / name, row_group_size=50)
        service = paged.ParquetService(str(tmp_path / name), "k")
        for where, keep in (([], lambda k: True), ([paged.Condition("k", ">=", 60)], lambda k: k is not None and k >= 60), ([paged.Condition("m", ">=", 2), paged.Condition("k", "in", keys[10:900])], lambda k: k is not None and k % 7 >= 2 and 10 <= k < 900)):
            want = [(k,) for k in sorted((k for k in ks if keep(k)), key=lambda k: (k is None, k))]
            got = [r for at in range(0, len(want), 30) for r in service.fetch(["k"], where, at, 30)]
            assert got == want and service.count(where) == len(want), name
    service = paged.ParquetService(str(tmp_path / "sorted"), "k")
    monkeypatch.setattr(paged.ParquetService, "_page", lambda self, place, *a: read.append(len(place.groups)) or [])
    service.fetch(["k"], [], 495, 10)
    places = service.located([], 495, 10)
    monkeypatch.setattr(paged, "_runs", None)  # a task is told where its page lies
    assert service.fetch_at(["k"], [], places) == [] and read.pop() and read.pop()
    assert read == [1, 1]


def test_studies_aggregate_the_lines_once(spark):
    from decidra.plans.built import QUERIES

    plan = QUERIES["bld_studies"](spark, DATA)._jdf.queryExecution().optimizedPlan().toString()
    assert plan.count("l_orderkey") and sum("Aggregate [l_orderkey" in line for line in plan.splitlines()) == 1


def test_audits_write_the_labelled_rows_once_and_keep_no_table(spark, monkeypatch):
    from decidra.plans import audits

    monkeypatch.setattr(audits, "_reports", {})
    monkeypatch.setattr(audits, "_written", {}, raising=False)
    kept = []
    monkeypatch.setattr(type(spark.range(1)), "persist", lambda self, *a: kept.append(self) or self)
    assert _scans(spark, lambda: [audits.report(spark, DATA, wrong) for wrong in (False, True)], "lineitem.parquet") == 1
    assert not kept
    assert "Union" not in audits.defective(spark, DATA)._jdf.queryExecution().optimizedPlan().toString()


def test_values_of_numbers_are_counted_and_shuffled_once(spark):
    from pyspark.sql import functions as F

    from decidra.operators.passes import Needs, Part, _numbers

    rows = spark.read.parquet(f"{DATA}/orders.parquet")
    part = Part(F.col("o_orderkey") % 3 > 0, (F.col("o_orderkey") % 2).cast("int"), (0.5,))
    needs = Needs(parts={"part": part, "all": Part(F.lit(True), part.label)}, numbers=("o_totalprice", "o_custkey"))
    assert _scans(spark, lambda: _numbers(rows, needs, 50), "ReusedExchange") == 1


def test_days_are_facets_as_dates_and_keep_their_names(spark):
    import datetime as dt

    from pyspark.sql import functions as F

    from decidra.operators.passes import Facet, _facets

    rows = spark.createDataFrame([(dt.date(998, 1, 2), "x"), (None, "2020-01-01"), (dt.date(2020, 1, 1), None), (dt.date(2020, 1, 1), "x")], "day date, name string")
    one = {"n": F.lit(1)}
    got = _facets(rows, {"day": Facet(F.col("day"), one), "name": Facet(F.col("name"), one | {"old": F.col("day") < dt.date(1000, 1, 1)})})
    assert got["day"] == [("0998-01-02", {"n": 1}), ("2020-01-01", {"n": 2}), (None, {"n": 1})]
    assert got["name"] == [("2020-01-01", {"n": 1, "old": 0}), ("x", {"n": 2, "old": 1}), (None, {"n": 1, "old": 0})]


def test_all_windows_look_back_by_one_join(spark):
    from decidra.operators.split import lookback_overlap, lookback_overlaps
    from decidra.plans.decisions import splits

    s = splits(spark, DATA)
    got = lookback_overlaps(s, "o_custkey", 200.0)
    want = {w.name: lookback_overlap(s.train(w), s.evaluate(w), "o_custkey", s.decision, 200.0).first().n for w in s.windows}
    assert {r.window: r.n for r in got.collect()} == want and any(want.values())
