import datetime as dt
import zipfile

import pytest
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

from decidra.functions import tables
from decidra.plans import builders
from decidra.sources import paged, readers, sinks
from decidra.streaming import maturation


def test_csv_strings_and_sentinels(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a,b,c\n1,,x\nNA,2,\" \"\n")
    df = readers.csv_strings(spark, str(tmp_path / "a.csv"))
    assert {t for _, t in df.dtypes} == {"string"} and sorted(r.b or "" for r in df.collect()) == ["", "2"]
    got = readers.csv_strings(spark, str(tmp_path / "a.csv"), ["a", "c"], ("NA", " "))
    assert got.columns == ["a", "c"] and sorted(str(r.a) for r in got.collect()) == ["1", "None"]


def test_tolerant_csv_keeps_what_fits(spark, tmp_path):
    from pyspark.sql.types import IntegerType, StringType, StructField, StructType

    (tmp_path / "a.csv").write_text("n,s\n1,x\nbad,y\n3,z\n")
    good, bad = readers.csv_tolerant(spark, str(tmp_path / "a.csv"), StructType([StructField("n", IntegerType()), StructField("s", StringType())]))
    assert sorted(r.n for r in good.collect()) == [1, 3] and bad.count() == 1


def test_csv_in_zips(spark, tmp_path):
    for k in range(3):
        with zipfile.ZipFile(tmp_path / f"{k}.zip", "w") as z:
            z.writestr(f"d/{k}.csv", "a,b,extra\n" + "".join(f"{k}{j},,9\n" for j in range(4)))
            z.writestr("readme.txt", "no rows")
    got = readers.csv_in_zips(spark, str(tmp_path), ["a", "b", "gone"]).collect()
    assert len(got) == 12 and {r.b for r in got} == {""} and {r.gone for r in got} == {None}
    with pytest.raises(readers.UnsafeArchive):
        readers.check_member(zipfile.ZipInfo("../x.csv"), 10)


def test_json_lines(spark, tmp_path):
    (tmp_path / "a.jsonl").write_text('{"a": {"b": {"c": "x"}, "l": [1, 2]}}\n{"a": {}}\n')
    got = readers.json_lines(spark, str(tmp_path / "a.jsonl"), "a struct<b: struct<c: string>, l: array<int>>", {"c": "a.b.c", "n": F.coalesce(F.size("a.l"), F.lit(0))})
    assert {(r.c, max(r.n, 0)) for r in got.collect()} == {(None, 0), ("x", 2)}


class Squares:
    """A service of 25 rows that writes down what it was asked, and breaks off as often as it is told to."""

    def __init__(self, folder, short=0, failures=0):
        self.folder, self.short, self.failures = str(folder), short, failures

    def _rows(self, where):
        rows = [{"k": k, "s": f"r{k}", "q": k * k if k % 5 else None} for k in range(25)]
        test = {"=": lambda a, b: a == b, ">": lambda a, b: a > b, "<=": lambda a, b: a <= b, "in": lambda a, b: a in b, "known": lambda a, b: True, "null": lambda a, b: a is None}
        return [r for r in rows if all((r[c.column] is not None or c.operator == "null") and test[c.operator](r[c.column], c.value) for c in where)]

    def count(self, where):
        return len(self._rows(where))

    def fetch(self, columns, where, offset, rows):
        import uuid
        from pathlib import Path

        Path(self.folder, uuid.uuid4().hex).write_text(paged.text(columns, where, "k", offset, rows))
        if len(list(Path(self.folder).iterdir())) <= self.failures:
            raise ConnectionError("the line broke off")
        return [tuple(r[c] for c in columns) for r in self._rows(where)[offset : offset + rows - self.short]]


def paged_table(spark, folder, columns=(), **more):
    folder.mkdir()
    service = {k: more.pop(k) for k in ("short", "failures") if k in more}
    name = f"squares_{folder.name}"
    spark.dataSource.register(paged.source(name, Squares(folder, **service), StructType.fromDDL("k int, s string, q int"), page=10, wait=0.01, **more))
    return paged.read(spark, name, columns)


def asked(folder):
    return sorted(p.read_text() for p in folder.iterdir())


def test_paged_source(spark, tmp_path):
    df = paged_table(spark, tmp_path / "all", expected=25)
    assert df.collect() == [(k, f"r{k}", k * k if k % 5 else None) for k in range(25)] and df.rdd.getNumPartitions() == 3
    df = paged_table(spark, tmp_path / "some", ["q", "k"]).where("k > 12 AND q IS NOT NULL AND k % 2 = 0")
    assert sorted(map(tuple, df.collect())) == [(k * k, k) for k in range(13, 25) if k % 5 and k % 2 == 0]
    assert all(t.startswith("SELECT q, k WHERE") and "k > 12" in t and "q IS NOT NULL" in t for t in asked(tmp_path / "some")) and len(asked(tmp_path / "some")) == 1
    df = paged_table(spark, tmp_path / "in").where(F.col("k").isin(3, 4, 24) & (F.col("s") == "r4"))
    assert df.count() == 1 and len(asked(tmp_path / "in")) == 1 and "IN (3, 4, 24)" in asked(tmp_path / "in")[0]
    assert paged_table(spark, tmp_path / "none").where("k > 99").count() == 0 and asked(tmp_path / "none") == []


def test_paged_source_tries_again_and_refuses_other_rows(spark, tmp_path):
    assert paged_table(spark, tmp_path / "again", failures=3).where("k <= 4").count() == 5 and len(asked(tmp_path / "again")) == 4
    for name, more in (("down", {"failures": 99}), ("short", {"short": 1}), ("changed", {"expected": 26})):
        with pytest.raises(Exception, match="broke off|instead of|were declared"):
            paged_table(spark, tmp_path / name, **more).collect()
    assert paged.text(["a"], [paged.Condition("b", "=", "it's"), paged.Condition("c", "null")], "a", 5, 9) == "SELECT a WHERE b = 'it''s' AND c IS NULL ORDER BY a LIMIT 9 OFFSET 5"


def test_parquet_service(spark, tmp_path):
    spark.range(100).select((99 - F.col("id")).alias("k"), (F.col("id") % 7).alias("m")).repartition(3).write.parquet(str(tmp_path / "t"))
    service = paged.ParquetService(str(tmp_path / "t"), "k")
    low = [paged.Condition("k", "<", 30), paged.Condition("m", ">=", 2), paged.Condition("m", "known")]
    want = [(k,) for k in range(30) if (99 - k) % 7 >= 2]
    assert service.count(low) == len(want) and service.fetch(["k"], low, 5, 4) == want[5:9] and service.count([paged.Condition("m", "null")]) == 0


def test_table_function_and_mergeable_aggregate(spark):
    name = tables.register_window_days(spark, "pieces")
    day = dt.date(2024, 1, 1)
    spark.createDataFrame([(1, day, day + dt.timedelta(days=17)), (2, day, day), (3, None, day), (4, day, day + dt.timedelta(days=7))], "k int, a date, z date").createOrReplaceTempView("spans")
    got = [tuple(r) for r in spark.sql(f"SELECT k, number, datediff(ends, begins), share FROM spans, LATERAL {name}(a, z, 7) ORDER BY k, number").collect()]
    assert got == [(1, 0, 7, 7 / 17), (1, 1, 7, 7 / 17), (1, 2, 3, 3 / 17), (4, 0, 7, 1.0)]
    rows = [("a", float(v)) for v in (5, 1, 9, 3, 3)] + [("b", 1.0), ("b", 2.0), (None, 4.0), (None, 6.0), (None, 8.0), ("c", None)]
    df = spark.createDataFrame(rows, "g string, v double").repartition(5)
    got = {r.g: (r.rows, r.trimmed_mean) for r in tables.trimmed_mean(df, "v", ["g"], 1).collect()}
    assert got == {"a": (5, pytest.approx(11 / 3)), "b": (2, None), None: (3, 6.0)}
    assert tables.trimmed_mean(df.limit(0), "v", ["g"]).count() == 0


def test_manifests_and_digests(spark, tmp_path):
    (tmp_path / "in").mkdir()
    for n in "abc":
        (tmp_path / "in" / n).write_text(n)
    one = sinks.manifest(spark, str(tmp_path / "in"))
    declared = spark.createDataFrame([tuple(r) for r in one.collect()], one.schema)
    (tmp_path / "in" / "a").write_text("changed")
    (tmp_path / "in" / "b").unlink()
    (tmp_path / "in" / "d").write_text("d")
    got = {r.name: r.problem for r in sinks.verify(declared, sinks.manifest(spark, str(tmp_path / "in"))).collect()}
    assert got == {"a": "changed", "b": "missing", "d": "extra"}
    assert len(sinks.dataset_digest(declared)) == 12
    df = spark.range(1000).withColumn("x", F.col("id") % 7)
    sinks.write_sorted(df, str(tmp_path / "out"), ["x", "id"])
    assert sinks.content_digest(spark.read.parquet(str(tmp_path / "out"))) == sinks.content_digest(df.repartition(5)) != sinks.content_digest(df.where("id > 0"))


def frame(spark, columns, *rows):
    return spark.createDataFrame(list(rows), ", ".join(f"{c} string" if " " not in c else c for c in columns))


def test_flights_and_loans(spark):
    f = frame(spark, ["FlightDate", "CRSDepTime", "CRSArrTime", "ArrTime", "Cancelled", "Diverted", "Carrier", "Number", "Origin", "Dest"], ("2024-01-31", "2330", "0045", "2400", "0.00", "0.00", "X", "1", "A", "B"), ("2024-01-31", "0800", "0900", "", "1.00", "", "X", "2", "A", "B"), ("bad", "", "", "", "", "", "X", "3", "A", "B"))
    got = {r.Number: r for r in builders.flights(f).collect()}
    assert set(got) == {"1", "2"} and got["2"].status == "cancelled" and got["2"].event_at is None
    assert got["1"].decided_at == dt.datetime(2024, 1, 31, 23, 30) and got["1"].planned_at == dt.datetime(2024, 2, 1, 0, 45) and got["1"].event_at == dt.datetime(2024, 2, 1)
    loans = frame(spark, ["id", "approved", "disbursed", "charged_off", "term", "amount", "industry"], ("1", "1-Jan-69", "31-Jan-98", "", "12", "$60,000.00 ", "451120"), ("2", "1-Jan-98", "5-Feb-98", "1-Jan-98", "12", "$1", "45"), ("3", "x", "", "", "", "", ""))
    got = {r.id: r for r in builders.loans(loans).collect()}
    assert set(got) == {"1"} and got["1"].approved_at.year == 1969 and got["1"].amount_usd == 60000 and got["1"].sector == "45" and got["1"].deadline_on == dt.datetime(1999, 1, 31)


def test_histories_of_inspections_and_incidents(spark):
    raw = frame(spark, ["inspection_id", "license", "inspected_on", "result", "risk"], ("1", "L", "01/01/2024", "Fail", "1"), ("2", "L", "02/01/2024", "Pass", "1"), ("3", "L", "03/01/2024", "FAIL w/ cond", "1"), ("4", "0", "01/01/2024", "Pass", "1"), ("5", "M", "", "Pass", "1"))
    got = {r.inspection_id: r for r in builders.inspections(raw).collect()}
    assert set(got) == {"1", "2", "3"} and got["2"].event_at == dt.datetime(2024, 3, 1) and got["1"].event_at is None and got["3"].prior_failed == 1 and got["3"].days_since == 29
    raw = frame(spark, ["row_id", "incident_datetime", "report_datetime", "district", "place", "category", "resolution"], ("1", "2024/01/01 01:00:00 AM", "2024/01/01 03:00:00 AM", "d", "p", "c", ""), ("2", "2024/01/02 01:00:00 AM", "2024/01/02 01:00:00 PM", "d", "p", "c", ""), ("3", "bad", "2024/01/02 01:00:00 PM", "d", "p", "c", ""))
    got = {r.row_id: r for r in builders.incidents(raw).collect()}
    assert got["1"].event_at == dt.datetime(2024, 1, 2, 13) and got["2"].event_at is None and (got["1"].reported_90d, got["2"].reported_90d) == (0, 1) and got["2"].lag_hours == 12


def test_machines_stays_calls_and_requests(spark):
    at = lambda *a: dt.datetime(2024, 1, *a)
    t = spark.createDataFrame([(1, at(d, h), 1.0 * d, 2.0, 3.0, 4.0) for d in range(1, 6) for h in (0, 12)], "machineID int, datetime timestamp_ntz, volt double, rotate double, pressure double, vibration double")
    e = spark.createDataFrame([(1, at(2))], "machineID int, datetime timestamp_ntz")
    f = spark.createDataFrame([(1, at(4, 6), "comp2"), (1, at(9), "comp1")], "machineID int, datetime timestamp_ntz, failure string")
    m = spark.createDataFrame([(1, "m", 3)], "machineID int, model string, age int")
    got = {r.day.day: r for r in builders.machine_days(t, e, f, m).collect()}
    assert set(got) == {2, 3, 4, 5} and got[2].event_at == at(4, 6) and got[3].event_at == at(9) and got[5].errors7 == 1 and got[5].volt_mean7 == 3.0
    v = spark.createDataFrame([(1, at(4, 6), "a"), (1, at(4, 6), "b")], "machineID int, datetime timestamp_ntz, comp string")
    assert [(r.components, r.event_at) for r in builders.visits(v, f).collect()] == [(2, at(9))]
    s = builders.stays(frame(spark, ["animal_id", "datetime", "kind"], ("a", "2024-01-01T10:00:00.000", "k"), ("a", "2024-01-01T10:00:00.000", "k")), frame(spark, ["animal_id", "datetime", "outcome"], ("a", "2024-01-01T10:00:00.000", "adopted"))).collect()
    assert len(s) == 1 and s[0].event_kind == "adopted" and s[0].status == "left"
    d = spark.createDataFrame([("c", "u1", at(1, 23), at(1, 23, 9), "2"), ("c", "u2", at(1, 23), at(1, 23, 5), "3")], "call_number string, unit string, received timestamp_ntz, on_scene timestamp_ntz, priority string")
    c = builders.calls(d).first()
    assert (c.units, c.priority, c.event_at, c.night) == (2, "2", at(1, 23, 5), 1)
    q = builders.requests(frame(spark, ["o", "c", "s"], ("2024-01-01", "2024-01-03", "Done"), ("2024-01-02", "2024-01-01", "Done"), ("2024-01-01", "", None), ("2024-01-01", "", "Cancel")), "o", "c", "s", 30, ["Cancel"])
    assert q.count() == 2


def test_streams(spark, tmp_path):
    at = lambda *a: dt.datetime(2024, 1, *a)
    for name, rows, schema in (("d", [("a", at(1)), ("b", at(1)), ("z", at(20))], "k string, t timestamp"), ("e", [("a", at(2)), ("b", at(9)), ("z", at(20))], "k string, u timestamp")):
        spark.createDataFrame(rows, schema).coalesce(1).write.parquet(str(tmp_path / name))
    d = spark.readStream.schema("k string, t timestamp").parquet(str(tmp_path / "d"))
    e = spark.readStream.schema("k string, u timestamp").parquet(str(tmp_path / "e"))
    out = maturation.matured_labels(d, e, key="k", decided_at="t", event_at="u", horizon="3 DAYS")
    q = out.writeStream.format("memory").queryName("labels").option("checkpointLocation", str(tmp_path / "c1")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert {r.k: r.label for r in spark.table("labels").collect()} == {"a": 1, "z": 1, "b": 0}
    q = maturation.daily_volume(d, time="t").writeStream.format("memory").queryName("volume").option("checkpointLocation", str(tmp_path / "c2")).outputMode("append").start()
    q.processAllAvailable()
    q.stop()
    assert [(r.day.day, r.n) for r in spark.table("volume").collect()] == [(1, 2)]
