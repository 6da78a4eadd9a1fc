"""Queries that write the driver's tables in foreign forms, read them back, and parse texts; each with its SQL."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import parsing
from ..sources import paged, readers, sinks
from . import builders
from .decisions import splits
from .tables import PERIODS, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def place(spark: SparkSession, name: str) -> str:
    """A new path in the folder that all machines share; a local one only where none is set and Spark runs on one machine."""
    shared = spark.conf.get("spark.checkpoint.dir", None)
    if not shared:
        if not spark.sparkContext.master.startswith("local["):
            raise ValueError("spark.checkpoint.dir must name a folder that all machines share")
        shared = "file://" + tempfile.mkdtemp(prefix="decidra-")
    return f"{shared.rstrip('/')}/decidra/{name}-{uuid.uuid4().hex[:12]}"


def _csv(df: DataFrame, name: str) -> str:
    path = place(df.sparkSession, name)
    df.write.option("header", True).csv(path)
    return path


# --- sources --------------------------------------------------------------------------------------------------------------


@query("SELECT c_custkey::VARCHAR AS c_custkey, c_name, c_nationkey::VARCHAR AS c_nationkey, c_mktsegment FROM customer")
def src1_csv_strings(spark, d):
    return readers.csv_strings(spark, _csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey", "c_mktsegment"), "src1"))


@query("SELECT c_custkey::BIGINT AS c_custkey, c_name, c_nationkey::BIGINT + 1 AS next_nation FROM customer")
def src2_csv_inferred(spark, d):
    df = readers.csv_inferred(spark, _csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_nationkey"), "src2"), 1.0)
    return df.select(F.col("c_custkey").cast("long").alias("c_custkey"), "c_name", (F.col("c_nationkey") + 1).cast("long").alias("next_nation"))


@query("SELECT c_mktsegment, c_custkey::VARCHAR AS c_custkey FROM customer")
def src3_csv_projection(spark, d):
    return readers.csv_strings(spark, _csv(table(spark, d, "customer").select("c_custkey", "c_name", "c_mktsegment"), "src3"), ["c_mktsegment", "c_custkey"])


@query("SELECT c_custkey::VARCHAR AS c_custkey, CASE WHEN c_custkey % 7 NOT IN (0, 1) THEN c_mktsegment END AS c_mktsegment FROM customer")
def src4_csv_sentinels(spark, d):
    key = F.col("c_custkey")
    df = table(spark, d, "customer").select("c_custkey", F.when(key % 7 == 0, "N/A").when(key % 7 == 1, "?").otherwise(F.col("c_mktsegment")).alias("c_mktsegment"))
    return readers.csv_strings(spark, _csv(df, "src4"), sentinels=("N/A", "?"))


@query("SELECT c_custkey % 11 = 0 AS rejected, count(*) AS n, sum(CASE WHEN c_custkey % 11 <> 0 THEN c_nationkey END)::BIGINT AS nations FROM customer GROUP BY 1")
def src5_csv_tolerant(spark, d):
    df = table(spark, d, "customer").select(F.when(F.col("c_custkey") % 11 == 0, F.concat(F.lit("x"), F.col("c_custkey").cast("string"))).otherwise(F.col("c_custkey").cast("string")).alias("c_custkey"), "c_nationkey")
    good, bad = readers.csv_tolerant(spark, _csv(df, "src5"), spark.createDataFrame([], "c_custkey long, c_nationkey int").schema)
    both = good.select(F.lit(False).alias("rejected"), F.col("c_nationkey").cast("long").alias("k")).unionByName(bad.select(F.lit(True).alias("rejected"), F.lit(None).cast("long").alias("k")))
    return both.groupBy("rejected").agg(F.count("*").alias("n"), F.sum("k").alias("nations"))


@query("SELECT o_orderkey::BIGINT AS id, o_orderstatus AS status, o_totalprice AS price, date_trunc('day', o_orderdate)::DATE AS day, o_orderkey % 3 AS tags FROM orders")
def src8_json_lines(spark, d):
    key = F.col("o_orderkey")
    nested = table(spark, d, "orders").select(key.alias("id"), F.struct(F.col("o_orderstatus").alias("code"), F.struct(F.to_date("o_orderdate").alias("day"), F.col("o_totalprice").alias("price")).alias("inner")).alias("order"), F.slice(F.array(F.lit("a"), F.lit("b")), 1, (key % 3).cast("int")).alias("tags"))
    nested.write.json(path := place(spark, "src8"))
    schema = "id long, order struct<code: string, inner: struct<day: date, price: double>>, tags array<string>"
    return readers.json_lines(spark, path, schema, {"id": "id", "status": "order.code", "price": "order.inner.price", "day": "order.inner.day", "tags": F.size("tags").cast("long")})


@query("SELECT o_orderstatus AS status, meaning, count(*) AS n FROM orders LEFT JOIN (VALUES ('O', 'open'), ('F', 'finished')) m(status, meaning) ON status = o_orderstatus GROUP BY 1, 2")
def src10_in_memory(spark, d):
    names = spark.createDataFrame([("O", "open"), ("F", "finished")], "status string, meaning string")
    return table(spark, d, "orders").select(F.col("o_orderstatus").alias("status")).join(F.broadcast(names), "status", "left").groupBy("status", "meaning").agg(F.count("*").alias("n"))


@query("SELECT o_orderkey, o_custkey, o_totalprice FROM orders WHERE o_orderkey > 2000 AND o_orderstatus = 'F' AND o_totalprice > 100000")
def src13_paged_source(spark, d):
    """Orders in pages of a service that answers the conditions itself."""
    columns = ["o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"]
    spark.dataSource.register(paged.source("pages_of_orders", paged.ParquetService(f"{d}/orders.parquet", "o_orderkey"), table(spark, d, "orders").schema, page=10_000))
    rows = paged.read(spark, "pages_of_orders", columns).where("o_orderkey > 2000 AND o_orderstatus = 'F' AND o_totalprice > 100000")
    return rows.select("o_orderkey", "o_custkey", "o_totalprice")


@query("""SELECT o_orderkey, row_number() OVER (PARTITION BY o_orderkey ORDER BY b)::INT - 1 AS number, b AS begins, least(b + 365, z) AS ends, round((least(b + 365, z) - b) / (z - a)::DOUBLE, 6) AS share
FROM (SELECT o_orderkey, a, z, unnest(range(a::TIMESTAMP, z::TIMESTAMP, INTERVAL 365 DAY))::DATE AS b FROM (SELECT o_orderkey, min(o_orderdate)::DATE AS a, max(l_shipdate)::DATE AS z FROM orders JOIN lineitem ON l_orderkey = o_orderkey GROUP BY 1) WHERE a < z)""")
def ud5_lateral_windows(spark, d):
    """Each order's years until its last shipment, by a table function that is joined laterally."""
    from ..functions.tables import register_window_days

    name = register_window_days(spark)
    orders, line = table(spark, d, "orders"), table(spark, d, "lineitem")
    spans = orders.join(line, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("o_orderkey").agg(F.to_date(F.min("o_orderdate")).alias("a"), F.to_date(F.max("l_shipdate")).alias("z"))
    spans.createOrReplaceTempView("decidra_spans")
    out = spark.sql(f"SELECT o_orderkey, w.* FROM decidra_spans, LATERAL {name}(a, z, 365) w")
    return out.select("o_orderkey", "number", "begins", "ends", F.round("share", 6).alias("share"))


@query("""SELECT l_returnflag, l_linestatus, count(*) AS rows, round((sum(l_extendedprice) - sum(l_extendedprice) FILTER (lo <= 3) - sum(l_extendedprice) FILTER (hi <= 3)) / (count(*) - 6), 4) AS trimmed_mean
FROM (SELECT *, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice) AS lo, row_number() OVER (PARTITION BY l_returnflag, l_linestatus ORDER BY l_extendedprice DESC) AS hi FROM lineitem) GROUP BY 1, 2""")
def ud5_trimmed_mean(spark, d):
    """A mean without the three smallest and largest prices, by an aggregate whose parts merge."""
    from ..functions.tables import trimmed_mean

    out = trimmed_mean(table(spark, d, "lineitem"), "l_extendedprice", ["l_returnflag", "l_linestatus"], 3)
    return out.withColumn("trimmed_mean", F.round("trimmed_mean", 4))


# --- sinks ----------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_custkey, o_orderstatus, o_totalprice FROM orders")
def snk1_sorted_parquet(spark, d):
    sinks.write_sorted(table(spark, d, "orders").select("o_orderkey", "o_custkey", "o_orderstatus", "o_totalprice"), path := place(spark, "snk1"), ["o_orderkey"])
    return spark.read.parquet(path)


def _parts_sql() -> str:
    from .decisions import ORACLE as known

    return f"SELECT \"window\", side, count(*) AS n, sum(o_orderkey)::BIGINT AS keys FROM ({known['sp1_parts']}) GROUP BY 1, 2"


@query(_parts_sql())
def snk2_split_parts(spark, d):
    sinks.write_parts(splits(spark, d), path := place(spark, "snk2"))
    names = [w.name for w in PERIODS]
    return spark.read.parquet(path).where(F.col("window").isin(names)).groupBy("window", "side").agg(F.count("*").alias("n"), F.sum("o_orderkey").alias("keys"))


@query("SELECT 'r' || r_regionkey AS folder, length(r_name) + 1 AS bytes, sha256(r_name || chr(10)) AS sha256 FROM region")
def snk4_manifest(spark, d):
    """One file in each folder, all of the same name before the part's number: names go from the root on."""
    rows = table(spark, d, "region").select(F.concat(F.lit("r"), F.col("r_regionkey").cast("string")).alias("folder"), F.col("r_name").alias("value"))
    rows.repartition("folder").write.partitionBy("folder").text(path := place(spark, "snk4"))
    files = sinks.manifest(spark, path).where(F.col("name").startswith("folder="))
    return files.select(F.regexp_extract("name", "^folder=([^/]*)/", 1).alias("folder"), F.col("bytes").cast("long").alias("bytes"), "sha256")


# --- texts ----------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, CASE WHEN event_id % 9 <> 0 THEN date_trunc('second', ts)::TIMESTAMP END AS at FROM events")
def dt_to_datetime(spark, d):
    raw = table(spark, d, "events").select("event_id", F.when(F.col("event_id") % 9 == 0, "no time").otherwise(F.date_format("ts", "yyyy/MM/dd hh:mm:ss a")).alias("raw"))
    return raw.select("event_id", builders.stamp("raw", "yyyy/MM/dd hh:mm:ss a").alias("at"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 9 <> 0 THEN o_orderdate::DATE END AS day FROM orders")
def dt_to_date(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.when(F.col("o_orderkey") % 9 == 0, "13/32/1999").otherwise(F.date_format("o_orderdate", "MM/dd/yyyy")).alias("raw"))
    return raw.select("o_orderkey", builders.day("raw", "MM/dd/yyyy").alias("day"))


@query("SELECT o_orderkey, CASE WHEN o_orderkey % 25 < 25 THEN o_orderdate::DATE::TIMESTAMP + to_hours((o_orderkey % 25)::INT) + to_minutes((CASE WHEN o_orderkey % 25 = 24 THEN 0 ELSE o_orderkey % 60 END)::INT) END AS at FROM orders")
def dt_hhmm_clock(spark, d):
    """Hours 0 to 24, 2400 being the next midnight."""
    key = F.col("o_orderkey")
    hhmm = F.when(key % 25 == 24, "2400").otherwise(F.format_string("%02d%02d", (key % 25).cast("int"), (key % 60).cast("int")))
    return table(spark, d, "orders").withColumn("hhmm", hhmm).select("o_orderkey", builders.clock(F.to_date("o_orderdate"), "hhmm").alias("at"))


@query("SELECT o_orderkey, o_orderdate::DATE AS day FROM orders")
def dt_century(spark, d):
    raw = table(spark, d, "orders").select("o_orderkey", F.date_format("o_orderdate", "d-MMM-yy").alias("raw"))
    return raw.select("o_orderkey", parsing.two_digit_year("raw", 2014).alias("day"))


@query("SELECT o_orderkey, CASE o_orderkey % 3 WHEN 0 THEN o_orderdate::DATE WHEN 1 THEN last_day(o_orderdate::DATE) END AS day FROM orders")
def dt_partial_month(spark, d):
    key = F.col("o_orderkey") % 3
    raw = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "MMM yyyy"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", parsing.partial_date("raw").alias("day"))


@query("SELECT o_orderkey, year(o_orderdate)::BIGINT AS year, CASE WHEN o_orderkey % 3 < 2 THEN month(o_orderdate) END::BIGINT AS month, CASE WHEN o_orderkey % 3 < 1 THEN day(o_orderdate) END::BIGINT AS day FROM orders")
def str_partial_date_split(spark, d):
    key = F.col("o_orderkey") % 3
    raw = F.when(key == 0, F.date_format("o_orderdate", "yyyy-MM-dd")).when(key == 1, F.date_format("o_orderdate", "yyyy-MM")).otherwise(F.date_format("o_orderdate", "yyyy"))
    return table(spark, d, "orders").select("o_orderkey", raw.alias("raw")).select("o_orderkey", *(c.cast("long").alias(n) for n, c in parsing.date_parts("raw").items()))


@query("SELECT r_regionkey AS region_key_no, r_name AS name_of_region FROM region")
def str_column_names(spark, d):
    return parsing.normalised(table(spark, d, "region").select(F.col("r_regionkey").alias(" Region-Key (no.)"), F.col("r_name").alias("Name of  Region")))


@query(r"SELECT doc_id, regexp_matches(text, '(?i)(^|[^A-Za-z0-9_])(the|und)($|[^A-Za-z0-9_])') AS has FROM documents")
def str_word_match(spark, d):
    return table(spark, d, "documents").select("doc_id", parsing.has_word("text", ("the", "und")).alias("has"))


@query("SELECT l_orderkey, l_linenumber, l_shipdate::TIMESTAMP + to_days(l_linenumber::INT) + to_hours((l_orderkey % 24)::INT) AS at FROM lineitem")
def dt_column_duration(spark, d):
    span = F.make_dt_interval(F.col("l_linenumber").cast("int"), (F.col("l_orderkey") % 24).cast("int"))
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", (F.col("l_shipdate").cast("timestamp_ntz") + span).alias("at"))


# --- grouping, windows and joins beyond the reference's own -----------------------------------------------------------------


@query("SELECT c_mktsegment, c_nationkey, count(*) AS n, grouping(c_mktsegment) * 2 + grouping(c_nationkey) AS level FROM customer GROUP BY CUBE (c_mktsegment, c_nationkey)")
def ag14_cube(spark, d):
    return table(spark, d, "customer").cube("c_mktsegment", "c_nationkey").agg(F.count("*").alias("n"), F.grouping_id().alias("level"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY GROUPING SETS ((o_orderstatus, o_orderpriority), (o_orderpriority), ())")
def ag14_grouping_sets(spark, d):
    status, priority = F.col("o_orderstatus"), F.col("o_orderpriority")
    return table(spark, d, "orders").groupingSets([(status, priority), (priority,), ()], status, priority).agg(F.count("*").alias("n"))


@query("""SELECT l_linestatus, count(DISTINCT l_linenumber) AS approx, count(DISTINCT l_linenumber) AS n, count(DISTINCT l_partkey) AS parts, abs(approx_count_distinct(l_partkey) - count(DISTINCT l_partkey)) <= 0.1 * count(DISTINCT l_partkey) AS near
FROM lineitem GROUP BY ROLLUP (l_linestatus)""")
def ag14_approx_distinct(spark, d):
    """Sketches by status and of the whole table: exact where a group has few values, near the exact count where it has many.

    Sketches and exact counts are two aggregations: together, each different value would carry a sketch through the shuffle."""
    rows, line, part = table(spark, d, "lineitem").select("l_linestatus", "l_linenumber", "l_partkey"), "l_linenumber", "l_partkey"
    exact = rows.rollup("l_linestatus").agg(F.count_distinct(line).alias("n"), F.count_distinct(part).alias("parts"), F.grouping_id().alias("level"))
    sketched = rows.rollup(F.col("l_linestatus").alias("status")).agg(F.approx_count_distinct(line, 0.02).alias("approx"), F.approx_count_distinct(part, 0.02).alias("sketch"), F.grouping_id().alias("at"))
    both = exact.join(sketched, (F.col("level") == F.col("at")) & F.col("l_linestatus").eqNullSafe(F.col("status")))
    return both.select("l_linestatus", "approx", "n", "parts", (F.abs(F.col("sketch") - F.col("parts")) <= 0.1 * F.col("parts")).alias("near"))


@query("SELECT o_orderkey, nth_value(o_orderkey, 2) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey ROWS BETWEEN UNBOUNDED PRECEDING AND UNBOUNDED FOLLOWING) AS second FROM orders")
def wn11_nth_value(spark, d):
    from pyspark.sql import Window

    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    return table(spark, d, "orders").select("o_orderkey", F.nth_value("o_orderkey", 2).over(w).alias("second"))


@query("SELECT c_custkey FROM customer WHERE NOT EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_orderstatus = 'P')")
def jn14_anti(spark, d):
    return table(spark, d, "customer").join(table(spark, d, "orders").where("o_orderstatus = 'P'"), F.col("o_custkey") == F.col("c_custkey"), "left_anti").select("c_custkey")


@query("SELECT coalesce(s_nationkey, c_nationkey) AS nation, s AS suppliers, c AS customers FROM (SELECT s_nationkey, count(*) AS s FROM supplier WHERE s_nationkey % 2 = 0 GROUP BY 1) FULL JOIN (SELECT c_nationkey, count(*) AS c FROM customer WHERE c_nationkey % 3 = 0 GROUP BY 1) ON s_nationkey = c_nationkey")
def jn14_full_outer(spark, d):
    s = table(spark, d, "supplier").where("s_nationkey % 2 = 0").groupBy(F.col("s_nationkey").alias("nation")).agg(F.count("*").alias("suppliers"))
    c = table(spark, d, "customer").where("c_nationkey % 3 = 0").groupBy(F.col("c_nationkey").alias("nation")).agg(F.count("*").alias("customers"))
    return s.join(c, "nation", "full_outer")


@query("SELECT o_custkey, count(*) AS n, sum(total)::BIGINT AS total FROM (SELECT a.o_custkey, a.o_orderkey + b.o_orderkey AS total FROM orders a JOIN orders b ON a.o_custkey = b.o_custkey AND b.o_orderdate > a.o_orderdate AND b.o_orderdate <= a.o_orderdate + INTERVAL 60 DAY) GROUP BY 1")
def jn15_range_join(spark, d):
    """A range of 60 days as an equality of buckets: a row looks in its own bucket and the next, so no key is compared whole."""
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey", "o_orderdate", F.floor(F.unix_date(F.to_date("o_orderdate")) / 60).alias("bucket"))
    a = o.select("o_custkey", F.col("o_orderkey").alias("ka"), F.col("o_orderdate").alias("da"), F.explode(F.array("bucket", F.col("bucket") + 1)).alias("bucket"))
    pairs = a.join(o, ["o_custkey", "bucket"]).where((F.col("o_orderdate") > F.col("da")) & (F.col("o_orderdate") <= F.col("da") + F.expr("INTERVAL 60 DAYS")))
    return pairs.groupBy("o_custkey").agg(F.count("*").alias("n"), F.sum(F.col("ka") + F.col("o_orderkey")).alias("total"))
