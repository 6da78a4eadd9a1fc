"""The driver's tables as decision tables: T1 (orders) and T2 (events), in Spark and in SQL."""

from __future__ import annotations

import datetime as dt

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..schema import Availability, Cause, ColumnSpec, Comparison, Grain, Missing, Outcome, Period, Positive, Role, Schema

SNAPSHOT = dt.datetime(2001, 3, 1)
RESERVE_FROM, RESERVE_UNTIL = dt.datetime(2000, 1, 1), dt.datetime(2001, 1, 1)
PERIODS = (Period("w1", dt.datetime(1998, 1, 1), dt.datetime(1998, 7, 1)), Period("w2", dt.datetime(1998, 7, 1), dt.datetime(1999, 1, 1)), Period("w3", dt.datetime(1999, 1, 1), dt.datetime(1999, 7, 1)))
HORIZON_DAYS = 180
CAUSES = (Cause("open", Missing.NOT_OCCURRED, "O"), Cause("finished", Missing.UNOBSERVED, "F"), Cause("partial", Missing.EXCLUDED, "P"))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def first_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    """(o_orderkey, event_at, kind): the first line shipped at or after the order, by date and then number, part, supplier, flag."""
    o, line = table(spark, sf_dir, "orders"), table(spark, sf_dir, "lineitem")
    pairs = line.join(o.select("o_orderkey", "o_orderdate"), (F.col("l_orderkey") == F.col("o_orderkey")) & (F.col("l_shipdate") >= F.col("o_orderdate")))
    first = F.min(F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("f")
    return pairs.groupBy("o_orderkey").agg(first).select("o_orderkey", F.col("f.l_shipdate").alias("event_at"), F.col("f.l_returnflag").alias("kind"))


def t1(spark: SparkSession, sf_dir: str, premature: bool = False) -> DataFrame:
    """One row per order: the decision, a deadline, the first shipment and features.

    ``premature`` takes the first shipment of all, which may lie before the order.
    """
    o, c = table(spark, sf_dir, "orders"), table(spark, sf_dir, "customer")
    if premature:
        events = table(spark, sf_dir, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.min("l_shipdate").alias("event_at"), F.min_by("l_returnflag", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey", "l_returnflag")).alias("kind"))
    else:
        events = first_lines(spark, sf_dir)
    customers = c.select(F.col("c_custkey").alias("o_custkey"), "c_acctbal", "c_mktsegment", "c_nationkey")
    return o.join(events, "o_orderkey", "left").join(customers, "o_custkey").select(
        "o_orderkey", "o_custkey", F.col("o_orderdate").alias("decided_at"), (F.col("o_orderdate") + F.expr(f"INTERVAL {HORIZON_DAYS} DAYS")).alias("deadline_on"), "event_at", F.col("o_orderstatus").alias("status"), "kind",
        F.col("o_orderpriority").alias("reason"), "c_mktsegment", "c_nationkey", "o_totalprice", "c_acctbal",
    )


T1_SQL = f"""
p AS (SELECT o_orderkey, l_shipdate, l_returnflag, row_number() OVER (PARTITION BY o_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM orders JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate >= o_orderdate),
t1 AS (SELECT o.o_orderkey, o_custkey, o_orderdate AS decided_at, o_orderdate + INTERVAL {HORIZON_DAYS} DAY AS deadline_on, p.l_shipdate AS event_at, o_orderstatus AS status, p.l_returnflag AS kind, o_orderpriority AS reason, c_mktsegment, c_nationkey, o_totalprice, c_acctbal
  FROM orders o LEFT JOIN p ON p.o_orderkey = o.o_orderkey AND p.k = 1 JOIN customer c ON c_custkey = o_custkey)"""

T1_PREMATURE_SQL = f"""
p AS (SELECT l_orderkey, l_shipdate, l_returnflag, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_shipdate, l_linenumber, l_partkey, l_suppkey, l_returnflag) AS k FROM lineitem),
t1 AS (SELECT o.o_orderkey, o_custkey, o_orderdate AS decided_at, o_orderdate + INTERVAL {HORIZON_DAYS} DAY AS deadline_on, p.l_shipdate AS event_at, o_orderstatus AS status, p.l_returnflag AS kind, o_orderpriority AS reason, c_mktsegment, c_nationkey, o_totalprice, c_acctbal
  FROM orders o LEFT JOIN p ON p.l_orderkey = o.o_orderkey AND p.k = 1 JOIN customer c ON c_custkey = o_custkey)"""

#: Labels of ``t1`` by instants or dates, in SQL: label, reason, known_at.
_MATURE = {"direct": f"deadline_on < TIMESTAMP '{SNAPSHOT}'", "by_date": f"CAST(deadline_on AS DATE) < DATE '{SNAPSHOT:%Y-%m-%d}'"}
_WITHIN = {"direct": "event_at <= deadline_on", "by_date": "CAST(event_at AS DATE) <= CAST(deadline_on AS DATE)"}
_PASSED = {"direct": "deadline_on", "by_date": "CAST(CAST(deadline_on AS DATE) + 1 AS TIMESTAMP)"}


def labelled_sql(how: str = "direct") -> str:
    return f"""
l AS (SELECT *, CASE WHEN event_at < decided_at THEN NULL WHEN event_at IS NULL THEN CASE WHEN status = 'O' AND {_MATURE[how]} THEN 0 END WHEN {_WITHIN[how]} THEN 1 ELSE 0 END AS label,
  CASE WHEN event_at < decided_at THEN 'before_decision' WHEN event_at IS NULL THEN CASE status WHEN 'O' THEN CASE WHEN {_MATURE[how]} THEN 'observed' ELSE 'immature' END WHEN 'F' THEN 'censored' WHEN 'P' THEN 'excluded' ELSE 'conflated' END ELSE 'observed' END AS reason_of,
  CASE WHEN {_WITHIN[how]} THEN event_at ELSE {_PASSED[how]} END AS known_at FROM t1)"""


def outcome(how: Comparison = Comparison.DIRECT, **more) -> Outcome:
    return Outcome("event_at", "deadline_on", how, Positive.WITHIN, CAUSES, recurring=True, **more)


def schema() -> Schema:
    feature = lambda n: ColumnSpec(n, Role.FEATURE, availability=Availability.AT_DECISION, source="order form", value_as_of="decided_at")
    return Schema((
        ColumnSpec("o_orderkey", Role.ENTITY_ID), ColumnSpec("o_custkey", Role.NATURAL_KEY), ColumnSpec("decided_at", Role.DECISION_TIME, Grain.INSTANT), ColumnSpec("deadline_on", Role.DEADLINE, Grain.INSTANT, value_as_of="decided_at"),
        ColumnSpec("event_at", Role.OUTCOME_COMPONENT, Grain.INSTANT), ColumnSpec("status", Role.STATUS), ColumnSpec("kind", Role.EVENT_KIND), ColumnSpec("reason", Role.OBSERVATION_REASON), ColumnSpec("c_mktsegment", Role.GROUP_ID), ColumnSpec("c_nationkey", Role.IGNORED), feature("o_totalprice"), feature("c_acctbal"),
    ))
