"""Builders over the driver's tables, taken for raw files: columns as strings, stand-ins for missing values, repeated rows."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import builders as b
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str):
    def keep(f):
        QUERIES[f.__name__], ORACLE[f.__name__] = f, sql
        return f

    return keep


def text(c: str, form: str = "yyyy-MM-dd HH:mm:ss"):
    return F.date_format(c, form)


def shipped(spark, d) -> DataFrame:
    """Orders with their first shipment."""
    first = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped_at"))
    return table(spark, d, "orders").join(first, F.col("l_orderkey") == F.col("o_orderkey"), "left").drop("l_orderkey")


_SHIPPED = "x AS (SELECT o.*, s.shipped_at FROM orders o LEFT JOIN (SELECT l_orderkey, min(l_shipdate) AS shipped_at FROM lineitem GROUP BY 1) s ON l_orderkey = o_orderkey)"


def _due(column: str, days: int) -> str:
    return f"{column} + INTERVAL {days} DAY"


@query(f"WITH {_SHIPPED} SELECT o_orderkey::VARCHAR AS claim_id, o_orderdate AS assembled_at, shipped_at AS first_hearing_at, o_orderstatus AS status, {_due('o_orderdate', 30)} AS horizon_30d, {_due('o_orderdate', 90)} AS horizon_90d FROM x WHERE o_orderdate >= TIMESTAMP '1996-01-01'")
def bld_claims(spark, d):
    raw = shipped(spark, d).select(F.col("o_orderkey").alias("Claim Identifier"), text("o_orderdate").alias("Assembly Date"), text("shipped_at").alias("First Hearing Date"), F.col("o_orderstatus").alias("Status"), F.lit("x").alias("Zip"))
    return b.claims(raw, {"Assembly Date": "assembled_at", "First Hearing Date": "first_hearing_at"}, {"Claim Identifier": "claim_id", "Status": "status"}, ["Zip"], "1996-01-01", (30, 90))


@query(f"""WITH {_SHIPPED} SELECT o_orderkey AS subscription, o_custkey AS customer_id, c_nationkey AS product, o_orderdate AS decided_at, CASE WHEN o_orderstatus = 'F' THEN shipped_at END AS event_at, c_mktsegment AS segment, n_name AS name,
{_due('o_orderdate', 90)} AS horizon_90d, {_due('o_orderdate', 365)} AS horizon_365d FROM x JOIN customer ON c_custkey = o_custkey LEFT JOIN nation ON n_nationkey = c_nationkey""")
def bld_subscriptions(spark, d):
    customer = table(spark, d, "customer").select(F.col("c_custkey").alias("customer_id"), F.col("c_mktsegment").alias("segment"), F.col("c_nationkey").alias("product"))
    orders = shipped(spark, d).withColumnRenamed("o_custkey", "customer_id").join(customer.select("customer_id", "product"), "customer_id")
    ended = F.when(F.col("o_orderstatus") == "F", text("shipped_at")).otherwise("NA")
    raw = orders.select(F.col("o_orderkey").alias("subscription"), "customer_id", "product", text("o_orderdate").alias("signup_date_time"), ended.alias("cancel_date_time"))
    catalogue = table(spark, d, "nation").select(F.col("n_nationkey").alias("product_id"), F.col("n_name").alias("name"))
    return b.subscriptions(raw, customer.select("customer_id", "segment"), catalogue, (90, 365))


@query(f"""WITH {_SHIPPED} SELECT o_orderkey::VARCHAR AS project_id, o_orderdate::DATE AS applied_at, shipped_at::DATE AS completed_at, CASE WHEN o_orderpriority <> '5-LOW' THEN o_totalprice END AS system_cost_usd, nullif(o_orderstatus, 'P') AS inverter_maker,
o_orderdate::DATE + 365 AS deadline_on, shipped_at::DATE - o_orderdate::DATE AS days_to_complete FROM x WHERE NOT coalesce(shipped_at::DATE < o_orderdate::DATE, false)""")
def bld_installations(spark, d):
    cost = F.when(F.col("o_orderpriority") == "5-LOW", "about a million").otherwise(F.col("o_totalprice").cast("string"))
    raw = shipped(spark, d).select(F.col("o_orderkey").cast("string").alias("Project ID"), text("o_orderdate", "MM/dd/yyyy").alias("Applied At"), text("shipped_at", "MM/dd/yyyy").alias("Completed At"), cost.alias("System Cost (USD)"), F.when(F.col("o_orderstatus") == "P", "None").otherwise(F.col("o_orderstatus")).alias("Inverter/Maker"))
    return b.installations(raw, ["applied_at", "completed_at"], ["system_cost_usd"], {"inverter_maker": ["None"]})


@query(f"""SELECT complaint_number, respondent_id, nullif(s_name, 'UNKNOWN') AS respondent_name, received_at, closed_at, complaint_number || '-' || respondent_id AS case_id, {_due('received_at', 45)} AS deadline_on
FROM (SELECT DISTINCT l_orderkey::VARCHAR AS complaint_number, l_suppkey::VARCHAR AS respondent_id, CASE WHEN s_nationkey < 5 THEN 'UNKNOWN' ELSE s_name END AS s_name, o_orderdate AS received_at, CASE WHEN o_orderstatus = 'F' THEN max(l_shipdate) OVER (PARTITION BY l_orderkey, l_suppkey) END AS closed_at
FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN supplier ON s_suppkey = l_suppkey)""")
def bld_complaints(spark, d):
    who = F.when(F.col("s_nationkey") < 5, "UNKNOWN").otherwise(F.col("s_name")).alias("respondent_name")
    sides = table(spark, d, "lineitem").groupBy("l_orderkey", "l_suppkey").agg(F.max("l_shipdate").alias("closed")).join(table(spark, d, "supplier"), F.col("s_suppkey") == F.col("l_suppkey"))
    rows = sides.join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey"))
    raw = rows.select(F.col("l_orderkey").cast("string").alias("complaint_number"), F.col("l_suppkey").cast("string").alias("respondent_id"), who, text("o_orderdate").alias("received_date"), F.when(F.col("o_orderstatus") == "F", text("closed")).alias("closed_date"))
    return b.complaints(raw)


@query(f"""WITH {_SHIPPED} SELECT o_orderkey::VARCHAR AS receipt, o_orderdate AS permit_issued, shipped_at AS permit_expires, CASE WHEN o_orderpriority <> '1-URGENT' THEN o_totalprice END AS depth, nullif(o_orderstatus, 'O') AS current_status
FROM x, (SELECT unnest([1, 2]) AS copy) WHERE o_orderpriority <> '2-HIGH' AND shipped_at IS NOT NULL AND (copy = 1 OR o_orderpriority = '5-LOW')""")
def bld_well_permits(spark, d):
    """Rows that repeat others stay."""
    raw = shipped(spark, d).select(
        F.col("o_orderkey").cast("string").alias("receipt"), F.when(F.col("o_orderpriority") != "2-HIGH", text("o_orderdate")).otherwise("soon").alias("permit_issued"), text("shipped_at").alias("permit_expires"),
        F.when(F.col("o_orderpriority") == "1-URGENT", "").otherwise(F.col("o_totalprice").cast("string")).alias("depth"), F.when(F.col("o_orderstatus") == "O", "NA").otherwise(F.col("o_orderstatus")).alias("current_status"), "o_orderpriority",
    )
    raw = raw.unionByName(raw.where("o_orderpriority = '5-LOW'")).drop("o_orderpriority")
    return b.well_permits(raw, ["permit_issued", "permit_expires"], ["depth"], {"current_status": ["NA"]})


_VISITS = """v AS (SELECT user_id AS m, date_trunc('day', ts) AS at, count(DISTINCT event_type) AS components FROM events WHERE event_type IN ('view', 'click') GROUP BY 1, 2),
k AS (SELECT user_id AS m, date_trunc('day', ts) AS at, count(*) AS n, min(event_type) AS kind FROM events WHERE event_type IN ('error', 'purchase', 'signup') GROUP BY 1, 2),
w AS (SELECT v.*, (SELECT min(k.at) FROM k WHERE k.m = v.m AND k.at > v.at) AS event_at FROM v)"""


@query(f"""WITH {_VISITS} SELECT w.m AS "machineID", w.at AS decided_at, components, event_at, {_due('w.at', 2)} AS deadline_on, CASE WHEN event_at <= {_due('w.at', 2)} THEN CASE WHEN n > 1 THEN 'several' ELSE kind END END AS failure_kind
FROM w LEFT JOIN k ON k.m = w.m AND k.at = w.event_at""")
def bld_visit_kinds(spark, d):
    """Days on which a user looked are visits; the next day with something else is the failure."""
    e = table(spark, d, "events").select(F.col("user_id").alias("machineID"), F.date_trunc("day", "ts").cast("timestamp_ntz").alias("datetime"), "event_type")
    looks = e.where(F.col("event_type").isin("view", "click")).withColumnRenamed("event_type", "comp")
    breaks = e.where(F.col("event_type").isin("error", "purchase", "signup")).withColumnRenamed("event_type", "failure")
    return b.visit_kinds(looks, breaks, 2)


@query(f"""WITH {_SHIPPED}, y AS (SELECT o_orderkey::VARCHAR AS nct_id, o_orderdate::DATE AS registered_at, CASE WHEN o_orderpriority = '3-MEDIUM' THEN last_day(shipped_at::DATE) ELSE shipped_at::DATE END AS due_at_current, o_orderdate::DATE + 100 AS due_at_promised, o_orderstatus, coalesce(n, 0) AS n FROM x LEFT JOIN (SELECT l_orderkey, count(*) AS n FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey WHERE o_orderstatus <> 'P')
SELECT nct_id, registered_at, due_at_current, CASE WHEN o_orderstatus = 'F' THEN 'ACTUAL' ELSE 'ESTIMATED' END AS due_type, o_orderstatus AS status, due_at_promised, n::INT AS condition_count, CASE WHEN o_orderstatus = 'F' THEN due_at_current END AS completed_at, due_at_current - due_at_promised AS deadline_shift_days, due_at_promised + 184 AS due_at_mild
FROM y WHERE NOT coalesce(due_at_current < registered_at, false)""")
def bld_studies(spark, d):
    """Orders as nested JSON records; orders of one status have no first version."""
    orders = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("shipped_at"), F.collect_list(F.col("l_linenumber").cast("string")).alias("conditions"))
    o = orders.join(lines, F.col("l_orderkey") == F.col("o_orderkey"), "left")
    date = lambda c, **more: F.struct(c.alias("date"), *(v.alias(k) for k, v in more.items()))
    due = F.when(F.col("o_orderpriority") == "3-MEDIUM", text("shipped_at", "yyyy-MM")).otherwise(text("shipped_at", "yyyy-MM-dd"))
    kind = F.when(F.col("o_orderstatus") == "F", "ACTUAL").otherwise("ESTIMATED")
    key = F.col("o_orderkey").cast("string")
    status = F.struct(date(due, type=kind).alias("primaryCompletionDateStruct"), date(text("o_orderdate", "yyyy-MM-dd")).alias("studyFirstPostDateStruct"), F.col("o_orderstatus").alias("overallStatus"))
    current = o.select(F.to_json(F.struct(F.struct(F.struct(key.alias("nctId")).alias("identificationModule"), status.alias("statusModule"), F.struct("conditions").alias("conditionsModule")).alias("protocolSection"))).alias("value"))
    promised = F.struct(F.struct(F.struct(date(F.date_format(F.date_add("o_orderdate", 100), "yyyy-MM-dd")).alias("primaryCompletionDateStruct")).alias("statusModule")).alias("protocolSection"))
    original = orders.select(F.to_json(F.struct(key.alias("nctId"), F.when(F.col("o_orderstatus") == "P", "no version").alias("error"), promised.alias("study"))).alias("value"))
    return b.registered_studies(current, original).drop("sponsor")


@query(f"""WITH {_SHIPPED}, k AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS i FROM x)
SELECT o_custkey::VARCHAR AS permit_number, o_orderkey AS row, o_orderdate::DATE AS filed_date, shipped_at::DATE AS issued_date, nullif(CASE o_orderstatus WHEN 'P' THEN 'unknown' ELSE o_orderstatus END, 'unknown') AS status, o_totalprice AS cost, o_orderdate::DATE + 30 AS due_30d, o_orderdate::DATE + 90 AS due_90d
FROM k WHERE i = 1 AND NOT coalesce(shipped_at::DATE < o_orderdate::DATE, false)""")
def bld_applications(spark, d):
    """A customer's first order is the application, later ones are its other places."""
    raw = shipped(spark, d).select(F.col("o_custkey").cast("string").alias("permit_number"), F.col("o_orderkey").alias("row"), "o_orderdate", text("o_orderdate", "MM/dd/yyyy").alias("filed_date"), text("shipped_at", "MM/dd/yyyy").alias("issued_date"), F.when(F.col("o_orderstatus") == "P", "unknown").otherwise(F.col("o_orderstatus")).alias("status"), F.col("o_totalprice").cast("string").alias("cost"))
    return b.applications(raw, ["o_orderdate", "row"], ["cost"], tolerances=(30, 90)).drop("o_orderdate")


_TOLERANCES = (90, 365, 1000, 1500, 2000)


@query(f"""SELECT t AS tolerance, round(rate, 6) AS rate, coalesce(k = min(k) FILTER (rate BETWEEN 0.10 AND 0.90) OVER (), false) AS chosen FROM (SELECT t, k, avg((l_returnflag = 'R' AND days <= t)::INT) AS rate
FROM (SELECT l_returnflag, l_shipdate::DATE - o_orderdate::DATE AS days FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_shipdate >= o_orderdate), (VALUES {", ".join(f"({t}, {k})" for k, t in enumerate(_TOLERANCES))}) v(t, k) GROUP BY 1, 2)""")
def bld_stays_tolerance(spark, d):
    """The first tolerance by which neither nearly all nor nearly none of the shipped lines came back."""
    rows = table(spark, d, "lineitem").join(table(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).where("l_shipdate >= o_orderdate")
    stays = rows.select("l_returnflag", F.datediff("l_shipdate", "o_orderdate").alias("days"))
    return b.tolerance_rates(stays, "l_returnflag", "days", "R", _TOLERANCES).withColumn("rate", F.round("rate", 6))


@query("""WITH i AS (SELECT o_custkey AS site, o_orderkey AS evaluation, date_trunc('day', o_orderdate) AS at, CASE o_orderpriority WHEN '1-URGENT' THEN 'FUI' WHEN '2-HIGH' THEN 'CEI' ELSE 'ZZZ' END AS code FROM orders),
f AS (SELECT o_custkey AS site, date_trunc('day', l_shipdate) AS at FROM lineitem JOIN orders ON l_orderkey = o_orderkey WHERE l_returnflag = 'R')
SELECT site::VARCHAR || '/' || evaluation::VARCHAR AS unit_id, i.at AS decided_at, c_mktsegment AS state, CASE code WHEN 'FUI' THEN 'signalled' WHEN 'CEI' THEN 'scheduled' ELSE 'unknown' END AS "trigger",
(SELECT count(*) FROM f WHERE f.site = i.site AND f.at < i.at) AS prior_violations, (SELECT min(f.at) FROM f WHERE f.site = i.site AND f.at >= i.at) AS event_at FROM i JOIN customer ON c_custkey = site""")
def bld_site_inspections(spark, d):
    """Orders as inspections of customers; returned lines are violations."""
    o, text_of = table(spark, d, "orders"), lambda c: F.col(c).cast("string")
    code = F.when(F.col("o_orderpriority") == "1-URGENT", "FUI").when(F.col("o_orderpriority") == "2-HIGH", "CEI").otherwise("ZZZ")
    evaluations = o.select(text_of("o_custkey").alias("site"), text_of("o_orderkey").alias("evaluation"), code.alias("kind"), text("o_orderdate", "MM/dd/yyyy").alias("started"), F.lit(1).alias("row"))
    facilities = table(spark, d, "customer").select(text_of("c_custkey").alias("site"), F.col("c_mktsegment").alias("state"), F.lit(1).alias("row"))
    returned = table(spark, d, "lineitem").where("l_returnflag = 'R'").join(o, F.col("l_orderkey") == F.col("o_orderkey"))
    violations = returned.select(text_of("o_custkey").alias("site"), text("l_shipdate", "MM/dd/yyyy").alias("found"))
    out = b.site_inspections(evaluations.unionByName(evaluations.withColumn("row", F.lit(2))), facilities, violations)
    return out.select("unit_id", "decided_at", "state", "trigger", "prior_violations", "event_at")


@query("""WITH i AS (SELECT l_orderkey AS order_id, count(*) AS items, sum(l_extendedprice) AS price, count(DISTINCT l_suppkey) AS sellers FROM lineitem GROUP BY 1),
c AS (SELECT order_id, category FROM (SELECT l_orderkey AS order_id, l_returnflag AS category, row_number() OVER (PARTITION BY l_orderkey ORDER BY count(*) DESC, l_returnflag) AS k FROM lineitem GROUP BY 1, 2) WHERE k = 1),
p AS (SELECT l_orderkey AS order_id, sum(l_tax) AS paid, count(*) AS payments FROM lineitem GROUP BY 1)
SELECT o_orderkey AS order_id, items, round(price, 2) AS price, sellers, category, round(paid, 4) AS paid, payments, 60 AS lead_days, round(1.0 / 61, 6)::DOUBLE AS rule_score, isodow(o_orderdate)::INT AS weekday, month(o_orderdate)::INT AS month
FROM orders JOIN i ON i.order_id = o_orderkey JOIN c ON c.order_id = o_orderkey JOIN p ON p.order_id = o_orderkey""")
def bld_star_orders(spark, d):
    """Orders with lines as items and as payments, each summed before it is joined."""
    o = table(spark, d, "orders").select(F.col("o_orderkey").alias("order_id"), F.col("o_orderdate").alias("decided_at"), (F.col("o_orderdate") + F.expr("INTERVAL 60 DAYS")).alias("deadline_on"))
    line = table(spark, d, "lineitem")
    items = line.select(F.col("l_orderkey").alias("order_id"), F.col("l_partkey").alias("product"), F.col("l_suppkey").alias("seller"), F.col("l_extendedprice").alias("price"), F.col("l_returnflag").alias("category"))
    paid = line.select(F.col("l_orderkey").alias("order_id"), F.lit("card").alias("kind"), F.col("l_tax").alias("value"))
    out = b.star_orders(o, items, paid).drop("decided_at", "deadline_on")
    return out.withColumns({"price": F.round("price", 2), "paid": F.round("paid", 4), "rule_score": F.round("rule_score", 6)})
