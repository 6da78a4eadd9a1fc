"""Relational operators over the driver's tables, each with its SQL."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions.ranks import quantiles
from ..governance import Rule
from ..operators.joins import Cardinality, Direction, asof_join, check_cardinality, guarded_join, join_losses, prior_count, rows_per_key
from ..operators.profile import SENTINELS, distinct_with_null, duplicate_rows, loss_counts, profile, sentinel_counts, without_sentinels
from ..operators.windows import MICROS_PER_DAY, average_rank, history, keep_first, micros, rolled, rolling
from .tables import table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r(column, digits: int = 6):
    return F.round(column, digits)


# --- projections, filters, conditions -------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice / 2 AS half, NULL::BIGINT AS nothing, upper(o_orderstatus) AS s FROM orders")
def prj1_project(spark, d):
    return table(spark, d, "orders").select("o_orderkey", (F.col("o_totalprice") / 2).alias("half"), F.lit(None).cast("bigint").alias("nothing"), F.upper("o_orderstatus").alias("s"))


@query("SELECT c_custkey AS customer_id, c_mktsegment AS segment FROM customer")
def prj2_rename_drop(spark, d):
    return table(spark, d, "customer").drop("c_name", "c_nationkey", "c_acctbal").withColumnsRenamed({"c_custkey": "customer_id", "c_mktsegment": "segment"})


@query("SELECT event_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS row_in_user FROM events")
def prj5_row_index(spark, d):
    w = Window.partitionBy("user_id").orderBy("ts", "event_id")
    return table(spark, d, "events").select("event_id", (F.row_number().over(w) - 1).cast("long").alias("row_in_user"))


@query("SELECT o_orderkey, o_orderdate + INTERVAL 30 DAY AS horizon_30d, o_orderdate + INTERVAL 60 DAY AS horizon_60d, o_orderdate + INTERVAL 90 DAY AS horizon_90d FROM orders")
def prj6_horizons(spark, d):
    return table(spark, d, "orders").select("o_orderkey", *((F.col("o_orderdate") + F.expr(f"INTERVAL {k} DAYS")).alias(f"horizon_{k}d") for k in (30, 60, 90)))


@query("SELECT l_orderkey, l_linenumber, l_quantity FROM lineitem WHERE l_shipdate >= TIMESTAMP '1997-01-01' AND l_shipdate < TIMESTAMP '1998-01-01' AND l_quantity > 40 AND l_returnflag IN ('A', 'R') AND NOT coalesce(l_discount > 0.05, false)")
def fil1_filters(spark, d):
    line = table(spark, d, "lineitem")
    when = (F.col("l_shipdate") >= F.lit("1997-01-01").cast("timestamp_ntz")) & (F.col("l_shipdate") < F.lit("1998-01-01").cast("timestamp_ntz"))
    return line.where(when & (F.col("l_quantity") > 40) & F.col("l_returnflag").isin("A", "R") & ~F.coalesce(F.col("l_discount") > 0.05, F.lit(False))).select("l_orderkey", "l_linenumber", "l_quantity")


@query("SELECT count(*) AS read, count(*) FILTER (value >= 5 AND event_type <> 'view') AS kept, count(*) FILTER (value < 5) AS small, count(*) FILTER (value >= 5 AND event_type = 'view') AS views, true AS balanced FROM events")
def fil6_row_balance(spark, d):
    return loss_counts(table(spark, d, "events"), {"small": F.col("value") < 5, "views": F.col("event_type") == "view"})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 200000 THEN 'high' WHEN o_totalprice > 100000 THEN 'middle' ELSE 'low' END AS level, coalesce(nullif(o_orderpriority, '5-LOW'), 'none') AS priority FROM orders")
def cnd1_case(spark, d):
    price = F.col("o_totalprice")
    return table(spark, d, "orders").select("o_orderkey", F.when(price > 200000, "high").when(price > 100000, "middle").otherwise("low").alias("level"), F.coalesce(F.nullif("o_orderpriority", F.lit("5-LOW")), F.lit("none")).alias("priority"))


@query("SELECT event_id, CASE WHEN event_type NOT IN ('view', 'click') THEN event_type END AS event_type FROM events")
def cnd3_sentinels(spark, d):
    return without_sentinels(table(spark, d, "events").select("event_id", "event_type"), {"event_type": ("view", "click")})


@query("SELECT o_orderkey, CASE WHEN o_totalprice > 150000 THEN 1.0 ELSE 0.0 END::DOUBLE AS score FROM orders")
def cnd4_rule_score(spark, d):
    return table(spark, d, "orders").select("o_orderkey", Rule(feature="o_totalprice", threshold=150000).score().alias("score"))


# --- joins ------------------------------------------------------------------------------------------------------------


@query("SELECT o_orderkey, c_mktsegment, o_totalprice FROM orders JOIN customer ON o_custkey = c_custkey")
def jn1_inner(spark, d):
    c = table(spark, d, "customer").select("c_custkey", "c_mktsegment")
    return table(spark, d, "orders").join(c, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "c_mktsegment", "o_totalprice")


@query("SELECT c_custkey, o_orderkey FROM customer LEFT JOIN orders ON o_custkey = c_custkey")
def jn1_left(spark, d):
    o = table(spark, d, "orders").select("o_custkey", "o_orderkey")
    return table(spark, d, "customer").join(o, F.col("o_custkey") == F.col("c_custkey"), "left").select("c_custkey", "o_orderkey")


@query("SELECT l_orderkey AS o_orderkey, l_linenumber, l_partkey, l_suppkey, o_orderstatus FROM lineitem JOIN orders ON l_orderkey = o_orderkey")
def jn2_guarded(spark, d):
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), "l_linenumber", "l_partkey", "l_suppkey")
    return guarded_join(line, table(spark, d, "orders").select("o_orderkey", "o_orderstatus"), on=["o_orderkey"], expect=Cardinality.MANY_TO_ONE)


@query("SELECT sum(n)::BIGINT AS rows, count(*) AS keys, max(n) AS most, round(avg(n), 6) AS mean FROM (SELECT l_orderkey, count(*) AS n FROM lineitem WHERE l_orderkey IS NOT NULL GROUP BY 1)")
def jn3_cardinality(spark, d):
    line = table(spark, d, "lineitem")
    assert check_cardinality(table(spark, d, "orders"), line.withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"], Cardinality.ONE_TO_ONE)
    return rows_per_key(line, ["l_orderkey"]).withColumn("mean", r("mean"))


@query("SELECT (SELECT count(*) FROM orders WHERE o_orderkey NOT IN (SELECT l_orderkey FROM lineitem WHERE l_orderkey IS NOT NULL)) AS left_lost, (SELECT count(*) FROM lineitem WHERE l_orderkey NOT IN (SELECT o_orderkey FROM orders)) AS right_lost")
def jn4_losses(spark, d):
    return join_losses(table(spark, d, "orders"), table(spark, d, "lineitem").withColumnRenamed("l_orderkey", "o_orderkey"), ["o_orderkey"])


@query("SELECT c_custkey FROM customer WHERE EXISTS (SELECT 1 FROM orders WHERE o_custkey = c_custkey AND o_totalprice > 300000)")
def jn5_semi(spark, d):
    big = table(spark, d, "orders").where(F.col("o_totalprice") > 300000)
    return table(spark, d, "customer").join(big, F.col("o_custkey") == F.col("c_custkey"), "left_semi").select("c_custkey")


def _purchases(spark, d):
    e = table(spark, d, "events")
    return e.where("event_type <> 'purchase'").select("event_id", "user_id", "ts"), e.where("event_type = 'purchase'").select("user_id", F.col("ts").alias("bought_at"), F.col("value").alias("paid"))


@query("SELECT l.event_id, l.ts, p.ts AS bought_at, p.value AS paid, l.user_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON l.user_id = p.user_id AND l.ts >= p.ts")
def jn6_asof_backward(spark, d):
    left, right = _purchases(spark, d)
    return asof_join(left, right, left_on="ts", right_on="bought_at", by=["user_id"], direction=Direction.BACKWARD, values=["paid"])


@query("SELECT l.event_id, l.ts, p.ts AS bought_at, p.value AS paid, l.user_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON l.user_id = p.user_id AND l.ts <= p.ts")
def jn6_asof_forward(spark, d):
    left, right = _purchases(spark, d)
    return asof_join(left, right, left_on="ts", right_on="bought_at", by=["user_id"], direction=Direction.FORWARD, values=["paid"])


@query("SELECT l.event_id, l.ts, p.ts AS bought_at, p.value AS paid, l.user_id FROM (SELECT * FROM events WHERE event_type <> 'purchase') l ASOF LEFT JOIN (SELECT * FROM events WHERE event_type = 'purchase') p ON l.user_id = p.user_id AND l.ts >= p.ts")
def jn6_asof_bucketed(spark, d):
    left, right = _purchases(spark, d)
    return asof_join(left, right, left_on="ts", right_on="bought_at", by=["user_id"], direction=Direction.BACKWARD, values=["paid"], bucket_days=5)


@query("SELECT l.event_id, l.user_id, l.ts, p.ts AS next_at FROM events l ASOF LEFT JOIN events p ON l.user_id = p.user_id AND l.ts < p.ts")
def jn7_asof_strict_forward(spark, d):
    e = table(spark, d, "events").select("event_id", "user_id", "ts")
    return asof_join(e, e.select("user_id", F.col("ts").alias("next_at")), left_on="ts", right_on="next_at", by=["user_id"], direction=Direction.FORWARD, strict=True, values=[])


@query("SELECT o_orderkey, min(l_shipdate) AS shipped_at FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey AND l_shipdate > o_orderdate GROUP BY o_orderkey")
def jn9_nearest_later(spark, d):
    o = table(spark, d, "orders").select("o_orderkey", "o_orderdate")
    line = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("o_orderkey"), F.col("l_shipdate").alias("shipped_at"))
    return asof_join(o, line, left_on="o_orderdate", right_on="shipped_at", by=["o_orderkey"], direction=Direction.FORWARD, strict=True, values=[]).select("o_orderkey", "shipped_at")


@query("SELECT a.l_partkey, a.l_suppkey, count(*) AS n, round(sum(b.q), 4) AS q FROM (SELECT DISTINCT l_partkey, l_suppkey FROM lineitem WHERE l_returnflag = 'A') a JOIN (SELECT l_partkey, l_suppkey, l_quantity AS q FROM lineitem WHERE l_returnflag = 'N') b USING (l_partkey, l_suppkey) GROUP BY 1, 2")
def jn10_multi_key(spark, d):
    line = table(spark, d, "lineitem")
    a = line.where("l_returnflag = 'A'").select("l_partkey", "l_suppkey").distinct()
    b = line.where("l_returnflag = 'N'").groupBy("l_partkey", "l_suppkey").agg(F.count("*").alias("n"), F.sum("l_quantity").alias("q"))
    return a.join(b, ["l_partkey", "l_suppkey"]).withColumn("q", r("q", 4))


@query("SELECT count(*) AS rows, count(*)::DOUBLE / (SELECT count(*) FROM orders) AS rows_ratio, round(sum(o_totalprice) / (SELECT sum(o_totalprice) FROM orders), 6) AS sum_ratio FROM orders LEFT JOIN lineitem ON l_orderkey = o_orderkey")
def jn11_inflation(spark, d):
    """Rows and sums that a naive join inflates: counted from keys, without making the joined rows."""
    o = table(spark, d, "orders")
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"))
    times = F.coalesce("n", F.lit(1))
    sums = o.join(lines, "o_orderkey", "left").agg(F.sum(times).alias("rows"), F.count("*").alias("_o"), F.sum(times * F.col("o_totalprice")).alias("_s"), F.sum("o_totalprice").alias("_t"))
    return sums.select("rows", (F.col("rows") / F.col("_o")).alias("rows_ratio"), r(F.col("_s") / F.col("_t")).alias("sum_ratio"))


@query("SELECT o_orderkey, coalesce(n, 0) AS n, round(coalesce(v, 0), 4) AS v, coalesce(k, 0) AS suppliers FROM orders LEFT JOIN (SELECT l_orderkey, count(*) AS n, sum(l_extendedprice * (1 - l_discount)) AS v, count(DISTINCT l_suppkey) AS k FROM lineitem GROUP BY 1) ON l_orderkey = o_orderkey")
def jn11_preaggregated(spark, d):
    lines = table(spark, d, "lineitem").groupBy(F.col("l_orderkey").alias("o_orderkey")).agg(F.count("*").alias("n"), F.sum(F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"), F.count_distinct("l_suppkey").alias("k"))
    return table(spark, d, "orders").join(lines, "o_orderkey", "left").select("o_orderkey", F.coalesce("n", F.lit(0)).alias("n"), r(F.coalesce("v", F.lit(0.0)), 4).alias("v"), F.coalesce("k", F.lit(0)).alias("suppliers"))


@query("SELECT l.event_id, (SELECT count(*) FROM events p WHERE p.event_type = 'purchase' AND p.user_id = l.user_id AND p.ts < l.ts) AS prior FROM events l WHERE event_type <> 'purchase'")
def jn13_prior_count(spark, d):
    left, right = _purchases(spark, d)
    return prior_count(left, right, by=["user_id"], decision_time="ts", event_time="bought_at").select("event_id", "prior")


@query("SELECT a.event_id, count(b.event_id) AS prior FROM events a LEFT JOIN (SELECT * FROM events WHERE event_type = (SELECT min(event_type) FROM events)) b ON b.user_id % 3 = a.user_id % 3 AND b.ts < a.ts WHERE a.event_id % 20 = 0 GROUP BY 1")
def jn13_prior_count_hot(spark, d):
    """Three keys hold all rows: each is split into buckets of days.  The asking rows are every twentieth."""
    rows = table(spark, d, "events").withColumn("part", F.col("user_id") % 3)
    least = rows.agg(F.min("event_type").alias("least"))
    found = rows.join(F.broadcast(least), F.col("event_type") == F.col("least")).select("part", F.col("ts").alias("found_at"))  # one row
    return prior_count(rows.where("event_id % 20 = 0"), found, by=["part"], decision_time="ts", event_time="found_at", bucket_days=1).select("event_id", "prior")


@query("SELECT n_name, count(*) AS orders, round(sum(l_extendedprice * (1 - l_discount)), 2) AS revenue FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey WHERE r_name = (SELECT min(r_name) FROM region) GROUP BY n_name")
def jn1_star(spark, d):
    first = table(spark, d, "region").orderBy("r_name").limit(1).select("r_regionkey")
    nations = table(spark, d, "nation").join(first, F.col("n_regionkey") == F.col("r_regionkey"), "left_semi").select("n_nationkey", "n_name")
    customers = table(spark, d, "customer").join(nations, F.col("c_nationkey") == F.col("n_nationkey")).select("c_custkey", "n_name")
    orders = table(spark, d, "orders").join(customers, F.col("o_custkey") == F.col("c_custkey")).select("o_orderkey", "n_name")
    lines = table(spark, d, "lineitem").select("l_orderkey", (F.col("l_extendedprice") * (1 - F.col("l_discount"))).alias("v"))
    return lines.join(orders, F.col("l_orderkey") == F.col("o_orderkey")).groupBy("n_name").agg(F.count("*").alias("orders"), r(F.sum("v"), 2).alias("revenue"))


# --- aggregations -----------------------------------------------------------------------------------------------------


@query("SELECT l_returnflag, l_linestatus, round(sum(l_quantity), 2) AS sum_qty, round(sum(l_extendedprice), 2) AS sum_base_price, round(sum(l_extendedprice * (1 - l_discount)), 2) AS sum_disc_price, round(avg(l_quantity), 6) AS avg_qty, min(l_tax) AS min_tax, max(l_tax) AS max_tax, round(stddev_samp(l_quantity), 6) AS sd, count(DISTINCT l_suppkey) AS suppliers, count(*) AS n FROM lineitem GROUP BY 1, 2")
def ag1_pricing_summary(spark, d):
    net = F.col("l_extendedprice") * (1 - F.col("l_discount"))
    return table(spark, d, "lineitem").groupBy("l_returnflag", "l_linestatus").agg(
        r(F.sum("l_quantity"), 2).alias("sum_qty"), r(F.sum("l_extendedprice"), 2).alias("sum_base_price"), r(F.sum(net), 2).alias("sum_disc_price"), r(F.avg("l_quantity")).alias("avg_qty"), F.min("l_tax").alias("min_tax"), F.max("l_tax").alias("max_tax"), r(F.stddev_samp("l_quantity")).alias("sd"), F.count_distinct("l_suppkey").alias("suppliers"), F.count("*").alias("n"),
    )


@query("SELECT min(o_orderdate) AS first_at, max(o_orderdate) AS last_at, round(avg(o_totalprice), 4) AS mean_price, round(sum(o_totalprice), 2) AS total FROM orders")
def ag2_global(spark, d):
    return table(spark, d, "orders").agg(F.min("o_orderdate").alias("first_at"), F.max("o_orderdate").alias("last_at"), r(F.avg("o_totalprice"), 4).alias("mean_price"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT count(DISTINCT x) + max((x IS NULL)::INT) AS n FROM (SELECT nullif(o_orderpriority, '5-LOW') AS x FROM orders)")
def ag3_distinct_with_null(spark, d):
    return table(spark, d, "orders").select(F.nullif("o_orderpriority", F.lit("5-LOW")).alias("x")).agg(distinct_with_null("x").alias("n"))


@query("SELECT status, count(*) AS rows, sum((x IS NULL)::INT)::BIGINT AS nulls, round(avg((x IS NOT NULL)::INT), 6) AS fill FROM (SELECT o_orderstatus AS status, nullif(o_orderpriority, '5-LOW') AS x FROM orders) GROUP BY 1")
def ag4_fill_rate(spark, d):
    rows = table(spark, d, "orders").select(F.col("o_orderstatus").alias("status"), F.nullif("o_orderpriority", F.lit("5-LOW")).alias("x"))
    return rows.groupBy("status").agg(F.count("*").alias("rows"), F.count_if(F.col("x").isNull()).alias("nulls"), r(F.avg(F.col("x").isNotNull().cast("int"))).alias("fill"))


@query("SELECT user_id, arg_min(event_type, ts) AS first_type, arg_max(value, ts) AS last_value FROM events GROUP BY 1")
def ag5_first_in_group(spark, d):
    return table(spark, d, "events").groupBy("user_id").agg(F.min_by("event_type", F.struct("ts", "event_id")).alias("first_type"), F.max_by("value", F.struct("ts", "event_id")).alias("last_value"))


@query("SELECT o_custkey, o_orderstatus AS usual FROM (SELECT o_custkey, o_orderstatus, row_number() OVER (PARTITION BY o_custkey ORDER BY count(*) DESC, o_orderstatus) AS k FROM orders GROUP BY 1, 2) WHERE k = 1")
def ag6_mode(spark, d):
    counts = table(spark, d, "orders").groupBy("o_custkey", "o_orderstatus").agg(F.count("*").alias("n"))
    return counts.groupBy("o_custkey").agg(F.min_by("o_orderstatus", F.struct(-F.col("n"), "o_orderstatus")).alias("usual"))


@query("SELECT event_type, round(median(value), 6) AS median, round(quantile_cont(value, 0.9), 6) AS q90 FROM events GROUP BY 1")
def ag7_quantiles(spark, d):
    q = quantiles(table(spark, d, "events"), "value", [0.5, 0.9], ["event_type"])
    return q.select("event_type", r(F.col("quantiles")[0]).alias("median"), r(F.col("quantiles")[1]).alias("q90"))


@query("SELECT o_custkey, count(*) AS n FROM orders GROUP BY 1 HAVING count(*) >= 15")
def ag8_having(spark, d):
    return table(spark, d, "orders").groupBy("o_custkey").agg(F.count("*").alias("n")).where("n >= 15")


@query("SELECT o_orderpriority, count(*) AS n, round(count(*) / sum(count(*)) OVER (), 6) AS share FROM orders GROUP BY 1")
def ag9_share(spark, d):
    n = table(spark, d, "orders").groupBy("o_orderpriority").agg(F.count("*").alias("n"))
    return n.withColumn("share", r(F.col("n") / F.sum("n").over(Window.partitionBy())))


@query("SELECT c_mktsegment, round(avg((o_totalprice > 150000)::INT), 6) AS high, count(*) FILTER (o_orderstatus = 'F') AS finished FROM orders JOIN customer ON c_custkey = o_custkey GROUP BY 1")
def ag10_conditional(spark, d):
    c = table(spark, d, "customer").select(F.col("c_custkey").alias("o_custkey"), "c_mktsegment")
    return table(spark, d, "orders").join(c, "o_custkey").groupBy("c_mktsegment").agg(r(F.avg((F.col("o_totalprice") > 150000).cast("int"))).alias("high"), F.count_if(F.col("o_orderstatus") == "F").alias("finished"))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, round(sum(o_totalprice), 2) AS total FROM orders GROUP BY 1")
def ag11_monthly(spark, d):
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), r(F.sum("o_totalprice"), 2).alias("total"))


@query("SELECT l_orderkey, min(l_shipdate) AS first_ship, arg_min(l_partkey, (l_shipdate, l_linenumber, l_partkey, l_suppkey)) AS first_part, count(*) AS units FROM lineitem GROUP BY 1")
def ag12_collapse(spark, d):
    return table(spark, d, "lineitem").groupBy("l_orderkey").agg(F.min("l_shipdate").alias("first_ship"), F.min_by("l_partkey", F.struct("l_shipdate", "l_linenumber", "l_partkey", "l_suppkey")).alias("first_part"), F.count("*").alias("units"))


@query("SELECT epoch_us(max(o_orderdate)) AS last_us, strftime(max(o_orderdate), '%Y-%m-%d') AS last_text FROM orders")
def ag13_last_moment(spark, d):
    return table(spark, d, "orders").agg(F.max(micros("o_orderdate")).alias("last_us"), F.date_format(F.max("o_orderdate"), "yyyy-MM-dd").alias("last_text"))


@query("SELECT o_orderstatus, o_orderpriority, count(*) AS n FROM orders GROUP BY ROLLUP (o_orderstatus, o_orderpriority)")
def ag14_rollup(spark, d):
    return table(spark, d, "orders").rollup("o_orderstatus", "o_orderpriority").agg(F.count("*").alias("n"))


@query("""WITH x AS (SELECT CASE WHEN o_orderpriority <> '5-LOW' THEN o_orderpriority END AS priority, o_orderstatus AS status, o_custkey AS customer FROM orders)
SELECT 'priority' AS "column", 'string' AS type, count(*) AS rows, count(*) - count(priority) AS nulls, count(DISTINCT priority) + (count(*) > count(priority))::INT AS "distinct" FROM x
UNION ALL SELECT 'status', 'string', count(*), count(*) - count(status), count(DISTINCT status) + (count(*) > count(status))::INT FROM x
UNION ALL SELECT 'customer', 'bigint', count(*), count(*) - count(customer), count(DISTINCT customer) + (count(*) > count(customer))::INT FROM x""")
def ag15_profile(spark, d):
    priority = F.when(F.col("o_orderpriority") != "5-LOW", F.col("o_orderpriority")).alias("priority")
    return profile(table(spark, d, "orders").select(priority, F.col("o_orderstatus").alias("status"), F.col("o_custkey").alias("customer")))


@query("SELECT count(*) - count(DISTINCT (o_custkey, o_orderstatus)) AS duplicates FROM orders")
def ag15_duplicates(spark, d):
    """Rows that repeat others in some columns."""
    return duplicate_rows(table(spark, d, "orders").select("o_custkey", "o_orderstatus"))


# --- windows ------------------------------------------------------------------------------------------------------------


@query("SELECT event_id, lag(value) OVER w AS previous_value, lead(ts) OVER w AS next_ts, round(coalesce(sum(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0), 4) AS prior_value, row_number() OVER w - 1 AS n_prior FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts, event_id)")
def wn1_history(spark, d):
    h = history(table(spark, d, "events"), by=["user_id"], order=["ts", "event_id"], previous=["value"], following=["ts"], sums=["value"])
    return h.select("event_id", "previous_value", "next_ts", r("prior_value", 4).alias("prior_value"), "n_prior")


@query("SELECT o_orderkey, round(avg((o_orderstatus = 'F')::INT) OVER (PARTITION BY o_orderpriority), 6) AS target_mean FROM orders")
def wn5_target_mean(spark, d):
    """The mean by value, joined back: a window by a value with a third of the rows would sit in one task."""
    o = table(spark, d, "orders")
    means = o.groupBy("o_orderpriority").agg(r(F.avg((F.col("o_orderstatus") == "F").cast("int"))).alias("target_mean"))
    return o.join(means, "o_orderpriority").select("o_orderkey", "target_mean")


@query("SELECT event_id, round(avg(value) OVER w, 6) AS mean7, round(max(value) OVER w, 6) AS max7, round(stddev_samp(value) OVER w, 5) AS sd7, count(*) OVER w AS n7 FROM events WINDOW w AS (PARTITION BY user_id ORDER BY ts RANGE BETWEEN INTERVAL '604799999999 microseconds' PRECEDING AND CURRENT ROW)")
def wn6_roll_right(spark, d):
    w = rolling(["user_id"], "ts", 7)
    return table(spark, d, "events").select("event_id", r(F.avg("value").over(w)).alias("mean7"), r(F.max("value").over(w)).alias("max7"), r(F.stddev_samp("value").over(w), 5).alias("sd7"), F.count("*").over(w).alias("n7"))


@query("SELECT event_id, count(*) OVER (PARTITION BY event_type ORDER BY ts RANGE BETWEEN INTERVAL 3 DAY PRECEDING AND INTERVAL 1 MICROSECOND PRECEDING) AS earlier FROM events")
def wn7_roll_left(spark, d):
    return rolled(table(spark, d, "events").select("event_id", "event_type", "ts"), by=["event_type"], time="ts", days=3, sums={"earlier": F.lit(1)}, closed="left").select("event_id", "earlier")


@query("SELECT day, day - lag(day) OVER (ORDER BY day) AS gap FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)")
def wn8_gaps(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("day")).distinct()
    return days.select("day", F.datediff("day", F.lag("day").over(Window.orderBy("day"))).cast("long").alias("gap"))


@query("SELECT p_size, count(*) AS n, sum(count(*)) OVER (ORDER BY p_size) - (count(*) - 1) / 2 AS average_rank FROM part GROUP BY 1")
def wn9_average_rank(spark, d):
    return average_rank(table(spark, d, "part"), "p_size")


@query("SELECT c_custkey, dense_rank() OVER w AS dense, ntile(4) OVER (PARTITION BY c_nationkey ORDER BY c_acctbal, c_custkey) AS quarter, round(percent_rank() OVER w, 6) AS percent FROM customer WINDOW w AS (PARTITION BY c_nationkey ORDER BY c_acctbal)")
def wn11_ranks(spark, d):
    w = Window.partitionBy("c_nationkey").orderBy("c_acctbal")
    return table(spark, d, "customer").select("c_custkey", F.dense_rank().over(w).cast("long").alias("dense"), F.ntile(4).over(Window.partitionBy("c_nationkey").orderBy("c_acctbal", "c_custkey")).cast("long").alias("quarter"), r(F.percent_rank().over(w)).alias("percent"))


# --- order, limits, duplicates, sets --------------------------------------------------------------------------------


@query("SELECT o_orderkey, o_totalprice FROM orders ORDER BY o_totalprice DESC, o_orderkey LIMIT 20")
def so3_top_k(spark, d):
    return table(spark, d, "orders").select("o_orderkey", "o_totalprice").orderBy(F.desc("o_totalprice"), "o_orderkey").limit(20)


@query("SELECT c_mktsegment, arg_max(c_custkey, (c_acctbal, c_custkey)) AS richest FROM customer GROUP BY 1")
def so4_arg_max(spark, d):
    return table(spark, d, "customer").groupBy("c_mktsegment").agg(F.max_by("c_custkey", F.struct("c_acctbal", "c_custkey")).alias("richest"))


@query("SELECT (SELECT count(*) FROM lineitem) - (SELECT count(*) FROM (SELECT DISTINCT l_orderkey, l_linenumber FROM lineitem)) AS duplicates")
def so5_duplicates(spark, d):
    return duplicate_rows(table(spark, d, "lineitem").select("l_orderkey", "l_linenumber"))


@query("SELECT user_id, event_type, event_id FROM (SELECT *, row_number() OVER (PARTITION BY user_id, event_type ORDER BY ts, event_id) AS k FROM events) WHERE k = 1")
def so6_keep_first(spark, d):
    return keep_first(table(spark, d, "events"), ["user_id", "event_type"], ["ts", "event_id"]).select("user_id", "event_type", "event_id")


@query("SELECT 'order' AS what, o_totalprice AS amount FROM orders UNION ALL SELECT 'balance', c_acctbal FROM customer")
def se1_union(spark, d):
    a = table(spark, d, "orders").select(F.lit("order").alias("what"), F.col("o_totalprice").alias("amount"))
    return a.unionByName(table(spark, d, "customer").select(F.lit("balance").alias("what"), F.col("c_acctbal").alias("amount")))


@query("SELECT s_nationkey::BIGINT AS k FROM supplier UNION ALL SELECT o_orderkey FROM orders")
def se2_union_widened(spark, d):
    return table(spark, d, "supplier").select(F.col("s_nationkey").alias("k")).unionByName(table(spark, d, "orders").select(F.col("o_orderkey").alias("k")))


@query("SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01' INTERSECT SELECT o_custkey FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01'")
def se3_shared_keys(spark, d):
    o, cut = table(spark, d, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") < cut).select("o_custkey").intersect(o.where(F.col("o_orderdate") >= cut).select("o_custkey"))


@query("SELECT count(*) AS shared FROM orders WHERE o_orderdate >= TIMESTAMP '1998-01-01' AND o_custkey IN (SELECT o_custkey FROM orders WHERE o_orderdate < TIMESTAMP '1998-01-01')")
def se4_shared_units(spark, d):
    o, cut = table(spark, d, "orders"), F.lit("1998-01-01").cast("timestamp_ntz")
    return o.where(F.col("o_orderdate") >= cut).join(o.where(F.col("o_orderdate") < cut).select("o_custkey"), "o_custkey", "left_semi").agg(F.count("*").alias("shared"))


@query("SELECT c_custkey AS k FROM customer EXCEPT SELECT o_custkey FROM orders WHERE o_totalprice > 200000")
def se5_difference(spark, d):
    return table(spark, d, "customer").select(F.col("c_custkey").alias("k")).subtract(table(spark, d, "orders").where("o_totalprice > 200000").select("o_custkey"))


# --- functions ----------------------------------------------------------------------------------------------------------


@query("SELECT p_partkey, substr(p_name, 1, 2) AS two, regexp_matches(p_name, '(?i)red') AS red, starts_with(p_type, 'S') AS s, length(p_brand) AS n, p_brand || '/' || p_type AS joined, TRY_CAST(regexp_replace('$' || p_retailprice || ' ', '[$, ]', '', 'g') AS DOUBLE) AS money FROM part")
def str_functions(spark, d):
    money = F.regexp_replace(F.concat(F.lit("$"), F.col("p_retailprice").cast("string"), F.lit(" ")), "[$, ]", "").try_cast("double")
    return table(spark, d, "part").select("p_partkey", F.substring("p_name", 1, 2).alias("two"), F.col("p_name").rlike("(?i)red").alias("red"), F.col("p_type").startswith("S").alias("s"), F.char_length("p_brand").cast("long").alias("n"), F.concat("p_brand", F.lit("/"), "p_type").alias("joined"), money.alias("money"))


@query("SELECT event_id, ts::DATE AS day, date_trunc('month', ts)::TIMESTAMP AS month, ts + INTERVAL 30 HOUR AS later, isodow(ts) AS weekday, hour(ts) AS hour, strftime(ts, '%Y-%m-%d %H:%M') AS text, epoch_us(ts) AS us, floor((epoch_us(ts) - epoch_us(TIMESTAMP '2024-01-10')) / 86400000000.0)::BIGINT AS floor_days, last_day(ts::DATE) AS month_end FROM events")
def dt_functions(spark, d):
    ts, start = F.col("ts"), F.lit("2024-01-10").cast("timestamp_ntz")
    return table(spark, d, "events").select(
        "event_id", F.to_date(ts).alias("day"), F.date_trunc("month", ts).cast("timestamp_ntz").alias("month"), (ts + F.expr("INTERVAL 30 HOURS")).alias("later"), (F.weekday(ts) + 1).cast("long").alias("weekday"), F.hour(ts).cast("long").alias("hour"), F.date_format(ts, "yyyy-MM-dd HH:mm").alias("text"), micros("ts").alias("us"), F.floor((micros("ts") - F.unix_micros(start.cast("timestamp"))) / MICROS_PER_DAY).alias("floor_days"), F.last_day(ts).alias("month_end"),
    )


@query("SELECT l_orderkey, l_linenumber, l_partkey, l_suppkey, round(sqrt(l_quantity), 6) AS root, round(ln(1 + l_tax), 6) AS log, (l_quantity::BIGINT) // 7 AS q, (l_quantity::BIGINT) % 7 AS m, floor(l_extendedprice * 1000) / 1000 AS floored, 1 / (1 + l_quantity) AS inverse FROM lineitem")
def math_functions(spark, d):
    q = F.col("l_quantity")
    return table(spark, d, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", r(F.sqrt(q)).alias("root"), r(F.log1p("l_tax")).alias("log"), F.expr("cast(l_quantity as bigint) div 7").alias("q"), (q.cast("long") % 7).alias("m"), (F.floor(F.col("l_extendedprice") * 1000) / 1000).alias("floored"), (1 / (1 + q)).alias("inverse"))


@query("SELECT event_id, CAST(json_extract(props, '$.k') AS BIGINT) AS k FROM events")
def js_props(spark, d):
    return table(spark, d, "events").select("event_id", F.from_json("props", "k bigint")["k"].alias("k"))


@query("SELECT event_id, CASE event_type WHEN 'purchase' THEN 'money' WHEN 'click' THEN 'interest' WHEN 'view' THEN 'interest' ELSE 'other' END AS class FROM events")
def ud1_lookup(spark, d):
    classes = F.create_map(*(F.lit(x) for pair in (("purchase", "money"), ("click", "interest"), ("view", "interest")) for x in pair))
    return table(spark, d, "events").select("event_id", F.coalesce(F.try_element_at(classes, F.col("event_type")), F.lit("other")).alias("class"))


_TOKENS = ", ".join(f"'{x}'" for x in SENTINELS)


@query(f"WITH e AS (SELECT CASE event_type WHEN 'view' THEN 'N/A' WHEN 'click' THEN '?' ELSE event_type END AS event_type, CASE WHEN event_id % 10 = 0 THEN '-1' ELSE props END AS props FROM events) SELECT 'event_type' AS \"column\", count(*) FILTER (event_type IN ({_TOKENS})) AS n FROM e UNION ALL SELECT 'props', count(*) FILTER (props IN ({_TOKENS})) FROM e")
def src15_sentinel_counts(spark, d):
    kind = F.when(F.col("event_type") == "view", "N/A").when(F.col("event_type") == "click", "?").otherwise(F.col("event_type"))
    return sentinel_counts(table(spark, d, "events").withColumns({"event_type": kind, "props": F.when(F.col("event_id") % 10 == 0, "-1").otherwise(F.col("props"))}))


@query("SELECT date_trunc('month', o_orderdate)::TIMESTAMP AS month, count(*) AS n, count(nullif(o_orderpriority, '5-LOW')) AS filled FROM orders GROUP BY 1")
def src14_monthly_counts(spark, d):
    return table(spark, d, "orders").groupBy(F.date_trunc("month", "o_orderdate").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), F.count(F.nullif("o_orderpriority", F.lit("5-LOW"))).alias("filled"))
