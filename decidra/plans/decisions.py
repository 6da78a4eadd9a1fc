"""Labels, splits, checks and metrics over the driver's tables, each with its SQL."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ..functions import stats
from ..functions.ranks import quantiles, tiles
from ..operators import label, split
from ..operators.checks import audit
from ..operators.profile import SENTINELS
from ..operators.windows import MICROS_PER_DAY, micros
from ..schema import Comparison, Task
from . import tables
from .tables import PERIODS, RESERVE_FROM, RESERVE_UNTIL, SNAPSHOT, T1_PREMATURE_SQL, T1_SQL, labelled_sql, table

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
WITH = f"WITH {T1_SQL}, {labelled_sql()} "


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


def r(column, digits: int = 6):
    return F.round(column, digits)


def labelled(spark, d, how: Comparison = Comparison.DIRECT, premature: bool = False, **more) -> DataFrame:
    made = label.label_columns(tables.outcome(how, **more), "decided_at", F.lit(SNAPSHOT).cast("timestamp_ntz"), "status", "kind")
    return tables.t1(spark, d, premature).withColumns(made | {label.KNOWN_AT: label.known_at(tables.outcome(how))})


def splits(spark, d) -> split.Split:
    return split.Split(labelled(spark, d), "decided_at", PERIODS, RESERVE_FROM, RESERVE_UNTIL)


def _named(df: DataFrame) -> DataFrame:
    return df.withColumnsRenamed({label.LABEL: "label", label.REASON: "reason_of", label.KNOWN_AT: "known_at"})


LABEL_COLUMNS = ["o_orderkey", "label", "reason_of", "known_at"]

# --- labels -------------------------------------------------------------------------------------------------------------


@query(f"WITH {T1_SQL}, {labelled_sql('by_date')} SELECT date_trunc('month', decided_at)::TIMESTAMP AS month, count(*) AS n, count(label) AS labelled, round(avg(label), 6) AS positive_rate FROM l GROUP BY 1")
def m0_label_rate_by_month(spark, d):
    month = F.date_trunc("month", "decided_at").cast("timestamp_ntz").alias("month")
    return labelled(spark, d, Comparison.BY_DATE).groupBy(month).agg(F.count("*").alias("n"), F.count(label.LABEL).alias("labelled"), r(F.avg(label.LABEL)).alias("positive_rate"))


@query(WITH + "SELECT o_orderkey, label, reason_of, known_at FROM l")
def lb2_label_direct(spark, d):
    return _named(labelled(spark, d)).select(LABEL_COLUMNS)


@query(f"WITH {T1_SQL}, {labelled_sql('by_date')} SELECT o_orderkey, label, reason_of, known_at FROM l")
def lb2_label_by_date(spark, d):
    return _named(labelled(spark, d, Comparison.BY_DATE)).select(LABEL_COLUMNS)


@query(f"WITH {T1_PREMATURE_SQL}, {labelled_sql()} SELECT reason_of, count(*) AS n, count(label) AS labelled, coalesce(sum(label), 0)::BIGINT AS positives FROM l GROUP BY 1")
def lb2_before_decision(spark, d):
    return _named(labelled(spark, d, premature=True)).groupBy("reason_of").agg(F.count("*").alias("n"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).alias("positives"))


@query(WITH + "SELECT o_orderkey, CASE WHEN kind <> 'N' AND event_at <= deadline_on THEN NULL ELSE label END AS label, CASE WHEN kind <> 'N' AND event_at <= deadline_on THEN 'censored' ELSE reason_of END AS reason_of FROM l")
def lb3_competing_kind(spark, d):
    return _named(labelled(spark, d, primary_kind="N")).select("o_orderkey", "label", "reason_of")


@query(WITH + "SELECT k.kind, count(*) AS rows, count(label) FILTER (NOT coalesce(l.kind <> k.kind AND event_at <= deadline_on, false)) AS labelled, coalesce(sum(label) FILTER (NOT coalesce(l.kind <> k.kind AND event_at <= deadline_on, false)), 0)::BIGINT AS positives, count(*) FILTER (l.kind <> k.kind AND event_at <= deadline_on) AS censored_by_others FROM l, (SELECT unnest(['A', 'N', 'R']) AS kind) k GROUP BY 1")
def lb4_by_kind(spark, d):
    return label.by_kind(tables.t1(spark, d), tables.outcome(), "decided_at", "kind", ["A", "N", "R"], SNAPSHOT, "status")


# --- splits -------------------------------------------------------------------------------------------------------------

_SEEN = f"decided_at < TIMESTAMP '{RESERVE_FROM}'"
_PARTS = ", ".join(f"('{w.name}', TIMESTAMP '{w.start}', TIMESTAMP '{w.stop}')" for w in PERIODS)
_TAGGED = WITH + f", w(w, start, stop) AS (VALUES {_PARTS}), t AS (SELECT w, 'train' AS side, start, stop, l.* FROM l, w WHERE {_SEEN} AND label IS NOT NULL AND known_at < start UNION ALL SELECT w, 'evaluate', start, stop, l.* FROM l, w WHERE {_SEEN} AND decided_at >= start AND decided_at < stop) "


@query(_TAGGED + f'SELECT w AS "window", (SELECT count(*) FROM t WHERE t.w = w.w AND side = \'train\') AS train, (SELECT count(*) FROM t WHERE t.w = w.w AND side = \'evaluate\') AS evaluate, (SELECT count(label) FROM t WHERE t.w = w.w AND side = \'evaluate\') AS labelled, (SELECT count(*) FROM t WHERE t.w = w.w AND side = \'evaluate\' AND label = 1) AS positives, (SELECT count(*) FROM t WHERE t.w = w.w AND side = \'evaluate\' AND reason_of = \'immature\') AS immature, (SELECT count(*) FROM l WHERE {_SEEN} AND decided_at < w.start AND known_at >= w.start) AS dropped_not_yet_known FROM w')
def sp1_window_counts(spark, d):
    return splits(spark, d).counts()


@query(WITH + f"SELECT count(*) FILTER (decided_at >= TIMESTAMP '{RESERVE_FROM}' AND decided_at < TIMESTAMP '{RESERVE_UNTIL}') AS reserved, count(*) FILTER (decided_at >= TIMESTAMP '{RESERVE_FROM}' AND decided_at < TIMESTAMP '{RESERVE_UNTIL}' AND reason_of = 'immature') AS reserved_immature, count(*) FILTER (decided_at >= TIMESTAMP '{RESERVE_UNTIL}') AS outside, count(*) FILTER (decided_at >= TIMESTAMP '{RESERVE_UNTIL}' AND reason_of = 'immature') AS outside_immature FROM l")
def sp2_reserve(spark, d):
    return splits(spark, d).reserve_counts()


@query(_TAGGED + 'SELECT w AS "window", side, o_orderkey FROM t')
def sp1_parts(spark, d):
    return splits(spark, d).tagged().select("window", "side", "o_orderkey")


@query(_TAGGED + 'SELECT w AS "window", count(*) FILTER (a > 0 AND e > 0) AS shared FROM (SELECT w, o_custkey, count(*) FILTER (side = \'train\') AS a, count(*) FILTER (side = \'evaluate\') AS e FROM t GROUP BY 1, 2) GROUP BY 1')
def sp4_entity_overlap(spark, d):
    return split.overlap(splits(spark, d), "o_custkey")


@query(_TAGGED + ', g AS (SELECT w, c_nationkey, count(*) FILTER (side = \'train\') AS a, count(*) FILTER (side = \'evaluate\') AS e FROM t GROUP BY 1, 2) SELECT w AS "window", count(*) FILTER (a > 0 AND e > 0) AS shared, round(sum(CASE WHEN a > 0 THEN e ELSE 0 END) / sum(e), 6) AS touched FROM g GROUP BY 1')
def sp6_group_overlap(spark, d):
    return split.group_overlap(splits(spark, d), "c_nationkey").withColumn("touched", r("touched"))


@query("WITH g AS (SELECT o_orderpriority AS v, count(DISTINCT o_orderkey) AS k, count(*) AS n FROM orders GROUP BY 1) SELECT 'o_orderpriority' AS \"column\", count(*) AS groups, sum(CASE WHEN k > 1 THEN n ELSE 0 END)::DOUBLE / sum(n) AS share FROM g HAVING count(*) >= 3")
def sp5_group_candidates(spark, d):
    return split.group_candidates(table(spark, d, "orders").select("o_orderkey", "o_orderpriority"), "o_orderkey", least_groups=3)


@query(_TAGGED + "SELECT count(*) AS n FROM t e JOIN (SELECT o_custkey, max(decided_at) AS last FROM t WHERE w = 'w2' AND side = 'train' GROUP BY 1) x USING (o_custkey) WHERE w = 'w2' AND side = 'evaluate' AND decided_at <= last + INTERVAL 90 DAY")
def sp7_lookback_overlap(spark, d):
    s = splits(spark, d)
    return split.lookback_overlap(s.train(PERIODS[1]), s.evaluate(PERIODS[1]), "o_custkey", "decided_at", 90)


@query(_TAGGED + "SELECT x.o_orderkey FROM t x LEFT JOIN (SELECT o_custkey, min(decided_at) AS f FROM t WHERE w = 'w2' AND side = 'evaluate' GROUP BY 1) e USING (o_custkey) WHERE w = 'w2' AND side = 'train' AND (f IS NULL OR decided_at < f - INTERVAL 90 DAY)")
def sp8_purge(spark, d):
    s = splits(spark, d)
    return split.purge_overlapping_train(s.train(PERIODS[1]), s.evaluate(PERIODS[1]), "o_custkey", "decided_at", 90).select("o_orderkey")


# --- what checks count ---------------------------------------------------------------------------------------------------


@query("SELECT count(DISTINCT o_orderkey) AS entities, count(DISTINCT o_custkey) AS objects, count(DISTINCT o_custkey) < count(DISTINCT o_orderkey) AS fewer FROM orders")
def a2_surrogate_key(spark, d):
    return table(spark, d, "orders").agg(F.count_distinct("o_orderkey").alias("entities"), F.count_distinct("o_custkey").alias("objects")).withColumn("fewer", F.col("objects") < F.col("entities"))


@query(f"WITH {T1_SQL} SELECT status, count(*) AS n, count(*) - count(event_at) AS without_event FROM t1 GROUP BY 1 HAVING count(event_at) BETWEEN 1 AND count(*) - 1")
def a5_status_conflict(spark, d):
    n = tables.t1(spark, d).groupBy("status").agg(F.count("*").alias("n"), F.count_if(F.col("event_at").isNull()).alias("without_event"))
    return n.where("without_event > 0 and without_event < n")


@query("WITH days AS (SELECT o_orderdate::DATE AS day, count(*) AS n FROM orders GROUP BY 1), m AS (SELECT max(day) AS last FROM days) SELECT round(sum(n) FILTER (day > last - 14) / 14, 6) AS tail, median(n) FILTER (day <= last - 14) AS usual, count(*) AS days FROM days, m")
def a6_tail_volume(spark, d):
    days = table(spark, d, "orders").groupBy(F.to_date("o_orderdate").alias("day")).agg(F.count("*").alias("n"))
    old = F.col("day") <= F.date_sub("last", 14)
    late = days.withColumn("last", F.max("day").over(Window.partitionBy()))
    return late.agg(r(F.sum(F.when(~old, F.col("n"))) / 14).alias("tail"), F.percentile(F.when(old, F.col("n")), 0.5).alias("usual"), F.count("*").alias("days"))


@query("SELECT day AS after, nxt AS before, nxt - day - 1 AS missing FROM (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM (SELECT DISTINCT o_orderdate::DATE AS day FROM orders)) WHERE nxt - day - 1 >= 1")
def a7_missing_days(spark, d):
    days = table(spark, d, "orders").select(F.to_date("o_orderdate").alias("after")).distinct().withColumn("before", F.lead("after").over(Window.orderBy("after")))
    return days.withColumn("missing", (F.datediff("before", "after") - 1).cast("long")).where("missing >= 1")


@query(f"WITH {T1_PREMATURE_SQL} SELECT decided_at::DATE AS day, count(*) FILTER (event_at < decided_at) AS before, count(*) FILTER (event_at = decided_at) AS equal FROM t1 GROUP BY 1")
def a13_before_decision(spark, d):
    return tables.t1(spark, d, True).groupBy(F.to_date("decided_at").alias("day")).agg(F.count_if(F.col("event_at") < F.col("decided_at")).alias("before"), F.count_if(F.col("event_at") == F.col("decided_at")).alias("equal"))


@query("SELECT count(*) FILTER (x IN ('-', '?', '', ' ')) AS n FROM (SELECT CASE o_orderpriority WHEN '5-LOW' THEN '-' WHEN '1-URGENT' THEN ' ' ELSE o_orderpriority END AS x FROM orders)")
def a14_sentinels(spark, d):
    x = F.when(F.col("o_orderpriority") == "5-LOW", "-").when(F.col("o_orderpriority") == "1-URGENT", " ").otherwise(F.col("o_orderpriority"))
    return table(spark, d, "orders").agg(F.count_if(x.isin(*SENTINELS)).alias("n"))


@query(_TAGGED + "SELECT w AS \"window\", count(label) AS rows, round(avg(label), 6) AS rate, round(sqrt(avg(label) * (1 - avg(label)) / count(label)), 6) AS error FROM t WHERE side = 'evaluate' GROUP BY 1")
def n3_rate_by_window(spark, d):
    rate = F.avg(label.LABEL)
    return splits(spark, d).tagged().where("side = 'evaluate'").groupBy("window").agg(F.count(label.LABEL).alias("rows"), r(rate).alias("rate"), r(F.sqrt(rate * (1 - rate) / F.count(label.LABEL))).alias("error"))


_AUC = "(sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label)))"


def _ranked(source: str, part: str) -> str:
    return f"SELECT *, rank() OVER (PARTITION BY {part} ORDER BY value) + (count(*) OVER (PARTITION BY {part}, value) - 1) / 2.0 AS rk FROM ({source})"


@query(_TAGGED + "SELECT w AS \"window\", feature, count(*) AS rows, round(" + _AUC + " - 0.5, 6) AS association FROM (" + _ranked("SELECT w, 'o_totalprice' AS feature, o_totalprice AS value, label FROM t WHERE side = 'evaluate' AND label IS NOT NULL UNION ALL SELECT w, 'c_acctbal', c_acctbal, label FROM t WHERE side = 'evaluate' AND label IS NOT NULL", "w, feature") + ") GROUP BY 1, 2")
def n4_association_by_window(spark, d):
    rows = splits(spark, d).tagged().where("side = 'evaluate'")
    return stats.association(rows, ["o_totalprice", "c_acctbal"], label.LABEL, ["window"]).select("window", "feature", "rows", r("association").alias("association"))


@query(WITH + "SELECT feature, count(*) AS rows, round(" + _AUC + " - 0.5, 6) AS association FROM (" + _ranked("SELECT 'o_totalprice' AS feature, o_totalprice AS value, label FROM l WHERE label IS NOT NULL UNION ALL SELECT 'c_acctbal', c_acctbal, label FROM l WHERE label IS NOT NULL", "feature") + ") GROUP BY 1")
def n6_association(spark, d):
    return stats.association(labelled(spark, d), ["o_totalprice", "c_acctbal"], label.LABEL).select("feature", "rows", r("association").alias("association"))


@query(_TAGGED + "SELECT w AS \"window\", round(quantile_cont(o_totalprice, 0.05), 4) AS q05, round(quantile_cont(o_totalprice, 0.95), 4) AS q95 FROM t WHERE side = 'evaluate' GROUP BY 1")
def n5_support(spark, d):
    q = quantiles(splits(spark, d).tagged().where("side = 'evaluate'"), "o_totalprice", [0.05, 0.95], ["window"])
    return q.select("window", r(F.col("quantiles")[0], 4).alias("q05"), r(F.col("quantiles")[1], 4).alias("q95"))


@query("WITH s AS (SELECT o_totalprice AS v, row_number() OVER (ORDER BY o_totalprice) - 1 AS k, count(*) OVER () AS n FROM orders) SELECT min(v) FILTER (k = round_even(0.9 * (n - 1), 0)) AS quantile FROM s")
def n5_quantile_nearest(spark, d):
    return stats.quantile_nearest(table(spark, d, "orders"), "o_totalprice", 0.9)


@query(WITH + "SELECT round(avg(label), 6) AS rate, round(sum(label) / (sum(label) + count(*) - count(label)), 6) AS x, round(count(*) FILTER (label IS NULL AND reason_of <> 'immature') / count(*), 6) AS unobserved FROM l")
def n16_unobserved(spark, d):
    y = F.col(label.LABEL)
    return labelled(spark, d).agg(r(F.avg(y)).alias("rate"), r(F.sum(y) / (F.sum(y) + F.count("*") - F.count(y))).alias("x"), r(F.count_if(y.isNull() & (F.col(label.REASON) != label.IMMATURE)) / F.count("*")).alias("unobserved"))


@query(WITH + "SELECT reason, count(*) AS n, round(avg(label), 6) AS rate FROM l WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 100")
def n17_rate_by_reason(spark, d):
    return labelled(spark, d).where(F.col(label.LABEL).isNotNull()).groupBy("reason").agg(F.count("*").alias("n"), r(F.avg(label.LABEL)).alias("rate")).where("n >= 100")


@query(WITH + "SELECT date_trunc('month', decided_at)::TIMESTAMP AS month, count(*) AS n, round(count(event_at) / count(*), 6) AS fill FROM l WHERE reason_of <> 'immature' GROUP BY 1")
def n18_fill_by_month(spark, d):
    rows = labelled(spark, d).where(F.col(label.REASON) != label.IMMATURE)
    return rows.groupBy(F.date_trunc("month", "decided_at").cast("timestamp_ntz").alias("month")).agg(F.count("*").alias("n"), r(F.count("event_at") / F.count("*")).alias("fill"))


@query("SELECT count(*) FILTER (age < 1) AS too_new, count(*) FILTER (age > 30) AS too_old, count(age) AS rows FROM (SELECT (epoch_us(o_orderdate) - epoch_us(s)) / 86400000000.0 AS age FROM (SELECT o_orderdate, lag(o_orderdate) OVER (PARTITION BY o_custkey ORDER BY o_orderdate, o_orderkey) AS s FROM orders))")
def s7_measured_window(spark, d):
    w = Window.partitionBy("o_custkey").orderBy("o_orderdate", "o_orderkey")
    rows = table(spark, d, "orders").withColumn("s", F.lag("o_orderdate").over(w)).select(((micros("o_orderdate") - micros("s")) / MICROS_PER_DAY).alias("age"))
    return rows.agg(F.count_if(F.col("age") < 1).alias("too_new"), F.count_if(F.col("age") > 30).alias("too_old"), F.count("age").alias("rows"))


@query()
def audit_orders(spark, d):
    """All checks over the orders' decision table, which is written once, as findings."""
    from .exchange import place

    s, out = splits(spark, d), tables.outcome(degenerate_below=0.01, collapse_kinds=True)
    s.labelled.write.parquet(path := place(spark, "orders"))
    s = dataclasses.replace(s, labelled=spark.read.parquet(path))
    return audit(s, tables.schema(), out, Task(has_process=True, is_stream=True), keep=False).frame(spark)


# --- metrics ------------------------------------------------------------------------------------------------------------

_SCORED = "s AS (SELECT doc_id, quality AS label, (n_chars % 1000) / 1000.0 AS value, n_chars, lang FROM labels JOIN documents USING (doc_id))"


def scored(spark, d) -> DataFrame:
    docs = table(spark, d, "documents").select("doc_id", "n_chars", "lang")
    return table(spark, d, "labels").join(docs, "doc_id").select("doc_id", F.col("quality").alias("label"), ((F.col("n_chars") % 1000) / 1000).alias("value"), "n_chars", "lang")


@query(f"WITH {_SCORED} SELECT count(*) AS rows, sum(label)::BIGINT AS positives, round({_AUC}, 6) AS auc FROM (" + _ranked("SELECT label, value FROM s WHERE label IS NOT NULL", "1") + ")")
def met1_auc(spark, d):
    return stats.auc(scored(spark, d), "value", "label").select("rows", "positives", r("auc").alias("auc"))


@query(f"WITH {_SCORED}, e AS (SELECT quantile_cont(value, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM s), b AS (SELECT greatest(0, least(9, len([x for x in q if x <= value]) - 1)) AS bin, count(*) AS n, avg(value) AS v, avg(label) AS y FROM s, e GROUP BY 1) SELECT round(sum(n * abs(v - y)) / sum(n), 6) AS ece FROM b")
def met2_ece(spark, d):
    return stats.calibration_error(scored(spark, d), "value", "label").select(r("ece").alias("ece"))


@query(f"WITH {_SCORED}, g AS (SELECT value, count(*) AS n, sum(label) AS p FROM s GROUP BY 1), c AS (SELECT p, sum(p) OVER (ORDER BY value DESC) / sum(n) OVER (ORDER BY value DESC) AS precision, sum(p) OVER () AS total FROM g) SELECT round(sum(precision * p / total), 6) AS ap FROM c")
def met3_average_precision(spark, d):
    return stats.average_precision(scored(spark, d), "value", "label").select(r("ap").alias("ap"))


@query(f"WITH {_SCORED} SELECT round(avg((value - label) * (value - label)), 6) AS brier FROM s")
def met4_brier(spark, d):
    return scored(spark, d).agg(r(stats.brier("value", "label")).alias("brier"))


@query(f"WITH {_SCORED} SELECT round(avg(CASE WHEN label = 1 THEN -ln(0.01 + 0.98 * value) ELSE -ln(1 - (0.01 + 0.98 * value)) END), 6) AS log_loss FROM s")
def met5_log_loss(spark, d):
    return scored(spark, d).withColumn("value", 0.01 + 0.98 * F.col("value")).agg(r(stats.log_loss("value", "label")).alias("log_loss"))


@query(f"WITH {_SCORED} SELECT t AS threshold, round((count(*) FILTER (value >= t AND label = 1) - count(*) FILTER (value >= t AND label = 0) * (t / (1 - t))) / count(*), 6) AS net_benefit FROM s, (SELECT unnest([0.25::DOUBLE, 0.5, 0.75]) AS t) GROUP BY 1")
def met6_net_benefit(spark, d):
    wide = scored(spark, d).agg(*(stats.net_benefit("value", "label", t).alias(f"t{k}") for k, t in enumerate((0.25, 0.5, 0.75))))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), r(F.col(f"t{k}")).alias("net_benefit")) for k, t in enumerate((0.25, 0.5, 0.75))))))


@query(f"WITH {_SCORED} SELECT 'lang' AS feature, lang AS value, count(*) AS rows, round(avg(s.value), 6) AS mean_score, round(avg(label), 6) AS mean_label, round(avg(s.value) - avg(label), 6) AS bias FROM s GROUP BY lang HAVING count(*) >= 20")
def met11_segment_bias(spark, d):
    out = stats.segment_bias(scored(spark, d).withColumnRenamed("value", "score"), "score", "label", ["lang"], 20)
    return out.select("feature", "value", "rows", *(r(c).alias(c) for c in ("mean_score", "mean_label", "bias")))


@query(f"WITH {_SCORED}, t AS (SELECT *, ntile(10) OVER (ORDER BY value, doc_id) AS decile FROM s) SELECT decile::BIGINT AS decile, count(*) AS rows, round(avg(value), 6) AS mean_score, round(avg(label), 6) AS mean_label FROM t GROUP BY 1")
def met13_deciles(spark, d):
    """Deciles of a labelled sample, of equal places in the order of (value, doc_id)."""
    return tiles(scored(spark, d), "value", "doc_id", 10, "decile").groupBy("decile").agg(F.count("*").alias("rows"), r(F.avg("value")).alias("mean_score"), r(F.avg("label")).alias("mean_label"))


@query(f"WITH {_SCORED} SELECT t AS threshold, (count(*) FILTER (value >= t AND label = 0) * 1 + count(*) FILTER (value < t AND label = 1) * 5)::BIGINT AS cost FROM s, (SELECT unnest([0.1::DOUBLE, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9]) AS t) GROUP BY 1")
def met13_cost_curve(spark, d):
    grid = [k / 10 for k in range(1, 10)]
    value, y = F.col("value"), F.col("label")
    wide = scored(spark, d).agg(*((F.count_if((value >= t) & (y == 0)) + 5 * F.count_if((value < t) & (y == 1))).alias(f"t{k}") for k, t in enumerate(grid)))
    return wide.select(F.inline(F.array(*(F.struct(F.lit(t).alias("threshold"), F.col(f"t{k}").alias("cost")) for k, t in enumerate(grid)))))


@query(WITH + "SELECT year(decided_at) AS year, round(corr(o_totalprice, label), 6) AS correlation, round(avg(label), 6) AS rate FROM l WHERE label IS NOT NULL GROUP BY 1")
def met14_correlation_drift(spark, d):
    rows = labelled(spark, d).where(F.col(label.LABEL).isNotNull())
    return rows.groupBy(F.year("decided_at").cast("long").alias("year")).agg(r(F.corr("o_totalprice", label.LABEL)).alias("correlation"), r(F.avg(label.LABEL)).alias("rate"))


@query(WITH + ", q AS (SELECT quantile_cont(o_totalprice, 0.25) AS lo, quantile_cont(o_totalprice, 0.75) AS hi FROM l WHERE label IS NOT NULL) SELECT round(avg(label) FILTER (o_totalprice >= hi) - avg(label) FILTER (o_totalprice <= lo), 6) AS gap FROM l, q WHERE label IS NOT NULL")
def met15_quartile_gap(spark, d):
    rows = labelled(spark, d).where(F.col(label.LABEL).isNotNull())
    edges = quantiles(rows, "o_totalprice", [0.25, 0.75]).select("quantiles")
    x, q = F.col("o_totalprice"), F.col("quantiles")
    rows = rows.crossJoin(F.broadcast(edges))  # one row
    return rows.agg(r(F.avg(F.when(x >= q[1], F.col(label.LABEL))) - F.avg(F.when(x <= q[0], F.col(label.LABEL)))).alias("gap"))


