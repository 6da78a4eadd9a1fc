"""Paired comparisons, calibration, costs of misses and bounds by cause over the driver's tables, with SQL where it can say it."""

from __future__ import annotations

import dataclasses
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .. import governance as g
from ..functions import calibration
from ..operators import label
from ..schema import Cause, Missing, Outcome, Positive
from . import tables
from .decisions import _SCORED, r, scored
from .tables import SNAPSHOT, T1_SQL

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None):
    def keep(f):
        QUERIES[f.__name__] = f
        if sql:
            ORACLE[f.__name__] = sql
        return f

    return keep


METRICS = ("auc", "ece", "ap", "brier", "log_loss", "net_benefit")
_COSTS = g.Costs(1, 3)
_SIDES = f"WITH {_SCORED}, b AS (SELECT label, 0.01 + 0.98 * value AS m, CASE WHEN n_chars > 1500 THEN 0.75 ELSE 0.25 END AS r FROM s), side AS (SELECT 'm' AS side, m AS v, label FROM b UNION ALL SELECT 'r', r, label FROM b)"


def _both(spark, d) -> DataFrame:
    """A score of each labelled text, and a rule's."""
    m = (0.01 + 0.98 * F.col("value")).alias("m")
    return scored(spark, d).select("label", m, F.when(F.col("n_chars") > 1500, 0.75).otherwise(0.25).alias("r"))


def _compared(spark, d) -> DataFrame:
    found = g.paired_all(_both(spark, d), "m", "r", "label", METRICS, _COSTS)
    rows = [(c.metric, c.model, c.rule, c.low, c.high) if isinstance(c, g.Comparison) else (c.metric, None, None, None, None) for c in found]
    return spark.createDataFrame(rows, "metric string, model double, rule double, low double, high double")


@query(
    _SIDES
    + """, rk AS (SELECT side, v, label, rank() OVER (PARTITION BY side ORDER BY v) + (count(*) OVER (PARTITION BY side, v) - 1) / 2.0 AS rk FROM side),
    cut AS (SELECT side, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM side GROUP BY 1),
    bin AS (SELECT side, abs(sum(v - label)) AS gap, count(*) AS n FROM (SELECT s.side, v, label, greatest(0, least(9, len([x for x in q if x <= v]) - 1)) AS k FROM side s JOIN cut USING (side)) GROUP BY side, k),
    step AS (SELECT side, p, sum(p) OVER (PARTITION BY side ORDER BY v DESC) / sum(n) OVER (PARTITION BY side ORDER BY v DESC) AS precision FROM (SELECT side, v, count(*) AS n, sum(label) AS p FROM side GROUP BY 1, 2)),
    long AS (SELECT side, 'auc' AS metric, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS x FROM rk GROUP BY 1
      UNION ALL SELECT side, 'ece', sum(gap) / sum(n) FROM bin GROUP BY 1 UNION ALL SELECT side, 'ap', sum(precision * p) / sum(p) FROM step GROUP BY 1
      UNION ALL SELECT side, 'brier', avg((v - label) * (v - label)) FROM side GROUP BY 1 UNION ALL SELECT side, 'log_loss', avg(CASE WHEN label = 1 THEN -ln(v) ELSE -ln(1 - v) END) FROM side GROUP BY 1
      UNION ALL SELECT side, 'net_benefit', (count(*) FILTER (v >= 0.25 AND label = 1) - count(*) FILTER (v >= 0.25 AND label = 0) / 3.0) / count(*) FROM side GROUP BY 1)
    SELECT metric, round(max(x) FILTER (side = 'm'), 6) AS model, round(max(x) FILTER (side = 'r'), 6) AS rule FROM long GROUP BY metric"""
)
def met8_paired_points(spark, d):
    """The sample's metrics of both scores, out of the same sums as the bootstrap's draws."""
    return _compared(spark, d).select("metric", r("model").alias("model"), r("rule").alias("rule"))


@query()
def met8_paired_intervals(spark, d):
    """Paired intervals of the differences; 400 draws."""
    return _compared(spark, d)


@query(
    f"""WITH {_SCORED}, v AS (SELECT value, count(*) AS n, sum(label) AS p, row_number() OVER (ORDER BY value) AS i FROM s WHERE label IS NOT NULL GROUP BY 1),
    c AS (SELECT i, value, sum(n) OVER (ORDER BY i) AS cn, sum(p) OVER (ORDER BY i) AS cp, n, p FROM v),
    pair AS (SELECT a.i AS j, b.i AS k, (b.cp - a.cp + a.p)::DOUBLE / (b.cn - a.cn + a.n) AS rate FROM c a JOIN c b ON b.i >= a.i),
    low AS (SELECT j, k, min(rate) OVER (PARTITION BY j ORDER BY k DESC) AS rate FROM pair)
    SELECT value, round(max(rate), 6) AS calibrated FROM low JOIN v ON v.i = low.k GROUP BY value"""
)
def met13_isotonic(spark, d):
    """Different scores with their isotonic rates."""
    rows = scored(spark, d)
    blocks = calibration.isotonic(rows, "value", "label")
    return calibration.calibrated(rows.where("label IS NOT NULL").select("value").distinct(), "value", blocks).select("value", r("calibrated").alias("calibrated"))


MISSES = (1.5, 3, 5, 10, 30)


@query(
    f"""WITH {_SCORED}, q AS (SELECT DISTINCT round(unnest(quantile_cont(value, [{", ".join(str(0.5 + 0.499 * k / 59) for k in range(60))}])), 6) AS t FROM s),
    m AS (SELECT unnest([{", ".join(map(str, MISSES))}]::DOUBLE[]) AS miss_cost),
    c AS (SELECT t, count(*) FILTER (value >= t) AS flagged, count(*) FILTER (value < t AND label = 1) AS missed, count(*) AS n, sum(label) AS p FROM s, q WHERE label IS NOT NULL GROUP BY t),
    e AS (SELECT *, flagged + missed * miss_cost AS cost, row_number() OVER (PARTITION BY miss_cost ORDER BY flagged + missed * miss_cost, t) AS k FROM c, m)
    SELECT miss_cost, t AS threshold, cost, p * miss_cost AS do_nothing, n::DOUBLE AS act_on_all, least(p * miss_cost, n) - cost AS gain FROM e WHERE k = 1"""
)
def met13_miss_cost(spark, d):
    """The best threshold of each cost of a miss."""
    rows = scored(spark, d)
    return calibration.miss_cost_sensitivity(rows, "value", "label", calibration.threshold_grid(rows, "value"), MISSES)


CONFLATED = Outcome(
    "event_at", "deadline_on", tables.Comparison.DIRECT, Positive.WITHIN,
    (Cause("open", Missing.NOT_OCCURRED, "O"), Cause("lost record", Missing.UNOBSERVED, assumption="records get lost at random"), Cause("withdrawn", Missing.EXCLUDED, assumption="orders are withdrawn silently")),
)


@query(
    f"""WITH {T1_SQL}, x AS (SELECT CASE WHEN event_at IS NOT NULL THEN NULL WHEN status = 'O' THEN 'O' ELSE 'indistinguishable' END AS class, deadline_on < TIMESTAMP '{SNAPSHOT}' AS mature,
    CASE WHEN event_at IS NOT NULL THEN (event_at <= deadline_on)::INT END AS y FROM t1),
    k AS (SELECT count(y) AS n, sum(y) AS p FROM x)
    SELECT class, count(*) AS rows, class = 'indistinguishable' AS conflated, round(CASE class WHEN 'O' THEN (p / (n + count(*) FILTER (mature)))::DOUBLE ELSE p / (n + count(*))::DOUBLE END, 6) AS low,
    round(CASE class WHEN 'O' THEN p / (n + count(*) FILTER (mature))::DOUBLE ELSE (p + count(*)) / (n + count(*))::DOUBLE END, 6) AS high FROM x, k WHERE class IS NOT NULL GROUP BY class, n, p"""
)
def lb7_cause_bounds(spark, d):
    """Bounds of the rate for each class of causes that the statuses can tell apart."""
    out = label.cause_bounds(tables.t1(spark, d), CONFLATED, "decided_at", F.lit(SNAPSHOT).cast("timestamp_ntz"), "status")
    return out.select("class", "rows", "conflated", r("low").alias("low"), r("high").alias("high"))


# --- measurements through the ledger ----------------------------------------------------------------------------------

_MODEL = "1 / (1 + o_totalprice / 200000)"
_WITHIN = f"WITH {T1_SQL}, {tables.labelled_sql()}, b AS (SELECT *, {_MODEL} AS m, (o_totalprice > 150000)::INT::DOUBLE AS r FROM l WHERE label IS NOT NULL)"
_RESERVED = f"decided_at >= TIMESTAMP '{tables.RESERVE_FROM}' AND decided_at < TIMESTAMP '{tables.RESERVE_UNTIL}'"
#: Metrics of the scores ``v`` against ``label`` by the columns ``by``, as rows (by, metric, x).
_METRICS = """rk AS (SELECT *, rank() OVER (PARTITION BY {by} ORDER BY v) + (count(*) OVER (PARTITION BY {by}, v) - 1) / 2.0 AS rk FROM side),
cut AS (SELECT {by}, quantile_cont(v, [0, 0.1, 0.2, 0.3, 0.4, 0.5, 0.6, 0.7, 0.8, 0.9, 1.0]) AS q FROM side GROUP BY {by}),
bin AS (SELECT {by}, abs(sum(v - label)) AS gap, count(*) AS n FROM (SELECT side.*, greatest(0, least(9, len([x for x in q if x <= v]) - 1)) AS k FROM side JOIN cut USING ({by})) GROUP BY {by}, k),
step AS (SELECT {by}, p, sum(p) OVER (PARTITION BY {by} ORDER BY v DESC) / sum(n) OVER (PARTITION BY {by} ORDER BY v DESC) AS precision FROM (SELECT {by}, v, count(*) AS n, sum(label) AS p FROM side GROUP BY {by}, v)),
long AS (SELECT {by}, 'auc' AS metric, (sum(rk * label) - sum(label) * (sum(label) + 1) / 2.0) / (sum(label) * (count(*) - sum(label))) AS x FROM rk GROUP BY {by}
UNION ALL SELECT {by}, 'ece', sum(gap) / sum(n) FROM bin GROUP BY {by} UNION ALL SELECT {by}, 'ap', sum(precision * p) / sum(p) FROM step GROUP BY {by}
UNION ALL SELECT {by}, 'brier', avg((v - label) * (v - label)) FROM side GROUP BY {by})"""
_FROM_ELSEWHERE = g.External("a formula of the order's price")


def _ledger(spark, d):
    """The samples of the orders' windows and reserve, and all orders' scores.

    The labelled orders, with the columns that a measurement reads, are written once: each check and metric reads them again."""
    from .decisions import splits
    from .exchange import place

    s = splits(spark, d)
    s.labelled.select("o_orderkey", s.decision, label.LABEL, label.KNOWN_AT, "o_totalprice").write.parquet(path := place(spark, "ledger"))
    s = dataclasses.replace(s, labelled=spark.read.parquet(path))
    ledger = g.SampleLedger(tables.schema())
    for w in s.windows:
        ledger.register_window(w.name, w.start, s.evaluate(w), s.train(w), "o_orderkey")
    ledger.register_window("reserve", s.reserve_from, s.reserved(), None, "o_orderkey")
    ledger.uses(["o_totalprice"])
    orders = tables.table(spark, d, "orders")
    return ledger, orders.select("o_orderkey", F.expr(_MODEL).alias("score")), orders.select("o_orderkey", (F.col("o_orderkey") % 7 / 7).alias("score"))


def _points(spark, named) -> DataFrame:
    rows = [(name, c.metric, *((c.model, c.rule) if isinstance(c, g.Comparison) else (None, None))) for name, c in named]
    df = spark.createDataFrame(rows, "sample string, metric string, model double, rule double")
    return df.select("sample", "metric", r("model").alias("model"), r("rule").alias("rule"))


@query(
    f"""{_WITHIN}, side AS (SELECT 'm' AS side, m AS v, label FROM b WHERE {_RESERVED} UNION ALL SELECT 'r', r, label FROM b WHERE {_RESERVED}), {_METRICS.format(by="side")}
    SELECT 'reserve' AS sample, metric, round(max(x) FILTER (side = 'm'), 6) AS model, round(max(x) FILTER (side = 'r'), 6) AS rule FROM long GROUP BY metric UNION ALL SELECT 'reserve', 'log_loss', NULL, NULL"""
)
def met9_against_baseline(spark, d):
    """The reserve, which is spent by it; a rule that says 0 or 1 has no finite log loss."""
    ledger, scores, _ = _ledger(spark, d)
    verdict = g.measure_against_baseline(ledger, "reserve", scores, g.Rule(feature="o_totalprice", threshold=150000), _FROM_ELSEWHERE, draws=50)
    return _points(spark, [("reserve", c) for c in verdict.comparisons])


@query(
    f"""{_WITHIN}, side AS (SELECT 'm' AS side, m AS v, label FROM b WHERE {_RESERVED} UNION ALL SELECT 'r', (o_orderkey % 7) / 7.0, label FROM b WHERE {_RESERVED}), {_METRICS.format(by="side")}
    SELECT 'reserve' AS sample, metric, round(max(x) FILTER (side = 'm'), 6) AS model, round(max(x) FILTER (side = 'r'), 6) AS rule FROM long WHERE metric IN ('auc', 'brier') GROUP BY metric"""
)
def met10_contrast(spark, d):
    """Two models on the reserve."""
    ledger, left, right = _ledger(spark, d)
    return _points(spark, [("reserve", c) for c in g.measure_contrast(ledger, "reserve", left, right, (_FROM_ELSEWHERE, _FROM_ELSEWHERE), draws=50).comparisons])


@query(
    f"""{_WITHIN}, w(w, start, stop) AS (VALUES {", ".join(f"('{w.name}', TIMESTAMP '{w.start}', TIMESTAMP '{w.stop}')" for w in tables.PERIODS)}),
    e AS (SELECT w, b.* FROM b JOIN w ON decided_at >= start AND decided_at < stop), side AS (SELECT w || 'm' AS side, m AS v, label FROM e UNION ALL SELECT w || 'r', r, label FROM e), {_METRICS.format(by="side")}
    SELECT side[:2] AS sample, metric, round(max(x) FILTER (side[3:] = 'm'), 6) AS model, round(max(x) FILTER (side[3:] = 'r'), 6) AS rule FROM long WHERE metric = 'auc' GROUP BY ALL"""
)
def met12_stability(spark, d):
    """The model against the rule in each window; all windows are spent together."""
    ledger, scores, _ = _ledger(spark, d)
    windows = [w.name for w in tables.PERIODS]
    out = g.stability_across_windows(ledger, dict.fromkeys(windows, scores), g.Rule(feature="o_totalprice", threshold=150000), dict.fromkeys(windows, _FROM_ELSEWHERE), draws=50)
    return _points(spark, out.windows.items())


@query(
    f"""{_WITHIN} SELECT name, accepted FROM (SELECT 'model' AS name, count(*) FILTER (label NOT IN (0, 1)) = 0 AS accepted FROM b UNION ALL SELECT 'status', false FROM b HAVING count(*) > 0
    UNION ALL SELECT 'label of counts', count(*) FILTER (o_orderkey NOT IN (0, 1)) = 0 FROM b UNION ALL SELECT 'key times a billion', max(o_orderkey) * 1000000000000 <= 9007199254740992 FROM b)"""
)
def met7_input_gate(spark, d):
    """What the gate takes: a model's score; not strings, labels that count, or whole numbers that lose digits."""
    from .decisions import labelled

    rows = labelled(spark, d).where(F.col(label.LABEL).isNotNull()).withColumns({"model": F.expr(_MODEL), "large": F.col("o_orderkey") * 1_000_000_000_000})
    asked = {"model": ("model", label.LABEL), "status": ("status", label.LABEL), "label of counts": ("model", "o_orderkey"), "key times a billion": ("large", label.LABEL)}
    out = []
    for name, (score, y) in asked.items():
        try:
            g.gate(rows, score, y)
            out.append((name, True))
        except g.Blocked:
            out.append((name, False))
    return spark.createDataFrame(out, "name string, accepted boolean")
