"""One query for each requirement of the audit, over the orders with planted defects, each with its SQL.

The table is T1 with the first shipment of all as the event.  Planted are: repeated rows, days without orders and a thin
last fortnight, lost and late events (all of one month, more under one reason and from one half year to the next), gaps of a
feature under one status, sentinels, a number and a string that leak the outcome, a number whose relation flips and one whose
values move with time, a feature that is measured outside its window and known after it, and an undeclared column.

A second audit of the same rows declares other things, and wrongly: objects recur, windows overlap, nothing is reserved,
kinds can't meet.  The labelled rows are written once for both, and the passes of an audit run once, for each session and folder.
"""

from __future__ import annotations

import dataclasses
import datetime as dt
from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators import label, split
from ..operators.checks import Report, audit
from ..operators.profile import SENTINELS
from ..schema import Availability, ColumnSpec, Grain, Period, Role, Schema, Simultaneous, Task
from . import tables
from .exchange import place
from .tables import PERIODS, RESERVE_FROM, RESERVE_UNTIL, SNAPSHOT, T1_PREMATURE_SQL, labelled_sql

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
GAP_FROM, GAP_UNTIL = dt.date(1997, 3, 1), dt.date(1997, 3, 20)
WINDOWS = (Period("w0", dt.datetime(1995, 1, 10), dt.datetime(1995, 1, 12)), *PERIODS)
OVERLAPPING = (Period("v1", dt.datetime(1998, 1, 1), dt.datetime(1998, 7, 15)), *PERIODS[1:])
WINDOW_DAYS, EXPECTED, TOLERANCE, DEGENERATE = (1.0, 30.0), 0.9, 0.02, 0.45
#: From when on many events come in time, and fewer with each half year until the reserve begins.
EARLY, LATER, LATEST = dt.datetime(1998, 1, 1), dt.datetime(1998, 7, 1), dt.datetime(1999, 1, 1)


def defective(spark: SparkSession, d: str) -> DataFrame:
    rows = tables.t1(spark, d, premature=True)
    last = rows.agg(F.max("decided_at").alias("last"))
    key, at = F.col("o_orderkey"), F.col("decided_at")
    since = lambda t: at >= F.lit(t).cast("timestamp_ntz")
    rows = rows.where((F.to_date("decided_at") < F.lit(GAP_FROM)) | (F.to_date("decided_at") >= F.lit(GAP_UNTIL)))
    rows = rows.crossJoin(F.broadcast(last)).where((F.datediff("last", "decided_at") > 13) | (key % 5 == 0)).drop("last")  # one row
    late = ((F.col("reason") == "1-URGENT") & (key % 8 < 6)) | (since(LATER) & (key % 4 < 2)) | (since(LATEST) & (key % 4 < 3))
    lost = (key % 4 == 0) | (F.date_trunc("month", "decided_at") == F.lit(dt.datetime(1998, 2, 1)).cast("timestamp_ntz"))
    shift = F.when(late, F.expr("INTERVAL 4000 DAYS")).otherwise(F.expr("INTERVAL 0 DAYS"))
    early = (since(EARLY) & ~since(LATER) & (key % 8 < 4)) | (since(LATER) & ~since(LATEST) & (key % 8 < 2)) | (since(RESERVE_FROM) & (key % 8 == 5))
    rows = rows.withColumn("event_at", F.when(~lost, F.when(early, at + F.expr("INTERVAL 30 DAYS")).otherwise(F.col("event_at") + shift)))
    within = F.coalesce((F.col("event_at") <= F.col("deadline_on")).cast("double"), F.lit(0.0))
    rows = rows.withColumns({
        "o_totalprice": F.when(F.col("status") != "P", F.col("o_totalprice")), "reason": F.when(F.col("reason") == "5-LOW", "-").otherwise(F.col("reason")),
        "leak": within + (key % 10) / 100, "verdict": F.when(within == 1, "good").when(key % 9 == 0, "odd").otherwise("bad"),
        "flips": within * F.when(since(LATER), -1).otherwise(1) + (key % 5) / 3, "moving": F.datediff(at, F.lit(dt.date(1992, 1, 1))).cast("double") + key % 7,
        "measured_on": at - F.make_dt_interval((key % 40).cast("int")), "extra": F.lit(1),
    })
    rows = rows.withColumn("reported_on", F.col("measured_on") + F.make_dt_interval(F.when(key % 4 == 1, 3).otherwise(0)))
    # not a union, which would make all rows twice
    return rows.withColumn("_copy", F.explode(F.when(key % 50 == 0, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))).drop("_copy")


KNOWN = {"availability": Availability.AT_DECISION, "source": "order form"}


def schema() -> Schema:
    number = lambda n, **more: ColumnSpec(n, Role.FEATURE, **(KNOWN | {"value_as_of": "decided_at"} | more))
    return Schema((
        ColumnSpec("o_orderkey", Role.ENTITY_ID), ColumnSpec("o_custkey", Role.NATURAL_KEY), ColumnSpec("decided_at", Role.DECISION_TIME, Grain.INSTANT), ColumnSpec("deadline_on", Role.DEADLINE, Grain.INSTANT),
        ColumnSpec("event_at", Role.OUTCOME_COMPONENT), ColumnSpec("status", Role.STATUS), ColumnSpec("kind", Role.EVENT_KIND), ColumnSpec("reason", Role.OBSERVATION_REASON), ColumnSpec("c_mktsegment", Role.GROUP_ID),
        ColumnSpec("c_nationkey", Role.FEATURE, availability=Availability.AFTER, source="customer file"), ColumnSpec("measured_on", Role.MEASURED_AT, Grain.INSTANT), ColumnSpec("reported_on", Role.AVAILABLE_AT, Grain.INSTANT),
        number("o_totalprice", value_as_of="event_at"), number("c_acctbal", measured_at="measured_on", window_days=WINDOW_DAYS, clock="measured_on"), number("leak", direction=-1, value_as_of=None, window_days=(0.0, 10.0)),
        number("verdict"), number("flips"), number("moving"),
    ))


def wrong_schema() -> Schema:
    """Declares the deadline as a feature of days, no status, and no windows of most features."""
    changed = {
        "deadline_on": ColumnSpec("deadline_on", Role.FEATURE, Grain.DATE, **KNOWN), "event_at": ColumnSpec("event_at", Role.OUTCOME_COMPONENT, Grain.INSTANT), "status": ColumnSpec("status", Role.IGNORED),
        "c_acctbal": ColumnSpec("c_acctbal", Role.FEATURE, **KNOWN, measured_at="measured_on", window_days=(1.0, 200.0)),
        "c_nationkey": ColumnSpec("c_nationkey", Role.FEATURE, availability=Availability.UNKNOWN), "verdict": ColumnSpec("verdict", Role.IGNORED),
    }
    return Schema(tuple(changed.get(c.name, c) for c in schema().columns))


_written: dict[tuple[str, str], str] = {}
_reports: dict[tuple[str, str, str], Report] = {}
_OUTCOME = tables.outcome(expected_rate=EXPECTED, tolerance=TOLERANCE, degenerate_below=DEGENERATE)


def labelled(spark: SparkSession, d: str) -> DataFrame:
    """The rows with their labels, which don't depend on what else an audit declares, from the place where they are written."""
    key = (spark.sparkContext.applicationId, d)
    if key not in _written:
        made = label.label_columns(_OUTCOME, "decided_at", F.lit(SNAPSHOT).cast("timestamp_ntz"), "status", "kind")
        defective(spark, d).withColumns(made | {label.KNOWN_AT: label.known_at(_OUTCOME)}).write.parquet(path := place(spark, "audit"))
        _written[key] = path
    return spark.read.parquet(_written[key])


def report(spark: SparkSession, d: str, wrong: bool = False) -> Report:
    key = (spark.sparkContext.applicationId, d, str(wrong))
    if key not in _reports:
        out = dataclasses.replace(_OUTCOME, recurring=wrong)
        rows = labelled(spark, d)
        if wrong:
            task = Task(has_process=True, is_stream=True, competing=True, simultaneous=Simultaneous.NOT_POSSIBLE, simultaneous_kind="R")
            _reports[key] = audit(split.Split(rows, "decided_at", OVERLAPPING), wrong_schema(), out, task, keep=False)
        else:
            parts = split.Split(rows, "decided_at", WINDOWS, RESERVE_FROM, RESERVE_UNTIL)
            _reports[key] = audit(parts, schema(), out, Task(has_process=True, is_stream=True), keep=False)
    return _reports[key]


def _values(windows) -> str:
    return ", ".join(f"('{w.name}', TIMESTAMP '{w.start}', TIMESTAMP '{w.stop}')" for w in windows)


def _declared(s: Schema) -> str:
    """The declarations as rows of SQL."""
    text = lambda v: "NULL" if v is None else f"'{v}'"
    rows = (
        f"({text(c.name)}, {text(c.role.value)}, {c.grain.value if c.grain else 'NULL'}, {text(c.availability.value if c.availability else None)}, {c.window_days[1] if c.window_days else 'NULL'}, {text(c.clock)}, {text(c.value_as_of)})"
        for c in s.columns
    )
    return f"declared(name, role, grain, availability, lookback, clock, as_of) AS (VALUES {', '.join(rows)})"


def _tagged(windows: str, seen: str) -> str:
    return f"""w(w, start, stop) AS (VALUES {windows}),
t AS (SELECT w, 'train' AS side, start, l.* FROM l, w WHERE {seen} AND label IS NOT NULL AND known_at < start UNION ALL SELECT w, 'evaluate', start, l.* FROM l, w WHERE {seen} AND decided_at >= start AND decided_at < stop)"""


_OLD = f"(decided_at::DATE < DATE '{GAP_FROM}' OR decided_at::DATE >= DATE '{GAP_UNTIL}')"
_LATE = f"(reason = '1-URGENT' AND o_orderkey % 8 < 6) OR (decided_at >= TIMESTAMP '{LATER}' AND o_orderkey % 4 < 2) OR (decided_at >= TIMESTAMP '{LATEST}' AND o_orderkey % 4 < 3)"
_EARLY = (
    f"(decided_at >= TIMESTAMP '{EARLY}' AND decided_at < TIMESTAMP '{LATER}' AND o_orderkey % 8 < 4) OR (decided_at >= TIMESTAMP '{LATER}' AND decided_at < TIMESTAMP '{LATEST}' AND o_orderkey % 8 < 2)"
    f" OR (decided_at >= TIMESTAMP '{RESERVE_FROM}' AND o_orderkey % 8 = 5)"
)
_STRINGS = ("status", "kind", "reason", "c_mktsegment", "verdict")
_SEEN = f"decided_at < TIMESTAMP '{RESERVE_FROM}'"
_RESERVED = f"decided_at >= TIMESTAMP '{RESERVE_FROM}' AND decided_at < TIMESTAMP '{RESERVE_UNTIL}'"
_NUMBERS = ("o_totalprice", "c_acctbal", "leak", "flips", "moving")
_AUC = "(sum(rk * y) - sum(y) * (sum(y) + 1) / 2.0) / nullif(sum(y) * (count(*) - sum(y)), 0) - 0.5"
_ROWS = f"""{T1_PREMATURE_SQL.replace("t1 AS", "t0 AS")},
t01 AS (SELECT * REPLACE (CASE WHEN NOT (o_orderkey % 4 = 0 OR date_trunc('month', decided_at) = TIMESTAMP '1998-02-01') THEN CASE WHEN {_EARLY} THEN decided_at + to_days(30) ELSE event_at + to_days(CASE WHEN {_LATE} THEN 4000 ELSE 0 END) END END AS event_at,
  CASE WHEN status <> 'P' THEN o_totalprice END AS o_totalprice, CASE WHEN reason = '5-LOW' THEN '-' ELSE reason END AS reason) FROM t0 WHERE {_OLD} AND (decided_at::DATE < (SELECT max(decided_at) FROM t0)::DATE - 13 OR o_orderkey % 5 = 0)),
t02 AS (SELECT *, coalesce((event_at <= deadline_on)::INT, 0) AS within FROM t01),
t03 AS (SELECT * EXCLUDE (within), within + (o_orderkey % 10) / 100.0 AS leak, CASE WHEN within = 1 THEN 'good' WHEN o_orderkey % 9 = 0 THEN 'odd' ELSE 'bad' END AS verdict,
  within * CASE WHEN decided_at >= TIMESTAMP '{LATER}' THEN -1 ELSE 1 END + (o_orderkey % 5)::DOUBLE / 3 AS flips, (decided_at::DATE - DATE '1992-01-01')::DOUBLE + o_orderkey % 7 AS moving,
  decided_at - to_days((o_orderkey % 40)::INT) AS measured_on, 1 AS extra FROM t02),
t04 AS (SELECT *, measured_on + to_days(CASE WHEN o_orderkey % 4 = 1 THEN 3 ELSE 0 END) AS reported_on FROM t03),
t1 AS (SELECT * FROM t04 UNION ALL SELECT * FROM t04 WHERE o_orderkey % 50 = 0), {labelled_sql()}"""
WITH = f"""WITH {_ROWS}, {_declared(schema())},
{_tagged(_values(WINDOWS), _SEEN)},
n AS (SELECT count(*) AS n, count(label) AS k, avg(label) AS rate, count(*) FILTER (label IS NULL AND reason_of <> 'immature') AS gone FROM l),
e AS (SELECT w, count(label) AS k, coalesce(sum(label), 0) AS p, count(*) AS n, count(*) FILTER (reason_of = 'immature') AS late FROM t WHERE side = 'evaluate' GROUP BY w),
v AS (SELECT 'reserve' AS w, count(label) AS k, coalesce(sum(label), 0) AS p, count(*) AS n, count(*) FILTER (reason_of = 'immature') AS late FROM l WHERE {_RESERVED}),
days AS (SELECT decided_at::DATE AS day, count(*) AS n FROM l GROUP BY 1),
f AS ({" UNION ALL ".join(f"SELECT '{c}' AS feature, {c}::DOUBLE AS value, label, (label IS NOT NULL)::INT AS seen, status FROM l" for c in _NUMBERS)}),
q AS (SELECT 'pooled' AS part, feature, value, label AS y FROM f WHERE label IS NOT NULL UNION ALL SELECT 'seen', feature, value, seen FROM f
  UNION ALL SELECT 'pooled', 'verdict', avg(label) OVER (PARTITION BY verdict), label FROM l WHERE label IS NOT NULL UNION ALL SELECT 'seen', 'verdict', avg((label IS NOT NULL)::INT) OVER (PARTITION BY verdict), (label IS NOT NULL)::INT FROM l
  UNION ALL {" UNION ALL ".join(f"SELECT w, '{c}', {c}::DOUBLE, label FROM t WHERE side = 'evaluate' AND label IS NOT NULL" for c in _NUMBERS)}),
ranked AS (SELECT *, rank() OVER (PARTITION BY part, feature ORDER BY value) + (count(*) OVER (PARTITION BY part, feature, value) - 1) / 2.0 AS rk FROM q WHERE value IS NOT NULL),
links AS (SELECT part, feature, count(*) AS n, sum(y) AS p, CASE WHEN count(*) >= 50 AND count(DISTINCT value) > 1 THEN {_AUC} END AS a FROM ranked GROUP BY 1, 2),
a AS (SELECT * FROM links WHERE part = 'pooled' AND a IS NOT NULL), s AS (SELECT * FROM links WHERE part = 'seen' AND a IS NOT NULL),
span AS (SELECT feature, w, quantile_cont(value, 0.05) AS lo, quantile_cont(value, 0.95) AS hi FROM ({" UNION ALL ".join(f"SELECT w, '{c}' AS feature, {c}::DOUBLE AS value FROM t WHERE side = 'evaluate'" for c in _NUMBERS)}) WHERE value IS NOT NULL GROUP BY 1, 2 HAVING count(*) >= 100),
apart AS (SELECT feature, CASE WHEN narrow > 0 THEN greatest(0, common) / narrow ELSE (common >= 0)::INT END AS share FROM (SELECT feature, min(hi - lo) AS narrow, min(hi) - max(lo) AS common FROM span GROUP BY 1 HAVING count(*) >= 2)),
r AS (SELECT w, p / k::DOUBLE AS x, k AS n, p, row_number() OVER (ORDER BY w) AS i FROM e WHERE k >= 100)
"""
WRONG = f"""WITH {_ROWS}, {_declared(wrong_schema())}, {_tagged(_values(OVERLAPPING), "true")}
"""
_NONE = "NULL::VARCHAR"


def _error(rate: str, n: str) -> str:
    return f"sqrt({rate} * (1 - {rate}) / {n})"


def _apart(a: str, n: str, b: str, m: str) -> str:
    """Two rates that three standard errors tell apart."""
    return f"abs({a} - {b}) > 3 * sqrt(pow({_error(a, n)}, 2) + pow({_error(b, m)}, 2))"


def requirement(name: str, sql: str, wrong: bool = False, subjects: tuple[str, ...] = (), also: str = "") -> None:
    """Registers the query of a requirement: (finding, subject, blocking, value, second), the last two being the finding's first
    two figures; ``sql`` may leave out the second.  ``subjects`` are those asked for under another name (``also``)."""

    def ask(spark: SparkSession, d: str) -> DataFrame:
        rows = []
        for x in report(spark, d, wrong).findings:
            if x.requirement == name and (not subjects or x.subject in subjects):
                figures = [round(float(v), 6) for v in x.metrics.values()][:2]
                rows.append((x.finding, x.subject, x.blocking, *figures, *[None] * (2 - len(figures))))
        return spark.createDataFrame(rows, "finding string, subject string, blocking boolean, value double, second double")

    key = f"check_{name.lower()}{also}"
    QUERIES[key] = ask
    five = "SELECT * FROM" if "/*two*/" in sql else "SELECT *, NULL FROM"
    ORACLE[key] = f"{WRONG if wrong else WITH} SELECT finding, subject, blocking, round(value, 6)::DOUBLE AS value, round(second, 6)::DOUBLE AS second FROM ({five} ({sql})) r(finding, subject, blocking, value, second)"


# --- what is declared -------------------------------------------------------------------------------------------------

_TIMES = "(SELECT e.grain AS e, d.grain AS d FROM declared e, declared d WHERE e.name = 'event_at' AND d.name = 'deadline_on')"
requirement("A10", f"SELECT 'mixed_temporal_grain', {_NONE}, true, NULL FROM {_TIMES} WHERE e <> d", wrong=True)
requirement("A10b", "SELECT 'missing_temporal_grain', name, true, NULL FROM declared WHERE name IN ('event_at', 'deadline_on') AND grain IS NULL")
requirement("C1", "SELECT 'feature_after_decision', name, true, NULL FROM declared WHERE role = 'feature' AND availability = 'after'")
requirement("C2", "SELECT 'unknown_availability', name, false, NULL FROM declared WHERE role = 'feature' AND coalesce(availability, 'unknown') = 'unknown'", wrong=True)
requirement("C6", "SELECT 'outcome_component_as_feature', name, true, NULL FROM declared WHERE name IN ('event_at', 'deadline_on') AND role = 'feature'", wrong=True)
requirement("S8", "SELECT 'undeclared_column', k, true, NULL FROM (SELECT unnest(json_keys(to_json(x))) AS k FROM (SELECT * EXCLUDE (label, reason_of, known_at) FROM l LIMIT 1) x) WHERE k NOT IN (SELECT name FROM declared)")
requirement("P10", "SELECT 'windows_overlap', w, true, NULL FROM (SELECT *, lead(start) OVER (ORDER BY start, stop) AS nxt FROM w) WHERE nxt < stop", wrong=True)

# --- rows and periods -------------------------------------------------------------------------------------------------

requirement("A2", f"SELECT 'surrogate_entity', {_NONE}, true, NULL FROM l HAVING count(DISTINCT o_custkey) < count(DISTINCT o_orderkey)")
requirement("A3", f"SELECT 'duplicate_rows', {_NONE}, false, count(*) - count(DISTINCT o_orderkey) FROM l HAVING count(*) > count(DISTINCT o_orderkey)")
requirement(
    "A5",
    """SELECT 'status_conflicts_with_event', status, false, 1 - count(event_at)::DOUBLE / count(*) FROM l WHERE status IS NOT NULL
    GROUP BY status HAVING count(event_at) BETWEEN 1 AND count(*) - 1""",
)
requirement(
    "A6",
    f"""SELECT 'truncated_tail', {_NONE}, false, tail / usual FROM (SELECT sum(n) FILTER (day > last - 14) / 14.0 AS tail, median(n) FILTER (day <= last - 14) AS usual, count(*) AS k
    FROM days, (SELECT max(day) AS last FROM days)) WHERE k >= 42 AND tail < 0.35 * usual""",
)
requirement("A7", "SELECT 'missing_period', day::VARCHAR, false, nxt - day - 1 FROM (SELECT day, lead(day) OVER (ORDER BY day) AS nxt FROM days) WHERE nxt - day - 1 >= 7")
requirement(
    "A11",
    """SELECT 'missing_by_status', feature, false, top / every FROM (SELECT feature, max(g)::DOUBLE AS top, sum(g)::DOUBLE AS every, arg_max(n, g)::DOUBLE AS size
    FROM (SELECT feature, status, count(*) AS n, count(*) - count(value) AS g FROM f GROUP BY 1, 2) GROUP BY 1), n
    WHERE every >= 30 AND top / every >= 0.8 AND top / every > 1.5 * size / n.n""",
)
requirement("A12", "SELECT 'immature_labels', w, true, late::DOUBLE / n FROM (SELECT * FROM e UNION ALL SELECT * FROM v) WHERE n > 0 AND late::DOUBLE / n >= 0.01")
requirement(
    "A13",
    f"""/*two*/ SELECT 'event_before_decision', {_NONE}, true, count(*), max(floor(epoch(decided_at - event_at) / 86400)) FROM l WHERE event_at < decided_at HAVING count(*) > 0
    UNION ALL SELECT 'event_at_decision', {_NONE}, false, count(*), NULL FROM l WHERE event_at = decided_at HAVING count(*) > 0""",
)
_list = ", ".join(f"'{x}'" for x in SENTINELS)
requirement("A14", " UNION ALL ".join(f"SELECT 'sentinel_as_value', '{c}', true, count(*) FROM l WHERE {c} IN ({_list}) HAVING count(*) > 0" for c in _STRINGS))
requirement(
    "S6",
    f"""SELECT 'premise_contradicted', 'process', true, NULL FROM declared HAVING count(*) FILTER (role = 'status') = 0
    UNION ALL SELECT 'premise_contradicted', 'stream', true, NULL FROM (SELECT list(gap ORDER BY gap) AS gaps, median(gap) AS usual FROM (SELECT day - lag(day) OVER (ORDER BY day) AS gap
    FROM (SELECT DISTINCT decided_at::DATE AS day FROM l)) WHERE gap IS NOT NULL) WHERE len(gaps) >= 3 AND gaps[round_even(0.9 * (len(gaps) - 1), 0)::INT + 1] > 3 * usual""",
    wrong=True,
)

# --- clocks and windows of features -----------------------------------------------------------------------------------

_AGE = "(SELECT epoch(decided_at - measured_on) / 86400 AS age FROM l)"
requirement(
    "S7",
    f"""/*two*/ SELECT 'measured_too_new', 'c_acctbal', true, count(*), max({WINDOW_DAYS[0]} - age) FROM {_AGE} WHERE age < {WINDOW_DAYS[0]} HAVING count(*) > 0
    UNION ALL SELECT 'measured_too_old', 'c_acctbal', true, count(*), max(age - {WINDOW_DAYS[1]}) FROM {_AGE} WHERE age > {WINDOW_DAYS[1]} HAVING count(*) > 0""",
)
_USABLE = "role = 'feature' AND availability = 'at_decision'"
requirement(
    "S9",
    f"""SELECT 'window_clock_undeclared', name, true, NULL FROM declared WHERE {_USABLE} AND lookback > 0 AND clock IS NULL
    UNION ALL SELECT 'window_clock_unknowable', name, true, share FROM declared, (SELECT count(*) FILTER (measured_on < reported_on)::DOUBLE / count(*) AS share FROM l)
    WHERE {_USABLE} AND lookback > 0 AND clock = 'measured_on' AND share >= 0.05""",
)
requirement(
    "S10",
    f"""SELECT 'value_as_of_undeclared', name, true, NULL FROM declared WHERE (role = 'deadline' OR ({_USABLE})) AND as_of IS NULL
    UNION ALL SELECT 'value_revised_after_decision', name, true, share FROM declared, (SELECT count(*) FILTER (event_at > decided_at)::DOUBLE / count(*) AS share FROM l)
    WHERE (role = 'deadline' OR ({_USABLE})) AND as_of = 'event_at' AND share >= 0.05""",
)

# --- splits -----------------------------------------------------------------------------------------------------------

requirement("P5", f"SELECT 'no_reserve', {_NONE}, true, count(*) FROM l WHERE decided_at >= (SELECT max(stop) FROM w) HAVING count(*) > 0", wrong=True)
requirement("P8", "SELECT 'small_training_part', w.w, true, count(t.w) FROM w LEFT JOIN t ON t.w = w.w AND side = 'train' GROUP BY w.w HAVING count(t.w) < 100")
requirement(
    "P9",
    "SELECT 'small_evaluation_part', w, true, k FROM (SELECT w.w, coalesce(k, 0) AS k FROM w LEFT JOIN e ON e.w = w.w UNION ALL SELECT w, k FROM v) WHERE k < 100",
)
requirement("N2", "SELECT 'entity_overlap', w, true, count(*) FROM (SELECT w, o_custkey FROM t GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) GROUP BY w")
requirement(
    "N2i",
    f"""SELECT 'feature_window_undeclared', name, true, NULL FROM declared WHERE {_USABLE} AND lookback IS NULL
    UNION ALL SELECT 'feature_windows_overlap', w, true, count(*) FROM (SELECT w, o_custkey, max(decided_at) AS last FROM t WHERE side = 'train' GROUP BY 1, 2) x
    JOIN (SELECT w, o_custkey, decided_at FROM t WHERE side = 'evaluate') y USING (w, o_custkey) WHERE decided_at <= last + to_days((SELECT max(lookback) FROM declared)::INT) GROUP BY w""",
    wrong=True,
)
requirement(
    "N14",
    """/*two*/ SELECT 'group_overlap', w, true, count(*), sum(hit)::DOUBLE / max(n) FROM (SELECT w, c_mktsegment, count(*) FILTER (side = 'evaluate') AS hit FROM t WHERE c_mktsegment IS NOT NULL
    GROUP BY 1, 2 HAVING count(DISTINCT side) = 2) JOIN e USING (w) GROUP BY w""",
)

# --- outcomes ---------------------------------------------------------------------------------------------------------

_TREND = "(SELECT count(*) AS k, bool_and(x > prev) AS up, bool_and(x < prev) AS down, arg_min(x, i) AS a, arg_min(n, i) AS an, arg_max(x, i) AS b, arg_max(n, i) AS bn FROM (SELECT *, lag(x) OVER (ORDER BY i) AS prev FROM r))"
_RESERVE = "(SELECT k AS m, p::DOUBLE / nullif(k, 0) AS after FROM v)"
requirement(
    "N3",
    f"""/*two*/ SELECT 'reserve_rate_differs', 'reserve', true, whole, after FROM (SELECT sum(p)::DOUBLE / sum(n) AS whole, sum(n) AS n FROM r HAVING count(*) >= 2), {_RESERVE} WHERE m >= 100 AND {_apart("whole", "n", "after", "m")}
    UNION ALL SELECT 'rate_trend', CASE WHEN m < 100 THEN 'unknown' WHEN abs(after - b) <= 3 * {_error("after", "m")} THEN 'flat' WHEN (after > b) = up THEN 'continues' ELSE 'reverses' END, true, a, b
    FROM {_TREND}, {_RESERVE} WHERE k >= 3 AND (up OR down) AND {_apart("a", "an", "b", "bn")}
    UNION ALL SELECT 'rate_drift', {_NONE}, true, a, b FROM (SELECT min(x) AS a, arg_min(n, x) AS an, max(x) AS b, arg_max(n, x) AS bn FROM r HAVING count(*) >= 2) WHERE b > 0 AND (a = 0 OR b / a >= 1.5) AND {_apart("a", "an", "b", "bn")}""",
)
_LINKS = "(SELECT l.*, 0.29 / sqrt(least(l.p, l.n - l.p)) AS err FROM links l JOIN w ON l.part = w.w WHERE l.a IS NOT NULL AND l.n >= 100 AND l.feature NOT IN (SELECT feature FROM apart WHERE share < 0.5))"
_SIGNED = f"(SELECT feature, min(a) AS lo, arg_min(err, a) AS le, max(a) AS hi, arg_max(err, a) AS he, min(abs(a)) AS weak, arg_min(err, abs(a)) AS we, max(abs(a)) AS top, arg_max(err, abs(a)) AS te FROM {_LINKS} GROUP BY 1 HAVING count(*) >= 2)"
_FLIPS = "lo < 0 AND hi > 0 AND -lo >= greatest(0.05, 3 * le) AND hi >= greatest(0.05, 3 * he)"
requirement(
    "N4",
    f"""/*two*/ SELECT 'relation_flips', feature, true, lo, hi FROM {_SIGNED} WHERE {_FLIPS}
    UNION ALL SELECT 'relation_weakens', feature, true, weak, top FROM {_SIGNED} WHERE NOT ({_FLIPS}) AND top >= 0.15 AND (weak = 0 OR top / weak >= 3) AND top - weak >= 3 * sqrt(we * we + te * te)""",
)
requirement("N5", "SELECT 'disjoint_support', feature, true, share FROM apart WHERE share < 0.5")
requirement(
    "N6",
    """SELECT 'feature_separates_outcome', feature, true, abs(a) FROM (SELECT x.*, (SELECT median(abs(y.a)) FROM a y WHERE y.feature <> x.feature) AS typical FROM a x)
    WHERE abs(a) >= 0.35 AND (abs(a) >= 0.45 OR typical = 0 OR abs(a) >= 2.5 * typical)""",
)
requirement(
    "N6",
    "SELECT 'feature_separates_outcome', feature, true, abs(a) FROM a JOIN (SELECT count(*) AS every, count(DISTINCT verdict) AS levels FROM l WHERE label IS NOT NULL) ON every >= 50 * levels WHERE feature = 'verdict' AND abs(a) >= 0.45",
    subjects=("verdict",), also="_strings",
)
requirement("N8", "SELECT 'direction_contradicted', feature, true, a FROM a WHERE feature = 'leak' AND a > 0 AND a >= greatest(0.05, 3 * 0.29 / sqrt(least(p, n - p)))")
requirement("N12", f"SELECT 'kinds_collapsed', {_NONE}, true, count(DISTINCT kind) FROM l HAVING count(DISTINCT kind) >= 2")
requirement(
    "N12",
    f"""/*two*/ SELECT 'simultaneity_contradicted', 'R', true, NULL, NULL FROM l HAVING count(*) FILTER (kind = 'R') > 0
    UNION ALL SELECT 'kinds_at_one_instant', {_NONE}, true, count(*), sum(n) FROM (SELECT count(*) AS n FROM l WHERE event_at IS NOT NULL AND kind IS NOT NULL GROUP BY o_custkey, event_at HAVING count(DISTINCT kind) > 1) HAVING count(*) > 0""",
    wrong=True, also="_simultaneous",
)
requirement("N13", f"SELECT 'rate_not_expected', {_NONE}, true, rate FROM n WHERE abs(rate - {EXPECTED}) > {TOLERANCE}")
requirement("N15", f"SELECT 'degenerate_outcome', {_NONE}, true, rate FROM n WHERE rate < {DEGENERATE} OR rate > 1 - {DEGENERATE}")
requirement(
    "N16",
    f"""/*two*/ SELECT 'unobserved_share', {_NONE}, (SELECT count(*) > 0 FROM s WHERE abs(a) > greatest(0.10, 3 * 0.29 / sqrt(least(p, n - p)))), rate * (n - gone) / n, (rate * (n - gone) + gone) / n
    FROM n WHERE gone::DOUBLE / n >= 0.05""",
)
requirement(
    "N17",
    f"""/*two*/ SELECT 'rate_depends_on_reason', {_NONE}, true, a, b FROM (SELECT min(x) AS a, max(x) AS b, count(*) AS k, arg_min(n, x) AS n, arg_max(n, x) AS m
    FROM (SELECT reason, avg(label) AS x, count(*) AS n FROM l WHERE label IS NOT NULL GROUP BY 1 HAVING count(*) >= 100)) WHERE k >= 2 AND {_apart("a", "n", "b", "m")} AND (a = 0 OR b / a >= 1.5)""",
)
requirement(
    "N18",
    f"""/*two*/ SELECT 'event_recording_stops', {_NONE}, true, a, b FROM (SELECT min(x) AS a, max(x) AS b, count(*) AS k, arg_min(n, x) AS n, arg_max(n, x) AS m
    FROM (SELECT date_trunc('month', decided_at) AS mo, count(event_at) / count(*)::DOUBLE AS x, count(*) AS n FROM l WHERE reason_of <> 'immature' GROUP BY 1 HAVING count(*) >= 100))
    WHERE k >= 2 AND b - a >= greatest(0.25, 3 * sqrt(pow({_error("a", "n")}, 2) + pow({_error("b", "m")}, 2)))""",
)
