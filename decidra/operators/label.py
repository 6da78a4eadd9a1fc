"""Outcome labels with explicit censoring and immaturity, and the moment at which each became known.

A label is one projection: no row is moved.
"""

from __future__ import annotations

import datetime as dt

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from ..schema import Comparison, DeclarationError, Missing, Outcome, Positive, Role, Schema, validate_outcome

LABEL, REASON, KNOWN_AT = "__outcome", "__outcome_reason", "__label_known_at"
OBSERVED, IMMATURE, EXCLUDED, CENSORED, CONFLATED, BEFORE_DECISION = "observed", "immature", "excluded", "censored", "conflated", "before_decision"


def snapshot_of(df: DataFrame, outcome: Outcome, decision: str) -> dt.datetime:
    """The last observed event, or else the last decision."""
    got = df.agg(F.max(outcome.event).alias("e"), F.max(decision).alias("d")).first()
    return got.e if got.e is not None else got.d


def unknown_statuses(df: DataFrame, outcome: Outcome, status: str) -> list[str]:
    """Statuses of rows without an event that no declared cause names."""
    rows = df.where(F.col(outcome.event).isNull() & F.col(status).isNotNull())
    known = list(outcome.by_status())
    rest = rows.where(~F.col(status).isin(*known)) if known else rows
    return sorted(r[0] for r in rest.select(status).distinct().limit(100).collect())


def _sides(outcome: Outcome) -> tuple[Column, Column]:
    event, deadline = F.col(outcome.event), F.col(outcome.deadline)
    return (F.to_date(event), F.to_date(deadline)) if outcome.comparison is Comparison.BY_DATE else (event, deadline)


def label_columns(outcome: Outcome, decision: str, snapshot: Column, status: str | None = None, kind: str | None = None) -> dict[str, Column]:
    """The label (0, 1 or null) and its reason as expressions."""
    event, deadline = _sides(outcome)
    horizon = F.to_date(snapshot) if outcome.comparison is Comparison.BY_DATE else snapshot
    after = outcome.positive is Positive.AFTER
    none, one = F.lit(None).cast("int"), (lambda yes: F.when(yes, 1).when(~yes, 0))
    mature = deadline < horizon

    def label(meaning: Missing | None) -> Column:
        return F.when(mature, F.lit(int(after))) if meaning is Missing.NOT_OCCURRED else none

    def reason(meaning: Missing | None) -> Column:
        if meaning is Missing.NOT_OCCURRED:
            return F.when(mature, OBSERVED).otherwise(IMMATURE)
        return F.lit({Missing.EXCLUDED: EXCLUDED, Missing.UNOBSERVED: CENSORED}.get(meaning, CONFLATED))

    missing_label, missing_reason = label(outcome.fallback()), reason(outcome.fallback())
    if status is not None:
        for value, meaning in outcome.by_status().items():
            mine = F.col(status) == value
            missing_label, missing_reason = F.when(mine, label(meaning)).otherwise(missing_label), F.when(mine, reason(meaning)).otherwise(missing_reason)
    premature = F.col(outcome.event) < F.col(decision)
    absent = F.col(outcome.event).isNull()
    found = one(event > deadline if after else event <= deadline)
    value = F.when(premature, none).when(absent, missing_label).otherwise(found)
    why = F.when(premature, BEFORE_DECISION).when(absent, missing_reason).otherwise(OBSERVED)
    if kind is not None and outcome.primary_kind is not None:
        other = F.coalesce((F.col(kind) != outcome.primary_kind) & (F.col(outcome.event) <= F.col(outcome.deadline)), F.lit(False))
        value, why = F.when(~other, value), F.when(other, CENSORED).otherwise(why)
    return {LABEL: value, REASON: why}


def known_at(outcome: Outcome) -> Column:
    """The event if it came in time, else the moment at which the deadline had passed."""
    event, deadline = _sides(outcome)
    passed = F.col(outcome.deadline)
    if outcome.comparison is Comparison.BY_DATE:
        passed = F.date_add(F.to_date(passed), 1).cast("timestamp_ntz")
    return F.when(event <= deadline, F.col(outcome.event)).otherwise(passed)


def compute(df: DataFrame, outcome: Outcome, schema: Schema, snapshot: dt.datetime | None = None) -> DataFrame:
    """``df`` with label, reason and the moment of knowledge; declared statuses and kinds are checked first."""
    validate_outcome(outcome, schema)
    decision, status, kind = schema.decision_time, schema.one(Role.STATUS), schema.one(Role.EVENT_KIND)
    if status is not None and (unknown := unknown_statuses(df, outcome, status)):
        raise DeclarationError(f"what a missing event means isn't declared for the statuses {unknown}")
    if outcome.primary_kind is not None:
        if kind is None:
            raise DeclarationError("a primary kind is declared, but no column of kinds")
        if not df.where(F.col(kind) == outcome.primary_kind).limit(1).count():
            raise DeclarationError(f"the primary kind {outcome.primary_kind!r} isn't in the data")
    moment = snapshot if snapshot is not None else snapshot_of(df, outcome, decision)
    made = label_columns(outcome, decision, F.lit(moment).cast("timestamp_ntz"), status, kind)
    return df.withColumns(made | {KNOWN_AT: known_at(outcome)})


def by_kind(df: DataFrame, outcome: Outcome, decision: str, kind: str, kinds: list[str], snapshot: dt.datetime, status: str | None = None) -> DataFrame:
    """(kind, rows, labelled, positives, censored_by_others): competing kinds in one pass, each as the primary one."""
    from dataclasses import replace

    moment, parts = F.lit(snapshot).cast("timestamp_ntz"), []
    for k in kinds:
        made = label_columns(replace(outcome, primary_kind=k), decision, moment, status, kind)
        others = F.coalesce((F.col(kind) != k) & (F.col(outcome.event) <= F.col(outcome.deadline)), F.lit(False))
        parts.append(F.struct(F.lit(k).alias("kind"), made[LABEL].alias("label"), others.alias("others")))
    rows = df.select(F.inline(F.array(*parts)))
    return rows.groupBy("kind").agg(F.count("*").alias("rows"), F.count("label").alias("labelled"), F.coalesce(F.sum("label"), F.lit(0)).cast("long").alias("positives"), F.count_if(F.col("others")).alias("censored_by_others"))


def cause_bounds(df: DataFrame, outcome: Outcome, decision: str, snapshot: Column, status: str | None = None) -> DataFrame:
    """(class, rows, meanings, conflated, low, high): for each class of causes that a status can tell apart, the rows without
    an event in it, and between which rates the truth lies if only these rows are added to those with an event.

    A row that may not have occurred counts as such if it is mature; one that may be unobserved, as either; one that may
    be excluded, as none.  The class without a status is named ``indistinguishable``; classes without rows stay out.
    """
    event, deadline = _sides(outcome)
    horizon = F.to_date(snapshot) if outcome.comparison is Comparison.BY_DATE else snapshot
    after = outcome.positive is Positive.AFTER
    shown = [c.status for c in outcome.distinguishable]
    name = F.lit("indistinguishable")
    if status is not None and shown:
        name = F.when(F.col(status).isin(*shown), F.col(status)).otherwise(name)
    found = F.when(F.col(outcome.event).isNotNull() & ~F.coalesce(F.col(outcome.event) < F.col(decision), F.lit(False)), (event > deadline if after else event <= deadline).cast("int"))
    rows = df.select(F.when(F.col(outcome.event).isNull(), name).alias("class"), F.coalesce(deadline < horizon, F.lit(False)).alias("mature"), found.alias("y"))
    by = rows.groupBy("class").agg(F.count("*").alias("rows"), F.count_if("mature").alias("mature"), F.count("y").alias("n"), F.coalesce(F.sum("y"), F.lit(0)).alias("p"))
    known = by.where("class IS NULL").agg(F.coalesce(F.sum("n"), F.lit(0)).alias("_n"), F.coalesce(F.sum("p"), F.lit(0)).alias("_p"))  # one row
    gone = by.where("class IS NOT NULL").crossJoin(F.broadcast(known))
    # of a class: rows that a negative, and that a positive label may be given to, and those that are in the population in either case
    low, high, meanings = F.lit(None).cast("double"), F.lit(None).cast("double"), F.lit(None).cast("array<string>")
    for value, causes in outcome.classes().items():
        mine = F.col("class") == ("indistinguishable" if value is None else value)
        means = {c.meaning for c in causes}
        either = Missing.UNOBSERVED in means
        only = means == {Missing.NOT_OCCURRED}
        may_no, may_yes = either or (Missing.NOT_OCCURRED in means and not after), either or (Missing.NOT_OCCURRED in means and after)
        m = F.col("rows") if either else F.col("mature")
        zero = F.lit(0)
        must = m if only else zero
        noes, yeses = (m if may_no else zero), (m if may_yes else zero)
        at_least = (F.col("_p") + (must if not may_no else zero)) / F.nullif(F.col("_n") + (noes if may_no else must), zero)
        at_most = (F.col("_p") + yeses) / F.nullif(F.col("_n") + (yeses if may_yes else must), zero)
        low, high = F.when(mine, at_least).otherwise(low), F.when(mine, at_most).otherwise(high)
        meanings = F.when(mine, F.array(*(F.lit(x.value) for x in sorted(means, key=lambda x: x.value)))).otherwise(meanings)
    return gone.select("class", "rows", meanings.alias("meanings"), (F.size(meanings) > 1).alias("conflated"), low.alias("low"), high.alias("high"))
