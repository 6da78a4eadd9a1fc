"""Measurement against rules and other models.  Samples come from the ledger (:mod:`.ledger`).

Every measurement asks what the model was fitted on, and spends its samples by one act, after all checks.
"""

from __future__ import annotations

from collections.abc import Iterator, Mapping, Sequence
from contextlib import contextmanager
from dataclasses import dataclass
from fractions import Fraction

import numpy as np
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, ByteType, DataType, DoubleType, FloatType, IntegerType, LongType, ShortType

from .functions.bootstrap import ORDERED, Loss, bootstrapped
from .ledger import Blocked, External, Fit, OverrideLedger, Purpose, SampleLedger, known_before
from .operators.label import LABEL

#: Draws, seed and level of bootstrap intervals.
DRAWS, SEED, LEVEL = 400, 20260101, 0.95


@dataclass(frozen=True)
class Rule:
    """A baseline: a constant, or a feature above or below a threshold."""

    constant: float | None = None
    feature: str | None = None
    threshold: float | None = None
    above: bool = True

    def score(self):
        if self.constant is not None:
            return F.lit(float(self.constant))
        x = F.col(self.feature)
        return (x > self.threshold if self.above else x < self.threshold).cast("double")


@dataclass(frozen=True)
class Costs:
    """What a needless action and a missed one cost."""

    false_positive: Fraction
    false_negative: Fraction

    @property
    def threshold(self) -> float:
        return float(self.false_positive / (self.false_positive + self.false_negative))


#: Metrics of which the smaller value is better.
ERRORS = ("ece", "brier", "log_loss")


@dataclass(frozen=True)
class Comparison:
    metric: str
    model: float
    rule: float
    low: float
    high: float

    @property
    def difference(self) -> float:
        return self.model - self.rule

    @property
    def decisive(self) -> bool:
        return self.low > 0 or self.high < 0

    @property
    def better(self) -> bool:
        """Whether the model decisively beats the rule; of errors the smaller one is better."""
        return self.high < 0 if self.metric in ERRORS else self.low > 0

    def statement(self) -> str:
        side = "can't be told from the rule" if not self.decisive else "is better than the rule" if self.better else "is worse than the rule"
        return f"{self.metric}: {self.model:.4f} against {self.rule:.4f}, difference [{self.low:+.4f}; {self.high:+.4f}]: the model {side}"


@dataclass(frozen=True)
class Unmeasured:
    metric: str
    reason: str


ALLOWED: tuple[type[DataType], ...] = (BooleanType, ByteType, ShortType, IntegerType, LongType, FloatType, DoubleType)


def gate(df: DataFrame, score: str, label: str) -> DataFrame:
    """Score and label as doubles and ints; refuses other types, labels that aren't 0 or 1, and scores that lose digits."""
    kinds = {f.name: f.dataType for f in df.schema.fields}
    for c in (score, label):
        if not isinstance(kinds[c], ALLOWED):
            raise Blocked(f"{c} is {kinds[c].simpleString()}")
    whole = isinstance(kinds[score], LongType)
    bad = df.agg(F.count_if(F.col(label).isNotNull() & ~F.col(label).cast("double").isin(0.0, 1.0)).alias("label"), F.count_if(F.abs(F.col(score).cast("double")) > 2.0**53).alias("large")).first()
    if bad.label:
        raise Blocked(f"{bad.label} labels aren't 0 or 1")
    if whole and bad.large:
        raise Blocked("scores lose digits as doubles")
    return df.withColumns({score: F.col(score).cast("double"), label: F.col(label).cast("int")})


def paired_all(df: DataFrame, model: str, rule: str, label: str, metrics: Sequence[str], costs: Costs | None = None, draws: int = DRAWS, seed: int = SEED, own: Mapping[str, Loss] | None = None) -> list[Comparison | Unmeasured]:
    """Metrics of two scores of the same rows with paired percentile intervals, from the same draws (:mod:`.functions.bootstrap`).

    ``own`` names losses of one's own, functions of scores and labels whose mean is a metric like any other."""
    m, r, y = F.col(model), F.col(rule), F.col(label)
    rows = df.where(y.isNotNull())
    odd = lambda c: c.isNull() | F.isnan(c) | (F.abs(c) == float("inf"))
    about = rows.agg(F.count_if(odd(m) | odd(r)).alias("bad"), F.count("*").alias("n"), F.min(y).alias("lo"), F.max(y).alias("hi"), F.least(F.min(m), F.min(r)).alias("least"), F.greatest(F.max(m), F.max(r)).alias("most")).first()
    why = {}
    for metric in metrics:
        if not about.n:
            why[metric] = "no rows"
        elif about.bad:
            why[metric] = f"{about.bad} scores aren't finite"
        elif metric in ORDERED and about.lo == about.hi:
            why[metric] = "a single class"
        elif metric in ("brier", "log_loss") and not 0 <= about.least <= about.most <= 1:
            why[metric] = "scores aren't probabilities"
    wanted = [x for x in metrics if x not in why]
    got = bootstrapped(rows, model, rule, label, wanted, costs.threshold if costs else None, draws, seed, own=own) if wanted else {}
    out: list[Comparison | Unmeasured] = []
    for metric in metrics:
        if metric in why:
            out.append(Unmeasured(metric, why[metric]))
            continue
        v = got[metric]
        gaps = v.draws_model - v.draws_rule
        if not np.isfinite([v.model, v.rule]).all():
            out.append(Unmeasured(metric, "a sure score is wrong" if metric == "log_loss" else "it is undefined"))
        elif not np.isfinite(gaps).all():
            out.append(Unmeasured(metric, f"{int((~np.isfinite(gaps)).sum())} of {draws} draws leave it undefined"))
        else:
            low, high = np.quantile(gaps, [(1 - LEVEL) / 2, (1 + LEVEL) / 2])
            out.append(Comparison(metric, v.model, v.rule, float(low), float(high)))
    return out


def paired(df: DataFrame, model: str, rule: str, label: str, metric: str, costs: Costs | None = None, draws: int = DRAWS, seed: int = SEED) -> Comparison | Unmeasured:
    """:func:`paired_all` of one metric."""
    return paired_all(df, model, rule, label, [metric], costs, draws, seed)[0]


@dataclass(frozen=True)
class Verdict:
    rows: int
    comparisons: tuple[Comparison | Unmeasured, ...]

    def text(self) -> str:
        return "\n".join(c.statement() if isinstance(c, Comparison) else f"{c.metric}: not measured, {c.reason}" for c in self.comparisons)


def measure_against_baseline(ledger: SampleLedger, sample: str, scores: DataFrame, rule: Rule, trained_on: Fit | External, costs: Costs | None = None, draws: int = DRAWS) -> Verdict:
    """Measures external scores (unit, score) on a sample, which is spent by it; scores are joined by unit, not by place."""
    scored = {sample: _scored(ledger, sample, scores, "_a")}
    names = ["auc", "ece", "ap", "brier", "log_loss", *(["net_benefit"] if costs else [])]
    with _spent(ledger, {sample: trained_on}, scored) as spent:
        rows = spent[sample].withColumn("_rule", rule.score())
        return Verdict(rows.count(), tuple(paired_all(rows, "_a", "_rule", LABEL, names, costs, draws)))


def _scored(ledger: SampleLedger, sample: str, scores: DataFrame, name: str) -> DataFrame:
    """(unit, name) with types checked and one score for each unit."""
    unit = ledger.unit(sample)
    if unit is None:
        raise Blocked(f"P2: {sample} has no unit to join scores by", "P2")
    checked = gate(scores.withColumn("_one", F.lit(1)), "score", "_one")
    if scores.groupBy(unit).count().where("count > 1").limit(1).count():
        raise Blocked("a unit has several scores")
    return checked.select(unit, F.col("score").alias(name))


@contextmanager
def _spent(ledger: SampleLedger, trained_on: dict[str, Fit | External], *scored: dict[str, DataFrame], purpose: Purpose = Purpose.MEASUREMENT) -> Iterator[dict[str, DataFrame]]:
    """Observed rows of all samples with their scores.  Provenance and scores are checked for all before any is spent.

    Metrics read the rows many times, so they are kept on disk until the measurement is done."""
    for sample, fit in trained_on.items():
        if defects := ledger.provenance_defects(sample, fit):
            raise Blocked("; ".join(defects))
        observed = ledger._sample(sample).frame.where(F.col(LABEL).isNotNull())
        for s in scored:
            if observed.join(s[sample], ledger.unit(sample), "left_anti").limit(1).count():
                raise Blocked(f"observed units of {sample} have no score")
    external = [f"scores from elsewhere: {f.reason}" for f in trained_on.values() if isinstance(f, External)]
    frames = ledger.spend(trained_on, purpose, "; ".join(dict.fromkeys([f"{', '.join(trained_on)} against scores", *external])))
    out, kept = {}, []
    try:
        for sample, frame in frames.items():
            rows = frame.where(F.col(LABEL).isNotNull())
            for s in scored:
                rows = rows.join(s[sample], ledger.unit(sample))
            kept.append(rows.persist(StorageLevel.DISK_ONLY))
            out[sample] = gate(rows, "_a", LABEL)
        yield out
    finally:
        for rows in kept:
            rows.unpersist()


def measure_contrast(ledger: SampleLedger, sample: str, left: DataFrame, right: DataFrame, trained_on: tuple[Fit | External, Fit | External], metrics: Sequence[str] = ("auc", "brier"), draws: int = DRAWS) -> Verdict:
    """Two models' scores (unit, score) on the same rows of a sample, which one checkout spends."""
    if defects := ledger.provenance_defects(sample, trained_on[1]):
        raise Blocked("; ".join(defects))
    a, b = ({sample: _scored(ledger, sample, df, n)} for df, n in ((left, "_a"), (right, "_b")))
    with _spent(ledger, {sample: trained_on[0]}, a, b) as spent:
        rows = spent[sample]
        return Verdict(rows.count(), tuple(paired_all(rows, "_a", "_b", LABEL, metrics, draws=draws)))


@dataclass(frozen=True)
class Stability:
    windows: dict[str, Comparison | Unmeasured]

    @property
    def signs(self) -> set[int]:
        """The signs of decisive differences; one sign, or none, is stable."""
        return {1 if c.low > 0 else -1 for c in self.windows.values() if isinstance(c, Comparison) and c.decisive}

    @property
    def stable(self) -> bool:
        return len(self.signs) <= 1


def stability_across_windows(ledger: SampleLedger, predictions: dict[str, DataFrame], rule: Rule, trained_on: dict[str, Fit | External], metric: str = "auc", draws: int = DRAWS) -> Stability:
    """A metric against the rule in each window.  All windows are validated before any is spent, and they are spent for
    selection: what is chosen by them is measured on another sample."""
    missing = sorted(set(predictions) - set(trained_on))
    if missing:
        raise Blocked(f"what the models of {missing} were fitted on isn't named")
    scored = {sample: _scored(ledger, sample, scores, "_a") for sample, scores in predictions.items()}
    with _spent(ledger, {s: trained_on[s] for s in predictions}, scored, purpose=Purpose.SELECTION) as rows:
        return Stability({s: paired(df.withColumn("_rule", rule.score()), "_a", "_rule", LABEL, metric, draws=draws) for s, df in rows.items()})


__all__ = ["Blocked", "Comparison", "Costs", "External", "Fit", "OverrideLedger", "Purpose", "Rule", "SampleLedger", "Stability", "Unmeasured", "Verdict", "gate", "known_before", "measure_against_baseline", "measure_contrast", "paired", "paired_all", "stability_across_windows"]
