"""What checks ask of a table, as fragments of plans, and the few passes that answer all of them.

A check declares *needs*: sums over all rows, sums by a facet (a day, a status), keys to be counted and met between windows,
and features to be ranked against labels.  The needs of all checks are united and answered by one query for each kind:

* sums: one aggregation without groups;
* facets: a row goes once to each facet, and one aggregation by (facet, value) sums what each facet measures;
* keys: a row goes once to each set of keys; keys are counted once, then their counts are summed, whatever the number of windows;
* ranks: numeric features are unpivoted and counted once by value, with a pair of counters for each part of the rows that is
  ranked, so no row is copied for windows; rank sums and quantiles of all parts come from one order of the values;
* levels: string features are counted by level, and levels are ranked by the rate of their labels.

All grouped results are small: days, statuses, sets of keys, features.
"""

from __future__ import annotations

from collections.abc import Callable, Mapping, Sequence
from dataclasses import dataclass, field

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DateType

from ..functions.ranks import bucket, same
from ..functions.stats import auc_of_counts


class NeedsDiffer(ValueError):
    """Two checks give one name to different expressions."""


@dataclass(frozen=True)
class Facet:
    """Sums of ``measures`` (numbers or booleans) by ``key``."""

    key: Column
    measures: Mapping[str, Column]


@dataclass(frozen=True)
class Part:
    """The rows of ``member``, ranked against ``label`` (0, 1 or null); ``shares`` asks for quantiles of all its values."""

    member: Column
    label: Column
    shares: tuple[float, ...] = ()


@dataclass(frozen=True)
class Needs:
    """Fragments that a check declares.  ``keys`` maps a name to an expression, a null of which is a key, too."""

    sums: Mapping[str, Column] = field(default_factory=dict)
    facets: Mapping[str, Facet] = field(default_factory=dict)
    keys: Mapping[str, Column] = field(default_factory=dict)
    parts: Mapping[str, Part] = field(default_factory=dict)
    numbers: Sequence[str] = ()
    strings: Sequence[str] = ()
    ranked_strings: Sequence[str] = ()

    def __or__(self, other: Needs) -> Needs:
        facets = dict(self.facets)
        for name, f in other.facets.items():
            mine = facets.get(name)
            if mine is None:
                facets[name] = f
            else:
                _agree(name, mine.key, f.key)
                facets[name] = Facet(f.key, _united(mine.measures, f.measures))
        parts = dict(self.parts)
        for name, p in other.parts.items():
            if name in parts:
                _agree(name, parts[name].member, p.member)
                p = Part(p.member, p.label, tuple(dict.fromkeys((*parts[name].shares, *p.shares))))
            parts[name] = p
        first = lambda a, b: tuple(dict.fromkeys((*a, *b)))
        return Needs(
            _united(self.sums, other.sums), facets, _united(self.keys, other.keys), parts,
            first(self.numbers, other.numbers), first(self.strings, other.strings), first(self.ranked_strings, other.ranked_strings),
        )


def _agree(name: str, a: Column, b: Column) -> None:
    if str(a) != str(b):
        raise NeedsDiffer(f"{name} is asked for as {a} and as {b}")


def _united(a: Mapping[str, Column], b: Mapping[str, Column]) -> dict[str, Column]:
    for name in a.keys() & b.keys():
        _agree(name, a[name], b[name])
    return {**a, **b}


@dataclass(frozen=True)
class Keys:
    """Different keys, with the null one; by window the keys of both sides, those but the null one, and the
    evaluation rows of all keys but null and of those that training rows have, too."""

    different: int
    shared: dict[str, int]
    shared_known: dict[str, int]
    rows: dict[str, int]
    touched: dict[str, int]


@dataclass(frozen=True)
class Rank:
    """A feature's association (AUC - 0.5) with the label in a part; null below the least rows, two values or two classes."""

    rows: int
    positives: int
    association: float | None
    valued: int = 0
    quantiles: tuple[float, ...] = ()


@dataclass(frozen=True)
class Answers:
    sums: dict[str, object]
    facets: dict[str, list[tuple[str | None, dict[str, int]]]]
    keys: dict[str, Keys]
    ranks: dict[tuple[str, str], Rank]


def answered(rows: DataFrame, needs: Needs, sides: Mapping[str, tuple[Column, Column]], least_rows: int, level_rows: int) -> Answers:
    """``sides`` has each window's (training, evaluation) conditions."""
    ranks = _numbers(rows, needs, least_rows) if needs.numbers else {}
    if needs.strings:
        ranks |= _levels(rows, needs, least_rows, level_rows)
    return Answers(_sums(rows, needs.sums), _facets(rows, needs.facets), _keys(rows, needs.keys, sides), ranks)


def _sums(rows: DataFrame, sums: Mapping[str, Column]) -> dict[str, object]:
    if not sums:
        return {}
    found = rows.agg(*(c.alias(f"_{k}") for k, c in enumerate(sums.values()))).first()
    return {name: v if v is not None else 0 for name, v in zip(sums, found, strict=True)}


def _facets(rows: DataFrame, facets: Mapping[str, Facet]) -> dict[str, list]:
    if not facets:
        return {}
    most = max(len(f.measures) for f in facets.values())
    names = [f"_{k}" for k in range(most)]
    blank = F.lit(None).cast("long")
    entries = []
    types = rows.select(*(f.key.alias(f"_{k}") for k, f in enumerate(facets.values()))).schema.fields
    for (name, f), kind in zip(facets.items(), types, strict=True):
        values = [c.cast("long") for c in f.measures.values()]
        values += [blank] * (most - len(values))
        text, day = (F.lit(None).cast("string"), f.key) if isinstance(kind.dataType, DateType) else (f.key.cast("string"), F.lit(None).cast("date"))
        entries.append(F.struct(F.lit(name).alias("facet"), text.alias("text"), day.alias("day"), *(v.alias(n) for v, n in zip(values, names, strict=True))))
    sums = rows.select(F.inline(F.array(*entries))).groupBy("facet", "text", "day").agg(*(F.sum(n).alias(n) for n in names))
    # days become texts once they are counted
    found = sums.select("facet", F.coalesce("text", F.col("day").cast("string")).alias("key"), *names).collect()
    out: dict[str, list] = {name: [] for name in facets}
    for r in found:
        out[r.facet].append((r.key, {m: r[n] or 0 for m, n in zip(facets[r.facet].measures, names, strict=False)}))
    return {name: sorted(entries, key=lambda e: (e[0] is None, e[0])) for name, entries in out.items()}


def _keys(rows: DataFrame, keys: Mapping[str, Column], sides: Mapping[str, tuple[Column, Column]]) -> dict[str, Keys]:
    if not keys:
        return {}
    windows = list(sides)
    flags = {f"t{k}": sides[w][0].cast("int") for k, w in enumerate(windows)} | {f"e{k}": sides[w][1].cast("long") for k, w in enumerate(windows)}
    entries = F.array(*(F.struct(F.lit(name).alias("set"), key.cast("string").alias("key")) for name, key in keys.items()))
    one = rows.select(*(c.alias(n) for n, c in flags.items()), F.inline(entries)).groupBy("set", "key")
    each = one.agg(*(F.max(n).alias(n) if n[0] == "t" else F.sum(n).alias(n) for n in flags), F.count("*").alias("n"))
    known = F.col("key").isNotNull()
    sums = [F.count("*").alias("different")]
    for k in range(len(windows)):
        trained, evaluated = F.coalesce(F.col(f"t{k}"), F.lit(0)) > 0, F.coalesce(F.col(f"e{k}"), F.lit(0)) > 0
        hit = F.coalesce(F.sum(F.when(known & trained, F.col(f"e{k}"))), F.lit(0))
        sums += [F.count_if(trained & evaluated).alias(f"s{k}"), F.count_if(trained & evaluated & known).alias(f"k{k}")]
        sums += [F.coalesce(F.sum(F.when(known, F.col(f"e{k}"))), F.lit(0)).alias(f"r{k}"), hit.alias(f"h{k}")]
    by = lambda r, p: {w: r[f"{p}{k}"] for k, w in enumerate(windows)}
    return {r["set"]: Keys(r.different, by(r, "s"), by(r, "k"), by(r, "r"), by(r, "h")) for r in each.groupBy("set").agg(*sums).collect()}


def _numbers(rows: DataFrame, needs: Needs, least_rows: int) -> dict[tuple[str, str], Rank]:
    """All parts of all numeric features from one order of their values."""
    parts = list(needs.parts.items())
    counters = []
    for k, (_, p) in enumerate(parts):
        y = p.label.cast("int")
        counters += [(p.member & y.isNotNull()).cast("int").alias(f"n{k}"), F.when(p.member, y).alias(f"p{k}")]
        counters += [p.member.cast("int").alias(f"m{k}")] if p.shares else []
    counts = [f"{c}{k}" for k, (_, p) in enumerate(parts) for c in ("npm" if p.shares else "np")]
    values = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).cast("double").alias("value")) for f in needs.numbers))
    long = rows.select(*counters, F.inline(values)).where(F.col("value").isNotNull())
    each = long.groupBy("feature", "value").agg(*(F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in counts)).withColumn("_bucket", bucket(F.col("value")))
    # the counts before each bucket, then before each value in it
    totals = each.groupBy("feature", "_bucket").agg(*(F.sum(c).alias(c) for c in counts))
    whole = Window.partitionBy("feature")
    earlier = whole.orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    running = [c for c in counts if c[0] in "nm"]
    # all counts are asked for on both sides of the join: only then is the unpivoted table counted and shuffled once for both
    tops = totals.select("feature", "_bucket", *(F.coalesce(F.sum(c).over(earlier), F.lit(0)).alias(f"b_{c}") for c in running), *(F.sum(c).over(whole).alias(f"a_{c}") for c in counts if c[0] in "mp"))
    local = each.withColumns({f"u_{c}": F.sum(c).over(Window.partitionBy("feature", "_bucket").orderBy("value")) for c in running})
    upto = same(local, tops, ["feature", "_bucket"])
    sums = []
    for k, (_, p) in enumerate(parts):
        n, pos = F.col(f"n{k}"), F.col(f"p{k}")
        rank = F.col(f"u_n{k}") + F.col(f"b_n{k}") - (n - 1) / 2
        sums += [F.sum(n).alias(f"n{k}"), F.max(f"a_p{k}").alias(f"p{k}"), F.sum(rank * pos).alias(f"r{k}"), F.count_if(n > 0).alias(f"v{k}")]
        if p.shares:
            sums.append(F.sum(f"m{k}").alias(f"m{k}"))
            reached = F.col(f"u_m{k}") + F.col(f"b_m{k}")
            for j, share in enumerate(p.shares):
                place = F.lit(float(share)) * (F.col(f"a_m{k}") - 1)
                at = lambda spot: F.min(F.when(F.col(f"m{k}") > 0, F.when(reached > spot, F.col("value"))))  # noqa: B023, E731
                sums += [at(F.floor(place)).alias(f"lo{k}_{j}"), at(F.ceil(place)).alias(f"hi{k}_{j}")]
    out = {}
    for r in upto.groupBy("feature").agg(*sums).collect():
        for k, (name, p) in enumerate(parts):
            n, pos, spread = r[f"n{k}"], r[f"p{k}"], ()
            valued = r[f"m{k}"] if p.shares else 0
            if valued:
                spread = tuple(_between(r[f"lo{k}_{j}"], r[f"hi{k}_{j}"], share * (valued - 1)) for j, share in enumerate(p.shares))
            link = None
            if n >= least_rows and r[f"v{k}"] > 1 and 0 < pos < n:
                link = (r[f"r{k}"] - pos * (pos + 1) / 2) / (pos * (n - pos)) - 0.5
            out[name, r.feature] = Rank(n, pos, link, valued, spread)
    return out


def _between(low: float, high: float, place: float) -> float:
    return low if low == high else low + (high - low) * (place - int(place))


def _levels(rows: DataFrame, needs: Needs, least_rows: int, level_rows: int) -> dict[tuple[str, str], Rank]:
    """String features of ``ranked_strings``'s parts: each level's value is the rate of its labels, which is the order that favours
    the feature most.  Features with fewer than ``level_rows`` rows a level are left out: small levels separate by chance."""
    parts = [(name, needs.parts[name]) for name in needs.ranked_strings]
    entries = F.array(*(F.struct(F.lit(f).alias("feature"), F.col(f).alias("level")) for f in needs.strings))
    counters, sums = [], []
    for k, (_, p) in enumerate(parts):
        y = p.label.cast("int")
        counters += [(p.member & y.isNotNull()).cast("int").alias(f"n{k}"), F.when(p.member, y).alias(f"p{k}")]
        sums += [F.sum(f"n{k}").alias(f"n{k}"), F.sum(f"p{k}").alias(f"p{k}")]
    long = rows.select(*counters, F.inline(entries)).where(F.col("level").isNotNull())
    each = long.groupBy("feature", "level").agg(*sums)
    wide = F.array(*(F.struct(F.lit(name).alias("part"), F.col(f"n{k}").alias("_n"), F.coalesce(F.col(f"p{k}"), F.lit(0)).alias("_p")) for k, (name, _) in enumerate(parts)))
    counts = each.select("feature", F.inline(wide)).where(F.col("_n") > 0)
    group = Window.partitionBy("part", "feature")
    coarse = counts.withColumns({"_rows": F.sum("_n").over(group), "_levels": F.count("*").over(group)}).where((F.col("_levels") > 1) & (F.col("_rows") >= F.lit(level_rows) * F.col("_levels")))
    ranked = coarse.groupBy("part", "feature", (F.col("_p") / F.col("_n")).alias("_s")).agg(F.sum("_n").alias("_n"), F.sum("_p").alias("_p"))
    out = {}
    for r in auc_of_counts(ranked, ["part", "feature"]).collect():
        out[r.part, r.feature] = Rank(r.rows, r.positives, r.auc - 0.5 if r.auc is not None and r.rows >= least_rows and r["values"] > 1 else None)
    return out


#: What a check without needs declares.
def nothing(_context) -> Needs:
    return Needs()


Declares = Callable[[object], Needs]
