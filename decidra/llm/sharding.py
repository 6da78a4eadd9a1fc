"""Shards of nearly equal size by sampled splitters.

Records are ordered by (hash of the text, hash of the id, number of the row).  Of all rows a sample is drawn in which a row's
chance grows with its size; quantiles of the sample's keys are the splitters of ``SLICES`` ranges for each shard.  The ranges'
exact sizes come from one aggregation.  A range with more than twice its due, in bytes or in rows, is subdivided: a sample
of its rows alone gives it splitters of its own, and so on until none is left.  A record that is larger than a whole range
gets one for itself.  Shards are runs of ranges that end where their bytes are due; large records, and groups of equal texts
that fill several ranges but no more than ``WHOLE`` of a shard, are dealt first, each to the shard with the fewest bytes, and
the runs fill what they leave.  So a shard's bytes differ from the mean by one range at most (1 in ``SLICES / 2``), unless
large records leave too few others to fill up with.

Equal texts are neighbours.  The first splitter within a group of them moves to the group's start; within it the hash of the id
gives splitters like any other key.  A group is divided between shards only if it fills more than ``WHOLE`` of one.

Only DataFrame functions are used.  A row's range is a binary search in an array of splitters, which is a constant of the
plan; the driver gets the sample (about ``SAMPLE`` keys whatever the input), large records (fewer than the ranges) and one
row per range.  No task gets more than one range to order.

Defined results: a null text has no bytes and counts as size 1, like an empty one.  Null ids are ids of their own, and rows that repeat
are dealt each.  Other columns are carried along if they are named and ignored else; an empty table gives an empty result.
"""

from __future__ import annotations

import heapq
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import dropped, written

#: Ranges for each shard, and keys sampled for each range.
SLICES = 256
KEYS_PER_RANGE = 8
#: The share of a shard up to which a group of equal texts stays in one.
WHOLE = 0.25
#: Rounds in which overfull ranges are subdivided; each makes them hundreds of times smaller, so a few are taken.
ROUNDS = 12
KEY = ("_group", "_tie", "_row")

Key = tuple[int, int, int]
#: Before all ties of a group.
LOWEST = -(2**63)


@dataclass(frozen=True)
class Range:
    """Number, bytes and rows of the records from one splitter up to the next."""

    number: int
    size: int
    rows: int
    alone: bool  # a single record larger than a range


def keyed(rows: DataFrame, group: Column, size: Column, *carry: str) -> DataFrame:
    """``carry`` of all rows with their size and their key, as a table: the row's number is then fixed."""
    hashed = rows.select(*carry, size.cast("long").alias("_size"), F.xxhash64(group).alias("_group"))
    tie = F.xxhash64(*carry, F.lit(1)) if carry else F.lit(0).cast("long")
    return written(hashed.withColumn("_tie", tie).withColumn("_row", F.monotonically_increasing_id()), "keyed")


def _longs(numbers: list[int]) -> Column:
    """A constant array; a string keeps the plan small."""
    return F.split(F.lit(",".join(map(str, numbers))), ",").cast("array<bigint>")


def range_of(splitters: list[Key]) -> Column:
    """How many splitters are at or before the row's key: steps of a binary search over three arrays."""
    if not splitters:
        return F.lit(0)
    parts = [_longs([s[k] for s in splitters]) for k in range(3)]
    n = len(splitters)

    def reached(k: Column) -> Column:
        a, b, c = (F.get(p, k) for p in parts)
        group, tie, row = map(F.col, KEY)
        return (a < group) | ((a == group) & ((b < tie) | ((b == tie) & (c <= row))))

    steps = F.array(*(F.lit(1 << k) for k in reversed(range(n.bit_length()))))
    return F.aggregate(steps, F.lit(0), lambda found, step: F.when((found + step <= n) & reached(found + step - 1), found + step).otherwise(found))


def _lowered(keys: list[Key]) -> list[Key]:
    """Different splitters in order; the first of each group is moved to the group's start."""
    out: list[Key] = []
    for k in sorted(set(keys)):
        out.append(k if out and out[-1][0] == k[0] else (k[0], LOWEST, 0))
    return out


def _sample(rows: DataFrame, weight: Column, total: float, wanted: int) -> list[tuple[Key, float]]:
    """Keys of about ``wanted`` rows, each drawn with a chance in proportion to its weight, with the weight it stands for.

    The draw is a hash of the key, so a task that is run again draws the same.
    """
    chance = F.least(F.lit(1.0), weight * (wanted / total))
    drawn = F.pmod(F.xxhash64(*KEY, F.lit(7)), F.lit(1 << 40)) / float(1 << 40) < chance
    found = rows.where(drawn).select(*KEY, F.greatest(weight, F.lit(total / wanted)).alias("w")).collect()
    return sorted((tuple(r[:3]), r.w) for r in found)


def _quantiles(sample: list[tuple[Key, float]], parts: int) -> list[Key]:
    """Keys at which the sample's weight passes each of ``parts`` equal shares."""
    total, upto, out = sum(w for _, w in sample), 0.0, []
    for key, w in sample:
        if int(upto * parts / total) < int((upto + w) * parts / total):
            out.append(key)
        upto += w
    return out


def _measured(rows: DataFrame, splitters: list[Key], large: float) -> dict[int, Range]:
    found = rows.groupBy(range_of(splitters).alias("k")).agg(F.sum("_size").alias("size"), F.count("*").alias("rows")).collect()
    return {r.k: Range(r.k, r.size, r.rows, r.rows == 1 and r.size > large) for r in found}


def split(rows: DataFrame, ranges: int, keys_per_range: int = KEYS_PER_RANGE) -> tuple[list[Key], list[Range]]:
    """Splitters, and the ranges between them, none of which has over twice its share of bytes or rows (see the module)."""
    whole = rows.agg(F.coalesce(F.sum("_size"), F.lit(0)).alias("size"), F.count("*").alias("n"), F.coalesce(F.max("_size"), F.lit(0)).alias("most")).first()
    if not whole.n:
        return [], []
    most, most_rows = 2 * whole["size"] / ranges, 2 * whole.n / ranges
    # a row counts by its bytes and as one of all rows: many small rows make a range, too
    weight, due = F.col("_size") / F.lit(float(whole["size"])) + F.lit(1.0 / whole.n), 2.0 / ranges
    large = [tuple(r) for r in rows.where(F.col("_size") > most).select(*KEY).collect()] if whole.most > most else []
    fixed = {x for g, t, r in large for x in ((g, t, r), (g, t, r + 1))}
    splitters = sorted({*fixed, *_lowered(_quantiles(_sample(rows, weight, 2.0, keys_per_range * ranges), ranges))})
    for _ in range(ROUNDS):
        found = _measured(rows, splitters, most)
        over = [x for x in found.values() if x.rows > 1 and (x.size > most or x.rows > most_rows)]
        if not over:
            break
        inside = rows.withColumn("_k", range_of(splitters)).where(F.col("_k").isin([x.number for x in over]))
        held = sum(x.size / whole["size"] + x.rows / whole.n for x in over)
        sample = _sample(inside, weight, held, keys_per_range * max(2 * len(over), int(held / due) + 1))
        own: dict[int, list[tuple[Key, float]]] = {}
        for key, w in sample:
            own.setdefault(bisect_right(splitters, key), []).append((key, w))
        more: set[Key] = set()
        for x in over:
            share = x.size / whole["size"] + x.rows / whole.n
            cuts = _quantiles(own.get(x.number, []), max(2, round(share / due)))
            start = splitters[x.number - 1] if x.number else None
            lowered = _lowered(cuts)
            # in a group that the range starts with, splitters stay where they are
            more |= {c if start and c[0] == start[0] else low for c, low in zip(sorted(set(cuts)), lowered, strict=True)}
        if not more - set(splitters):
            break
        splitters = sorted({*splitters, *more})
    else:
        found = _measured(rows, splitters, most)
    return splitters, sorted(found.values(), key=lambda x: x.number)


def units(splitters: list[Key], ranges: list[Range]) -> list[list[Range]]:
    """Ranges that begin with or within the same group are one unit; the range before the first splitter is one, too."""
    out: list[list[Range]] = []
    last = None
    for x in ranges:
        group = splitters[x.number - 1][0] if x.number else None
        if out and group is not None and group == last:
            out[-1].append(x)
        else:
            out.append([x])
        last = group
    return out


def dealt(splitters: list[Key], ranges: list[Range], shards: int, whole: float = WHOLE) -> dict[int, tuple[int, int]]:
    """(shard, rows of the shard before it) of each range."""
    total = sum(x.size for x in ranges)
    first: list[list[Range]] = []  # dealt before the runs: groups of several ranges that stay whole, and single large records
    for unit in units(splitters, ranges):
        if (len(unit) > 1 or unit[0].alone) and sum(x.size for x in unit) <= whole * total / shards:
            first.append(unit)
        else:
            first += [[x] for x in unit if x.alone]
    loads = [(0, s) for s in range(shards)]
    shard: dict[int, int] = {}
    for unit in sorted(first, key=lambda u: (-sum(x.size for x in u), u[0].number)):
        load, s = heapq.heappop(loads)
        shard |= {x.number: s for x in unit}
        heapq.heappush(loads, (load + sum(x.size for x in unit), s))
    taken = {s: load for load, s in loads}
    runs = [x for x in ranges if x.number not in shard]
    room = [max(0.0, total / shards - taken[s]) for s in range(shards)]
    scale, ends, upto = sum(x.size for x in runs) / (sum(room) or 1), [], 0.0
    for r in room:
        upto += r * scale
        ends.append(upto)
    upto = 0.0
    for x in runs:
        shard[x.number] = min(bisect_right(ends, upto + x.size / 2), shards - 1)
        upto += x.size
    places, counts = {}, [0] * shards
    for x in ranges:
        s = shard[x.number]
        places[x.number] = (s, counts[s])
        counts[s] += x.rows
    return places


def sharded(rows: DataFrame, group: Column, size: Column, carry: list[str], shards: int = 16, slices: int = SLICES) -> DataFrame:
    """``carry`` of all rows with size, shard (from 0) and slot (from 0, gapless in the shard, in the order of keys)."""
    table = keyed(rows, group, size, *carry)
    splitters, ranges = split(table, shards * slices)
    places = dealt(splitters, ranges, shards)
    numbers = range(len(splitters) + 1)
    of = lambda part: F.get(_longs([places.get(k, (0, 0))[part] for k in numbers]), F.col("_k"))
    order = F.row_number().over(Window.partitionBy("_k").orderBy(*KEY)) - 1
    placed = table.withColumn("_k", range_of(splitters)).withColumn("slot", order.cast("long") + of(1)).withColumn("shard", of(0).cast("int"))
    return placed.select(*carry, F.col("_size").alias("size"), "shard", "slot")


def write_shards(rows: DataFrame, path: str, group: Column, size: Column, carry: list[str], shards: int = 16) -> None:
    """Parquet folders ``shard=k`` under ``path`` with the rows of each shard; a shard's files are made by as many tasks as its ranges fill."""
    made = written(sharded(rows, group, size, carry, shards), "dealt")
    made.repartition("shard", (F.col("slot") / F.lit(100_000)).cast("long")).sortWithinPartitions("shard", "slot").write.partitionBy("shard").parquet(path)
    dropped(made)
