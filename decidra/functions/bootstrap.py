"""Paired Poisson bootstrap of metrics of two scores, as mergeable sums of all draws.

Rows with equal scores and labels are a cell.  A cell's weight in a draw is a Poisson number with the cell's rows as its mean,
which is what the rows' own Poisson weights would add up to.  It comes from a hash of the cell and the draw, so it is made
again wherever it is needed and never shuffled, and both scores get the same draws.  What travels are arrays with one
sum for the sample and one for each draw:

* errors, benefits and calibration bins are sums over cells; each task sends one array for each of them;
* AUC and average precision need an order.  Cells are ordered within narrow buckets of scores only, and a bucket sends its rows,
  positives and rank sum.  A score that very many cells share (a rule's constant) is a place of its own in the order, and is
  summed by all tasks.  The sums before each bucket come from one pass over buckets, split by draws.

The cost is linear in cells, and no task holds all scores.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterator, Mapping, Sequence
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark import StorageLevel
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .ranks import bucket, quantiles

#: Cells whose weights a task holds at a time; cells of one score from which it is summed apart; draws of one pass over buckets.
CHUNK, HEAVY, BLOCK = 2048, 4096, 64
#: Partial sums that one merge gets of each task meet in so many groups first.
FAN = 64
#: Quantile bins of the calibration error.
BINS = 10
_KEEP = StorageLevel.DISK_ONLY


@dataclass(frozen=True)
class Values:
    """A metric of both scores in the sample and in each draw; nan where it is undefined."""

    model: float
    rule: float
    draws_model: np.ndarray
    draws_rule: np.ndarray


def _mixed(x: np.ndarray) -> np.ndarray:
    """A 64-bit mixer: every bit of the input changes each bit of the output in half of all cases."""
    with np.errstate(over="ignore"):
        x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
        x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def _poisson_steps(mean: int) -> tuple[int, np.ndarray]:
    """The smallest number considered, and the cumulated chances from it on; what lies 12 standard deviations off is left out."""
    spread = 12 * math.sqrt(mean) + 20
    low, high = max(0, int(mean - spread)), int(mean + spread)
    k = np.arange(low + 1, high + 1)
    logs = low * math.log(mean) - mean - math.lgamma(low + 1) + np.concatenate([[0.0], np.cumsum(np.log(mean) - np.log(k))])
    return low, np.cumsum(np.exp(logs))


def weights(keys: np.ndarray, counts: np.ndarray, draws: int, seed: int) -> np.ndarray:
    """(cells, draws + 1): the counts, then each draw's weights."""
    out = np.empty((len(keys), draws + 1))
    out[:, 0] = counts
    with np.errstate(over="ignore"):
        steps = (np.arange(1, draws + 1, dtype=np.uint64) + np.uint64(seed)) * np.uint64(0x9E3779B97F4A7C15)
        uniform = (_mixed(_mixed(keys.astype(np.int64).view(np.uint64))[:, None] + steps) >> np.uint64(11)).astype(float) * 2.0**-53
    for n in np.unique(counts):
        low, upto = _poisson_steps(int(n))
        mine = counts == n
        out[mine, 1:] = low + np.searchsorted(upto, uniform[mine], side="right")
    return out


def cells(rows: DataFrame, model: str, rule: str, label: str) -> DataFrame:
    """(m, r, y, n, k) of the rows with a label: different scores and labels with their rows and key."""
    known = rows.where(F.col(label).isNotNull()).select(F.col(model).alias("m"), F.col(rule).alias("r"), F.col(label).cast("int").alias("y"))
    return known.groupBy("m", "r", "y").agg(F.count("*").alias("n")).withColumn("k", F.xxhash64("m", "r", "y"))


def _chunks(frame: pd.DataFrame) -> Iterator[pd.DataFrame]:
    for start in range(0, len(frame), CHUNK):
        yield frame.iloc[start : start + CHUNK]


def _added(parts: DataFrame, keys: Sequence[str], schema: str) -> DataFrame:
    """Sums of the arrays ``w`` by ``keys``, in two levels (parts have a number ``fan``)."""

    def add(frame: pd.DataFrame) -> pd.DataFrame:
        out = frame.iloc[:1].copy()
        out["w"] = [np.sum(np.stack(frame["w"].to_numpy()), axis=0)]
        return out

    return parts.groupBy(*keys, "fan").applyInPandas(add, schema).groupBy(*keys).applyInPandas(add, schema)


def _fan() -> int:
    from pyspark import TaskContext

    return TaskContext.get().partitionId() % FAN


# --- sums over cells -------------------------------------------------------------------------------------------------


def _losses(s: np.ndarray, y: np.ndarray, cost: float | None) -> dict[str, np.ndarray]:
    with np.errstate(all="ignore"):
        log = np.where(y == 1, -np.log(s), -np.log1p(-s))
    act = s >= cost if cost is not None else np.zeros(len(s), bool)
    gain = np.where(act, np.where(y == 1, 1.0, -cost / (1 - cost)), 0.0) if cost is not None else np.zeros(len(s))
    return {"brier": (s - y) ** 2, "log_loss": np.where(np.isfinite(log), log, 0.0), "sure": (~np.isfinite(log)).astype(float), "net_benefit": gain}


#: A metric of one's own: the loss of each row from scores and labels; the metric is their mean.
Loss = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _linear(table: DataFrame, edges: dict[str, np.ndarray], cost: float | None, draws: int, seed: int, own: Mapping[str, Loss]) -> dict[str, np.ndarray]:
    """Arrays of sums by name: ``rows``, ``m brier``, ``m bin 3 rows`` and so on."""

    def work(frames):
        total: dict[str, np.ndarray] = {}
        for whole in frames:
            for f in _chunks(whole):
                y, w = f["y"].to_numpy(float), weights(f["k"].to_numpy(), f["n"].to_numpy(), draws, seed)
                columns = {"rows": np.ones(len(f))}
                for side in ("m", "r"):
                    s = f[side].to_numpy(float)
                    columns |= {f"{side} {name}": v for name, v in _losses(s, y, cost).items()}
                    columns |= {f"{side} {name}": np.asarray(loss(s, y), float) for name, loss in own.items()}
                    place = np.clip(np.searchsorted(edges[side], s, side="right") - 1, 0, BINS - 1)
                    for b in range(BINS):
                        here = (place == b).astype(float)
                        columns |= {f"{side} bin {b} rows": here, f"{side} bin {b} gap": here * (s - y)}
                sums = np.stack(list(columns.values())) @ w
                for name, v in zip(columns, sums, strict=True):
                    total[name] = total.get(name, 0) + v
        if total:
            yield pd.DataFrame({"name": list(total), "fan": _fan(), "w": list(total.values())})

    schema = "name string, fan int, w array<double>"
    return {r["name"]: np.array(r["w"]) for r in _added(table.mapInPandas(work, schema), ["name"], schema).collect()}


# --- sums in an order ------------------------------------------------------------------------------------------------


def _placed(table: DataFrame, side: str, heavy: int) -> DataFrame:
    """(v, y, n, k, b, part, one): cells with their place (b, part) in the order; ``one``: the place is a single score."""
    base = table.select(F.col(side).alias("v"), "y", "n", "k", bucket(F.col(side)).alias("b"))
    many = base.groupBy("b", "v").agg(F.count("*").alias("c")).where(F.col("c") > heavy)
    lists = many.groupBy("b").agg(F.sort_array(F.collect_list("v")).alias("alone"))
    known = base.join(lists, "b", "left")
    below = F.coalesce(F.size(F.filter("alone", lambda x: x < F.col("v"))), F.lit(0))
    one = F.coalesce(F.array_contains("alone", F.col("v")), F.lit(False))
    return known.select("v", "y", "n", "k", "b", (2 * F.greatest(below, F.lit(0)) + one.cast("int")).alias("part"), one.alias("one"))


def _by_value(frame: pd.DataFrame, draws: int, seed: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Rows and positives (scores, draws + 1) in the order of scores, some scores at a time."""
    frame = frame.sort_values("v", kind="stable")
    v = frame["v"].to_numpy()
    start = 0
    while start < len(v):
        stop = min(len(v), start + CHUNK)
        stop = int(np.searchsorted(v, v[stop - 1], side="right"))
        f = frame.iloc[start:stop]
        w = weights(f["k"].to_numpy(), f["n"].to_numpy(), draws, seed)
        first = np.flatnonzero(np.concatenate([[True], v[start + 1 : stop] != v[start : stop - 1]]))
        yield np.add.reduceat(w, first, axis=0), np.add.reduceat(w * f["y"].to_numpy(float)[:, None], first, axis=0)
        start = stop


_SUMS = "b long, part int, n array<double>, p array<double>, r array<double>"


def _places(placed: DataFrame, draws: int, seed: int) -> DataFrame:
    """(b, part, n, p, r): rows, positives and rank sum within each place."""

    def inner(frame: pd.DataFrame) -> pd.DataFrame:
        n = np.zeros(draws + 1)
        p, r = np.zeros(draws + 1), np.zeros(draws + 1)
        for rows, positives in _by_value(frame, draws, seed):
            upto = n + np.cumsum(rows, axis=0)
            r += ((upto - (rows - 1) / 2) * positives).sum(axis=0)
            n, p = n + rows.sum(axis=0), p + positives.sum(axis=0)
        return pd.DataFrame({"b": frame["b"].iloc[:1], "part": frame["part"].iloc[:1], "n": [n], "p": [p], "r": [r]})

    def single(frames):
        total: dict[tuple, np.ndarray] = {}
        for whole in frames:
            for f in _chunks(whole):
                w = weights(f["k"].to_numpy(), f["n"].to_numpy(), draws, seed)
                for key, at in f.reset_index(drop=True).groupby(["b", "part", "y"]).groups.items():
                    total[key] = total.get(key, 0) + w[at].sum(axis=0)
            if len(total) > CHUNK:
                yield _frame(total)
                total = {}
        if total:
            yield _frame(total)

    def _frame(total):
        keys = list(total)
        return pd.DataFrame({"b": [k[0] for k in keys], "part": [k[1] for k in keys], "y": [k[2] for k in keys], "fan": _fan(), "w": list(total.values())})

    def tied(frame: pd.DataFrame) -> pd.DataFrame:
        by = dict(zip(frame["y"], frame["w"], strict=True))
        p = np.asarray(by.get(1, np.zeros(draws + 1)), float)
        n = p + np.asarray(by.get(0, np.zeros(draws + 1)), float)
        return pd.DataFrame({"b": frame["b"].iloc[:1], "part": frame["part"].iloc[:1], "n": [n], "p": [p], "r": [(n + 1) / 2 * p]})

    light = placed.where(~F.col("one")).groupBy("b", "part").applyInPandas(inner, _SUMS)
    schema = "b long, part int, y int, fan int, w array<double>"
    heavy = _added(placed.where("one").mapInPandas(single, schema), ["b", "part", "y"], schema)
    return light.unionByName(heavy.groupBy("b", "part").applyInPandas(tied, _SUMS))


def _blocked(places: DataFrame, draws: int) -> DataFrame:
    """Places once for each block of draws."""
    blocks = F.explode(F.sequence(F.lit(0), F.lit(draws // BLOCK))).alias("block")
    cut = lambda c: F.slice(c, F.col("block") * BLOCK + 1, F.lit(BLOCK)).alias(c)
    return places.select("b", "part", "n", "p", "r", blocks).select("b", "part", "block", cut("n"), cut("p"), cut("r"))


def _matrices(frame: pd.DataFrame, *names: str) -> list[np.ndarray]:
    return [np.stack(frame[c].to_numpy()) for c in names]


def _auc(places: DataFrame, draws: int) -> np.ndarray:
    def whole(frame: pd.DataFrame) -> pd.DataFrame:
        n, p, r = _matrices(frame.sort_values(["b", "part"]), "n", "p", "r")
        ranks = (r + (np.cumsum(n, axis=0) - n) * p).sum(axis=0)
        every, positives = n.sum(axis=0), p.sum(axis=0)
        with np.errstate(all="ignore"):
            v = (ranks - positives * (positives + 1) / 2) / (positives * (every - positives))
        return pd.DataFrame({"block": frame["block"].iloc[:1], "v": [v]})

    return _joined(_blocked(places, draws).groupBy("block").applyInPandas(whole, "block int, v array<double>").collect())


def _joined(rows) -> np.ndarray:
    return np.concatenate([np.array(r.v, float) for r in sorted(rows, key=lambda r: r.block)])


def _precision(placed: DataFrame, places: DataFrame, draws: int, seed: int) -> np.ndarray:
    """Average precision; equal scores are one threshold, so a place needs the rows and positives above it."""

    def above(frame: pd.DataFrame) -> pd.DataFrame:
        frame = frame.sort_values(["b", "part"], ascending=False)
        n, p = _matrices(frame, "n", "p")
        up = np.cumsum(n, axis=0) - n, np.cumsum(p, axis=0) - p
        return pd.DataFrame({"b": frame["b"], "part": frame["part"], "block": frame["block"], "n": list(up[0]), "p": list(up[1])})

    tops = _blocked(places, draws).groupBy("block").applyInPandas(above, "b long, part int, block int, n array<double>, p array<double>")
    ordered = F.array_sort(F.collect_list(F.struct("block", "n", "p")))
    flat = lambda c: F.flatten(F.transform("all", lambda x: x[c])).alias(c)
    tops = tops.groupBy("b", "part").agg(ordered.alias("all")).select("b", "part", flat("n"), flat("p"))
    out = "fan int, w array<double>"

    def inner(cells_of: pd.DataFrame, top: pd.DataFrame) -> pd.DataFrame:
        if not len(cells_of):
            return pd.DataFrame({"fan": pd.Series([], dtype="int32"), "w": pd.Series([], dtype=object)})
        n, p = (np.asarray(top[c].iloc[0], float) for c in "np")
        # scores rise, thresholds fall: start with all of the place and take away what was passed
        every = [np.stack([a.sum(axis=0) for a in pair]) for pair in _by_value(cells_of, draws, seed)]
        rows, positives = n + sum(e[0] for e in every), p + sum(e[1] for e in every)
        gain = np.zeros(draws + 1)
        for v_rows, v_positives in _by_value(cells_of, draws, seed):
            at_rows, at_positives = rows - (np.cumsum(v_rows, axis=0) - v_rows), positives - (np.cumsum(v_positives, axis=0) - v_positives)
            with np.errstate(all="ignore"):
                gain += np.where(v_positives > 0, at_positives / at_rows * v_positives, 0.0).sum(axis=0)
            rows, positives = rows - v_rows.sum(axis=0), positives - v_positives.sum(axis=0)
        return pd.DataFrame({"fan": [int(cells_of["b"].iloc[0]) % FAN], "w": [gain]})

    def tied(frames):
        total = 0
        for f in frames:
            n, p, up_n, up_p = (np.stack(f[c].to_numpy()) for c in ("n", "p", "up_n", "up_p"))
            with np.errstate(all="ignore"):
                total = total + np.where(p > 0, (up_p + p) / (up_n + n) * p, 0.0).sum(axis=0)
        if not np.isscalar(total):
            yield pd.DataFrame({"fan": [_fan()], "w": [total]})

    light = placed.where(~F.col("one")).groupBy("b", "part").cogroup(tops.groupBy("b", "part")).applyInPandas(inner, out)
    single = places.where("part % 2 = 1").join(tops.withColumnsRenamed({"n": "up_n", "p": "up_p"}), ["b", "part"]).select("n", "p", "up_n", "up_p").mapInPandas(tied, out)
    schema = "one int, fan int, w array<double>"
    gains = _added(light.unionByName(single).select(F.lit(1).alias("one"), "fan", "w"), ["one"], schema).first()
    return np.array(gains["w"]) if gains else np.zeros(draws + 1)


ORDERED = ("auc", "ap")


def bootstrapped(rows: DataFrame, model: str, rule: str, label: str, metrics: Sequence[str], cost: float | None = None, draws: int = 400, seed: int = 1, heavy: int = HEAVY, own: Mapping[str, Loss] | None = None) -> dict[str, Values]:
    """Values of ``metrics`` (auc, ap, ece, brier, log_loss, net_benefit, and those of ``own``) of two scores; ``cost`` is the threshold
    of net benefit.

    ECE's bins are those of the sample.  Rows without a label don't count; scores must be finite.
    """
    table = cells(rows, model, rule, label).persist(_KEEP)
    out: dict[str, Values] = {}
    try:
        known = rows.where(F.col(label).isNotNull())
        if wanted := [m for m in metrics if m not in ORDERED]:
            shares = [k / BINS for k in range(BINS + 1)]
            edges = {s: np.array(quantiles(known, c, shares).first().quantiles, float) for s, c in (("m", model), ("r", rule))} if "ece" in wanted else {s: np.zeros(BINS + 1) for s in "mr"}
            sums = _linear(table, edges, cost, draws, seed, own or {})
            for m in wanted:
                out[m] = _pair(*(_from_sums(sums, m, side) for side in ("m", "r")))
        if wanted := [m for m in metrics if m in ORDERED]:
            found = {m: [] for m in wanted}
            for side in ("m", "r"):
                placed = _placed(table, side, heavy).persist(_KEEP)
                places = _places(placed, draws, seed).persist(_KEEP)
                positives = _total(places, "p", draws)
                for m in wanted:
                    with np.errstate(all="ignore"):
                        found[m].append(_auc(places, draws) if m == "auc" else _precision(placed, places, draws, seed) / positives)
                places.unpersist()
                placed.unpersist()
            out |= {m: _pair(*found[m]) for m in wanted}
    finally:
        table.unpersist()
    return {m: out[m] for m in metrics}


def _total(places: DataFrame, name: str, draws: int) -> np.ndarray:
    def add(frame: pd.DataFrame) -> pd.DataFrame:
        return pd.DataFrame({"block": frame["block"].iloc[:1], "v": [_matrices(frame, name)[0].sum(axis=0)]})

    return _joined(_blocked(places, draws).groupBy("block").applyInPandas(add, "block int, v array<double>").collect())


def _from_sums(sums: dict[str, np.ndarray], metric: str, side: str) -> np.ndarray:
    with np.errstate(all="ignore"):
        if metric == "ece":
            return sum(np.abs(sums[f"{side} bin {b} gap"]) for b in range(BINS)) / sums["rows"]
        v = sums[f"{side} {metric}"] / sums["rows"]
        return np.where(sums[f"{side} sure"] > 0, np.inf, v) if metric == "log_loss" else v


def _pair(a: np.ndarray, b: np.ndarray) -> Values:
    return Values(float(a[0]), float(b[0]), a[1:], b[1:])
