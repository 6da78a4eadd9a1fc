"""Whitening of embeddings by a compensated covariance.

Entries become whole numbers; each distinct vector of them is a row of the fit list.  Its length and sums are exact.  Tasks
centre their rows as pairs of doubles (the mean is a pair, too), multiply them with error-free transformations (Knuth's two-sum,
Dekker's two-product) and add the outer products up in double-double, in blocks that fold in halves.  A task's high and
low parts travel in pieces of ``PIECE`` entries; two levels of grouped merges add them with the same transformations,
so no task gets more than a bounded number of parts, and the driver gets one matrix of the dimension's square.
Its eigenvectors come from the tridiagonal divide-and-conquer solver (LAPACK's ``syevd``, which is what ``numpy.linalg.eigh``
calls): Householder reflections to tridiagonal form, halves solved on their own, and rank-one updates by secular equations.

Defined results: rows whose vector is null or empty, or holds a null, an entry that is not finite, or one beyond 2^46 (its whole
number would not be exact) are dropped, and so are vectors of another length than the most frequent one (of equally
frequent ones the longest).  Ids may be null or repeat: each row is whitened.  A component without variance (fewer distinct
vectors than dimensions, constant entries) has a null ``whitened``; without any variance ``explained`` is null.  ``deviation``
is null where it doesn't fit a long.  Other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, written

#: Entries of a matrix that travel in one row, and rows that a merge of the first level gets from each 1 / FAN of the tasks.
PIECE = 1024
FAN = 256
#: Products that a task holds at a time.
CELLS = 1 << 18
LARGEST = float(1 << 46)


# Error-free transformations: the two results add up to the exact one.


def two_sum(a, b):
    s = a + b
    t = s - a
    return s, (a - (s - t)) + (b - t)


def quick_two_sum(a, b):
    """For \\|a\\| >= \\|b\\|."""
    s = a + b
    return s, b - (s - a)


def _halves(a):
    c = 134217729.0 * a  # 2^27 + 1
    high = c - (c - a)
    return high, a - high


def two_product(a, b):
    p = a * b
    (ah, al), (bh, bl) = _halves(a), _halves(b)
    return p, ((ah * bh - p) + ah * bl + al * bh) + al * bl


def add(a, b):
    """Sum of two double-doubles."""
    s, e = two_sum(a[0], b[0])
    t, f = two_sum(a[1], b[1])
    s, e = quick_two_sum(s, e + t)
    return quick_two_sum(s, e + f)


def multiply(a, b):
    """Product of two double-doubles."""
    p, e = two_product(a[0], b[0])
    return quick_two_sum(p, e + (a[0] * b[1] + a[1] * b[0]))


def folded(high, low):
    """Double-double sums over the first axis, by halves."""
    while len(high) > 1:
        half = (len(high) + 1) // 2
        rest = len(high) - half
        s = add((high[:rest], low[:rest]), (high[half:], low[half:]))
        high, low = np.concatenate([s[0], high[rest:half]]), np.concatenate([s[1], low[rest:half]])
    return high[0], low[0]


def quotient(whole: int, n: int) -> tuple[float, float]:
    """``whole`` / ``n`` as a double-double."""
    high = whole / n
    top, bottom = high.as_integer_ratio()
    return high, (whole * bottom - top * n) / (n * bottom)


@dataclass(frozen=True)
class Centre:
    """Length and exact sums of the fit list."""

    n: int
    sums: tuple[int, ...]

    def mean(self) -> tuple[np.ndarray, np.ndarray]:
        pairs = [quotient(s, self.n) for s in self.sums]
        return np.array([p[0] for p in pairs]), np.array([p[1] for p in pairs])


@dataclass(frozen=True)
class Whitening:
    centre: Centre
    components: np.ndarray  # a column each, by falling eigenvalue
    values: np.ndarray
    trace: float

    @property
    def scale(self) -> np.ndarray:
        """1 / sqrt(e); not a number for components without variance."""
        least = len(self.centre.sums) * np.finfo(float).eps * max(self.trace, 0.0)
        with np.errstate(all="ignore"):
            return np.where(self.values > least, 1 / np.sqrt(np.abs(self.values)), np.nan)


def vectors(embeddings: DataFrame, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, x) of the rows that remain."""
    sound = F.forall("_c", lambda c: c.isNotNull() & ~F.isnan(c) & (F.abs(c) <= LARGEST))
    rows = embeddings.select(key, F.col(column).cast("array<double>").alias("_c")).where((F.size("_c") > 0) & sound)
    sizes = rows.groupBy(F.size("_c").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    d = sizes.d if sizes else 0
    return rows.where(F.size("_c") == d).select(key, F.transform("_c", lambda c: F.floor(c * 64).cast("long") + 1_000_000).alias("x"))


def _matrix(column) -> np.ndarray:
    """Rows of an Arrow column of lists of one length."""
    flat = column.flatten().to_numpy(zero_copy_only=False)
    return flat.reshape(len(column), -1) if len(column) else flat.reshape(0, 0)


def centred_on(fit: DataFrame) -> Centre | None:
    """Exact: tasks add whole numbers, and the sums of tasks are added as decimals."""

    def work(batches):
        import pyarrow as pa

        n, sums = 0, None
        for batch in batches:
            if batch.num_rows:
                x = _matrix(batch.column("x"))
                part = [int(v) for v in x.astype(object).sum(axis=0)] if np.abs(x).max() > 2**40 else x.sum(axis=0).tolist()
                sums = part if sums is None else [a + b for a, b in zip(sums, part, strict=True)]
                n += len(x)
        if n:
            yield pa.RecordBatch.from_arrays([pa.array([n], pa.int64()), pa.array([[str(s) for s in sums]], pa.list_(pa.string()))], ["n", "sums"])

    parts = written(arrow_map(fit, work, "n long, sums array<string>"), "sums")
    sums = parts.select(F.posexplode("sums").alias("k", "s")).groupBy("k").agg(F.sum(F.col("s").cast("decimal(30,0)")).alias("s")).orderBy("k").collect()
    n = parts.agg(F.sum("n")).first()[0]
    dropped(parts)
    return Centre(n, tuple(int(r.s) for r in sums)) if n else None


def products(rows: tuple[np.ndarray, np.ndarray], upper) -> tuple[np.ndarray, np.ndarray]:
    """Double-double sums of the outer products of rows (as double-doubles), their upper triangle."""
    high, low = rows
    i, j = upper
    step = max(1, CELLS // len(i))
    total = np.zeros(len(i)), np.zeros(len(i))
    for k in range(0, len(high), step):
        h, e = high[k : k + step], low[k : k + step]
        total = add(total, folded(*multiply((h[:, i], e[:, i]), (h[:, j], e[:, j]))))
    return total


def covariance(fit: DataFrame, n: int, dims: int, centred) -> np.ndarray:
    """Covariance with divisor ``n`` of the rows that ``centred`` makes (double-doubles) of a matrix of x."""
    upper = np.triu_indices(dims)
    pieces = -(-len(upper[0]) // PIECE)

    def work(batches):
        import pyarrow as pa
        from pyspark import TaskContext

        total = np.zeros(len(upper[0])), np.zeros(len(upper[0]))
        for batch in batches:
            if batch.num_rows:
                total = add(total, products(centred(_matrix(batch.column("x"))), upper))
        task = TaskContext.get().partitionId()
        cut = [[t[k * PIECE : (k + 1) * PIECE].tolist() for k in range(pieces)] for t in total]
        yield pa.RecordBatch.from_arrays([pa.array(range(pieces), pa.int32()), pa.array([task % FAN] * pieces, pa.int32()), pa.array(cut[0]), pa.array(cut[1])], ["piece", "fan", "high", "low"])

    schema = "piece int, fan int, high array<double>, low array<double>"

    def merge(group):
        import pyarrow as pa

        # in the order of their bits, so that the result doesn't hang on the order of arrival
        high, low = (_matrix(group.column(c).combine_chunks()) for c in ("high", "low"))
        order = np.lexsort((low[:, 0], high[:, 0]))
        high, low = folded(high[order], low[order])
        first = group.slice(0, 1)
        return pa.table([first.column("piece"), first.column("fan"), pa.array([high.tolist()]), pa.array([low.tolist()])], names=["piece", "fan", "high", "low"])

    parts = arrow_map(fit, work, schema).groupBy("piece", "fan").applyInArrow(merge, schema).groupBy("piece").applyInArrow(merge, schema).orderBy("piece").select("high", "low").collect()
    high, low = (np.concatenate([r[k] for r in parts]) for k in (0, 1))
    share = high / n
    p, e = two_product(share, float(n))
    out = np.zeros((dims, dims))
    out[upper] = share + (((high - p) - e) + low) / n
    return out + np.triu(out, 1).T


def _pairs(centre: Centre):
    high, low = centre.mean()

    def centred(x: np.ndarray):
        s, e = two_sum(x.astype(float), -high)
        return quick_two_sum(s, e - low)

    return centred


def fitted(fit: DataFrame) -> Whitening | None:
    """Centre and components of the fit list (x), whose rows are distinct; None without rows."""
    centre = centred_on(fit)
    if centre is None:
        return None
    matrix = covariance(fit, centre.n, len(centre.sums), _pairs(centre))
    values, columns = np.linalg.eigh(matrix)
    return Whitening(centre, columns[:, ::-1], np.maximum(values[::-1], 0.0), float(np.trace(matrix)))


def exact_centred(x: np.ndarray, centre: Centre) -> np.ndarray:
    """n * x - S in whole numbers: longs where they fit, Python's else."""
    sums = np.array(centre.sums, dtype=object)
    most = max(int(np.abs(x).max()) * centre.n, max(map(abs, centre.sums))) if x.size else 0
    if most < 1 << 61:
        return centre.n * x - sums.astype(np.int64)
    return centre.n * x.astype(object) - sums


def projected(made: Whitening, components: int):
    """Rows of x to their whitened entries; a sum over dimensions doesn't depend on the batch that a row comes in."""
    axes, scale = made.components[:, :components], made.scale[:components]

    def whitened(x: np.ndarray) -> np.ndarray:
        y = (exact_centred(x, made.centre) / made.centre.n).astype(float)
        return np.einsum("rd,dc->rc", y, axes) * scale

    return whitened


def identity_error(fit: DataFrame, made: Whitening, components: int) -> float | None:
    """Largest absolute entry of the whitened fit list's covariance minus the identity, over components with variance.

    Whitened entries have mean zero by construction (the centre is exact), so they are centred already.
    """
    live = int(np.isfinite(made.scale[:components]).sum())
    if not live:
        return None
    whiten = projected(made, live)

    def centred(x):
        w = whiten(x)
        return w, np.zeros_like(w)

    return float(np.abs(covariance(fit, made.centre.n, live, centred) - np.eye(live)).max())


def whitened(embeddings: DataFrame, components: int = 16, column: str = "embedding", key: str = "vec_id") -> DataFrame:
    """(key, component, n, deviation, whitened, explained, identity_error) of each remaining row and component up to ``components``."""
    rows = vectors(embeddings, column, key)
    fit = written(rows.select("x").distinct(), "fit-list")
    made = fitted(fit)
    schema = f"{key} {dict(rows.dtypes)[key]}, component int, n long, deviation long, whitened double, explained double, identity_error double"
    if made is None:
        dropped(fit)
        return embeddings.sparkSession.createDataFrame([], schema)
    k = min(components, len(made.values))
    error = identity_error(fit, made, k)
    dropped(fit)
    explained = made.values[:k] / made.trace if made.trace > 0 else np.full(k, np.nan)
    n, whiten = made.centre.n, projected(made, k)

    def work(batches):
        import pyarrow as pa

        names = [key, "component", "n", "deviation", "whitened", "explained", "identity_error"]
        for batch in batches:
            m = batch.num_rows
            if not m:
                continue
            x = _matrix(batch.column("x"))
            d = exact_centred(x, made.centre)
            if d.dtype == object or int(np.abs(d).max()) ** 2 * d.shape[1] >= 1 << 63:
                far = [int(v) for v in (d.astype(object) ** 2).sum(axis=1)]
                far = pa.array([v if v < 1 << 63 else None for v in far], pa.int64())
            else:
                far = pa.array((d * d).sum(axis=1))
            w = whiten(x).ravel()
            index = pa.array(np.repeat(np.arange(m), k))
            e = np.tile(explained, m)
            columns = [
                batch.column(key).take(index), pa.array(np.tile(np.arange(1, k + 1, dtype=np.int32), m)), pa.array(np.full(m * k, n)), far.take(index),
                pa.array(w, mask=~np.isfinite(w)), pa.array(e, mask=~np.isfinite(e)), pa.array([error] * (m * k), pa.float64()),
            ]
            yield pa.RecordBatch.from_arrays(columns, names)

    return arrow_map(rows, work, schema)
