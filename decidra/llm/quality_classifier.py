"""Quality classifier by co-training.

Two logistic classifiers see different views of a text: its content (shares of kinds of characters, words and lines,
and hashed words), and its page's metadata (language, source, stated and measured length).  Over rounds each labels
the unlabelled texts that it is surest of, and these go into the other's training set.  Held-out labelled rows then
calibrate both, and the calibrated log-odds of the views are added to score all texts.

The classifiers are fitted on bounded samples of labelled and of unlabelled rows (parameters below); every row is
scored by its whole text, without a shuffle.

Defined results: null and empty texts have zero features and get a score like any other; null metadata is a value of its
own.  Without labels of both classes every score is the share of good labels (0.5 without labels).  Of several
labels of one id the largest counts.  Repeated rows get equal scores, null ids are kept and never learned from,
other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, slices, text_or_empty

#: Bounds of the samples, rounds, and pseudo-labels that a view gives in a round at most.
LABELLED, UNLABELLED, ROUNDS, EXCHANGED = 4000, 6000, 4, 300
#: Surety from which a pseudo-label is given.
SURE = 0.95
WORD_BITS, META_BITS, STATISTICS = 10, 8, 14
WORD = re.compile(r"\w+")


def content(text: str) -> np.ndarray:
    """The content view."""
    x = np.zeros(STATISTICS + (1 << WORD_BITS), np.float32)
    words = WORD.findall(text)
    n, chars = len(words), len(text)
    x[0] = 1
    if not chars:
        return x
    known = held("word buckets", dict)
    if len(known) > 500_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = zlib.crc32(w.lower().encode("utf-8", "surrogatepass")) & ((1 << WORD_BITS) - 1)
    raw = np.frombuffer(text.encode("utf-8", "surrogatepass"), np.uint8)
    count = np.bincount(raw, minlength=256)
    size = len(raw)
    lines = text.split("\n")
    x[1] = count[65:91].sum() / size * 3
    x[2] = count[48:58].sum() / size * 3
    x[3] = count[[35, 36, 37, 38, 42, 60, 62, 124]].sum() / size * 5
    x[4] = count[[33, 63]].sum() / size * 10
    x[5] = count[[46, 44, 59, 58]].sum() / size * 10
    x[6] = count[32] / size * 3
    x[7] = n / max(1, chars) * 3
    x[8] = len(set(words)) / max(1, n)
    x[9] = 1 - len(set(lines)) / len(lines)
    x[10] = math.log1p(n) / 8
    x[11] = math.log1p(len(lines)) / 5
    x[12] = sum(map(len, words)) / max(1, n) / 10
    x[13] = n < 20
    if n:
        tf = np.log1p(np.bincount(np.fromiter(map(known.__getitem__, words), np.int64, n), minlength=1 << WORD_BITS))
        x[STATISTICS:] = tf / np.sqrt((tf * tf).sum())
    return x


def metadata(lang: str | None, source: str | None, n_chars: int | None) -> np.ndarray:
    """The metadata view; it reads nothing of the text."""
    x = np.zeros(3 + 3 * (1 << META_BITS), np.float32)
    x[0], x[1], x[2] = 1, math.log1p(max(0, n_chars or 0)) / 10, n_chars is None
    for k, v in enumerate((f"l{lang}", f"s{source}", f"n{int(math.log2(1 + max(0, n_chars or 0)) * 2)}")):
        x[3 + k * (1 << META_BITS) + (zlib.crc32(v.encode("utf-8", "surrogatepass")) & ((1 << META_BITS) - 1))] = 1
    return x


def _sigmoid(z):
    return 1 / (1 + np.exp(-np.clip(z, -30, 30)))


def logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray, ridge: float = 1e-3, steps: int = 200) -> np.ndarray:
    """Weights of a ridge logistic regression by accelerated gradient descent."""
    w = np.zeros(x.shape[1])
    v, scale = w.copy(), weight.sum()
    rate = 1 / (0.25 * float(np.einsum("ij,i->", x * x, weight)) / scale + ridge)
    for k in range(steps):
        g = x.T @ (weight * (_sigmoid(x @ v) - y)) / scale + ridge * v
        new = v - rate * g
        v = new + k / (k + 3) * (new - w)
        w = new
    return w


@dataclass
class CoTrained:
    content: np.ndarray
    metadata: np.ndarray
    scales: tuple[tuple[float, float], tuple[float, float]]
    prior: float
    trained: bool = True

    def scores(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Added calibrated log-odds of both views; the prior counts once."""
        if not self.trained:
            return np.full(len(a), self.prior)
        (s, t), (u, v) = self.scales
        base = math.log(max(1e-6, self.prior) / max(1e-6, 1 - self.prior))
        return _sigmoid(s * (a @ self.content) + t + u * (b @ self.metadata) + v - base)


def platt(z: np.ndarray, y: np.ndarray) -> tuple[float, float]:
    a, b = np.stack([z, np.ones_like(z)], 1), np.zeros(2)
    for _ in range(30):
        p = _sigmoid(a @ b)
        b = b - np.clip(np.linalg.solve((a * (p * (1 - p))[:, None]).T @ a + np.diag([1.0, 1e-3]), a.T @ (p - y) + np.array([b[0], 0])), -1, 1)
    return max(0.0, float(b[0])), float(b[1])


def cotrain(a: np.ndarray, b: np.ndarray, y: np.ndarray, free_a: np.ndarray, free_b: np.ndarray, rounds: int = ROUNDS, exchanged: int = EXCHANGED, seed: int = 3) -> CoTrained:
    """Labelled views (a, b, y) and unlabelled ones."""
    prior = float(y.mean()) if len(y) else 0.5
    if len(set(y.tolist())) < 2:
        return CoTrained(np.zeros(a.shape[1] if a.ndim == 2 else 0), np.zeros(0), ((0, 0), (0, 0)), prior, False)
    kept = np.random.default_rng(seed).random(len(y)) < 0.25
    if len(set(y[kept].tolist())) < 2 or len(set(y[~kept].tolist())) < 2:
        kept = np.zeros(len(y), bool)
    fit = ~kept
    held = kept if kept.any() else fit
    views, free = (a, b), (free_a, free_b)
    extra = [[], []]  # for each view: (index of an unlabelled row, label)
    used = np.zeros(len(free_a), bool)
    balance = lambda t: np.where(t == 1, 0.5 / max(1e-9, t.mean()), 0.5 / max(1e-9, 1 - t.mean()))

    def trained(k: int) -> np.ndarray:
        rows = np.array([i for i, _ in extra[k]], np.int64)
        x = np.concatenate([views[k][fit], free[k][rows]])
        t = np.concatenate([y[fit], np.array([v for _, v in extra[k]], float)])
        return logistic(x, t, balance(t) * np.concatenate([np.ones(fit.sum()), np.full(len(rows), 0.5)]))

    for _ in range(rounds):
        for k in (0, 1):
            w = trained(k)
            s, t = platt(views[k][held] @ w, y[held])
            p = _sigmoid(s * (free[k] @ w) + t)
            for label, sure, share in ((1.0, p, prior), (0.0, 1 - p, 1 - prior)):
                order = np.argsort(-sure, kind="stable")
                chosen = [i for i in order if sure[i] >= SURE and not used[i]][: max(1, int(exchanged * share))]
                extra[1 - k] += [(i, label) for i in chosen]
                used[chosen] = True
    w = [trained(0), trained(1)]
    return CoTrained(w[0], w[1], tuple(platt(views[k][held] @ w[k], y[held]) for k in (0, 1)), prior)


def _views(b) -> tuple[np.ndarray, np.ndarray]:
    texts = [t or "" for t in b.column("text").to_pylist()]
    meta = zip(b.column("lang").to_pylist(), b.column("source").to_pylist(), b.column("n_chars").to_pylist(), strict=True)
    return np.stack([content(t) for t in texts]), np.stack([metadata(*m) for m in meta])


def _inputs(documents: DataFrame) -> DataFrame:
    return documents.select("doc_id", text_or_empty().alias("text"), F.col("lang").cast("string").alias("lang"), F.col("source").cast("string").alias("source"), F.col("n_chars").cast("long").alias("n_chars"))


def fit(documents: DataFrame, labels: DataFrame, learned=None, labelled: int = LABELLED, unlabelled: int = UNLABELLED) -> CoTrained:
    """``learned``: a condition on doc_id for the labels that may be used (all, if None).  Samples go by a hash of the id; of an
    id with several rows one is taken."""
    spark = documents.sparkSession
    rows = labels.where("doc_id is not null and quality in (0, 1)").groupBy("doc_id").agg(F.max("quality").cast("double").alias("y"))
    rows = rows.where(learned) if learned is not None else rows
    known = rows.orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled).collect()
    ids = {r.doc_id: r.y for r in known}
    pool = [r.doc_id for r in documents.where("doc_id is not null").select("doc_id").distinct().orderBy(F.xxhash64("doc_id"), "doc_id").limit(labelled + unlabelled).collect() if r.doc_id not in ids][:unlabelled]
    if not ids:
        return cotrain(np.zeros((0, 1)), np.zeros((0, 1)), np.zeros(0), np.zeros((0, 1)), np.zeros((0, 1)))
    chosen = F.broadcast(spark.createDataFrame([(k, float(v)) for k, v in ids.items()] + [(k, None) for k in pool], "_id long, y double"))

    def work(batches):
        import pyarrow as pa

        for b in slices(batches):
            a, m = _views(b)
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), b.column("y"), pa.array([v.tobytes() for v in a.astype(np.float16)], pa.binary()), pa.array([v.tobytes() for v in m.astype(np.float16)], pa.binary())], ["doc_id", "y", "a", "b"])

    inputs = _inputs(documents)
    # one row of each id: the sample bounds rows only then
    one = inputs.join(chosen, inputs.doc_id == F.col("_id")).groupBy("_id").agg(F.max("y").alias("y"), F.min(F.struct("text", "lang", "source", "n_chars")).alias("d"))
    got = one.select(F.col("_id").alias("doc_id"), "d.*", "y").mapInArrow(work, "doc_id long, y double, a binary, b binary").collect()
    got = sorted(got, key=lambda r: (r.doc_id, r.a, r.b))
    view = lambda name, has: np.stack([np.frombuffer(r[name], np.float16) for r in got if (r.y is not None) == has]).astype(np.float64) if any((r.y is not None) == has for r in got) else np.zeros((0, len(np.frombuffer(got[0][name], np.float16))) if got else (0, 1))
    return cotrain(view("a", True), view("b", True), np.array([r.y for r in got if r.y is not None]), view("a", False), view("b", False))


def score(documents: DataFrame, model: CoTrained) -> DataFrame:
    """(doc_id, score) of each row of ``documents`` (doc_id, text, lang, source, n_chars): the probability of good quality."""
    shared = documents.sparkSession.sparkContext.broadcast(model)

    def work(batches):
        import pyarrow as pa

        for b in slices(batches):
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(shared.value.scores(*_views(b)), pa.float64())], ["doc_id", "score"])

    return arrow_map(_inputs(documents).select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang", "source", "n_chars"), work, "doc_id long, score double")
