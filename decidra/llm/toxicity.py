"""Toxicity: a bidirectional gated recurrent network with attention pooling, trained in numpy.

Every word enters as two vectors: an embedding of the word and the mean of the embeddings of its character
n-grams, so stems with unseen endings are known too.  Texts are cut into overlapping windows of words; the
score of a text comes from its highest window.

Defined results: null and empty texts, and texts without a word, have no window and get the share of toxic
labels as score (never above 0.5).  Rows are scored one by one: repeated rows and ties get equal scores, null
ids are kept and never held out, other columns are ignored, an empty table gives an empty result.  Without
any labels of either class the model is untrained and every score is that share (0 without labels).
"""

from __future__ import annotations

import re
import zlib
from collections import Counter
from dataclasses import dataclass

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, slices, text_or_empty

WORD = re.compile(r"\w+")
CHAR_BITS, DIM, HIDDEN = 16, 8, 8
#: Words with a vector of their own: at most so many, found in so many windows of the sample at least; others share one.
VOCABULARY, LEAST_WINDOWS = 20_000, 4
WINDOW, STRIDE = 48, 32
NGRAMS = (3, 4, 5)
#: Bounds of the labelled sample that the network is fitted on, for each class, and of its windows for each text.
SAMPLE_TOXIC, SAMPLE_CLEAN, SAMPLE_WINDOWS = 1500, 4000, 10
#: Words whose input vectors a Python worker keeps.
CACHE_WORDS = 250_000


def windows_of(n: int) -> list[tuple[int, int]]:
    """Overlapping windows that cover all of ``n`` words; the last one ends with the text."""
    if n <= WINDOW:
        return [(0, n)] if n else []
    starts = list(range(0, n - WINDOW, STRIDE)) + [n - WINDOW]
    return [(s, s + WINDOW) for s in starts]


def ngram_buckets(words: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """Hash buckets of all character n-grams (with word ends) of all words, and the word that each belongs to."""
    codes = np.frombuffer(("\x02" + "\x03\x02".join(words) + "\x03").encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.uint64)
    owner = np.cumsum(codes == 2) - 1
    found, owners = [], []
    for n in NGRAMS:
        if len(codes) < n:
            continue
        h = np.full(len(codes) - n + 1, n, np.uint64)
        for k in range(n):
            h = h * np.uint64(0x100000001B3) + codes[k : len(codes) - n + 1 + k] * np.uint64(0x9E3779B97F4A7C15)
        inside = owner[: len(h)] == owner[n - 1 :]
        found.append((h[inside] >> np.uint64(64 - CHAR_BITS)).astype(np.int64))
        owners.append(owner[: len(h)][inside])
    found.append(np.zeros(len(words), np.int64))  # each word has one bucket at least
    owners.append(np.arange(len(words)))
    found, owners = np.concatenate(found), np.concatenate(owners)
    order = np.argsort(owners, kind="stable")
    return found[order], owners[order]


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -30, 30)))


def _segment_sum(rows: np.ndarray, at: np.ndarray, n: int) -> np.ndarray:
    return np.stack([np.bincount(at, rows[:, k], n) for k in range(rows.shape[1])], 1).astype(np.float32)


@dataclass
class Network:
    """Parameters by name, the calibration of the highest window and the score of texts without a word."""

    p: dict[str, np.ndarray]
    scale: tuple[float, float]
    empty: float
    vocabulary: dict[str, int]
    trained: bool = True

    @staticmethod
    def initial(vocabulary: dict[str, int], seed: int = 11) -> Network:
        r = np.random.default_rng(seed)
        f = lambda *s, k=0.3: (r.standard_normal(s) * k).astype(np.float32)
        h = HIDDEN
        p = {"word": f(len(vocabulary) + 1, DIM, k=0.05), "char": f(1 << CHAR_BITS, DIM, k=0.2), "in": f(2 * DIM, 6 * h), "in_b": np.zeros(6 * h, np.float32), "rec": f(2, h, 3 * h), "att": f(2 * h, h), "att_v": f(h), "out": f(2 * h), "out_b": np.zeros(1, np.float32)}
        return Network(p, (1.0, 0.0), 0.0, vocabulary)

    def embed(self, words: list[str], forget: np.ndarray | None = None) -> tuple[np.ndarray, tuple]:
        """The two joined vectors of each word, and what their gradient needs.  forget: words that are taken for unknown ones."""
        at_word = np.array([self.vocabulary.get(w, 0) for w in words])
        if forget is not None:
            at_word[forget] = 0
        grams, owner = ngram_buckets(words)
        count = np.bincount(owner, minlength=len(words)).astype(np.float32)[:, None]
        starts = np.searchsorted(owner, np.arange(len(words)))
        chars = np.add.reduceat(self.p["char"][grams], starts, axis=0) / np.sqrt(count)
        return np.concatenate([self.p["word"][at_word], chars], 1), (at_word, grams, owner, count)

    def inputs(self, words: list[str]) -> np.ndarray:
        """What the gates get from each word; it doesn't depend on the word's neighbours."""
        return self.embed(words)[0] @ self.p["in"] + self.p["in_b"]

    def forward(self, x: np.ndarray, mask: np.ndarray | None, keep: bool = False):
        """Logits of windows.  x: (time, windows, 6 * HIDDEN)."""
        h, (steps, n) = HIDDEN, x.shape[:2]
        states = np.empty((steps, n, 2 * h), np.float32)
        kept = []
        for way in (0, 1):
            u, state = self.p["rec"][way], np.zeros((n, h), np.float32)
            for t in range(steps) if way == 0 else range(steps - 1, -1, -1):
                g, from_x = state @ u, x[t, :, 3 * h * way : 3 * h * way + 3 * h]
                zr = 1 / (1 + np.exp(-(from_x[:, : 2 * h] + g[:, : 2 * h])))
                z, r = zr[:, :h], zr[:, h:]
                new = np.tanh(from_x[:, 2 * h :] + r * g[:, 2 * h :])
                after = new + z * (state - new)
                if mask is not None:
                    after = np.where(mask[t][:, None], after, state)
                if keep:
                    kept.append((way, t, state, z, r, new, g[:, 2 * h :]))
                state = after
                states[t, :, h * way : h * way + h] = state
        hidden = np.tanh(states.reshape(-1, 2 * h) @ self.p["att"])
        energy = (hidden @ self.p["att_v"]).reshape(steps, n)
        if mask is not None:
            energy = np.where(mask, energy, -1e9)
        weight = np.exp(energy - energy.max(0))
        weight /= weight.sum(0)
        pooled = np.einsum("tn,tnh->nh", weight, states)
        logits = pooled @ self.p["out"] + self.p["out_b"][0]
        return logits, (states, kept, hidden, weight, pooled)

    def gradients(self, words: list[str], at: np.ndarray, mask: np.ndarray, y: np.ndarray, cost: np.ndarray, forget: np.ndarray) -> tuple[dict, float]:
        """Gradients of the weighted cross-entropy.  at: (time, windows) indices into words."""
        p, h = self.p, HIDDEN
        emb, (at_word, grams, owner, count) = self.embed(words, forget)
        x = (emb @ p["in"] + p["in_b"])[at]
        logits, (states, kept, hidden, weight, pooled) = self.forward(x, mask, keep=True)
        prob = _sigmoid(logits)
        dl = ((prob - y) * cost / len(y)).astype(np.float32)
        loss = float(-(cost * (y * np.log(prob + 1e-7) + (1 - y) * np.log(1 - prob + 1e-7))).mean())
        g = {"out": pooled.T @ dl, "out_b": np.array([dl.sum()], np.float32)}
        d_pool = dl[:, None] * p["out"]
        d_states = weight[:, :, None] * d_pool
        d_weight = np.einsum("nh,tnh->tn", d_pool, states)
        d_energy = weight * (d_weight - (weight * d_weight).sum(0))
        flat = d_energy.reshape(-1)
        g["att_v"] = hidden.T @ flat
        d_hidden = flat[:, None] * p["att_v"] * (1 - hidden**2)
        g["att"] = states.reshape(-1, 2 * h).T @ d_hidden
        d_states = d_states + (d_hidden @ p["att"].T).reshape(states.shape)
        dx = np.zeros_like(x)
        g["rec"] = np.zeros_like(p["rec"])
        carried = [np.zeros((x.shape[1], h), np.float32) for _ in (0, 1)]
        for way, t, state, z, r, new, gn in reversed(kept):
            u = p["rec"][way]
            d = carried[way] + d_states[t, :, h * way : h * way + h]
            m = mask[t][:, None]
            passed, d = np.where(m, 0, d), np.where(m, d, 0)
            dz, dn = d * (state - new) * z * (1 - z), d * (1 - z) * (1 - new**2)
            dr = dn * gn * r * (1 - r)
            dg = np.concatenate([dz, dr, dn * r], 1)
            g["rec"][way] += state.T @ dg
            dx[t, :, 3 * h * way : 3 * h * way + 3 * h] = np.concatenate([dz, dr, dn], 1)
            carried[way] = d * z + dg @ u.T + passed
        d_in = _segment_sum(dx.reshape(-1, 6 * h), at.reshape(-1), len(words))
        g["in"], g["in_b"] = emb.T @ d_in, d_in.sum(0)
        d_emb = d_in @ p["in"].T
        g["word"] = _segment_sum(d_emb[:, :DIM], at_word, len(p["word"]))
        g["char"] = _segment_sum((d_emb[:, DIM:] / np.sqrt(count))[owner], grams, 1 << CHAR_BITS)
        return g, loss


def _pack(windows: list[list[str]]) -> tuple[list[str], np.ndarray, np.ndarray]:
    """The different words, their index by (time, window), and which places are filled."""
    index: dict[str, int] = {}
    steps = max(len(w) for w in windows)
    at, mask = np.zeros((steps, len(windows)), np.int64), np.zeros((steps, len(windows)), bool)
    for k, w in enumerate(windows):
        at[: len(w), k] = [index.setdefault(x, len(index)) for x in w]
        mask[: len(w), k] = True
    return list(index), at, mask


def train(examples: list[tuple[int, list[list[str]]]], share: float, epochs: int = 5, batch: int = 192, seed: int = 5) -> Network:
    """Fits the network on (label, windows) of each sampled text.

    Later epochs let only the higher windows of toxic texts speak for them.  A fifth of the texts is kept for the
    calibration, which weights the two classes as ``share``, the share of toxic labels, has them.
    """
    r = np.random.default_rng(seed)
    examples = [(y, ws) for y, ws in examples if ws]
    kept = r.random(len(examples)) < 0.2
    fitted = [e for e, k in zip(examples, kept, strict=True) if not k]
    seen = Counter(w for _, ws in fitted for window in ws for w in set(window))
    common = sorted((w for w, n in seen.items() if n >= LEAST_WINDOWS), key=lambda w: (-seen[w], w))[:VOCABULARY]
    net = Network.initial({w: k for k, w in enumerate(common, 1)})
    net.empty = min(0.5, share)
    if len({y for y, _ in fitted}) < 2:
        net.trained = False
        return net
    doc = np.array([k for k, (_, ws) in enumerate(fitted) for _ in ws])
    y = np.array([e[0] for e in fitted], np.float32)[doc]
    windows = [w for _, ws in fitted for w in ws]
    order = np.argsort([len(w) for w in windows], kind="stable")
    moment = {k: [np.zeros_like(v), np.zeros_like(v)] for k, v in net.p.items()}
    use, step, rate = np.ones(len(windows), bool), 0, 0.01
    epochs = max(epochs, min(20, 40_000 // len(windows)))
    for epoch in range(epochs):
        if epoch * 3 >= epochs:
            now = logits_of(net, windows)
            top = np.full(len(fitted), -np.inf)
            np.maximum.at(top, doc, now)
            use = np.where(y == 1, now >= np.minimum(top[doc] - 1e-6, 0), (now > -4) | (r.random(len(now)) < 0.5))
        chosen = order[use[order]]
        chosen = np.concatenate([r.permutation(chosen[k : k + batch * 8]) for k in range(0, len(chosen), batch * 8)])
        parts = [chosen[k : k + batch] for k in range(0, len(chosen), batch)]
        for b in r.permutation(len(parts)):
            part = parts[b]
            words, at, mask = _pack([windows[i] for i in part])
            g, _ = net.gradients(words, at, mask, y[part], np.ones(len(part), np.float32), r.random(len(words)) < 0.3)
            size = np.sqrt(sum(float((v**2).sum()) for v in g.values()))
            step += 1
            for name, v in g.items():
                v = v * min(1.0, 2.0 / max(size, 1e-9))
                m = moment[name]
                m[0] += 0.1 * (v - m[0])
                m[1] += 0.01 * (v * v - m[1])
                net.p[name] -= rate * (m[0] / (1 - 0.9**step)) / (np.sqrt(m[1] / (1 - 0.99**step)) + 1e-6)
        rate *= 0.75 if epochs <= 8 else 0.9
    judged = [e for e, k in zip(examples, kept, strict=True) if k]
    judged = judged if len({y for y, _ in judged}) == 2 else fitted
    flat = logits_of(net, [w for _, ws in judged for w in ws])
    top = np.maximum.reduceat(flat, np.cumsum([0, *(len(ws) for _, ws in judged)])[:-1])
    net.scale = calibrated(top, np.array([e[0] for e in judged], float), share)
    return net


def logits_of(net: Network, windows: list[list[str]]) -> np.ndarray:
    out, order = np.empty(len(windows), np.float32), np.argsort([len(w) for w in windows], kind="stable")
    for k in range(0, len(order), 1024):
        part = order[k : k + 1024]
        words, at, mask = _pack([windows[i] for i in part])
        out[part] = net.forward(net.inputs(words)[at], mask)[0]
    return out


def calibrated(x: np.ndarray, y: np.ndarray, share: float, rounds: int = 50) -> tuple[float, float]:
    """Slope and intercept of a ridge logistic fit by Newton steps, the classes weighted to a ``share`` of ones."""
    w = np.where(y == 1, share / max(1, y.sum()), (1 - share) / max(1, (1 - y).sum())) * len(y)
    a, b = np.stack([x, np.ones_like(x)], 1), np.array([0.5, 0.0])
    for _ in range(rounds):
        prob = _sigmoid(a @ b)
        g = a.T @ (w * (prob - y)) + np.array([0.5 * (b[0] - 0.5), 0.0])
        h = (a * (w * prob * (1 - prob))[:, None]).T @ a + np.diag([0.5, 1e-6])
        b = b - np.clip(np.linalg.solve(h, g), -1, 1)
    return max(float(b[0]), 0.05), float(b[1])


class Scorer:
    """Scores texts in a Python worker; remembers the input vectors of words that it has met."""

    def __init__(self, net: Network):
        self.net, self.known, self.x = net, {}, np.empty((0, 6 * HIDDEN), np.float32)

    def _learn(self, words: set[str]) -> None:
        new = sorted(w for w in words if w not in self.known)
        if not new:
            return
        if len(self.known) + len(new) > CACHE_WORDS:
            self.known, self.x, new = {}, self.x[:0], sorted(words)
        made = self.net.inputs(new).astype(np.float32)
        need = len(self.known) + len(new)
        if need > len(self.x):
            grown = np.empty((max(need, 2 * len(self.x), 4096), 6 * HIDDEN), np.float32)
            grown[: len(self.known)] = self.x[: len(self.known)]
            self.x = grown
        self.x[len(self.known) : need] = made
        self.known.update(zip(new, range(len(self.known), need), strict=True))

    def scores(self, texts: list[str | None]) -> np.ndarray:
        found = [WORD.findall((t or "").lower()) for t in texts]
        out = np.full(len(texts), self.net.empty)
        if not self.net.trained:
            return out
        self._learn(set().union(*found))
        get, full, doc, short = self.known.__getitem__, [], [], []
        for k, words in enumerate(found):
            ids = np.fromiter(map(get, words), np.int32, len(words))
            n = len(ids)
            if n >= WINDOW:
                starts = np.array([s for s, _ in windows_of(n)])
                full.append(ids[starts[:, None] + np.arange(WINDOW)])
                doc.append(np.full(len(starts), k))
            elif n:
                short.append((k, ids))
        top = np.full(len(texts), -np.inf)
        if full:
            full, doc = np.concatenate(full), np.concatenate(doc)
            for k in range(0, len(full), 2048):
                part = full[k : k + 2048].T
                np.maximum.at(top, doc[k : k + 2048], self.net.forward(self.x[part], None)[0])
        short.sort(key=lambda s: len(s[1]))
        for k in range(0, len(short), 512):
            part = short[k : k + 512]
            at, mask = np.zeros((len(part[-1][1]), len(part)), np.int32), np.zeros((len(part[-1][1]), len(part)), bool)
            for j, (_, ids) in enumerate(part):
                at[: len(ids), j], mask[: len(ids), j] = ids, True
            top[[d for d, _ in part]] = self.net.forward(self.x[at], mask)[0]
        has = np.isfinite(top)
        out[has] = _sigmoid(self.net.scale[0] * top[has] + self.net.scale[1])
        return out


def held_out(column: str = "doc_id"):
    """Rows that labels are never learned from."""
    return F.coalesce(F.crc32(F.col(column).cast("string")) % 3 == 1, F.lit(False))


def fit(documents: DataFrame, labels: DataFrame, sample_toxic: int = SAMPLE_TOXIC, sample_clean: int = SAMPLE_CLEAN, sample_windows: int = SAMPLE_WINDOWS) -> Network:
    """Trains on a bounded sample of the labelled rows that aren't held out.

    The sample has at most ``sample_toxic`` and ``sample_clean`` rows, chosen by a hash of the id, and at most
    ``sample_windows`` windows of each text.  A row with several labels counts as toxic if one of them is 1;
    of an id with several texts one is taken.
    """
    spark = documents.sparkSession
    rows = labels.select("doc_id", "toxic").where(F.col("doc_id").isNotNull() & F.col("toxic").isin(0, 1) & ~held_out()).groupBy("doc_id").agg(F.max("toxic").cast("int").alias("toxic"))
    seen = rows.agg(F.avg("toxic")).first()[0] or 0.0
    pick = lambda y, n: rows.where(F.col("toxic") == y).orderBy(F.xxhash64("doc_id"), "doc_id").limit(n).collect()
    chosen = pick(1, sample_toxic) + pick(0, sample_clean)
    if not chosen:
        return train([], seen)
    ids = F.broadcast(spark.createDataFrame([(r.doc_id, r.toxic) for r in chosen], "doc_id long, toxic int"))

    def cut(batches):
        import pyarrow as pa

        for b in slices(batches):
            made = []
            for t in b.column("text").to_pylist():
                words = WORD.findall((t or "").lower())
                spans = windows_of(len(words))
                keep = sorted({round(k) for k in np.linspace(0, len(spans) - 1, min(len(spans), sample_windows))}) if spans else []
                made.append([" ".join(words[a:z]) for a, z in (spans[k] for k in keep)])
            yield pa.RecordBatch.from_arrays([b.column("toxic"), pa.array(made, pa.list_(pa.string()))], ["toxic", "windows"])

    # one text of each id: the sample bounds rows only then
    got = documents.select("doc_id", text_or_empty().alias("text")).join(ids, "doc_id").groupBy("doc_id").agg(F.max("toxic").alias("toxic"), F.min("text").alias("text")).select("toxic", "text")
    got = arrow_map(got, cut, "toxic int, windows array<string>").collect()
    examples = sorted((r.toxic, [w.split(" ") for w in r.windows]) for r in got)
    return train(examples, seen)


def score(documents: DataFrame, net: Network, column: str = "toxicity") -> DataFrame:
    """``documents`` with one more column (or this one replaced), the score of the whole text.  No shuffle."""
    from pyspark.sql.types import DoubleType, StructField, StructType

    documents = documents.drop(column)
    key = zlib.crc32(net.p["out"].tobytes()).to_bytes(4, "big") + zlib.crc32(net.p["char"].tobytes()).to_bytes(4, "big")
    shared = documents.sparkSession.sparkContext.broadcast(net)

    def work(batches):
        import pyarrow as pa

        for b in slices(batches, rows=512):
            made = held(key, lambda: Scorer(shared.value)).scores(b.column("text").to_pylist())
            yield pa.RecordBatch.from_arrays([*b.columns, pa.array(made, pa.float64())], [*b.schema.names, column])

    return arrow_map(documents, work, StructType([*documents.schema.fields, StructField(column, DoubleType())]))
