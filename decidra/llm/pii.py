"""Personal data: exact patterns, and a skip-chain conditional random field that adds what they miss.

The patterns (e-mail, IP, card, phone) give the base spans.  The field's nodes are the tokens of a text that have a
digit or an at sign: what stands between white space, quotes, commas, semicolons, colons, equals signs, brackets (but round
ones) and the borders of base spans.  Neighbouring nodes share a chain potential; nodes with the same digits or letters, however far
apart, and nodes that end with the same seven digits or have the same mail domain share skip potentials, each with the next such node.
Tokens in base spans are observed; loopy belief propagation gives the others' marginals, so an entity that is written
as a pattern once is found where it is written otherwise.  The potentials are trained in numpy by pseudo-likelihood on
a bounded sample of texts, with the base spans as labels.

Defined results: null and empty texts have no spans.  Each row is judged by its own text, repeated rows alike; null
ids stay null; other columns are kept by ``found`` and ignored by the query; an empty table gives an empty result.
Base spans of different kinds may overlap; added ones overlap no span.
"""

from __future__ import annotations

import re
from bisect import bisect_right
from dataclasses import dataclass

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_or_empty

KINDS = ("email", "ip", "card", "phone")
#: Bounds of the training sample: texts, and nodes of each text.
SAMPLE_TEXTS, SAMPLE_NODES = 2000, 100
#: Least marginal probability of an added span; rounds of message passing.
SURE, ROUNDS = 0.9, 12

_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_LOCALS = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_IP = re.compile(r"(?<![0-9])[0-9]++\.[0-9]++\.[0-9]++\.[0-9]++")
_CARD = re.compile(r"[0-9](?:[ -]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][ ().0-9-]+[0-9]")
_DIGIT = re.compile(r"[0-9]")
_MARK, _SPACE = re.compile(r"[0-9@]"), re.compile(r"\s")
_FIELD = re.compile(r"""[^"'`\u2018-\u201f\u00ab\u00bb,;:=\[\]{}<>]+""")


def _digits(s: str) -> str:
    return "".join(c for c in s if "0" <= c <= "9")


def luhn(digits: str) -> bool:
    total = 0
    for k, c in enumerate(reversed(digits)):
        d = int(c) * (1 + k % 2)
        total += d - 9 if d > 9 else d
    return total % 10 == 0


def _emails(text: str) -> list[tuple[str, int, int]]:
    out, end, at = [], 0, text.find("@")
    while at >= 0:
        start = at
        while start > end and text[start - 1] in _LOCALS:
            start -= 1
        m = _DOMAIN.match(text, at + 1) if start < at else None
        if m:
            end = m.end()
            out.append(("email", start, end))
        else:
            end = max(end, at + 1)  # the run before it can't start a match that passes this sign
        at = text.find("@", end)
    return out


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each kind's pattern; failing ones are dropped without a retry."""
    out = _emails(text) if "@" in text else []
    if not _DIGIT.search(text):
        return out
    for m in _IP.finditer(text):
        if all(len(p.lstrip("0")) <= 3 and int(p[-3:]) <= 255 for p in m.group().split(".")):
            out.append(("ip", m.start(), m.end()))
    for m in _CARD.finditer(text):
        if 14 <= m.end() - m.start() and 14 <= len(d := _digits(m.group())) <= 19 and luhn(d):
            out.append(("card", m.start(), m.end()))
    if "+" in text:
        for m in _PHONE.finditer(text):
            if 10 <= len(_digits(m.group())) <= 15:
                out.append(("phone", m.start(), m.end()))
    return out


def nodes(text: str, base: list[tuple[str, int, int]] = ()) -> list[tuple[int, int]]:
    """Places of the tokens with a digit or an at sign, without punctuation around them; none lies across a border of a base span."""
    out, borders = [], sorted({k for _, start, end in base for k in (start, end)})
    for at in _runs(text):
        for m in _FIELD.finditer(text, *at):
            cuts = borders[bisect_right(borders, m.start()) : bisect_right(borders, m.end() - 1)]
            for a, z in zip([m.start(), *cuts], [*cuts, m.end()], strict=True):
                if not _MARK.search(text, a, z):
                    continue
                while a < z and not (text[a].isalnum() or text[a] in "+("):
                    a += 1
                while z > a and not (text[z - 1].isalnum() or text[z - 1] == ")"):
                    z -= 1
                if a < z:
                    out.append((a, z))
    return out


def _runs(text: str) -> list[tuple[int, int]]:
    """Tokens between white space that hold a digit or an at sign, in time linear in the text."""
    out, end = [], 0
    for m in _MARK.finditer(text):
        if m.start() < end:
            continue
        a = m.start()
        while a > end and not text[a - 1].isspace():
            a -= 1
        space = _SPACE.search(text, m.end())
        end = space.start() if space else len(text)
        out.append((a, end))
    return out


FEATURES = 26
_CUES = (("mail",), ("ip", "host", "server", "address"), ("card", "visa", "credit", "iban"), ("tel", "phone", "call", "mobile", "fax"))


def features(text: str, spans: list[tuple[int, int]]) -> np.ndarray:
    """What is seen of each node: its characters and the word before it."""
    out = np.zeros((len(spans), FEATURES), np.float32)
    for k, (a, z) in enumerate(spans):
        token, x = text[a:z], out[k]
        d, n = len(_digits(token)), z - a
        dots, alphas = token.count("."), sum(c.isalpha() for c in token)
        x[0] = 1
        x[1 + min(6, d // 3)] = 1
        x[8], x[9], x[10], x[11] = "@" in token, dots == 3, dots > 0, alphas == 0
        x[12], x[13], x[14] = d == n, "-" in token, "(" in token or ")" in token
        x[15], x[16], x[17] = token[0] == "+", alphas > d, n > 30
        x[18] = bool(re.fullmatch(r"\d{1,3}(\.\d{1,3}){3}", token))
        x[19] = "@" in token and "." in token.partition("@")[2]
        x[20] = 13 <= d <= 19 and alphas == 0
        x[21] = d in (3, 7) and alphas == 0
        before = text[max(0, a - 24) : a].lower()
        for j, cues in enumerate(_CUES):
            x[22 + j] = any(c in before for c in cues)
    return out


def edges(text: str, spans: list[tuple[int, int]]) -> list[tuple[int, int, int]]:
    """(node, node, kind): 0 neighbours, 1 repeated tokens, 2 similar tokens; a node is linked with the next of each."""
    out, same, alike = [], {}, {}
    for k, (a, z) in enumerate(spans):
        if k and a - spans[k - 1][1] <= 3:
            out.append((k - 1, k, 0))
        token = text[a:z].lower()
        key = "".join(c for c in token if c.isalnum() or c == "@")
        d = _digits(token)
        like = token.rpartition("@")[2] if "@" in token else d[-7:] if len(d) >= 7 else ""
        if key in same:
            out.append((same[key], k, 1))
        if like and like in alike and alike[like] != same.get(key):
            out.append((alike[like], k, 2))
        same[key] = k
        if like:
            alike[like] = k
    return out


def observed(spans: list[tuple[int, int]], base: list[tuple[str, int, int]]) -> np.ndarray:
    """The label of each node by the base spans (0: none, else kind + 1); spans' borders part nodes, so they cover a node or miss it."""
    out, b, j = np.zeros(len(spans), np.int64), sorted(base, key=lambda s: s[1]), 0
    for k, (a, z) in enumerate(spans):
        while j < len(b) and b[j][2] <= a:
            j += 1
        i = j
        while i < len(b) and b[i][1] < z:
            if b[i][2] > a:
                out[k] = KINDS.index(b[i][0]) + 1
            i += 1
    return out


@dataclass
class Field:
    """Unary weights (features, labels), and pair weights (edge kind, label, label)."""

    unary: np.ndarray
    pair: np.ndarray

    def marginals(self, x: np.ndarray, links: np.ndarray, seen: np.ndarray) -> np.ndarray:
        """Marginals of all nodes by loopy sum-product with damping.  links: (a, b, kind) rows; seen: labels that are known, else 0."""
        labels = self.unary.shape[1]
        score = x @ self.unary
        known = seen > 0
        score[known] = -30
        score[known, seen[known]] = 0
        if len(links):
            a, b, kind = links.T
            source, goal = np.concatenate([a, b]), np.concatenate([b, a])
            table = np.concatenate([self.pair[kind], self.pair[kind].transpose(0, 2, 1)])
            back = np.concatenate([np.arange(len(a)) + len(a), np.arange(len(a))])
            m = np.zeros((len(source), labels))
            for _ in range(ROUNDS):
                belief = score + np.stack([np.bincount(goal, m[:, c], len(x)) for c in range(labels)], 1)
                sent = (belief[source] - m[back])[:, :, None] + table
                top = sent.max(1)
                new = top + np.log(np.exp(sent - top[:, None, :]).sum(1))
                m = 0.5 * m + 0.5 * (new - new.max(1, keepdims=True))
            score = score + np.stack([np.bincount(goal, m[:, c], len(x)) for c in range(labels)], 1)
        p = np.exp(score - score.max(1, keepdims=True))
        return p / p.sum(1, keepdims=True)


def neighbours(links: list[tuple[int, int, int]], y: np.ndarray) -> np.ndarray:
    """(node, edge kind, label): how many neighbours of each kind have each label."""
    out = np.zeros((len(y), 3, len(KINDS) + 1))
    if links:
        a, b, kind = np.array(links, np.int64).T
        np.add.at(out, (a, kind, y[b]), 1)
        np.add.at(out, (b, kind, y[a]), 1)
    return out


def sampled(text: str, spans: list[tuple[int, int]], most: int) -> list[int]:
    """At most ``most`` nodes of the whole text, by a hash of their tokens and numbers."""
    if len(spans) <= most:
        return list(range(len(spans)))
    hashed = lambda k: xxhash.xxh3_64_intdigest(f"{k} {text[slice(*spans[k])]}".encode("utf-8", "surrogatepass"))
    return sorted(sorted(range(len(spans)), key=hashed)[:most])


def train(x: np.ndarray, around: np.ndarray, y: np.ndarray, steps: int = 400, decay: float = 1e-3) -> Field:
    """Pseudo-likelihood: each node's label given its neighbours' labels (``around``), by gradient descent with momentum."""
    labels = len(KINDS) + 1
    unary, pair = np.zeros((FEATURES, labels)), np.zeros((3, labels, labels))
    pair[1] += 2.0 * np.eye(labels)
    pair[2] += 1.0 * np.eye(labels)
    if not len(x):
        unary[0, 0] = 3.0
        return Field(unary, pair)
    one = np.eye(labels)
    counts = around.transpose(1, 0, 2)
    start = pair.copy()
    speed = [np.zeros_like(unary), np.zeros_like(pair)]
    rate = np.where(np.bincount(y, minlength=labels) > 0, len(y) / labels / np.maximum(1, np.bincount(y, minlength=labels)), 0).clip(0.1, 5)[y]
    for _ in range(steps):
        score = x @ unary + sum(counts[k] @ pair[k] for k in range(3))
        p = np.exp(score - score.max(1, keepdims=True))
        d = (p / p.sum(1, keepdims=True) - one[y]) * rate[:, None] / len(y)
        g = [x.T @ d + decay * unary, np.stack([counts[k].T @ d for k in range(3)]) + decay * (pair - start)]
        for k, w in enumerate((unary, pair)):
            speed[k] = 0.9 * speed[k] - 0.5 * g[k]
            w += speed[k]
        pair = (pair + pair.transpose(0, 2, 1)) / 2
    return Field(unary, pair)


def fit(documents: DataFrame, sample_texts: int = SAMPLE_TEXTS, sample_nodes: int = SAMPLE_NODES) -> Field:
    """Trains on at most ``sample_texts`` texts with a digit or at sign, chosen by a hash of the text, and ``sample_nodes`` nodes of each, chosen by a hash from all of them."""

    def described(batches):
        import pyarrow as pa

        for b in slices(batches):
            cols = [[], [], []]
            for t in b.column("text").to_pylist():
                base = base_spans(t)
                spans = nodes(t, base)
                y, chosen = observed(spans, base), sampled(t, spans, sample_nodes)
                around = neighbours(edges(t, spans), y)[chosen]
                for c, v in zip(cols, (features(t, [spans[k] for k in chosen]).ravel().tolist(), around.astype(np.float32).ravel().tolist(), y[chosen].tolist()), strict=True):
                    c.append(v)
            yield pa.RecordBatch.from_arrays([pa.array(cols[0], pa.list_(pa.float32())), pa.array(cols[1], pa.list_(pa.float32())), pa.array(cols[2], pa.list_(pa.int64()))], ["x", "around", "y"])

    with_node = documents.select(text_or_empty().alias("text")).where(F.col("text").rlike("[0-9@]"))
    # the ids of the sample are found by hashes first, so only its texts are gathered
    hashes = with_node.select(F.xxhash64("text").alias("h")).distinct().orderBy("h").limit(sample_texts).collect()
    if not hashes:
        return train(np.zeros((0, FEATURES)), np.zeros((0, 3, len(KINDS) + 1)), np.zeros(0, np.int64))
    most = hashes[-1].h
    rows = with_node.where(F.xxhash64("text") <= most).dropDuplicates(["text"]).limit(sample_texts).mapInArrow(described, "x array<float>, around array<float>, y array<long>").collect()
    rows = sorted(rows, key=lambda r: (r.y, r.around, r.x))
    x, around = (np.concatenate([np.array(r[c], np.float64) for r in rows]) for c in ("x", "around"))
    return train(x.reshape(-1, FEATURES), around.reshape(-1, 3, len(KINDS) + 1), np.concatenate([np.array(r.y, np.int64) for r in rows]))


def spans_of(texts: list[str], field: Field) -> list[tuple[list, list]]:
    """For each text its base spans and the added ones."""
    base = [base_spans(t) for t in texts]
    places = [nodes(t, b) for t, b in zip(texts, base, strict=True)]
    shift, xs, links, seen = 0, [], [], []
    for t, b, p in zip(texts, base, places, strict=True):
        if p:
            xs.append(features(t, p))
            links.append(np.array(edges(t, p), np.int64).reshape(-1, 3) + np.array([shift, shift, 0]))
            seen.append(observed(p, b))
            shift += len(p)
    if not xs:
        return [(b, []) for b in base]
    seen = np.concatenate(seen)
    p = field.marginals(np.concatenate(xs).astype(float), np.concatenate(links), seen)
    label = np.where((seen == 0) & (p[:, 1:].max(1) >= SURE), p[:, 1:].argmax(1) + 1, 0)
    out, k = [], 0
    for t, b, place in zip(texts, base, places, strict=True):
        added: list[list] = []
        for a, z in place:
            kind, k = label[k], k + 1
            if kind:
                if added and added[-1][0] == KINDS[kind - 1] and t[added[-1][2] : a].isspace() and a - added[-1][2] == 1:
                    added[-1][2] = z
                else:
                    added.append([KINDS[kind - 1], a, z])
        out.append((b, [tuple(s) for s in added]))
    return out


def found(documents: DataFrame, field: Field, make, columns: str, keep_text: bool = False) -> DataFrame:
    """Rows of ``documents`` (a string ``text``) with the columns that ``make(text, base, added)`` gives (a tuple), which replace any of their names.  No shuffle."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string(columns)
    kept = [f for f in documents.schema.fields if (keep_text or f.name != "text") and f.name not in made.names]
    shared = documents.sparkSession.sparkContext.broadcast(field)
    schema = StructType([*kept, *made.fields])

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            rows = [make(t, base, added) for t, (base, added) in zip(texts, spans_of(texts, shared.value), strict=True)]
            arrays = [pa.array([r[k] for r in rows], to_arrow_type(f.dataType)) for k, f in enumerate(made.fields)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *arrays], schema.names)

    return arrow_map(documents, work, schema)


def redacted(text: str, spans: list[tuple[str, int, int]]) -> str:
    """The text with each span, or union of overlapping ones, as its first kind in brackets."""
    out, end = [], 0
    for kind, a, z in sorted(spans, key=lambda s: (s[1], -s[2])):
        if a >= end:
            out += [text[end:a], f"[{kind}]"]
        end = max(end, z)
    return "".join([*out, text[end:]])
