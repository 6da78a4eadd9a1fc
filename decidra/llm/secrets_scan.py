"""Secrets: exact patterns, and a battery of randomness tests that adds what they miss.

Candidates are runs of 16 and more characters of base64 and its kin.  The alphabet of each is inferred from its
characters.  Three tests measure how random it is: chi-squared uniformity over the alphabet, runs (of kinds of characters, a word's capital being of the word's kind), and
serial dependence: how much less its neighbouring letters go together than those of the corpus's own words do, of which one
pass counts all pairs (a lag-one rank correlation where a string has few letters, or the corpus none).  Their p-values
come from rough models of ordinary strings and are joined by Fisher's sum; what that sum is worth is not taken from a
model but measured.  Every text gives strings of its own words for each class of length, in each of the forms that ordinary
candidates have: joined, with inner capitals and a number, with signs, as paths, in capitals, around a date.  A candidate's p-value is the
share of such strings that score as high, in the form in which that share is largest, so it holds whatever
forms a corpus has.  The Benjamini-Hochberg rule is applied within strata, of length and of whether both cases occur, to the
p-values of all candidates of the corpus, by mergeable counts of scores, so long and short strings don't share a threshold.  Identifiers of the fixed form
of a UUID are no candidates: they are random, and no secrets.

Defined results: null and empty texts have no spans.  Each row is judged by its own text, repeated rows alike, and counts in
the corpus; null ids stay null; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import math
import re
import zlib
from bisect import bisect_right
from collections.abc import Sequence
from dataclasses import dataclass
from itertools import accumulate, chain

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, slices, text_or_empty, written
from .spans import Taken

KINDS = ("assign", "access", "hex", "random")
#: Rate of false discoveries, and the lower ends of the classes of length.
RATE, CLASSES = 0.01, (16, 24, 32, 48, 96)
BINS_PER_DECADE, MOST_BIN = 20, 800

_words = "|".join("".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in w) for w in ("password", "passwd", "secret", "token", "api_?key"))
_ASSIGN = re.compile(rf"(?:{_words})[\"']? *[:=] *[\"']?([A-Za-z0-9+/_.=-]+)")
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{32,}")
_WORDS = re.compile(r"(?<![A-Za-z0-9+/_=-])[A-Za-z][a-z]*(?![A-Za-z0-9+/_=-])")
_CANDIDATE = re.compile(r"[A-Za-z0-9+/_=-]{16,}")
_UUID = re.compile(r"[0-9A-Fa-f]{8}(?:-[0-9A-Fa-f]{4}){3}-[0-9A-Fa-f]{12}")
_ALPHABETS = (("hex", frozenset("0123456789abcdef")), ("HEX", frozenset("0123456789ABCDEF")), ("base32", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZ234567")), ("base36", frozenset("abcdefghijklmnopqrstuvwxyz0123456789")), ("base64", frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/_-")))
_SIZE = {"hex": 16, "HEX": 16, "base32": 32, "base36": 36, "base64": 64}
#: Sum of squared frequencies of ordinary text in each alphabet: decimal digits for hex, letters else.
_ORDINARY = {"hex": 0.1, "HEX": 0.1, "base32": 0.066, "base36": 0.066, "base64": 0.066}
#: Rough models of ordinary strings for the scores: changes between kinds of characters, and lag-one correlation.
_CHANGES, _CORRELATION = 0.08, 0.5


def base_spans(text: str) -> list[tuple[str, int, int]]:
    """Leftmost non-overlapping matches of each pattern; failing ones are dropped without a retry."""
    out = [("assign", m.start(), m.end()) for m in _ASSIGN.finditer(text) if m.end(1) - m.start(1) >= 8]
    out += [("access", m.start(), m.end()) for m in _ACCESS.finditer(text) if m.end() - m.start() >= 16]
    return out + [("hex", m.start(), m.end()) for m in _HEX.finditer(text)]


def encoding(token: str) -> str:
    """The smallest alphabet that holds all characters."""
    seen = set(token)
    return next((name for name, chars in _ALPHABETS if seen <= chars), "base64")


def _normal(z: float) -> float:
    return 0.5 * math.erfc(-z / math.sqrt(2))


@dataclass(frozen=True)
class Pairs:
    """Log-odds of neighbouring letters in the corpus's words against chance, and their mean and variance there."""

    odds: np.ndarray
    mean: float
    variance: float

    @classmethod
    def of(cls, counts: np.ndarray) -> Pairs | None:
        """Of counts (26, 26) of letters and what follows them; None if there are too few to tell."""
        total = counts.sum()
        if total < 1000:
            return None
        rows = counts.sum(axis=1, keepdims=True)
        after = (counts + counts.sum(axis=0) / total * 26) / (rows + 26)  # rare letters are followed by what is frequent
        odds = np.log(26 * np.maximum(after, 1e-6))
        share = counts / total
        mean = float((share * odds).sum())
        return cls(odds, mean, float((share * (odds - mean) ** 2).sum()))


def letter_pairs(text: bytes) -> np.ndarray:
    """Counts (26 * 26) of neighbouring letters, in any case."""
    codes = np.frombuffer(text, np.uint8) & 0xDF  # upper case
    letter = (codes >= 65) & (codes <= 90) & (np.frombuffer(text, np.uint8) >= 65)
    both = letter[1:] & letter[:-1]
    return np.bincount((codes[:-1][both].astype(np.int64) - 65) * 26 + codes[1:][both] - 65, minlength=676)


def corpus_pairs(documents: DataFrame) -> Pairs | None:
    """The pairs of all texts; each task sends one row of counts."""

    def work(batches):
        import pyarrow as pa

        total = np.zeros(676, np.int64)
        for b in batches:
            for t in b.column("text").to_pylist():
                if t and len(t) > 1:
                    total += letter_pairs(t.encode("ascii", "replace"))
        yield pa.RecordBatch.from_arrays([pa.array([total.tolist()], pa.list_(pa.int64()))], ["counts"])

    parts = arrow_map(documents.select("text"), work, "counts array<long>")
    rows = parts.select(F.posexplode("counts").alias("k", "n")).groupBy("k").agg(F.sum("n").alias("n")).collect()
    counts = np.zeros(676)
    for r in rows:
        counts[r.k] = r.n
    return Pairs.of(counts.reshape(26, 26))


#: For each character the alphabets that hold it, as bits.
_BITS = np.array([sum(1 << k for k, (_, chars) in enumerate(_ALPHABETS) if chr(c) in chars) for c in range(128)])
_FIRST = np.array([next((k for k in range(len(_ALPHABETS)) if bits >> k & 1), len(_ALPHABETS) - 1) for bits in range(1 << len(_ALPHABETS))])
_SIZES, _SQUARES = (np.array([t[name] for name, _ in _ALPHABETS], float) for t in (_SIZE, _ORDINARY))
_MOST = 12.0  # decades that one test counts for at most


def _decades(z: np.ndarray) -> np.ndarray:
    """-log10 of the normal distribution at ``z``."""
    return np.array([min(_MOST, -math.log10(max(_normal(v), 1e-300))) for v in z.tolist()])


def scores(tokens: Sequence[str], pairs: Pairs | None = None) -> np.ndarray:
    """Fisher's sum of the three tests of each token, in decades; 0 for tokens that are too short."""
    stripped = [t.rstrip("=") for t in tokens]
    out = np.zeros(len(tokens))
    live = [k for k, t in enumerate(stripped) if len(t) >= 4]
    for start in range(0, len(live), 1024):
        part = live[start : start + 1024]
        out[part] = _scores([stripped[k] for k in part], pairs)
    return out


def _scores(tokens: list[str], pairs: Pairs | None) -> np.ndarray:
    codes = np.frombuffer("".join(tokens).encode(), np.uint8).astype(np.int64)
    n = np.array([len(t) for t in tokens])
    first = np.cumsum(n) - n
    owner = np.repeat(np.arange(len(n)), n)
    count = lambda mask, of: np.bincount(of[mask], minlength=len(n)).astype(float)
    kind_of = _FIRST[np.bitwise_and.reduceat(_BITS[codes], first)]
    size, squares = _SIZES[kind_of], _SQUARES[kind_of]
    same = (np.bincount(owner * 128 + codes, minlength=len(n) * 128).reshape(-1, 128).astype(float) ** 2).sum(axis=1)
    extra = size * squares - 1
    chi, mean, spread = same * size / n - n, size - 1 + (n - 1) * extra, np.sqrt(2 * (size - 1) + 4 * (n - 1) * extra)
    uniform = _decades((chi - mean) / spread)
    kind = np.select([codes < 48, codes < 58, codes < 91, codes == 95], [0, 1, 2, 0], 3)
    capital = (kind[:-1] == 2) & (kind[1:] == 3) & (owner[1:] == owner[:-1])
    kind[:-1][capital] = 3  # a capital before a small letter starts a word and is of its kind
    signed = kind > 0  # signs join words, and are rare in encoded bytes
    k, of = kind[signed], owner[signed]
    within = of[1:] == of[:-1]
    steps, changed = count(within, of[1:]), count(within & (k[1:] != k[:-1]), of[1:])
    with np.errstate(all="ignore"):
        share = np.where(steps > 0, changed / np.maximum(steps, 1), 0.0)
        stay = np.where(share < 1, (1 - share) * np.log(np.maximum(1 - share, 1e-300) / (1 - _CHANGES)), 0.0)
        runs = np.where(share > _CHANGES, (n - 1) * (share * np.log(np.maximum(share, 1e-300) / _CHANGES) + stay), 0.0) / math.log(10)
    return uniform + np.minimum(runs, _MOST) + _serial(codes, owner, n, first, pairs, count)


def _serial(codes: np.ndarray, owner: np.ndarray, n: np.ndarray, first: np.ndarray, pairs: Pairs | None, count) -> np.ndarray:
    upper = np.where(codes >= 97, codes - 32, codes)
    letter = (upper >= 65) & (upper <= 90)
    both = letter[1:] & letter[:-1] & (owner[1:] == owner[:-1])
    m = count(both, owner[1:])
    few = m < 6 if pairs is not None else np.ones(len(n), bool)
    out = np.zeros(len(n))
    if pairs is not None:
        odds = np.bincount(owner[1:][both], pairs.odds[upper[:-1][both] - 65, upper[1:][both] - 65], len(n))
        with np.errstate(all="ignore"):
            z = (odds - m * pairs.mean) / np.sqrt(m * max(pairs.variance, 1e-9))
        out[~few] = _decades(z[~few])
    for k in np.flatnonzero(few).tolist():
        c = codes[first[k] : first[k] + n[k]]
        rank = np.searchsorted(np.unique(c), c).astype(float)
        a, b = rank[:-1] - rank[:-1].mean(), rank[1:] - rank[1:].mean()
        scale = math.sqrt(float((a * a).sum() * (b * b).sum()))
        r = min(0.999, abs(float((a * b).sum()) / scale)) if scale else 0.999
        out[k] = _decades(np.array([(math.atanh(r) - math.atanh(_CORRELATION)) * math.sqrt(max(1, int(n[k]) - 3))]))[0]
    return out


def ordinary(text: str) -> list[tuple[int, str]]:
    """(class, string): joined words of the text for each class of length that they fill, from a hashed place on."""
    return [(k, string) for k, string, *_ in _drawn(text)]


def _drawn(text: str, draws: int = 1) -> list[tuple[int, str, list[str], int]]:
    """(class, joined words cut to a length, the words, a hash), ``draws`` of each class under 48 characters and one of each other."""
    words = _WORDS.findall(text)
    out, total = [], sum(map(len, words))
    crc = zlib.crc32(text.encode("utf-8", "surrogatepass"))
    ends = list(accumulate(map(len, words)))
    for k, low in enumerate(CLASSES):
        high = CLASSES[k + 1] if k + 1 < len(CLASSES) else 2 * low
        for j in range(draws if low < 48 else 1):
            seed = (crc * (2 * j + 1) + j * 0x9E3779B9) & 0xFFFFFFFF
            n = low + (seed >> 3 * k) % (high - low)
            if total < n:
                continue
            first = bisect_right(ends, (seed * (2 * k + 1) + k) % (total - n + 1))
            start = ends[first] - len(words[first])
            if total - start < n:  # the last words
                first = bisect_right(ends, total - n)
            taken, have = [], 0
            for w in words[first:]:
                taken.append(w)
                have += len(w)
                if have >= n:
                    break
            if have >= n:
                out.append((k, "".join(taken)[:n], taken, seed >> 3 * k & 0xFFFF))
    return out


#: The forms of ordinary strings, see :func:`shaped`; strings of each form that a text gives for each short class.
FORMS, DRAWS = 6, 2
#: The forms in which both cases occur.
MIXED = (1, 5)


def shaped(text: str) -> list[tuple[int, int, str]]:
    """(class, form, string) of the text's own words for each class of length that they fill, in each form."""
    out = []
    for k, string, words, h in _drawn(text, DRAWS):
        n = len(string)
        number = str(h * 2654435761 % 100_000)[: 1 + h % 5]
        at = h % max(1, min(3, len(words)))
        head, tail = words[: at + 1], words[at + 1 :]
        date = f"{1990 + h % 40}-{1 + h % 12:02}-{1 + h % 28:02}"
        forms = [
            string.lower(), "".join([*(w.capitalize() for w in head), number, *(w.capitalize() for w in tail)]), "_".join([*(w.lower() for w in head), number, *(w.lower() for w in tail)]),
            "/".join([*(w.lower() for w in head), *(w.lower() + number for w in tail[:1]), *(w.lower() for w in tail[1:])]), "_".join([*(w.upper() for w in head), *(w.upper() for w in tail), number]), "-".join([*(w.capitalize() for w in head[:1]), date, *head[1:], *tail]),
        ]
        cut = [(form, whole[:n]) for form, whole in enumerate(forms)]
        out += [(k, form, whole) for form, whole in cut if stratum(whole) % 2 == (form in MIXED)]  # a form's strings are of one stratum
    return out


def bins(tokens: Sequence[str], pairs: Pairs | None = None) -> list[int]:
    return np.minimum(MOST_BIN, scores(tokens, pairs) * BINS_PER_DECADE).astype(int).tolist()


def p_bin(token: str, pairs: Pairs | None = None) -> int:
    return bins([token], pairs)[0]


def length_class(n: int) -> int:
    return max(k for k, low in enumerate(CLASSES) if n >= low)


def stratum(token: str) -> int:
    """The class of length, and whether letters of both cases occur: the encodings of one case have other null strings."""
    return 2 * length_class(len(token)) + (token != token.lower() and token != token.upper())


def scanned(documents: DataFrame, pairs: Pairs | None = None) -> DataFrame:
    """Rows of ``documents`` without the text, with base spans, candidates (start, end, class, bin of the score) and the classes, forms and
    bins of ordinary strings."""
    from pyspark.sql.types import StructType, _parse_datatype_string

    made = _parse_datatype_string("base array<struct<kind:string,start:long,end:long>>, candidates array<struct<start:long,end:long,class:int,bin:int>>, ordinary array<struct<class:int,form:int,bin:int>>")
    kept = [f for f in documents.schema.fields if f.name not in {"text", *made.names, "added"}]
    schema = StructType([*kept, *made.fields])

    def work(batches):
        import pyarrow as pa
        from pyspark.sql.pandas.types import to_arrow_type

        for b in slices(batches):
            texts = [t or "" for t in b.column("text").to_pylist()]
            spans = [base_spans(t) for t in texts]
            bases = [[{"kind": k, "start": a, "end": z} for k, a, z in base] for base in spans]
            candidates, plain = [], []
            for t, base in zip(texts, spans, strict=True):
                taken = Taken(base)
                free = (m for m in _CANDIDATE.finditer(t) if not taken.overlaps(m.start(), m.end()) and not _UUID.fullmatch(m.group()))
                candidates.append([{"start": m.start(), "end": m.end(), "class": stratum(m.group()), "bin": m.group()} for m in free])
                plain.append([{"class": stratum(x), "form": form, "bin": x} for _, form, x in shaped(t)])
            every = list(chain.from_iterable(chain(candidates, plain)))
            for e, value in zip(every, bins([e["bin"] for e in every], pairs), strict=True):
                e["bin"] = value
            arrays = [pa.array(v, to_arrow_type(f.dataType)) for v, f in zip((bases, candidates, plain), made.fields, strict=True)]
            yield pa.RecordBatch.from_arrays([*(b.column(f.name) for f in kept), *arrays], schema.names)

    return arrow_map(documents, work, schema)


def thresholds(counts: dict[tuple[int, int], int], plain: dict[tuple, int], rate: float = RATE) -> dict[int, int]:
    """The least bin of each class of length that passes; counts of candidates by (class, bin), of ordinary strings by (class,
    bin) or (class, form, bin).

    A candidate's p-value is one more than the ordinary strings of its class in its bin or a higher one, of one more than all;
    of several forms the largest counts.
    """
    out = {}
    for c in {k for k, _ in counts}:
        mine = sorted(((b, n) for (k, b), n in counts.items() if k == c), reverse=True)
        forms: dict[object, list[tuple[int, int]]] = {}
        for key, n in plain.items():
            if key[0] == c:
                forms.setdefault(key[1:-1], []).append((key[-1], n))
        nulls = [sorted(v, reverse=True) for v in forms.values()] or [[]]
        every, above, at = [sum(n for _, n in null) for null in nulls], [0] * len(nulls), [0] * len(nulls)
        total, passed = sum(n for _, n in mine), 0
        for b, n in mine:
            passed += n
            for k, null in enumerate(nulls):
                while at[k] < len(null) and null[at[k]][0] >= b:
                    above[k] += null[at[k]][1]
                    at[k] += 1
            p = max((1 + a) / (1 + e) for a, e in zip(above, every, strict=True))
            if p * total <= rate * passed:
                out[c] = b
    return out


def found(documents: DataFrame, rate: float = RATE) -> DataFrame:
    """Rows without the text, with ``base`` and ``added``: arrays of (kind, start, end)."""
    rows = written(scanned(documents, corpus_pairs(documents)), "secrets")

    def counts(column: str, *by: str) -> dict[tuple, int]:  # at most 2 * len(CLASSES) * FORMS * (MOST_BIN + 1) rows
        found_rows = rows.select(F.explode(column).alias("c")).groupBy(*(F.col(f"c.{x}").alias(x) for x in by)).count().collect()
        return {tuple(r[:-1]): r["count"] for r in found_rows}

    limits = thresholds(counts("candidates", "class", "bin"), counts("ordinary", "class", "form", "bin"), rate)
    passes = lambda c: F.coalesce(*(F.when((c["class"] == k) & (c["bin"] >= b), F.lit(True)) for k, b in limits.items()), F.lit(False))
    added = F.transform(F.filter("candidates", passes), lambda c: F.struct(F.lit("random").alias("kind"), c["start"].alias("start"), c["end"].alias("end")))
    return rows.withColumn("added", added).drop("candidates", "ordinary")
