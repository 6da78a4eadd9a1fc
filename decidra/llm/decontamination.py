"""Benchmark decontamination by templates.

Words, numbers and sentence ends are read from a text; numbers (English number words too), units after numbers and names
(words with a capital first that don't start a sentence, or that also stand within one) become typed placeholders.
Names that follow each other are one placeholder, and so is a number with the number words after it.  Windows of the template are
hash-joined with those of the benchmark items.  A second view keeps names as words, for passages whose punctuation or
case was changed.  Windows of which numbers and units are more than half say too little as a template; a third view joins
them with their values as they stand, so that copies are found and other numbers aren't.  The windows' places within a
stretch of the text, no longer than two items, cover a share of the item, and the placeholders' values must correspond both ways:
within one alignment, an item's value always stands for the same value of the text, and that for no other one.

The windows of a text are first held against a bit map of the benchmark's window hashes; its size has a fixed bound,
and what passes is joined by hash, so the benchmark itself may be of any size.

Defined results: null and empty texts and items match nothing; rows without an id match nothing, as they can't be
named.  Repeated rows of one id are judged together.  An item that is shorter than a window is one window; an item of
fewer than ``shortest`` words matches only a sentence, or several, of just these words and values.  Other columns are ignored; empty tables give an empty result.
"""

from __future__ import annotations

import re
from itertools import repeat

import numpy as np
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, slices, text_or_empty, written

WINDOW, SHORTEST = 8, 5
#: Least share of an item's words that must lie in matching windows, and of its slots that must correspond.
COVERAGE, CONSISTENT = 0.5, 0.8
#: Words that are covered at least for a match of a long item's part.
COVERED_WORDS = 40
#: Bits of the map of window hashes: 2 MB and 16 MB.
MAP_BITS, MAP_BITS_LARGE, LARGE = 24, 27, 1_000_000

TOKEN = re.compile(r"[^\W\d_]+|\d+(?:[.,]\d+)*|[.!?\n]")
#: Unit words, as they follow a number.
UNITS = frozenset("mm cm m km in inch inches ft foot feet yd yard yards mi mile miles mg g kg gram grams kilogram kilograms lb lbs pound pounds oz ounce ounces ml l liter liters litre litres gallon gallons s sec second seconds min minute minutes h hr hour hours day days week weeks month months year years dollar dollars cent cents euro euros usd eur percent degree degrees celsius fahrenheit kelvin watt watts volt volts amp amps joule joules newton newtons hz khz mhz ghz kb mb gb tb".split())
#: Number words.
SPELLED = frozenset("zero one two three four five six seven eight nine ten eleven twelve thirteen fourteen fifteen sixteen seventeen eighteen nineteen twenty thirty forty fifty sixty seventy eighty ninety hundred thousand million billion".split())
WORD, NAMELIKE, NUMBER, STOP, UNIT, NUMBER_WORD = range(6)
_BASE = np.uint64(0x9E3779B97F4A7C15)


def _about(token: str) -> int:
    """Hash and kind (the lowest three bits) of a token."""
    low = token.lower()
    kind = NAMELIKE if token[0].isupper() and len(token) > 1 else WORD
    if token in ".!?\n":
        kind = STOP
    elif token[0].isdigit():
        kind = NUMBER
    elif low in UNITS:
        kind = UNIT
    elif low in SPELLED:
        kind = NUMBER_WORD
    return (xxhash.xxh3_64_intdigest(low.encode("utf-8", "surrogatepass")) >> 4) << 3 | kind


def template(text: str | None) -> tuple[list[str], np.ndarray, np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """All tokens and which are words, these words' hashes, the type of each placeholder (0: an ordinary word, else its kind), which
    go on the placeholder before them, and which (one beyond the last, too) stand first after a sentence's end."""
    tokens = TOKEN.findall(text or "")
    known = held("template tokens", dict)
    if len(known) > 600_000:
        known.clear()
    got = np.fromiter(map(known.get, tokens, repeat(-1)), np.int64, len(tokens))
    for k in np.flatnonzero(got < 0).tolist():
        got[k] = known[tokens[k]] = _about(tokens[k])
    kind, h = got & 7, got >> 3
    after = np.concatenate([[STOP], kind[:-1]]) if len(kind) else kind
    keep = kind != STOP
    kind, h, after = kind[keep], h[keep].astype(np.uint64), after[keep]
    name = (kind == NAMELIKE) & (after != STOP)
    first = (kind == NAMELIKE) & ~name
    if name.any() and first.any():
        name[first] = np.isin(h[first], h[name])
    slot = np.where(name, NAMELIKE, 0)
    spelled = kind == NUMBER_WORD
    slot[(kind == NUMBER) | spelled] = NUMBER
    slot[(kind == UNIT) & ((after == NUMBER) | (after == NUMBER_WORD))] = UNIT
    before = np.concatenate([[0], slot[:-1]]) if len(slot) else slot
    goes_on = (after != STOP) & ((name & (before == NAMELIKE)) | (spelled & (before == NUMBER)))
    return tokens, np.flatnonzero(keep), h, slot, goes_on, np.append(after == STOP, True)


def _typed(slot: np.ndarray, view: int) -> np.ndarray:
    """Which words are placeholders in a view."""
    return slot > (0, NAMELIKE, UNIT)[view]


def seen(h: np.ndarray, slot: np.ndarray, goes_on: np.ndarray, view: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The places of a view: the first word of each, its hash, and whether it is a placeholder (in view 2: would be in view 1).

    View 0 has all placeholders, 1 keeps names as words, 2 keeps all values."""
    typed = _typed(slot, view)
    x = np.where(typed, slot.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93), h)
    if view == 2:
        return np.arange(len(h)), x, _typed(slot, 1)
    start = np.flatnonzero(~(goes_on & typed))
    return start, x[start], typed[start]


def windows(x: np.ndarray, n: int) -> np.ndarray:
    """Hashes of all windows of ``n`` places."""
    if len(x) < n:
        return np.empty(0, np.uint64)
    out = np.full(len(x) - n + 1, n, np.uint64)
    for k in range(n):
        out = out * _BASE + x[k : len(x) - n + 1 + k]
        out ^= out >> np.uint64(29)
    return out


def _literal(typed: np.ndarray, n: int) -> np.ndarray:
    """Places that aren't placeholders, in each window."""
    typed = np.concatenate([[0], np.cumsum(typed)])
    return n - (typed[n:] - typed[:-n])


#: ``pos`` counts the places of view 0, which values of other lengths don't shift; ``first`` to ``last`` are the words that the window covers.
WINDOW_SCHEMA = "id long, hash long, pos int, width int, first int, last int, words int, slots array<string>"


def _rows(batches, id_column: str, chosen):
    """Windows of texts as Arrow batches; ``chosen`` gives for a view's places the widths and windows to keep."""
    import pyarrow as pa

    for b in slices(batches):
        cols = [[] for _ in range(8)]
        for key, text in zip(b.column(id_column).to_pylist(), b.column("text").to_pylist(), strict=True):
            tokens, words, h, slot, goes_on, opens = template(text)
            place = np.cumsum(~goes_on) - 1
            for view in (0, 1, 2) if (slot == NAMELIKE).any() else (0, 2):
                start, x, typed = seen(h, slot, goes_on, view)
                for n, hashes, at in chosen(x, typed, view, opens):
                    for p in at:
                        where = np.flatnonzero(typed[p : p + n]) + p if view < 2 else ()
                        slots = [f"{slot[start[k]]}:{' '.join(tokens[words[j]].lower() for j in range(start[k], _end(start, k + 1, len(h))))}" for k in where]
                        values = (key, int(hashes[p].astype(np.int64)), int(place[start[p]]), n, int(start[p]), int(_end(start, p + n, len(h))) - 1, len(words), slots)
                        for c, v in zip(cols, values, strict=True):
                            c.append(v)
        kinds = [pa.int64(), pa.int64(), *[pa.int32()] * 5, pa.list_(pa.string())]
        yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, kinds, strict=True)], ["id", "hash", "pos", "width", "first", "last", "words", "slots"])


def _end(start: np.ndarray, k: int, words: int) -> int:
    """Where the words of place ``k - 1`` end."""
    return start[k] if k < len(start) else words


def item_windows(benchmark: DataFrame, shortest: int = SHORTEST) -> DataFrame:
    def chosen(x, typed, view, opens):
        n = min(WINDOW, len(x))
        if n >= shortest:
            yield n, windows(x, n), np.flatnonzero((_literal(typed, n) * 2 >= n) == (view < 2))
        elif n and view == 2:
            yield n, windows(x, n), (0,)

    rows = benchmark.select(F.col("item_id").cast("long").alias("id"), text_or_empty().alias("text")).where("id is not null")
    return arrow_map(rows, lambda batches: _rows(batches, "id", chosen), WINDOW_SCHEMA)


def bit_map(hashes: DataFrame, bits: int) -> np.ndarray:
    """The bit map of a column ``hash``; at most 2 ** (bits - 6) numbers reach the driver."""
    place = F.shiftrightunsigned("hash", 64 - bits)
    words = hashes.select(F.shiftright(place, 6).alias("word"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - bits}) & 63))").alias("bit")).groupBy("word").agg(F.bit_or("bit").alias("bits"))
    out = np.zeros(1 << (bits - 6), np.uint64)
    got = words.toPandas()
    out[got["word"].to_numpy(np.int64)] = got["bits"].to_numpy(np.int64).view(np.uint64)
    return out


def matches(documents: DataFrame, benchmark: DataFrame, coverage: float = COVERAGE, consistent: float = CONSISTENT, covered_words: int = COVERED_WORDS, shortest: int = SHORTEST) -> DataFrame:
    """(doc_id, item_id, coverage, consistency, kind) of each leaked item; kind: exact or re-parameterised."""
    items = written(item_windows(benchmark, shortest), "items")
    about = items.agg(F.count("*").alias("n"), F.collect_set("width").alias("widths")).first()
    bits, widths = MAP_BITS_LARGE if about.n > LARGE else MAP_BITS, sorted(about.widths)
    shared = documents.sparkSession.sparkContext.broadcast(bit_map(items, bits))

    def chosen(x, typed, view, opens):
        known = shared.value
        values = np.count_nonzero(typed) if view == 2 else 0
        for n in widths:
            if len(x) < n or (n < shortest and view < 2):
                continue
            if n < shortest:
                few = opens[: len(x) - n + 1] & opens[n:]
            # a text's first word may follow a number elsewhere, so one value less will do
            elif view == 2 and (2 * values < n - 1 or not (few := 2 * _literal(typed, n) <= n + 1).any()):
                continue
            w = windows(x, n)
            place = w >> np.uint64(64 - bits)
            marked = (known[(place >> np.uint64(6)).astype(np.int64)] >> (place & np.uint64(63))) & np.uint64(1)
            yield n, w, np.flatnonzero(marked if view < 2 else marked.astype(bool) & few)

    rows = documents.select(F.col("doc_id").cast("long").alias("id"), text_or_empty().alias("text")).where("id is not null")
    hits = arrow_map(rows, lambda batches: _rows(batches, "id", chosen), WINDOW_SCHEMA).select(F.col("id").alias("doc_id"), "hash", F.col("width").alias("doc_width"), F.col("pos").alias("doc_pos"), F.col("slots").alias("doc_slots"))
    found = hits.join(items, "hash").where("width = doc_width and size(slots) = size(doc_slots)").select("doc_id", F.col("id").alias("item_id"), "first", "last", "words", (F.col("doc_pos") - F.col("pos")).alias("shift"), "slots", "doc_slots")
    found = written(found, "hits")
    # a stretch is two items long and begins where another is half over, so an alignment that words shift lies in one
    stretch = F.floor(F.col("shift") / F.col("words"))
    places = found.select("doc_id", "item_id", "words", F.explode(F.array(stretch, stretch + 1)).alias("stretch"), "first", "last").distinct().select("doc_id", "item_id", "words", "stretch", F.explode(F.sequence("first", "last")).alias("place"))
    cover = places.groupBy("doc_id", "item_id", "stretch").agg(F.count_distinct("place").alias("covered"), F.max("words").alias("words")).groupBy("doc_id", "item_id").agg(F.max("covered").alias("covered"), F.max("words").alias("words"))
    slot = found.select("doc_id", "item_id", "shift", F.explode(F.arrays_zip("slots", "doc_slots")).alias("s")).select("doc_id", "item_id", "shift", F.col("s.slots").alias("was"), F.col("s.doc_slots").alias("now"))
    slot = slot.distinct()

    def constant(given: str, other: str) -> DataFrame:
        """How many of an alignment's values on one side have one value on the other."""
        values = slot.groupBy("doc_id", "item_id", "shift", given).agg(F.min(other).alias("low"), F.max(other).alias("high"))
        return values.groupBy("doc_id", "item_id").agg(F.avg(F.expr("int(low = high)")).alias(f"by_{given}"), F.bool_and(F.expr(f"low = {given} and high = {given}")).alias(f"same_{given}"))

    fits = constant("was", "now").join(constant("now", "was"), ["doc_id", "item_id"]).select("doc_id", "item_id", F.least("by_was", "by_now").alias("share"), F.col("same_was").alias("same"))
    judged = cover.join(fits, ["doc_id", "item_id"], "left").select(
        "doc_id", "item_id", "covered", (F.col("covered") / F.col("words")).alias("coverage"), F.coalesce("share", F.lit(1.0)).alias("consistency"), F.when(F.coalesce("same", F.lit(True)), "exact").otherwise("re-parameterised").alias("kind")
    )
    return judged.where((F.col("coverage") >= coverage) | (F.col("covered") >= covered_words)).where(F.col("consistency") >= consistent).drop("covered")


def without_leaks(documents: DataFrame, benchmark: DataFrame) -> DataFrame:
    """The rows of ``documents`` whose ids match no benchmark item."""
    return documents.join(matches(documents, benchmark).select("doc_id").distinct(), "doc_id", "left_anti").select(documents.columns)
