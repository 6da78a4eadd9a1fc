"""Fill-in-middle transformation by a scan for events.

A text is cut into units by classes of ASCII characters: a run of one class makes units of the class's width (the last
one of a run may be shorter; width 0: the run is one unit), and all other characters are a class of their own.  One
Aho-Corasick automaton finds, in one pass, the characters that change the class and the sentinels.  Only these events are
looked at: what lies in a gap between two of them is a run of the other class, whose units are counted by arithmetic.  The
starts of the runs with the units before them are all that a rank is looked up in, so memory follows the events and not the
units.

Three cuts by rank give prefix, middle and suffix; hashes of the row's id decide where they lie and which form the row
takes, so a row's result depends on the row alone and a lost task gives the same again.

Defined results: a null text counts as empty, an empty text and one with a sentinel stay plain; a null id has no digits
in what is hashed; repeated rows each give the same result; other columns are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

import hashlib
from bisect import bisect_right
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import SPACES, arrow_map, held, slices, text_or_empty


@dataclass(frozen=True)
class Units:
    """(characters, width) of each class; ``rest`` is the width of all other characters."""

    classes: tuple[tuple[str, int], ...]
    rest: int


#: Each code point is a unit, in lines and in their breaks alike.
POINTS = Units((("\n", 1),), 1)
#: Words and the white space between them.
WORDS = Units(((SPACES, 0),), 0)
#: Lines and runs of line breaks.
LINES = Units((("\n", 0),), 0)


@dataclass(frozen=True)
class Scheme:
    """``seed`` is hashed with the id; of 100 rows ``plain`` stay as they are, and of 100 others ``spm`` put the suffix first."""

    units: Units = POINTS
    seed: int = 1
    plain: int = 10
    spm: int = 20
    prefix: str = "<P>"
    suffix: str = "<S>"
    middle: str = "<M>"


SENTINEL = -1


def automaton(scheme: Scheme):
    """Finds the characters of all classes (valued by the class's number) and the sentinels."""
    import ahocorasick

    found = ahocorasick.Automaton()
    for k, (characters, _) in enumerate(scheme.units.classes):
        for c in characters:
            if not c.isascii():
                raise ValueError("classes are of ASCII characters")
            found.add_word(c, k)
    for s in (scheme.prefix, scheme.suffix, scheme.middle):
        found.add_word(s, SENTINEL)
    found.make_automaton()
    return found


class Scan:
    """Runs of a text: their starts, the units before each, and their widths; ``sentinel``: one occurs."""

    def __init__(self, text: str, events, units: Units):
        self.starts, self.before, self.widths = [], [], []
        self.end, self.units, self.sentinel = len(text), 0, False
        at, last = 0, None  # all before ``at`` is in runs; ``last`` is the class of the run that ends there, if it may go on
        for place, kind in events.iter(text):
            if kind == SENTINEL:
                self.sentinel = True
                continue
            if place > at:
                self._run(at, place, units.rest)
                last = None
            if kind != last:
                self.starts.append(place)
                self.before.append(self.units)
                self.widths.append(units.classes[kind][1])
                self._from, last = place, kind
                self.units += 1
            else:  # the run of the last class goes on
                width = units.classes[kind][1]
                self.units = self.before[-1] + self._count(place + 1 - self._from, width)
            at = place + 1
        if self.end > at:
            self._run(at, self.end, units.rest)

    @staticmethod
    def _count(points: int, width: int) -> int:
        return -(-points // width) if width else 1

    def _run(self, start: int, end: int, width: int) -> None:
        self.starts.append(start)
        self.before.append(self.units)
        self.widths.append(width)
        self.units += self._count(end - start, width)

    def offset(self, rank: int) -> int:
        """The code point at which the unit of that rank (from 0) starts; the end for their number."""
        if rank >= self.units:
            return self.end
        k = bisect_right(self.before, rank) - 1
        return self.starts[k] + (rank - self.before[k]) * self.widths[k]


def draws(seed: int, key: int | None) -> list[int]:
    """Four numbers under 2^32 from the hash of ``seed:key``."""
    digits = hashlib.sha256(f"{seed}:{'' if key is None else key}".encode()).hexdigest()
    return [int(digits[k : k + 8], 16) for k in (0, 8, 16, 24)]


def transformed(text: str, key: int | None, scheme: Scheme, events) -> tuple[int, str, int | None, int | None, str]:
    """(units, form, code points of the prefix, of the middle, output)."""
    scan = Scan(text, events, scheme.units)
    h1, h2, h3, h4 = draws(scheme.seed, key)
    n = scan.units
    if not n or scan.sentinel or h3 % 100 >= 100 - scheme.plain:
        return n, "plain", None, None, text
    first, second = sorted((h1 % (n + 1), h2 % (n + 1)))
    a, z = scan.offset(first), scan.offset(second)
    prefix, middle, suffix = text[:a], text[a:z], text[z:]
    if h4 % 100 < scheme.spm:
        return n, "spm", a, z - a, f"{scheme.suffix}{suffix}{scheme.prefix}{prefix}{scheme.middle}{middle}"
    return n, "psm", a, z - a, f"{scheme.prefix}{prefix}{scheme.suffix}{suffix}{scheme.middle}{middle}"


def filled_in(documents: DataFrame, scheme: Scheme | None = None) -> DataFrame:
    """(doc_id, n, form, prefix_chars, middle_chars, output) for each row of ``documents`` (doc_id, text)."""
    scheme = scheme or Scheme()

    def work(batches):
        import pyarrow as pa

        events = held(("fim", scheme), lambda: automaton(scheme))
        kinds = [pa.int64(), pa.int64(), pa.string(), pa.int64(), pa.int64(), pa.string()]
        names = ["doc_id", "n", "form", "prefix_chars", "middle_chars", "output"]
        for batch in slices(batches):
            ids, texts = (batch.column(c).to_pylist() for c in ("doc_id", "text"))
            rows = [(key, *transformed(text, key, scheme, events)) for key, text in zip(ids, texts, strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

    rows = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    return arrow_map(rows, work, "doc_id long, n long, form string, prefix_chars long, middle_chars long, output string")


def restored(output: str = "output", form: str = "form", scheme: Scheme | None = None) -> Column:
    """The text that ``output`` was made of.  Parts hold no sentinel, and none can start in a part and end in the next
    sentinel, so the first of each kind is the one that was put there."""
    s = scheme or Scheme()
    out = F.col(output)

    def parts(one: str, two: str, three: str) -> tuple[Column, Column, Column]:
        second = F.instr(out, two)
        third = F.locate(three, out, len(one) + 1)  # what stands between them holds no other sentinel
        begin, rest = len(one) + 1, F.char_length(out)
        cut = lambda a, z: F.substring(out, a, z - a)
        return cut(F.lit(begin), second), cut(second + len(two), third), cut(third + len(three), rest + 1)

    psm, spm = parts(s.prefix, s.suffix, s.middle), parts(s.suffix, s.prefix, s.middle)
    return F.when(F.col(form) == "psm", F.concat(psm[0], psm[2], psm[1])).when(F.col(form) == "spm", F.concat(spm[1], spm[2], spm[0])).otherwise(out)
