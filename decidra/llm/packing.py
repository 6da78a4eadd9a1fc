"""Best-fit packing of token sequences, hierarchical.

Texts are tokenized where they lie.  The pieces, without their tokens, are dealt over partitions and packed there by
best fit, longest first.  Nearly full bins are final, and so are those that the shortest remaining bin doesn't fit in;
the others go up a tree as items of their own: several partitions' remaining bins meet in one and are packed again.
A partition gets about ``per_task`` items at every level: where so many remain that less than half of the partitions
can't hold them, bins of samples that large have found no partners, the tree ends, and several partitions' bins are the last.

Defined results: a null text is empty and gives one piece, the end token alone.  Repeated rows (equal ids and texts)
are packed one by one.  Null ids stay null.  Other columns are ignored; an empty table gives an empty result.  Ties
of length go by a hash of the id, the id and the piece's number; which sequence an equal piece gets is arbitrary.
"""

from __future__ import annotations

import re
import zlib
from bisect import bisect_left, insort
from collections.abc import Callable, Iterable, Iterator
from itertools import chain, repeat

import numpy as np
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, held, slices, text_or_empty, written

SIZE, END = 4096, 1
#: Bins with at most so many free places are final before the last level.
NEARLY_FULL = 8
#: Partitions whose remaining bins meet in one of the next level at most; items dealt to one partition of a level, about.
FAN, PIECES = 8, 20_000
#: Different strings between spaces, and different words, whose ids a Python worker keeps.
CACHE_STRINGS, CACHE_WORDS = 900_000, 1_000_000


#: Letters and digits that stay such in the tokenizer's lower case, whatever its version of Unicode: ASCII, Latin and Cyrillic
#: but for the capital dotted I, of which a mark remains that joins the sign after it.
_LETTERS = "A-Za-z0-9\u00c0-\u00d6\u00d8-\u00f6\u00f8-\u012f\u0131-\u024f\u0400-\u0481\u048a-\u0527"
_AFTER_SIGN = re.compile(rf"[^{_LETTERS} \t\n][.,][ \n]")


def apart(text: str) -> str:
    """The text with spaces for line ends, and around commas and full stops that end a word, which are words of their own.

    One after another sign belongs to that sign's word; texts with such, or with letters that may end in a mark, are left
    as they are.
    """
    if not _AFTER_SIGN.search(text):
        text = text.replace(", ", " , ").replace(". ", " . ").replace(",\n", " , ").replace(".\n", " . ")
    return text.replace("\n", " ")


class Table:
    """Id sequences of strings, end to end in one array."""

    def __init__(self) -> None:
        self.index: dict[str, int] = {}
        self.flat, self.start, self.used = np.empty(1 << 16, np.uint32), np.zeros(1 << 12, np.int64), 0

    def add(self, strings: list[str], ids: np.ndarray, lengths: np.ndarray) -> None:
        n, more = len(self.index), len(strings)
        while self.used + len(ids) > len(self.flat):
            self.flat = np.concatenate([self.flat, np.empty_like(self.flat)])
        while n + more + 1 > len(self.start):
            self.start = np.concatenate([self.start, np.zeros_like(self.start)])
        self.flat[self.used : self.used + len(ids)] = ids
        self.start[n + 1 : n + more + 1] = self.used + np.cumsum(lengths)
        self.used += len(ids)
        self.index.update(zip(strings, range(n, n + more), strict=True))

    def places(self, strings: list[str]) -> np.ndarray:
        """Where each string stands, -1 if it is unknown."""
        return np.fromiter(map(self.index.get, strings, repeat(-1)), np.int64, len(strings))

    def gather(self, at: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The joined ids of the strings at these places, and how many each has."""
        first = self.start[at]
        lengths = self.start[at + 1] - first
        ends = np.cumsum(lengths)
        return self.flat[np.arange(ends[-1] if len(ends) else 0) + np.repeat(first - (ends - lengths), lengths)], lengths


class Tokens:
    """Ids by a tokenizer of lower-cased words, of which white space always ends a word.

    A string between spaces is split into the words of the tokenizer's pattern once; a word is encoded once.  Strings
    beyond printable Latin characters go through the tokenizer whole.
    """

    #: Fixed value: the tokenizer's own pattern of words.
    PATTERN = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"

    def __init__(self, path: str):
        import regex
        from tokenizers import Tokenizer, normalizers, pre_tokenizers

        self.whole, self.plain = Tokenizer.from_file(path), Tokenizer.from_file(path)
        self.plain.normalizer = normalizers.Sequence([])
        self.plain.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.WhitespaceSplit(), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self.words = regex.compile(self.PATTERN).findall
        self.special = [t.content for t in self.whole.get_added_tokens_decoder().values()]
        ids = self.whole.get_vocab(with_added_tokens=False)
        self.ends = np.zeros(max(ids.values()) + 1, bool)
        self.ends[[k for token, k in ids.items() if token.endswith("</w>")]] = True
        self.strings, self.parts = Table(), Table()

    def _learn_parts(self, parts: list[str]) -> None:
        ids = np.array(self.plain.encode(" ".join(parts), add_special_tokens=False).ids, np.uint32)
        last = np.flatnonzero(self.ends[ids])
        self.parts.add(parts, ids, np.diff(last, prepend=-1))

    def _learn(self, strings: list[str]) -> None:
        cut, odd = [], []
        for s in strings:
            if s.isascii() and s.isprintable():
                low = s.lower()
            elif s.isprintable() and max(s) < "\u0250":
                low = self.whole.normalizer.normalize_str(s)
            else:
                odd.append(s)
                continue
            if "<|" in s and any(t in s for t in self.special):
                odd.append(s)
                continue
            cut.append((s, self.words(low)))
        flat = list(chain.from_iterable(parts for _, parts in cut))
        at = self.parts.places(flat)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn_parts(list(dict.fromkeys(flat[k] for k in missing)))
            at[missing] = self.parts.places([flat[k] for k in missing])
        ids, lengths = self.parts.gather(at)
        count = np.array([len(parts) for _, parts in cut], np.int64)
        total = np.concatenate([[0], np.cumsum(lengths)])
        ends = np.cumsum(count)
        self.strings.add([s for s, _ in cut], ids, total[ends] - total[ends - count])
        if odd:
            made = [np.array(e.ids, np.uint32) for e in self.whole.encode_batch_fast(odd, add_special_tokens=False)]
            self.strings.add(odd, np.concatenate(made), np.array([len(m) for m in made]))

    def encode(self, texts: list[str]) -> Iterator[np.ndarray]:
        """The ids of each text, without an end token."""
        cut = [apart(t).split(" ") for t in texts]
        flat = list(chain.from_iterable(cut))
        if len(self.strings.index) > CACHE_STRINGS:
            self.strings = Table()
        if len(self.parts.index) > CACHE_WORDS:
            self.parts = Table()
        at = self.strings.places(flat)
        missing = np.flatnonzero(at < 0).tolist()
        if missing:
            self._learn(list(dict.fromkeys(flat[k] for k in missing)))
            at[missing] = self.strings.places([flat[k] for k in missing])
        ids, lengths = self.strings.gather(at)
        total, k = np.concatenate([[0], np.cumsum(lengths)]), 0
        for words in cut:
            yield ids[total[k] : total[k + len(words)]]
            k += len(words)


def pieces(documents: DataFrame, vocabulary: Callable[[], str], size: int = SIZE, end: int = END) -> DataFrame:
    """(doc_id, piece, start, length, ids_crc32) of every text: at most ``size`` tokens each, the end token included.

    ``vocabulary`` gives the tokenizer file's path on the machine that asks.
    """

    def work(batches):
        import pyarrow as pa

        for b in slices(batches):
            path = vocabulary()
            coder, out = held(("tokens", path), lambda: Tokens(path)), [[], [], [], [], []]
            ids_of = b.column("doc_id").to_pylist()
            for doc, ids in zip(ids_of, coder.encode(b.column("text").to_pylist()), strict=True):
                n, last = len(ids) + 1, np.array([end], "<u4").tobytes()
                for k, start in enumerate(range(0, n, size)):
                    stop = min(n, start + size)
                    crc = zlib.crc32(ids[start : min(stop, n - 1)].astype("<u4", copy=False).tobytes())
                    for c, v in zip(out, (doc, k, start, stop - start, zlib.crc32(last, crc) if stop == n else crc), strict=True):
                        c.append(v)
            kinds = [pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(out, kinds, strict=True)], ["doc_id", "piece", "start", "length", "ids_crc32"])

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), work, "doc_id long, piece int, start long, length long, ids_crc32 long")


def best_fit(lengths: Iterable[int], size: int) -> list[int]:
    """The bin of each length, given longest first: of the bins with room, the one that it leaves least room in."""
    rooms: list[int] = []  # the different free places, ascending
    bins: dict[int, list[int]] = {}
    out, made = [], 0
    for n in lengths:
        k = bisect_left(rooms, n)
        if k == len(rooms):
            b, room, made = made, size, made + 1
        else:
            room = rooms[k]
            b = bins[room].pop()
            if not bins[room]:
                del bins[room], rooms[k]
        left = room - n
        if left:
            if left not in bins:
                bins[left] = []
                insort(rooms, left)
            bins[left].append(b)
        out.append(b)
    return out


def _level(size: int, limit: int, depth: int):
    """Packs one partition's items."""

    def work(key, frame):
        import pandas as pd

        frame = frame.sort_values(["length", "id"], ascending=[False, True], kind="stable")
        lengths = frame.length.to_numpy()
        bins = np.array(best_fit(lengths.tolist(), size), np.int64)
        order = np.argsort(bins, kind="stable")
        place = np.empty(len(bins), np.int64)
        running = np.cumsum(lengths[order]) - lengths[order]
        fresh = np.concatenate([[True], bins[order][1:] != bins[order][:-1]])
        place[order] = running - running[fresh][np.cumsum(fresh) - 1]
        fill = np.bincount(bins, lengths).astype(np.int64)
        lead = frame.id.to_numpy()[order][fresh]  # a bin is known by its first item
        return pd.DataFrame({"id": frame.id, "parent": lead[bins], "place": place, "fill": fill[bins], "final": (size - fill[bins]) <= limit, "cell": int(key[0]), "number": (depth << 56) + (int(key[0]) << 24) + bins})

    return work


def next_width(width: int, left: int, fan: int, per_task: int) -> int:
    """Partitions of the next level for ``left`` bins of ``width`` partitions; 0 if there is none: no two bins are left, or too many for half of the partitions."""
    if left < 2:
        return 0
    upper = max(-(-width // fan), -(-left // per_task))
    return upper if upper <= -(-width // 2) else 0


def packed(items: DataFrame, size: int = SIZE, fan: int = FAN, per_task: int = PIECES, nearly_full: int = NEARLY_FULL) -> DataFrame:
    """``items`` (with a length of 1 to ``size``) with sequence_id and offset; gapless, no sequence over ``size``.

    At each level a bin (id, parent, place) says where its contents lie in the bin of the next level.
    """
    columns = items.columns
    items = written(items.withColumn("_uid", F.monotonically_increasing_id()), "pieces")
    count = items.count()
    width = max(1, -(-count // per_task))
    cell = F.pmod(F.xxhash64("_uid"), F.lit(width)).cast("int")
    level = items.select(F.col("_uid").alias("id"), "length", cell.alias("cell"))
    above, depth = [], 0
    while True:
        last = width == 1  # its bins are all final
        done = written(level.groupBy("cell").applyInPandas(_level(size, size if last else nearly_full, depth), "id long, parent long, place long, fill long, final boolean, cell int, number long"), f"level-{depth}")
        above.append(done)
        if last:
            break
        left = done.where("not final and place = 0 and id = parent").select("id", F.col("fill").alias("length"))
        shortest = left.agg(F.min("length")).first()[0]
        left = left.where(F.col("length") <= size - shortest) if shortest else left.limit(0)
        upper = next_width(width, left.count(), fan, per_task)
        if not upper:
            break
        width, depth = upper, depth + 1
        level = left.withColumn("cell", F.pmod(F.xxhash64("id"), F.lit(width)).cast("int"))
    placed = above[-1].select("id", "number", "place")
    for lower in reversed(above[:-1]):
        up = placed.select(F.col("id").alias("parent"), F.col("number").alias("top"), F.col("place").alias("shift"))
        placed = lower.select("id", "parent", "number", "place").join(up, "parent", "left").select("id", F.coalesce("top", "number").alias("number"), (F.col("place") + F.coalesce("shift", F.lit(0))).alias("place"))
    named = placed.select(F.col("id").alias("_uid"), F.col("number").alias("sequence_id"), F.col("place").alias("offset"))
    return items.join(named, "_uid").select(*columns, "sequence_id", "offset")
