"""N-gram Jaccard join by PartEnum signatures.

A text's set holds the hashes of its distinct word n-grams.  Sets are banded by size; for a smaller set of ``a`` elements
two sets that reach the threshold differ in at most ``D(a)`` elements.  A band splits the domain of elements into groups of
``parts`` parts, and every subset of all parts but one of a group is a signature.  A set of ``a`` elements uses the first
``D(a) // 2 + 1 + spare`` groups: in one more than ``spare`` of them two such sets differ in one part at most, so they share
``share = 2 * spare + 1`` signatures at least (:class:`Band`).

That more than one is shared is made use of: of each set's signatures without elements and those in the largest
buckets, ``share - 1`` are left out; the others of two linked sets still meet in one, as all follow one order.

Sets that share a signature are never all paired.  Each set is compared with the smallest of its bucket.  Buckets whose
sets then are in one component are settled.  In the others, sets of different components are compared: those of small buckets
by a join, those of large ones in blocks of rows by their sketches alone: first a forest of close pairs, then the close
pairs of sets that these haven't linked.  Sizes and parity sketches rule out most pairs without their texts.

Elements are 64-bit hashes of words and sets are known by 64-bit fingerprints; everything else is exact.

Defined results: null and empty texts and texts without a word have an empty set and link with nothing.  Texts of
fewer words than ``n`` have one element, the whole sequence.  Repeated rows are copies of each other; rows without an
id count as copies, too, but can't be named: a component of such rows alone is null, and they open no links to other
texts.  If one id has several texts each row is linked by its own text.  Other columns are ignored; an empty table
gives an empty result.
"""

from __future__ import annotations

from dataclasses import dataclass
from functools import lru_cache
from itertools import combinations

import numpy as np
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import arrow_map, dropped, held, slices, text_or_empty, written
from .graph import components

#: Sets of a bucket up to which a join compares them.
BLOCK = 16
#: Rows of a large bucket, about, that are compared with as many others in one group.
CHUNK = 2048
#: Words of sketches that are compared at a time.
SLAB = 2_000_000
#: Share of a set's signatures that may lie in the largest buckets, besides those without elements, before these buckets are read.
HOT = 0.1
_C = [np.uint64(x) for x in (0x9E3779B97F4A7C15, 0xBF58476D1CE4E5B9, 0x94D049BB133111EB, 0xD6E8FEB86659FD93)]


def mix(x: np.ndarray) -> np.ndarray:
    """A bijection of 64-bit numbers that spreads all bits."""
    x = (x ^ (x >> np.uint64(30))) * _C[1]
    x = (x ^ (x >> np.uint64(27))) * _C[2]
    return x ^ (x >> np.uint64(31))


def word_hashes(words: list[bytes]) -> np.ndarray:
    known = held("word hashes", dict)
    if len(known) > 150_000:
        known.clear()
    for w in words:
        if w not in known:
            known[w] = xxhash.xxh3_64_intdigest(w)
    return np.fromiter(map(known.__getitem__, words), np.uint64, len(words))


def shingles(text: str | None, n: int) -> np.ndarray:
    """Sorted hashes of the distinct n-grams; A-Z lower-cased, words split at 0x20 and 0x09 to 0x0D."""
    words = (text or "").encode("utf-8", "surrogatepass").lower().split()
    if not words:
        return np.empty(0, np.uint64)
    w, width = word_hashes(words), min(n, len(words))
    h = np.full(len(w) - width + 1, width, np.uint64)
    for k in range(width):
        h = mix(h * _C[0] + w[k : len(w) - width + 1 + k])
    return np.unique(h)


@dataclass(frozen=True)
class Threshold:
    """Jaccard similarity of at least num / den."""

    num: int
    den: int

    def needed(self, a, b):
        """The smallest intersection of linked sets of a and b elements."""
        return -(-self.num * (a + b) // (self.num + self.den))

    def linked(self, both, a, b):
        return self.den * both >= self.num * (a + b - both)

    def largest(self, a: int) -> int:
        return self.den * a // self.num

    def differences(self, sizes: np.ndarray) -> np.ndarray:
        """D: what a set of this size and a linked one that isn't smaller differ in at most; never falls with the size."""
        sizes = np.asarray(sizes, np.int64)
        few = _few(self)
        real = (self.den - self.num) * (sizes + self.largest(sizes)) // (self.den + self.num)  # never below the exact one
        return np.where(sizes < len(few), few[np.minimum(sizes, len(few) - 1)], real)

    def bands(self, most: int) -> list[Band]:
        return list(_bands(self, 1 << max(6, int(most).bit_length())))


@lru_cache
def _few(t: Threshold) -> np.ndarray:
    """The differences of small sizes, counted out."""
    most = [max((a + b - 2 * t.needed(a, b) for b in range(a, t.largest(a) + 1)), default=0) for a in range(1, 400)]
    return np.maximum.accumulate(np.array([0, *most], np.int64))


@dataclass(frozen=True)
class Band:
    """Signatures of pairs whose smaller set has ``low`` to ``high`` elements: groups of ``parts`` parts, ``spare`` more groups than needed."""

    low: int
    high: int
    groups: int
    parts: int
    spare: int

    @property
    def share(self) -> int:
        """Signatures that two linked sets share at least: ``g = D // 2 + 1 + spare`` groups give ``2 * g - D`` or more, however D differences fall."""
        return 2 * self.spare + 1

    @staticmethod
    def of(t: Threshold, low: int, high: int) -> Band:
        """``spare`` is as large as empty signatures of the band's smallest sets, and hot ones of all, are likely to need."""
        least, most = t.differences([low, high])
        parts = 3 if most <= 16 else 2
        fits = []
        for spare in range(1, 3 + int(most) // 3):
            groups = int(most) // 2 + 1 + spare
            count = parts * (int(least) // 2 + 1 + spare)
            empty = count * np.exp(-low * (parts - 1) / (groups * parts))
            lacking = empty + 3 * np.sqrt(empty) + HOT * count - 2 * spare
            fits.append((max(0.0, lacking), spare, groups))
        _, spare, groups = min(fits)
        return Band(low, high, groups, parts, spare)


@lru_cache
def _bands(t: Threshold, most: int) -> tuple:
    out, low = [], 1
    while low <= most and t.differences([low])[0] == 0:  # such sets are linked with equal ones only
        low += 1
    while low <= most:
        high = t.largest(t.largest(low))
        out.append(Band.of(t, low, high))
        low = high + 1
    return tuple(out)


def signatures(sets: list[np.ndarray], t: Threshold) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All signatures of all sets, the index of each one's set, and for each set how many it shares with any linked set, at
    least, in even and in odd bands.  A signature's lowest bit says whether its band is odd."""
    sizes = np.array([len(s) for s in sets], np.int64)
    bands = t.bands(sizes.max(initial=1))
    lows, highs = np.array([b.low for b in bands]), np.array([b.high for b in bands])
    own = np.searchsorted(lows, sizes, side="right") - 1
    sets_of, band_of = [], []
    for back in (0, 1):  # as the smaller set of a pair, and as the larger one of a pair of the band before
        b = own - back
        fits = np.flatnonzero((b >= 0) & ((sizes <= highs[b]) | (sizes <= t.largest(highs[b]))))
        sets_of.append(fits)
        band_of.append(b[fits])
    sets_of, band_of = np.concatenate(sets_of), np.concatenate(band_of)
    out, owners, room = [], [], np.zeros((len(sets), 2), np.int64)
    for parts in (2, 3):
        pick = np.array([bands[b].parts == parts for b in band_of], bool)
        if not pick.any():
            continue
        w, b = sets_of[pick], band_of[pick]
        groups, spare = np.array([bands[x].groups for x in b]), np.array([bands[x].spare for x in b])
        used = t.differences(np.minimum(sizes[w], highs[b])) // 2 + 1 + spare
        first = np.concatenate([[0], np.cumsum(used * parts)])
        h = np.concatenate([sets[k] for k in w])
        at = np.repeat(np.arange(len(w)), sizes[w])
        part = (((mix(h ^ _C[3]) >> np.uint64(32)) * (groups * parts)[at].astype(np.uint64)) >> np.uint64(32)).astype(np.int64)
        inside = part < (used * parts)[at]
        place, value = (first[at] + part)[inside], mix(h[inside] + _C[0])
        order = np.argsort(place, kind="stable")
        count = np.bincount(place, minlength=first[-1])
        total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(value[order], dtype=np.uint64)])
        ends = np.cumsum(count)
        sums, count = (total[ends] - total[ends - count]).reshape(-1, parts), count.reshape(-1, parts)
        pair = np.repeat(np.arange(len(w)), used)
        group = np.arange(len(pair)) - np.repeat(first[:-1] // parts, used)
        chosen = list(combinations(range(parts), parts - 1))
        empty = np.stack([count[:, list(c)].sum(1) == 0 for c in chosen], 1)
        left = 2 * spare + 1 - np.bincount(pair, empty.sum(1), len(w)).astype(np.int64)
        room[w, b & 1] = left
        base = mix(b[pair].astype(np.uint64) * _C[0] + mix(group.astype(np.uint64) * np.uint64(8) + np.uint64(parts)))
        odd = (b[pair] & 1).astype(np.uint64)
        for j, c in enumerate(chosen):
            sig = base + np.uint64(j)
            for p in c:
                sig = mix(sig * _C[3] + sums[:, p])
            keep = ~empty[:, j] | (left <= 0)[pair]
            out.append((sig[keep] & ~np.uint64(1)) | odd[keep])
            owners.append(w[pair[keep]])
    if not out:
        return np.empty(0, np.uint64), np.empty(0, np.int64), room
    return np.concatenate(out), np.concatenate(owners), room


def fingerprint(s: np.ndarray) -> np.int64:
    return (mix(s + _C[1]).sum(dtype=np.uint64) ^ np.uint64(len(s))).astype(np.int64) if len(s) else np.int64(0)


def sketch(s: np.ndarray) -> list[int]:
    """Parities of the elements in 2 to 4 bits an element, a power of two: sets that differ in d elements differ in d bits at most."""
    bits = 1 << max(6, (2 * len(s) - 1).bit_length())
    odd = np.bincount((mix(s ^ _C[2]) & np.uint64(bits - 1)).astype(np.int64), minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).view(np.int64).tolist()


def prepared(documents: DataFrame, n: int, t: Threshold) -> DataFrame:
    """Texts are read once, for rows of two sorts.

    (doc_id, size, fp, sketch, room) of each text, room being how many signatures its set shares with any linked one at
    least, in even and in odd bands; and (sig, fp) of each signature, once or more.
    """

    def work(batches):
        import pyarrow as pa

        names = ["doc_id", "size", "fp", "sketch", "room", "sig"]
        longs, none = pa.list_(pa.int64()), lambda k, kind=pa.int64(): pa.nulls(k, kind)
        seen: set[int] = set()
        for b in slices(batches, rows=500, chars=1_000_000):
            sets = [shingles(text, n) for text in b.column("text").to_pylist()]
            fps = np.array([fingerprint(s) for s in sets], np.int64)
            sig, owner, room = signatures(sets, t)
            about = [b.column("doc_id"), pa.array([len(s) for s in sets], pa.int64()), pa.array(fps), pa.array([sketch(s) if len(s) else None for s in sets], longs), pa.array(room.tolist(), longs)]
            yield pa.RecordBatch.from_arrays([*about, none(len(sets))], names)
            fresh = np.zeros(len(sets), bool)
            for k, fp in enumerate(fps.tolist()):
                if fp not in seen:
                    seen.add(fp)
                    fresh[k] = True
            if len(seen) > 50_000:
                seen.clear()
            new = fresh[owner]
            sig, fp = sig[new].view(np.int64), fps[owner[new]]
            order = np.argsort(fp, kind="stable")
            sig, fp = sig[order], fp[order]
            for k in range(0, len(sig), 50_000):
                part = sig[k : k + 50_000]
                m = len(part)
                yield pa.RecordBatch.from_arrays([none(m), none(m), pa.array(fp[k : k + 50_000]), none(m, longs), none(m, longs), pa.array(part)], names)

    return arrow_map(documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text")), work, "doc_id long, size long, fp long, sketch array<long>, room array<long>, sig long")


def marked(rows: DataFrame, key: Column, wanted: DataFrame) -> DataFrame:
    """The rows whose hashed ``key`` a bit map of ``wanted.hash`` has: of 8 MB at most, made by Spark, so a join must follow."""
    spark, bits = rows.sparkSession, min(26, max(16, 3 + int(wanted.count()).bit_length()))
    place = F.shiftrightunsigned("hash", 64 - bits)
    set_bits = wanted.select(F.shiftright(place, 6).alias("id"), F.expr(f"shiftleft(1L, int(shiftrightunsigned(hash, {64 - bits}) & 63))").alias("bit")).groupBy("id").agg(F.bit_or("bit").alias("bits"))
    whole = spark.range(1 << (bits - 6)).join(set_bits, "id", "left").agg(F.sort_array(F.collect_list(F.struct("id", F.coalesce("bits", F.lit(0).cast("long")).alias("bits"))))["bits"].alias("bits"))
    place = F.shiftrightunsigned(key, 64 - bits)
    return rows.where(F.getbit(F.get(written(whole, "marks").scalar(), F.shiftright(place, 6).cast("int")), place.bitwiseAND(63).cast("int")) == 1)


def members(signs: DataFrame, classes: DataFrame) -> DataFrame:
    """(sig, fp) of the signatures by which a set must be compared with others.

    Signatures are counted first, so that the others, most by far, are never dealt with their sets.  Of a set's shared
    signatures the ``room - 1`` of the largest buckets are left out: of two linked sets' shared ones, which are ``room`` of
    either at least, the one in the smallest bucket stays with both.
    """
    many = written(signs.groupBy("sig").agg(F.count("*").alias("many")).where("many > 1"), "counts")
    rows = marked(signs, F.xxhash64("sig"), many.select(F.xxhash64("sig").alias("hash"))).join(many, "sig")
    own = rows.groupBy("fp").agg(F.collect_set(F.struct("many", "sig")).alias("own")).join(classes.select("fp", "room"), "fp")  # bounded by the layout of signatures

    def part(odd: int):
        mine = F.sort_array(F.filter("own", lambda x: x["sig"].bitwiseAND(1) == odd))
        return F.slice(mine, 1, F.greatest(F.lit(0), F.size(mine) - F.greatest(F.lit(0), F.get("room", F.lit(odd)).cast("int") - 1)))

    out = written(own.select("fp", F.explode(F.concat(part(0), part(1))["sig"]).alias("sig")), "members")
    dropped(many)
    return out


def with_leads(rows: DataFrame) -> DataFrame:
    """(sig, lead, fp): the smallest set of each bucket of several, for each of its others."""
    leads = rows.groupBy("sig").agg(F.min("fp").alias("lead"), F.count("*").alias("many")).where("many > 1").select("sig", "lead")
    return rows.join(leads, "sig").where("lead <> fp").select("sig", "lead", "fp")


def plausible(pairs: DataFrame, about: DataFrame, t: Threshold) -> DataFrame:
    """Pairs (a, b) of fingerprints whose sizes and sketches don't rule out a link; with one row's id for each."""
    side = lambda x: about.select(F.col("fp").alias(x), F.col("size").alias(f"size_{x}"), F.col("sketch").alias(f"sketch_{x}"), F.col("id").alias(f"id_{x}"))
    most = F.expr(f"size_a + size_b - 2 * ceil({t.num} * (size_a + size_b) / {t.num + t.den}D - 1e-9)")
    words = F.least(F.size("sketch_a"), F.size("sketch_b"))
    half = lambda c: F.when(F.size(c) > words, F.zip_with(F.slice(c, 1, words), F.slice(c, words + 1, words), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col(c))
    differ = F.aggregate(F.zip_with(half("sketch_a"), half("sketch_b"), lambda x, y: F.bit_count(x.bitwiseXOR(y))), F.lit(0), lambda s, x: s + x)
    fits = F.expr(f"{t.den} * least(size_a, size_b) >= {t.num} * greatest(size_a, size_b)")
    return pairs.join(side("a"), "a").join(side("b"), "b").where(fits & (differ <= most)).select("a", "b", "id_a", "id_b")


def close_pairs(rows: DataFrame, about: DataFrame, t: Threshold, forest: bool) -> DataFrame:
    """Pairs (a, b) of different roots in buckets (sig, fp, root) whose sizes and sketches don't rule out a link.

    A bucket's rows are dealt in chunks of about ``CHUNK``, each pair of chunks to one group; chunks of the bucket's largest
    component are not compared with each other.  A pair is made in the lowest of the buckets that it shares.  ``forest``:
    only pairs that join trees of a group, the nearest of some rows first, so fewer than the group has roots; over all groups they
    reach what all the pairs reach.
    """
    own = rows.groupBy("fp").agg(F.collect_set("sig").alias("sigs"))  # bounded by the layout of signatures
    many = rows.groupBy("sig", "root").agg(F.count("*").alias("many"))
    main = many.groupBy("sig").agg(F.max_by("root", F.struct("many", "root")).alias("main"), F.max("many").alias("most"), F.sum("many").alias("all"))
    chunks = lambda c: F.ceil(c / CHUNK).cast("int")
    one = F.pmod(F.xxhash64("fp", "sig"), F.greatest(F.lit(1), F.when(F.col("root") == F.col("main"), F.col("n")).otherwise(F.col("m")))).cast("int")
    dealt = rows.join(main.select("sig", "main", chunks(F.col("most")).alias("n"), chunks(F.col("all") - F.col("most")).alias("m")), "sig")
    dealt = dealt.withColumn("chunk", F.when(F.col("root") == F.col("main"), one).otherwise(F.col("n") + one))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.when(F.col("root") == F.col("main"), F.col("n")).otherwise(F.lit(0)), F.col("n") + F.col("m") - 1)))
    short = F.when(F.size("sketch") > 8, F.zip_with(F.slice("sketch", 1, (F.size("sketch") / 2).cast("int")), F.slice("sketch", (F.size("sketch") / 2).cast("int") + 1, (F.size("sketch") / 2).cast("int")), lambda x, y: x.bitwiseXOR(y))).otherwise(F.col("sketch"))
    dealt = dealt.join(about.select("fp", "size", short.alias("sketch")).join(own, "fp"), "fp")
    dealt = dealt.select("sig", F.least("chunk", "other").alias("i"), F.greatest("chunk", "other").alias("j"), "chunk", "fp", "root", "size", "sketch", F.filter("sigs", lambda x: x < F.col("sig")).alias("lower"))

    def work(key, rows):
        import pyarrow as pa

        found = near_pairs(key[1].as_py(), key[2].as_py(), {c: rows[c].combine_chunks() for c in rows.column_names}, t, forest)
        return pa.table({"a": pa.array(found[0], pa.int64()), "b": pa.array(found[1], pa.int64())})

    return dealt.groupBy("sig", "i", "j").applyInArrow(work, "a long, b long").distinct()


def near_pairs(i: int, j: int, columns: dict, t: Threshold, forest: bool) -> tuple[np.ndarray, np.ndarray]:
    """The close pairs of the rows of chunk ``i`` with those of chunk ``j``, in slabs of some rows at a time."""
    chunk, fp, root, size = (columns[c].to_numpy() for c in ("chunk", "fp", "root", "size"))
    bits, starts, lower = _same_length(columns["sketch"]), columns["lower"].offsets.to_numpy(), columns["lower"].values.to_numpy()
    known: dict[int, frozenset] = {}

    def lows(k: int) -> frozenset:
        if k not in known:
            known[k] = frozenset(lower[starts[k] : starts[k + 1]].tolist())
        return known[k]

    tree = np.unique(root, return_inverse=True)[1]
    first, second = np.flatnonzero(chunk == i), np.flatnonzero(chunk == j)
    out, step = [[], []], max(1, SLAB // (max(1, len(second)) * bits.shape[1]))
    for k in range(0, len(first), step):
        part = first[k : k + step]
        fits = tree[part][:, None] != tree[second]
        if i == j:
            fits &= part[:, None] < second
        fits &= t.den * np.minimum(size[part][:, None], size[second]) >= t.num * np.maximum(size[part][:, None], size[second])
        a, b = np.nonzero(fits)
        a, b = part[a], second[b]
        differ = np.bitwise_count(bits[a] ^ bits[b]).sum(1, dtype=np.int64)
        near = np.flatnonzero(differ <= size[a] + size[b] - 2 * t.needed(size[a], size[b]))
        for at in near[np.argsort(differ[near], kind="stable")] if forest else near:
            x, y = int(a[at]), int(b[at])
            if (forest and tree[x] == tree[y]) or not lows(x).isdisjoint(lows(y)):
                continue
            if forest:
                tree[tree == tree[y]] = tree[x]
            out[0].append(min(fp[x], fp[y]))
            out[1].append(max(fp[x], fp[y]))
    return np.array(out[0], np.int64), np.array(out[1], np.int64)


def _same_length(sketches) -> np.ndarray:
    """Sketches, each folded to the length of the shortest, as rows of words."""
    lengths, values, starts = np.diff(sketches.offsets.to_numpy()), sketches.values.to_numpy().view(np.uint64), sketches.offsets.to_numpy()
    words = lengths.min()
    out = np.empty((len(lengths), words), np.uint64)
    for n in np.unique(lengths):
        at = np.flatnonzero(lengths == n)
        out[at] = np.bitwise_xor.reduce(values[starts[at][:, None] + np.arange(n)].reshape(len(at), n // words, words), 1)
    return out


def texts_of(sets: DataFrame, documents: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, text) of the sets that are compared; texts of other sets may be among them if an id repeats."""
    ids = written(classes.join(sets.select("fp").distinct(), "fp", "left_semi").select("fp", F.col("id").alias("doc_id")), "ids")
    texts = documents.select(F.col("doc_id").cast("long").alias("doc_id"), text_or_empty().alias("text"))
    out = written(marked(texts, F.xxhash64("doc_id"), ids.select(F.xxhash64("doc_id").alias("hash"))).join(ids, "doc_id").select("fp", "text"), "texts")
    dropped(ids)
    return out


def verified(pairs: DataFrame, texts: DataFrame, n: int, t: Threshold) -> DataFrame:
    """The pairs that reach the threshold, by the sets of their whole texts."""

    def work(batches):
        import pyarrow as pa

        for batch in batches:
            for b in slices([batch], rows=64, column="text_a"):
                last, out = ("", np.empty(0, np.uint64)), []
                for a, z, ta, tz in zip(*(b.column(c).to_pylist() for c in ("a", "b", "text_a", "text_b")), strict=True):
                    if last[0] != ta:
                        last = (ta, shingles(ta, n))
                    x, y = last[1], shingles(tz, n)
                    if int(fingerprint(x)) == a and int(fingerprint(y)) == z:
                        both = len(np.intersect1d(x, y, assume_unique=True))
                        if t.linked(both, len(x), len(y)):
                            out.append((a, z))
                yield pa.RecordBatch.from_arrays([pa.array([p[0] for p in out], pa.int64()), pa.array([p[1] for p in out], pa.int64())], ["a", "b"])

    side = lambda x: texts.select(F.col("fp").alias(x), F.col("text").alias(f"text_{x}"))
    joined = pairs.select("a", "b").join(side("b"), "b").join(side("a"), "a")
    return arrow_map(joined.select("a", "b", "text_a", "text_b"), work, "a long, b long").distinct()


def similar_components(documents: DataFrame, n: int = 4, threshold: Threshold = Threshold(85, 100)) -> DataFrame:
    """(doc_id, n_shingles, component_id) of each row: the smallest id that links of the threshold reach."""
    if 2 * threshold.num < threshold.den:
        raise ValueError("sketches are compared for thresholds from 0.5")
    rows = written(prepared(documents, n, threshold), "sets")
    about = written(rows.where("size is not null").select("doc_id", "size", "fp", "sketch", "room"), "about")
    classes = about.where("size > 0 and doc_id is not null").groupBy("fp").agg(F.min("doc_id").alias("id"), *(F.first(c).alias(c) for c in ("size", "sketch", "room")))
    classes = written(classes, "classes")
    met = members(rows.where("sig is not null").select("sig", "fp"), classes)
    dropped(rows)
    shared = written(with_leads(met), "shared")
    dropped(met)
    everyone = shared.select("sig", "fp").unionByName(shared.groupBy("sig").agg(F.min("lead").alias("fp")))
    texts = None
    links = roots = None

    def settle(pairs: DataFrame, one_first: bool = False):
        """Verifies pairs of different components; the links and components that are then known."""
        nonlocal links, roots, texts
        open_pairs = written(plausible(pairs, classes, threshold), "pairs")
        part = open_pairs
        if one_first:  # one pair of each set: what these link need not be verified again
            part = open_pairs.groupBy("b").agg(F.min("a").alias("a"))
        while part.limit(1).count():
            if texts is None:
                texts = texts_of(everyone, documents, classes)
            found = written(verified(part, texts, n, threshold), "links")
            if found.limit(1).count():
                links = found if links is None else written(links.unionByName(found), "links")
                roots = components(links)
            if not one_first:
                break
            open_pairs = part = written(apart(open_pairs).join(part, ["a", "b"], "left_anti"), "pairs")
            one_first = False

    def apart(pairs: DataFrame) -> DataFrame:
        """Rows whose a and b aren't known to be in one component."""
        if roots is None:
            return pairs
        root = lambda x: roots.select(F.col("node").alias(x), F.col("root").alias(f"root_{x}"))
        return pairs.join(root("a"), "a", "left").join(root("b"), "b", "left").where("coalesce(root_a, a) <> coalesce(root_b, b)").drop("root_a", "root_b")

    def mixed(rows: DataFrame) -> DataFrame:
        """(sig, fp, root, bucket) of buckets of several components; bucket: its sets."""
        rooted = rows.select("sig", "fp", F.col("fp").alias("root"))
        if roots is not None:
            rooted = rows.join(roots.withColumnRenamed("node", "fp"), "fp", "left").select("sig", "fp", F.coalesce("root", "fp").alias("root"))
        several = rooted.groupBy("sig").agg(F.min("root").alias("low"), F.max("root").alias("high"), F.count("*").alias("bucket")).where("low <> high").select("sig", "bucket")
        return written(rooted.join(several, "sig"), "rest")

    settle(shared.select(F.col("lead").alias("a"), F.col("fp").alias("b")).distinct(), one_first=True)
    # in buckets of several components, sets of different ones are compared
    open_sigs = apart(shared.select("sig", F.col("lead").alias("a"), F.col("fp").alias("b"))).select("sig").distinct()
    rest = mixed(everyone.join(open_sigs, "sig", "left_semi"))
    if rest.limit(1).count():
        small, large = rest.where(F.col("bucket") <= BLOCK), rest.where(F.col("bucket") > BLOCK)
        other = small.select("sig", F.col("fp").alias("x"), F.col("root").alias("root_x"))
        settle(small.join(other, "sig").where("x < fp and root_x <> root").select(F.col("x").alias("a"), F.col("fp").alias("b")).distinct())
        left = mixed(large.select("sig", "fp"))
        if left.limit(1).count():
            tried = written(close_pairs(left, classes, threshold, forest=True), "pairs")
            settle(tried)  # most of what is linked is joined up by these
            left = mixed(left.select("sig", "fp"))
            settle(close_pairs(left, classes, threshold, forest=False).join(tried, ["a", "b"], "left_anti"))

    if roots is None:
        roots = documents.sparkSession.createDataFrame([], "node long, root long")
    named = roots.join(classes.select(F.col("fp").alias("node"), "id"), "node").groupBy("root").agg(F.min("id").alias("low"))
    of = roots.join(named, "root").select(F.col("node").alias("fp"), "low")
    lowest = written(classes.select("fp", "id").join(of, "fp", "left").select("fp", F.coalesce("low", "id").alias("low")), "lowest")
    dropped(classes, shared, texts)
    linked = about.select("doc_id", "size", F.when(F.col("size") > 0, F.col("fp")).alias("fp")).join(lowest, "fp", "left")
    return linked.select("doc_id", F.col("size").alias("n_shingles"), F.coalesce("low", "doc_id").alias("component_id"))
