import random
import zlib
from collections import Counter, defaultdict

import numpy as np
import pytest

from decidra.llm import jaccard_join, packing
from decidra.llm.graph import components
from decidra.llm.jaccard_join import Threshold, signatures, similar_components, shingles
from decidra.llm.packing import best_fit, next_width, packed, pieces
from decidra.llm.queries_packing import vocabulary

SCHEMA = "doc_id long, text string, size int, fp string"


def brute(rows, n, t):
    """Components by comparing all pairs of texts."""
    sets = []
    for _, text in rows:
        w = (text or "").encode().lower().split()
        sets.append({tuple(w[k : k + n]) for k in range(max(1, len(w) - n + 1))} if w else set())
    parent = list(range(len(rows)))

    def root(k):
        while parent[k] != k:
            k = parent[k]
        return k

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and t.linked(len(sets[i] & sets[j]), len(sets[i]), len(sets[j])):
                parent[root(i)] = root(j)
    low = defaultdict(lambda: None)
    for k, (doc, _) in enumerate(rows):
        if doc is not None:
            low[root(k)] = doc if low[root(k)] is None else min(doc, low[root(k)])
    return Counter((doc, len(sets[k]), low[root(k)]) for k, (doc, _) in enumerate(rows))


def corpus(seed):
    r = random.Random(seed)
    word = lambda: "".join(r.choices("abcdefg", k=r.randint(1, 4)))
    rows, doc = [], 0
    for _ in range(12):
        base = [word() for _ in range(r.choice([1, 3, 6, 9, 40, 200]))]
        for _ in range(r.randint(1, 7)):
            text = list(base)
            for _ in range(r.choice([0, 1, 1, 2, 4, 8])):
                text[r.randrange(len(text))] = word()
            rows.append((doc, " ".join(text)))
            doc += 1
    passage = " ".join(word() for _ in range(60))
    rows += [(doc + k, f"{word()} {passage} {word()} {word()}") for k in range(40)]
    return rows


@pytest.mark.parametrize(("n", "t"), [(4, Threshold(85, 100)), (5, Threshold(8, 10))])
def test_components_equal_brute_force(spark, n, t):
    rows = corpus(n) + [(9001, None), (9002, ""), (9003, " \t "), (9004, "One"), (9005, "one"), (9006, "x" * 50_000)]
    df = spark.createDataFrame([(d, x, 1, "clash") for d, x in rows], SCHEMA).repartition(5)
    got = Counter(tuple(r) for r in similar_components(df, n, t).select("doc_id", "n_shingles", "component_id").collect())
    assert got == brute(rows, n, t)


def test_large_buckets_in_many_chunks_equal_brute_force(spark, monkeypatch):
    """Near copies about the threshold: most share buckets, some of them a link."""
    called = []
    close_pairs = jaccard_join.close_pairs
    monkeypatch.setattr(jaccard_join, "close_pairs", lambda rows, *args, **more: called.append(rows.count()) or close_pairs(rows, *args, **more))
    monkeypatch.setattr(jaccard_join, "BLOCK", 2)
    monkeypatch.setattr(jaccard_join, "CHUNK", 5)
    r = random.Random(11)
    base = [f"w{k}" for k in range(150)]
    rows = []
    for k in range(70):
        text = list(base)
        for j in range(r.choice([2, 3, 4])):
            text[r.randrange(len(text))] = f"x{k}.{j}"
        rows.append((k, " ".join(text)))
    t = Threshold(85, 100)
    got = Counter(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string").repartition(4), 4, t).collect())
    assert got == brute(rows, 4, t)
    assert len(called) == 2 and called[0] > jaccard_join.CHUNK
    assert 1 < len({c for _, _, c in got}) < 70


def test_components_of_both_ways_agree(spark):
    r = random.Random(4)
    edges = [(r.randrange(300), r.randrange(300)) for _ in range(160)] + [(1000 + k, 1001 + k) for k in range(60)] + [(None, 5), (7, None), (9, 9)]
    df = spark.createDataFrame(edges, "a long, b long").repartition(3)
    one, many = components(df), components(df, one_task=0)
    assert Counter(map(tuple, one.collect())) == Counter(map(tuple, many.collect()))
    assert {x.root for x in many.collect() if x.node >= 1000} == {1000}
    assert components(df.limit(0)).count() == components(df.limit(0), one_task=0).count() == 0


def test_chains_of_links_are_followed(spark):
    """Each text links with the next, few with the smallest of their buckets."""
    words = [f"w{k}" for k in range(400)]
    rows = [(100 - k, " ".join(words[8 * k : 8 * k + 160])) for k in range(28)]
    t = Threshold(85, 100)
    got = Counter(tuple(r) for r in similar_components(spark.createDataFrame(rows, "doc_id long, text string"), 4, t).collect())
    assert got == brute(rows, 4, t)


def test_repeated_rows_null_ids_and_no_rows(spark):
    rows = [(5, "a b c d e f"), (5, "a b c d e f"), (None, "a b c d e f"), (None, "z z z z z"), (3, "a B c d e f")]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    got = Counter(tuple(r) for r in similar_components(df).collect())
    assert got == Counter({(5, 3, 3): 2, (3, 3, 3): 1, (None, 3, 3): 1, (None, 1, None): 1})
    assert similar_components(df.limit(0)).count() == 0


@pytest.mark.parametrize("t", [Threshold(85, 100), Threshold(8, 10), Threshold(1, 2)])
def test_linked_sets_share_as_many_signatures_as_stated(t):
    """So that one is left with both if each leaves out one less than its ``room``, those of the largest buckets first."""
    r, found = np.random.default_rng(1), 0
    for size in (4, 5, 7, 8, 9, 12, 17, 30, 41, 90, 400, 900):
        for _ in range(40):
            base = r.integers(0, 2**63, size, dtype=np.uint64)
            k = int(r.integers(0, max(2, size // 4)))
            other = np.concatenate([base[k:], r.integers(0, 2**63, k if r.random() < 0.5 else 0, dtype=np.uint64)])
            a, b = np.unique(base), np.unique(other)
            if a.tolist() != b.tolist() and t.linked(len(np.intersect1d(a, b)), len(a), len(b)):
                sig, owner, room = signatures([a, b], t)
                both = set(sig[owner == 0].tolist()) & set(sig[owner == 1].tolist())
                band = [len([x for x in both if x & 1 == odd]) for odd in (0, 1)]
                assert any(n > 0 and n >= max(room[:, odd]) for odd, n in enumerate(band))
                found += 1
    assert found > 100


def test_differences_bound_all_linked_pairs_and_never_fall():
    for t in (Threshold(85, 100), Threshold(8, 10), Threshold(1, 2)):
        d = t.differences(np.arange(1500)).tolist()
        assert d == sorted(d)
        for a in range(1, 1500):
            assert all(d[a] >= a + b - 2 * t.needed(a, b) for b in range(a, t.largest(a) + 1, 1 if a < 60 else 17))
        bands = t.bands(5000)
        assert all(x.high + 1 == y.low for x, y in zip(bands, bands[1:], strict=False)) and bands[-1].high >= 5000
    assert Threshold(1, 1).bands(50) == []


def test_shingles_split_and_lower_only_ascii():
    assert len(shingles("A\x0bb\x0cC d", 4)) == 1
    assert shingles("A b c d", 4).tolist() == shingles("a B C D", 4).tolist()
    assert shingles("É b c d", 4).tolist() != shingles("é b c d", 4).tolist()
    assert len(shingles("a b c d e", 4)) == 1  # no break at other spaces


def test_best_fit_takes_the_tightest_bin():
    assert best_fit([7, 6, 3, 3, 1], 10) == [0, 1, 0, 1, 1]


def test_packing_round_trip(spark):
    from tokenizers import Tokenizer

    r = random.Random(2)
    texts = [None, "", "short", "It's 5 o'clock\tand\nmore", "naïve Ünïcode ΑΣ <|endoftext|> İx", "word " * 9000, "x" * 30_000] + ["".join(r.choices("abc de.,é", k=r.randint(1, 3000))) for _ in range(150)]
    rows = [(k, t, "clash", 0) for k, t in enumerate(texts)] + [(2, "short", "clash", 0), (None, "short", "clash", 0)]
    df = spark.createDataFrame(rows, "doc_id long, text string, cell string, sequence_id int")
    got = packed(pieces(df, vocabulary, 4096), 4096, fan=2, per_task=20).collect()
    t = Tokenizer.from_file(vocabulary())
    want = Counter()
    for doc, text, *_ in rows:
        ids = np.array([*t.encode(text or "", add_special_tokens=False).ids, 1], "<u4")
        for k, s in enumerate(range(0, len(ids), 4096)):
            want[doc, k, s, len(ids[s : s + 4096]), zlib.crc32(ids[s : s + 4096].tobytes())] += 1
    assert Counter((g.doc_id, g.piece, g.start, g.length, g.ids_crc32) for g in got) == want
    bins = defaultdict(list)
    for g in got:
        bins[g.sequence_id].append((g.offset, g.length))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 4096
    total = sum(g.length for g in got)
    assert len(bins) <= -(-total // 4096) + 2
    assert packed(pieces(df.limit(0), vocabulary)).count() == 0


@pytest.mark.parametrize("small", [0, 3])
def test_packing_bounds_a_task_when_no_two_pieces_fit(spark, monkeypatch, small):
    """Bins without partners don't meet in one task; small pieces among them change nothing."""
    r = random.Random(4)
    lengths = [r.randint(2100, 4000) for _ in range(600)] + [5] * small
    sizes, real = spark.sparkContext.accumulator(0), packing._level

    def level(size, limit, depth):
        work = real(size, limit, depth)

        def counted(key, frame):
            sizes.add(max(0, len(frame) - 100))
            return work(key, frame)

        return counted

    monkeypatch.setattr(packing, "_level", level)
    got = packed(spark.createDataFrame(list(enumerate(lengths)), "doc_id long, length long"), 4096, fan=8, per_task=50).collect()
    assert sizes.value == 0
    assert sorted((g.doc_id, g.length) for g in got) == list(enumerate(lengths))
    assert len({g.sequence_id for g in got}) == 600


def test_packing_levels_shrink():
    assert next_width(1500, 30_000_000, 8, 20_000) == 0 and next_width(1500, 4_000_000, 8, 20_000) == 200 and next_width(1500, 100, 8, 20_000) == 188
    assert next_width(3, 40, 2, 20) == 2 and next_width(2, 20, 2, 20) == 1 and next_width(5, 1, 8, 20) == 0


def test_ids_equal_the_whole_tokenizers_on_any_script():
    """100,000 strings of letters, marks, signs, spaces and special tokens of many scripts."""
    from decidra.llm.packing import Tokens

    coder, r = Tokens(vocabulary()), random.Random(11)
    spans = [(0x20, 0x7F), (0xA0, 0x250), (0x250, 0x370), (0x370, 0x530), (0x590, 0x700), (0x900, 0xA00), (0xE00, 0xE80), (0x1E00, 0x2100), (0x2C00, 0x2E00), (0x3040, 0x3100), (0x4E00, 0x4E80), (0xA640, 0xA700), (0xFB00, 0xFB10), (0xFE20, 0xFE30), (0x1F600, 0x1F650)]
    fixed = [", ", ". ", ",\n", ".\n", " ", "\n", "\t", ",", ".", "\u0130", "\u0130, ", "\u0130. ", "e\u0301, ", "\u0307", "'s", "_, ", "\u1e9e", "\u212a", "\ufb03, ", "\u00df", *coder.special[:4]]
    assert list(coder.encode(["ANKARA'DAK\u0130, sonra EVDEK\u0130. Sonra"]))[0].tolist() == coder.whole.encode("ANKARA'DAK\u0130, sonra EVDEK\u0130. Sonra", add_special_tokens=False).ids
    for _ in range(20):
        texts = ["".join(r.choice(fixed) if r.random() < 0.4 else chr(r.randrange(*r.choice(spans))) for _ in range(r.randrange(1, 24))) for _ in range(5000)]
        want = coder.whole.encode_batch_fast(texts, add_special_tokens=False)
        for text, got, w in zip(texts, coder.encode(texts), want, strict=True):
            assert got.tolist() == w.ids, ascii(text)
