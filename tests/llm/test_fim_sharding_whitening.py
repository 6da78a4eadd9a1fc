import hashlib
import random
import re
from collections import Counter, defaultdict
from fractions import Fraction

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

from decidra.llm import fim, sharding, whitening
from decidra.llm.queries_fim import ORACLE, op12_fill_in_middle
from decidra.llm.queries_sharding import op13_sharding
from decidra.llm.queries_whitening import op11_embedding_whitening

DATA = "/root/testdata/sf0.001"
SCHEMES = {fim.POINTS: r"(?s).", fim.WORDS: r"[ \t\n\x0b\f\r]+|[^ \t\n\x0b\f\r]+", fim.LINES: r"\n+|[^\n]+", fim.Units((("0123456789", 3), (" ", 0)), 4): r"[0-9]{1,3}|[ ]+|[^0-9 ]{1,4}"}


@pytest.mark.parametrize("units", SCHEMES)
def test_ranks_equal_those_of_a_tokenising_pattern(units):
    r, scheme = random.Random(3), fim.Scheme(units)
    events = fim.automaton(scheme)
    for _ in range(400):
        text = "".join(r.choice(["a", "Z", "7", "12345", " ", "  ", "\n", "\t", "é", "🤦🏼‍♂️", "中", "<", "<P", ">", "\0", "İ"]) for _ in range(r.randrange(40)))
        starts = [m.start() for m in re.finditer(SCHEMES[units], text)]
        scan = fim.Scan(text, events, units)
        assert scan.units == len(starts) and scan.sentinel == ("<P>" in text)
        assert [scan.offset(k) for k in range(len(starts) + 1)] == [*starts, len(text)]


def _expected(doc_id, text):
    text = text or ""
    h = hashlib.sha256(f"1:{'' if doc_id is None else doc_id}".encode()).hexdigest()
    h1, h2, h3, h4 = (int(h[k : k + 8], 16) for k in (0, 8, 16, 24))
    n = len(text)
    sha = lambda s: hashlib.sha256(s.encode()).hexdigest()
    if not text or any(s in text for s in ("<P>", "<S>", "<M>")) or h3 % 100 >= 90:
        return (doc_id, n, "plain", None, None, sha(text), sha(text))
    a, z = sorted((h1 % (n + 1), h2 % (n + 1)))
    p, m, s = text[:a], text[a:z], text[z:]
    form, out = ("spm", f"<S>{s}<P>{p}<M>{m}") if h4 % 100 < 20 else ("psm", f"<P>{p}<S>{s}<M>{m}")
    return (doc_id, n, form, a, z - a, sha(out), sha(text))


def _fim(df):
    rows = fim.filled_in(df).select("doc_id", "n", "form", "prefix_chars", "middle_chars", F.sha2("output", 256), F.sha2(fim.restored(), 256))
    return [tuple(r) for r in rows.collect()]


def test_fill_in_middle_of_odd_texts(spark):
    r = random.Random(4)
    texts = [None, "", "x", "<P>", "a <S> b", "<M", "<S", "<<P", "S>", "P>\n<", "\n\n", "🤦🏼‍♂️é\0", "word 中文\n" * 50_000, "<S<P<M" * 9]
    texts += ["".join(r.choice(["<", "P", "S", "M", ">", "\n", "ü", "🙂"]) for _ in range(r.randrange(60))) for _ in range(300)]
    docs = [(k, t) for k, t in enumerate(texts)] + [(None, "no id\nhere"), (7, texts[7]), (7, texts[7])]
    df = spark.createDataFrame([(k, t, "clash", 1) for k, t in docs], "doc_id long, text string, output string, n int")
    assert Counter(_fim(df)) == Counter(_expected(k, t) for k, t in docs)
    assert _fim(df.limit(0)) == []
    assert {x[2] for x in _fim(df)} == {"plain", "psm", "spm"}


def test_fill_in_middle_equals_its_sql(spark):
    con = duckdb.connect()
    con.sql(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    df = op12_fill_in_middle(spark, DATA)
    want = con.sql(f"SELECT {', '.join(df.columns)} FROM ({ORACLE['op12_fill_in_middle']})").fetchall()
    assert Counter(map(tuple, df.collect())) == Counter(want)


def _held(rows, shards, slack):
    """Slots are gapless; bytes are near equal; returns the shards of each text."""
    load, slots, where = [0] * shards, defaultdict(list), defaultdict(set)
    for r in rows:
        load[r.shard] += r["size"]
        slots[r.shard].append(r.slot)
        where[r.text].add(r.shard)
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    assert max(load) - min(load) <= slack, load
    return where


def _sharded(df, shards=16, **more):
    return sharding.sharded(df, F.col("text"), F.coalesce(F.octet_length("text"), F.lit(0)) + 1, ["doc_id", "text"], shards, **more).collect()


def test_shards_divide_hot_groups_and_keep_others_whole(spark):
    r = random.Random(6)
    texts = ["hot " * 50] * 3000 + [None] * 500 + [""] * 1500 + ["a copy " * 9] * 40 + ["x" * r.randrange(1, 800) + str(k) for k in range(3000)]
    df = spark.createDataFrame([(None if k % 1000 == 5 else k // 2, t, 3) for k, t in enumerate(texts)], "doc_id long, text string, shard int")
    rows = _sharded(df)
    assert Counter((x.doc_id, x.text) for x in rows) == Counter((x.doc_id, x.text) for x in df.collect())
    total = sum(x["size"] for x in rows)
    where = _held(rows, 16, total / 16 * 0.02)
    assert len(where["hot " * 50]) > 4
    assert all(len(s) == 1 for t, s in where.items() if t != "hot " * 50)  # null and empty texts, too: few bytes
    again = {(x.doc_id, x.text, x.shard, x.slot) for x in _sharded(df)}
    assert again == {(x.doc_id, x.text, x.shard, x.slot) for x in rows}


def test_shards_of_giants_repeats_and_few_rows(spark):
    giants = [(k, "g" * 50_000 + str(k)) for k in range(20)] + [(k, "small " + str(k)) for k in range(2000)]
    rows = _sharded(spark.createDataFrame(giants, "doc_id long, text string"))
    _held(rows, 16, 51_000)
    same = spark.range(5000).select(F.lit(1).cast("long").alias("doc_id"), F.lit("the same").alias("text"))
    _held(_sharded(same), 16, 9 * 5000 / 16 * 0.05)
    for n in (1, 3):
        few = _sharded(spark.createDataFrame([(k, "t") for k in range(n)], "doc_id long, text string"))
        assert len(few) == n and len({(x.shard, x.slot) for x in few}) == n
    assert _sharded(same.limit(0)) == []


def test_no_range_is_overfull(spark):
    df = spark.range(20_000).select(F.col("id").alias("doc_id"), F.when(F.col("id") % 3 == 0, "hot").otherwise(F.concat(F.lit("t"), F.col("id") % 4000)).alias("text"))
    table = sharding.keyed(df, F.col("text"), F.octet_length("text") + 1, "doc_id")
    splitters, ranges = sharding.split(table, 256)
    assert splitters == sorted(set(splitters))
    total, n = sum(x.size for x in ranges), sum(x.rows for x in ranges)
    assert n == 20_000 and all(x.rows == 1 or (x.size <= 2 * total / 256 and x.rows <= 2 * n / 256) for x in ranges)


def test_shards_are_written_whole(spark, tmp_path):
    df = spark.createDataFrame([(k, f"text {k}\n" * (k % 9)) for k in range(500)], "doc_id long, text string")
    sharding.write_shards(df, str(tmp_path / "out"), F.col("text"), F.octet_length("text") + 1, ["doc_id", "text"], 4)
    back = spark.read.parquet(str(tmp_path / "out"))
    assert sorted(map(tuple, back.select("doc_id", "text").collect())) == sorted(map(tuple, df.collect()))
    assert back.select("shard").distinct().count() == 4


def test_copies_stay_together_in_small_tables(spark):
    """Fewer rows than ranges: most records are larger than a range, copies stay in one shard all the same."""
    r = random.Random(8)
    texts = [f"{k} " + "y" * r.randrange(10, 9000) for k in range(300)]
    rows = [(k, texts[k % 300] if k % 3 else texts[k % 40]) for k in range(1000)]
    where = _held(_sharded(spark.createDataFrame(rows, "doc_id long, text string")), 16, 20_000)
    share = sum(len(t) + 1 for _, t in rows) / 16
    sizes = Counter(t for _, t in rows)
    assert all(len(s) == 1 for t, s in where.items() if sizes[t] * (len(t) + 1) <= share / 4)


def test_query_of_shards(spark):
    df = op13_sharding(spark, DATA)
    docs = {r.doc_id: (r.text or "").encode() for r in spark.read.parquet(f"{DATA}/documents.parquet").collect()}
    import zlib

    rows = df.collect()
    assert len(rows) == len(docs) and all((r["size"], r.text_crc32) == (len(docs[r.doc_id]) + 1, zlib.crc32(docs[r.doc_id])) for r in rows)
    where = defaultdict(set)
    for r in rows:
        where[docs[r.doc_id]].add(r.shard)
    share, copies = sum(r["size"] for r in rows) / 16, Counter(docs.values())
    assert all(len(s) == 1 for t, s in where.items() if copies[t] * (len(t) + 1) <= share / 4)
    assert dict(df.dtypes)["grown_shard"] == "int" and {r.law for r in rows} == {"bytes"}


def _numbers(v):
    return [int(np.floor(64 * float(c))) + 1_000_000 for c in v]


def _rational_covariance(fit):
    n, d = len(fit), len(fit[0])
    mean = [Fraction(sum(v[k] for v in fit), n) for k in range(d)]
    y = [[v[k] - mean[k] for k in range(d)] for v in fit]
    return np.array([[float(sum(r[i] * r[j] for r in y) / n) for j in range(d)] for i in range(d)])


def test_double_doubles_are_exact_beyond_doubles():
    r = np.random.default_rng(1)
    a, b = r.normal(size=200) * 10.0 ** r.integers(-9, 9, 200), r.normal(size=200)
    p, e = whitening.two_product(a, b)
    s, f = whitening.two_sum(a, b)
    for k in range(200):
        assert Fraction(p[k]) + Fraction(e[k]) == Fraction(a[k]) * Fraction(b[k]) and Fraction(s[k]) + Fraction(f[k]) == Fraction(a[k]) + Fraction(b[k])
    big = np.array([1e16, 1.0, -1e16, 1e-9] * 25)[:, None]
    high, low = whitening.folded(big, np.zeros_like(big))
    assert abs(high[0] + low[0] - 25 * (1 + 1e-9)) < 1e-13
    assert sum(map(Fraction, whitening.quotient(10**18 + 1, 3))) - Fraction(10**18 + 1, 3) < Fraction(1, 10**14)


def test_whitening_of_odd_rows_equals_fractions(spark):
    r = np.random.default_rng(2)
    mix = r.normal(size=(5, 5))
    good = [(int(k), [float(np.float32(c)) for c in r.normal(size=5) @ mix + 3]) for k in range(60)]
    nan, inf = float("nan"), float("inf")
    odd = [(900, None), (901, []), (902, [1.0, None, 1.0, 1.0, 1.0]), (903, [nan] * 5), (904, [1.0, inf, 0.0, 0.0, 0.0]), (905, [1.0, 2.0]), (906, [1e30] * 5)]
    rows = good + odd + [(None, good[0][1]), good[3], good[3], (990, [-c for c in good[1][1]])]
    df = spark.createDataFrame([(k, v, "x") for k, v in rows], "vec_id long, embedding array<float>, n string").repartition(7)
    got = whitening.whitened(df, 16).collect()
    kept = [(k, _numbers(v)) for k, v in good + rows[-4:]]
    assert Counter((g.vec_id, g.component) for g in got) == Counter((k, c) for k, _ in kept for c in range(1, 6))
    fit = sorted({tuple(v) for _, v in kept})
    n, matrix = len(fit), _rational_covariance(fit)
    values, axes = np.linalg.eigh(matrix)
    values, axes = values[::-1], axes[:, ::-1]
    sums = [sum(v[k] for v in fit) for k in range(5)]
    by_id = {k: v for k, v in kept}
    sign = {}
    for g in got:
        d = [n * v - s for v, s in zip(by_id[g.vec_id], sums)]
        assert (g.n, g.deviation) == (n, sum(v * v for v in d))
        want = float(np.array([v / n for v in d]) @ axes[:, g.component - 1] / np.sqrt(values[g.component - 1]))
        side = sign.setdefault(g.component, 1 if abs(g.whitened - want) < abs(g.whitened + want) else -1)
        assert abs(side * g.whitened - want) < 1e-9
        assert abs(g.explained - values[g.component - 1] / np.trace(matrix)) < 1e-12 and g.identity_error < 1e-10
    assert whitening.whitened(df.limit(0)).count() == 0 and whitening.whitened(df.where("vec_id >= 900 and vec_id < 905")).count() == 0


def test_whitening_without_variance(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0]), (2, [1.0, 2.0, 3.0])], "vec_id long, embedding array<double>")
    got = whitening.whitened(df).collect()
    assert len(got) == 6 and all(g.n == 1 and g.deviation == 0 and g.whitened is None and g.explained is None and g.identity_error is None for g in got)
    line = spark.createDataFrame([(k, [float(k), 2.0 * k, 5.0]) for k in range(10)], "vec_id long, embedding array<double>")
    got = whitening.whitened(line).collect()
    assert all((g.whitened is None) == (g.component > 1) for g in got) and max(g.identity_error for g in got) < 1e-12


def test_covariance_doesnt_depend_on_partitions(spark):
    r = np.random.default_rng(7)
    rows = [(k, [int(v) for v in r.integers(0, 10**9, 40)]) for k in range(500)]
    df = spark.createDataFrame(rows, "vec_id long, x array<long>")
    one, many = (whitening.fitted(df.repartition(p)) for p in (1, 13))
    exact = _rational_covariance([v for _, v in rows])
    centre = one.centre
    got = whitening.covariance(df, centre.n, 40, whitening._pairs(centre))
    assert np.array_equal(got, exact) and np.array_equal(one.values, many.values)


def test_query_of_whitening_covers_its_table(spark):
    got = op11_embedding_whitening(spark, DATA)
    assert got.count() == 16 * spark.read.parquet(f"{DATA}/embeddings.parquet").count()
    assert got.agg(F.max("identity_error")).first()[0] < 1e-9
