import hashlib
import random
import re

import numpy as np
import pytest

from decidra.llm import pii, secrets_scan, spans, toxicity
from decidra.llm.common import shared_dir
from decidra.llm.decontamination import matches, without_leaks
from decidra.llm.quality_classifier import cotrain
from decidra.llm.quality_classifier import fit as fit_quality
from decidra.llm.quality_classifier import score as score_quality
from decidra.llm.queries_quality_rules import op8_quality_rules
from decidra.llm.quality_rules import judged

ITEM = "Then John has 5 apples, and Mary gives John 12 more apples and 3 kg of sugar. How many apples does John have now?"


def test_decontamination_finds_re_parameterised_items(spark):
    docs = [
        (1, "Intro. " + ITEM), (2, ITEM.replace("John", "Peter").replace("Mary", "Anna").replace("5", "7").replace("12", "20").replace("3 kg", "9 lb")), (3, "a clean text about apples and sugar that John wrote, with 5 words more than needed"),
        (4, None), (5, ""), (None, ITEM), (6, ITEM.lower()), (7, "word " * 20_000), (1, "Intro. " + ITEM),
    ]
    bench = [(0, ITEM, "x"), (1, None, "x"), (2, "", "x"), (3, "too short", "x"), (None, ITEM, "x")]
    df = spark.createDataFrame([(a, b, 1) for a, b in docs], "doc_id long, text string, hash int")
    items = spark.createDataFrame(bench, "item_id long, text string, hash string")
    got = {(r.doc_id, r.item_id): r.kind for r in matches(df, items).collect()}
    assert got == {(1, 0): "exact", (2, 0): "re-parameterised", (6, 0): got.get((6, 0))} and got[6, 0]
    kept = without_leaks(df, items)
    assert kept.columns == df.columns and sorted((r.doc_id or -1) for r in kept.collect()) == [-1, 3, 4, 5, 7]
    assert matches(df.limit(0), items).count() == 0 and matches(df, items.limit(0)).count() == 0


def test_decontamination_checks_slots(spark):
    bad = ITEM.replace("John has", "Carl has").replace("gives John", "gives Bob").replace("does John", "does Tom").replace("apples and 3", "pears or 3")
    df = spark.createDataFrame([(1, bad)], "doc_id long, text string")
    got = matches(df, spark.createDataFrame([(0, ITEM)], "item_id long, text string"), coverage=0.3, consistent=0.9)
    assert got.count() == 0


def test_decontamination_keeps_windows_of_numbers(spark):
    items = [(0, "Compute 12 + 7 * 5 - 3 of 8"), (1, "The table reads 3 4 5 6 7 8 9 10 11 12 13 14 15 16 17 18 19 20 and ends there"), (2, "1 2 3 5 8 13 21 34 55 89"), (3, "Convert 5 km 300 m 20 cm 4 mm")]
    docs = [(k, f"Before it stands a line. {t}. After it stands one.") for k, t in items] + [(9, "Compute 13 + 8 * 6 - 4 of 9. Then 2 3 4 6 9 14 22 35 56 90 and 6 km 400 m 30 cm 5 mm")]
    df, bench = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(items, "item_id long, text string")
    got = {(r.doc_id, r.item_id): (r.coverage, r.kind) for r in matches(df, bench).collect()}
    assert got == {(k, k): (1.0, "exact") for k in range(4)}


def test_decontamination_of_short_items_takes_whole_sentences(spark):
    items = spark.createDataFrame([(0, "Compute 3 + 4."), (1, "Name it!"), (2, "...")], "item_id long, text string")
    rows = [(1, "First. Compute 3 + 4. Then stop."), (2, "compute 3 4"), (3, "We compute 3 + 4 here."), (4, "Compute 3 + 5."), (5, "So. Name it"), (6, "name it so"), (7, "..."), (8, None)]
    got = {(r.doc_id, r.item_id) for r in matches(spark.createDataFrame(rows, "doc_id long, text string"), items).collect()}
    assert got == {(1, 0), (2, 0), (5, 1)}


def test_decontamination_equals_brute_force_on_new_parameters(spark):
    """Word problems and sums with new names and numbers, against a matcher that tries every place of the text."""
    r = random.Random(5)
    names, things = ["Ann", "Bob", "Cid", "Dora", "Egon", "Fay", "Gus", "Hal"], ["apples", "pears", "books", "coins", "cards", "rings", "bells", "boats", "hats", "keys", "nuts", "pens"]

    def problem(a, b, x, y, z, t):
        return f"When {a} has {x} {t} and {b} gives {a} another {y} {t} while {b} keeps {z} {t} of them, how many {t} does {a} hold after {b} has left the {t}?"

    picks = lambda: (*r.sample(names, 2), *r.sample(range(2, 99), 3))
    bench, docs = [], []
    for k, t in enumerate(things):
        one, two = picks(), picks()
        bench.append((k, problem(*one, t)))
        docs.append((k, f"It is told so. {problem(*two, t)} Nobody knows."))  # other parameters
        broken = problem(*two, t).replace(f"does {two[0]}", "does Ida").replace(f"after {two[1]}", "after Jon")
        docs.append((100 + k, f"It is told so. {broken} Nobody knows."))  # names that don't correspond
        docs.append((200 + k, " ".join(r.sample(problem(*two, t).split(), 25))))  # the words in disorder
    df, items = spark.createDataFrame(docs, "doc_id long, text string"), spark.createDataFrame(bench, "item_id long, text string")
    got = {(m.doc_id, m.item_id): m.kind for m in matches(df, items).collect()}

    slotted = re.compile(r"[A-Z][a-z]+|\d+")

    def corresponds(item, text):
        """Tokens are equal but for names and numbers, and these map one to one, at a share of 0.8 of both sides' values."""
        one, two = re.findall(r"\w+", item)[1:], re.findall(r"\w+", text)[1:]
        pairs = set()
        for x, y in zip(one, two, strict=False):
            if slotted.fullmatch(x) and slotted.fullmatch(y) and x.isdigit() == y.isdigit():
                pairs.add((x, y))
            elif x != y:
                return False
        share = lambda side: np.mean([len({p for p in pairs if p[side] == v}) == 1 for v in {p[side] for p in pairs}])
        return min(share(0), share(1)) >= 0.8

    want = {(d, i) for d, t in docs for i, x in bench for s in [re.search(r"When .*\?", t)] if s and corresponds(x, s.group())}
    assert {k for k in got} == want and {(k, k) for k in range(12)} <= want
    assert not any(d >= 100 for d, _ in want) and set(got.values()) == {"re-parameterised"}


def test_decontamination_finds_values_of_other_lengths(spark):
    item = "Then John from New York has three apples, and Smith gives John twelve apples at NASA in New York. How many of three apples does John keep for Smith?"
    swaps = {"John": "Mary Ann", "New York": "Paris", "three": "seventy five", "twelve": "12", "Smith": "McDonald", "NASA": "Intel"}
    told = item
    for a, z in swaps.items():
        told = told.replace(a, z)
    wrong = told.replace("Mary Ann keep", "Carla keep").replace("gives Mary Ann", "gives Bob Lee").replace("of seventy five", "of nine").replace("for McDonald", "for Jones")
    df = spark.createDataFrame([(1, told), (2, item), (3, wrong), (4, item.upper())], "doc_id long, text string")
    got = {r.doc_id: (r.coverage, r.kind) for r in matches(df, spark.createDataFrame([(0, item)], "item_id long, text string")).collect()}
    assert got.keys() == {1, 2, 4} and got[1] == (1.0, "re-parameterised") and got[2] == (1.0, "exact")


def plain_pii(t):
    out = [("email", m.start(), m.end()) for m in re.finditer(r"[A-Za-z0-9._%+-]+@[A-Za-z0-9-]+(\.[A-Za-z0-9-]+)+", t)]
    out += [("ip", m.start(), m.end()) for m in re.finditer(r"[0-9]+(\.[0-9]+)(\.[0-9]+)(\.[0-9]+)", t) if all(int(x) <= 255 for x in m.group().split("."))]
    out += [("card", m.start(), m.end()) for m in re.finditer(r"[0-9]([\x20-]?[0-9])+", t) if 14 <= len(d := re.sub(r"\D", "", m.group())) <= 19 and pii.luhn(d)]
    return out + [("phone", m.start(), m.end()) for m in re.finditer(r"\+[0-9][\x20().0-9-]+[0-9]", t) if 10 <= len(re.sub(r"\D", "", m.group())) <= 15]


def plain_secrets(t):
    out = [("assign", m.start(), m.end()) for m in re.finditer(r"(?i:(password|passwd|secret|token|api_?key))[\"']?\x20*[:=]\x20*[\"']?([A-Za-z0-9+/_.=-]+)", t) if len(m.group(2)) >= 8]
    out += [("access", m.start(), m.end()) for m in re.finditer(r"AKIA[A-Z0-9]+", t) if len(m.group()) >= 16]
    return out + [("hex", m.start(), m.end()) for m in re.finditer(r"[0-9a-f]+", t) if len(m.group()) >= 32]


def test_taken_places_equal_brute_force():
    draw = random.Random(4)
    for _ in range(200):
        made = [("k", a, a + draw.randrange(1, 15)) for a in (draw.randrange(60) for _ in range(draw.randrange(6)))]
        taken = spans.Taken(made)
        for a in range(0, 75, 3):
            z = a + draw.randrange(1, 9)
            assert taken.overlaps(a, z) == any(a < e and s < z for _, s, e in made)


def test_clusters_must_name_a_shared_folder():
    class Named(dict):
        conf = property(lambda self: self)

        def set(self, key, value):
            self[key] = value

    with pytest.raises(ValueError, match="spark.checkpoint.dir"):
        shared_dir(Named({"spark.master": "yarn"}))
    assert shared_dir(Named({"spark.master": "yarn", "spark.checkpoint.dir": "hdfs://x/y/"})) == "hdfs://x/y"
    assert shared_dir(Named({"spark.master": "local[2]"})).startswith("file://")


@pytest.mark.parametrize("seed", range(6))
def test_base_spans_equal_the_patterns(seed):
    r = random.Random(seed)
    parts = ["a@b.c", "@", "x@y", "..", "1.2.3.4", "256.1.1.1", "0255.1.2.3", "1.2.3.4.5.6.7.8", "4111111111111111", "4111 1111-1111 1111", "+1 (212) 555-0100", "+1", "é", " ", "-", "AKIA" + "Z" * 14, "token = ", "Secret:'", "abcd1234efgh", "0" * 33, "f" * 40, "api_key=\"", "passwd:", "+", "%", "\n"]
    for _ in range(300):
        t = "".join(r.choice(parts) for _ in range(r.randint(0, 12)))
        assert sorted(pii.base_spans(t)) == sorted(plain_pii(t)), t
        assert sorted(secrets_scan.base_spans(t)) == sorted(plain_secrets(t)), t


def test_pii_takes_linear_time_on_long_runs():
    for t in ("1" * 300_000, "a" * 300_000, "1." * 150_000, "+1(" * 100_000, "a@" * 150_000):
        pii.base_spans(t)
        pii.nodes(t)


def test_skip_edges_carry_labels(spark):
    text = "Call me: +1 (212) 555-0199 tonight. Office (212) 555-0199 is closed; room 12 stays open."
    rows = [(k, f"word {k} +1 (2{k % 90 + 10}) 555-0{k:03d} and page {k} of 9 and mail u{k}@ex{k}.org then 10.0.{k}.7 ok") for k in range(200)] + [(999, text), (1000, None), (1001, ""), (999, text), (None, text)]
    df = spark.createDataFrame([(a, b, "clash") for a, b in rows], "doc_id long, text string, spans string")
    field = pii.fit(df)
    out = {r.doc_id: r for r in pii.found(df, field, lambda t, base, added: (spans.joined(base + added, pii.KINDS), pii.redacted(t, base + added)), "spans string, new string").collect()}
    second = text.index("(212)", 30)
    assert f"phone:{second}:{second + 14}" in out[999].spans
    assert "room 12 stays" in out[999].new and "555" not in out[999].new
    assert out[1000].spans == "" and out[1001].spans == ""
    assert spans.digest([], pii.KINDS) == hashlib.sha256(b"").hexdigest()


def test_fields_of_a_run_are_nodes(spark):
    cut = lambda t: [t[a:z] for a, z in pii.nodes(t, pii.base_spans(t))]
    assert cut('{"m":"a@b.org","p":"(212)555-0199","n":[3]}') == ["a@b.org", "(212)555-0199", "3"]
    assert cut("id=7;x@y.net/212.555.0199,10.0.0.1:80") == ["7", "x@y.net", "212.555.0199", "10.0.0.1", "80"]
    odd = '{"u":"a1@b.org","tel":"(212)555-0199"}'
    assert pii.observed(pii.nodes(odd, pii.base_spans(odd)), pii.base_spans(odd)).tolist() == [1, 0]
    rows = [(k, f"word {k} +1 (2{k % 90 + 10}) 555-0{k:03d} and page {k} of 9 and mail u{k}@ex{k}.org then 10.0.{k}.7 ok") for k in range(200)]
    rows.append((900, "Call me: +1 (212) 555-0199 tonight. mail=a1@b.org;phone=(212) 555-0199,room=12"))
    df = spark.createDataFrame(rows, "doc_id long, text string")
    field = pii.fit(df)
    out = {r.doc_id: r.new for r in pii.found(df, field, lambda t, base, added: (pii.redacted(t, base + added),), "new string").collect()}
    assert out[900] == "Call me: [phone] tonight. mail=[email];phone=[phone],room=12"


def test_training_nodes_come_from_the_whole_text():
    text = " ".join(f"n{k}" for k in range(2000))
    chosen = pii.sampled(text, pii.nodes(text), 100)
    assert len(chosen) == 100 and chosen == sorted(set(chosen)) and chosen[-1] > 1500 and chosen[50] > 500
    around = pii.neighbours([(0, 1, 0), (1, 2, 2)], np.array([3, 0, 1]))
    assert around[1, 0, 3] == around[1, 2, 1] == around[0, 0, 0] == around[2, 2, 0] == 1 and around.sum() == 4


def test_marginals_equal_enumeration():
    """On a chain, message passing is exact."""
    r = np.random.default_rng(0)
    field = pii.Field(r.normal(size=(pii.FEATURES, 5)), r.normal(size=(3, 5, 5)))
    field.pair = (field.pair + field.pair.transpose(0, 2, 1)) / 2
    x, links = r.normal(size=(3, pii.FEATURES)), np.array([[0, 1, 0], [1, 2, 1]])
    score = x @ field.unary
    p = np.zeros((3, 5))
    for a in range(5):
        for b in range(5):
            for c in range(5):
                w = np.exp(score[0, a] + score[1, b] + score[2, c] + field.pair[0, a, b] + field.pair[1, b, c])
                p[0, a] += w
                p[1, b] += w
                p[2, c] += w
    got = field.marginals(x, links, np.zeros(3, np.int64))
    assert np.abs(got - p / p.sum(1, keepdims=True)).max() < 0.02


ENCODINGS = {"base64": "ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789+/", "base36": "abcdefghijklmnopqrstuvwxyz0123456789", "HEX": "0123456789ABCDEF", "base32": "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"}


def test_randomness_finds_planted_keys_at_the_stated_rate(spark):
    """Keys of four encodings in every fifth text of a table; precision and recall of what only the tests find."""
    r = random.Random(1)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    rows, planted = [], {}
    for k, text in enumerate(texts):
        if k % 5 == 0:
            name = list(ENCODINGS)[k // 5 % 4]
            key = "".join(r.choices(ENCODINGS[name], k=r.choice([24, 32, 40, 48, 64] if name == "base64" else [64, 80])))
            planted[k] = ("random", len(text) + 1, len(text) + 1 + len(key))
            text = f"{text} {key} end"
        rows.append((k, text, 1))
    rows += [(5000, None, 1), (5001, "", 1), (0, rows[0][1], 1), (None, "x" * 50_000, 1)]
    out = secrets_scan.found(spark.createDataFrame(rows, "doc_id long, text string, base int").repartition(4)).collect()
    found = {(x.doc_id, *s) for x in out for s in x.added}
    want = {(k, *s) for k, s in planted.items()}
    assert len(found & want) >= 0.9 * len(want) and len(found & want) >= 0.9 * len(found)
    assert next(x for x in out if x.doc_id == 5000).base == [] and next(x for x in out if x.doc_id == 5001).added == []
    assert [x.added for x in out if x.doc_id == 0][0] == [x.added for x in out if x.doc_id == 0][1]


def _identifiers(r, words):
    """Names, paths, versions, dates and UUIDs as programs write them."""
    import uuid

    w = lambda n: [r.choice(words).lower() for _ in range(n)]
    camel = lambda n: "".join(x.capitalize() for x in w(n))
    return {
        "number": f"{camel(2)}{r.randrange(10, 99999)}{camel(1)}", "camel": (lambda c: c[0].lower() + c[1:])(camel(5)), "snake": "_".join(w(4)), "constant": "_".join(w(4)).upper() + f"_{r.randrange(99)}", "path": "/".join(["", *w(4)]) + f"/{r.choice(words)}{r.randrange(99)}",
        "date": f"{r.choice(words)}-20{r.randrange(10, 30)}-{r.randrange(1, 13):02}-{r.randrange(1, 29):02}T{r.randrange(10, 24)}-{r.randrange(10, 60)}", "kebab": "-".join(w(5)), "uuid": str(uuid.UUID(int=r.getrandbits(128))), "UUID": str(uuid.UUID(int=r.getrandbits(128))).upper(), "digits": str(r.randrange(10**17, 10**22)),
    }


@pytest.mark.parametrize("keys", [True, False])
def test_identifiers_are_no_secrets(spark, keys):
    """Ten kinds of identifiers in every fifth text, with keys in other texts and without: nearly all that is flagged are keys."""
    r = random.Random(9)
    texts = [x.text or "" for x in spark.read.parquet("/root/testdata/sf0.01/documents.parquet").orderBy("doc_id").select("text").collect()]
    words = [w for t in texts[:200] for w in t.split() if w.isascii() and w.isalpha() and 2 < len(w) < 10]
    rows, planted, kinds = [], set(), {}
    for k, text in enumerate(texts):
        if k % 5 == 1:
            for kind, name in _identifiers(r, words).items():
                kinds[k, len(text) + 1, len(text) + 1 + len(name)] = kind
                text += f" {name}"
        if k % 5 == 2 and keys:
            key = "".join(r.choices(ENCODINGS["base64"], k=r.choice([24, 32, 40, 48, 64])))
            planted.add((k, len(text) + 1, len(text) + 1 + len(key)))
            text += f" {key} end"
        rows.append((k, text))
    out = secrets_scan.found(spark.createDataFrame(rows, "doc_id long, text string").repartition(4)).collect()
    found = {(x.doc_id, s["start"], s["end"]) for x in out for s in x.added}
    false = found - planted
    assert len(false) <= max(2, 0.02 * len(found)), [kinds.get(x) for x in false]
    if keys:
        assert len(found & planted) >= 0.9 * len(planted)


def test_scores_of_many_strings_are_those_of_each():
    r = random.Random(3)
    pairs = secrets_scan.Pairs.of(sum(secrets_scan.letter_pairs(t.encode()) for t in [ITEM] * 50).reshape(26, 26).astype(float))
    tokens = ["".join(r.choices(r.choice(list(ENCODINGS.values())), k=r.randrange(1, 90))) + "=" * r.randrange(3) for _ in range(3000)] + ["", "===", "aaaa", "1234567890123456", "____----++++"]
    for table in (None, pairs):
        whole = secrets_scan.bins(tokens, table)
        assert whole[:40] + whole[-5:] == [secrets_scan.p_bin(t, table) for t in tokens[:40] + tokens[-5:]]
    assert secrets_scan.letter_pairs(b"ab-Ba aB1b")[1] == 2 and secrets_scan.letter_pairs(b"ab-Ba aB1b").sum() == 3 and secrets_scan.Pairs.of(np.zeros((26, 26))) is None
    assert {f for _, f, _ in secrets_scan.shaped(ITEM * 9)} == set(range(secrets_scan.FORMS)) and all(secrets_scan.length_class(len(x)) <= k for k, _, x in secrets_scan.shaped(ITEM * 9))


def test_ordinary_strings_pass_for_secrets_no_more_often_than_stated():
    r = random.Random(2)
    words = [w for w in "the of and a to in is was he for it with as his on be at by had not are but from or have an they which one you were her all she there would their we him been has when who will more no if out so said what up its about into than them can only other new some could time these two may then do first any my now such like our over man me even most made after also did many before must through years where much your way well down should because each just those people how too little state good very make world still own see men work long get here between both life being under never day same another know while last".split()]
    texts = [" ".join(r.choice(words).capitalize() if r.random() < 0.1 else r.choice(words) for _ in range(80)) for _ in range(1500)]
    plain, judged_too = ({}, {})
    for k, text in enumerate(texts):
        for c, string in secrets_scan.ordinary(text):
            assert secrets_scan.length_class(len(string)) == c and string in text.replace(" ", "")
            into = plain if k % 2 else judged_too
            into[c, secrets_scan.p_bin(string)] = into.get((c, secrets_scan.p_bin(string)), 0) + 1
    assert {c for c, _ in plain} == set(range(5))
    for c in range(5):  # p-values of strings that nothing distinguishes are uniform
        null = np.array([b for (k, b), n in plain.items() if k == c for _ in range(n)])
        p = np.array([(1 + (null >= b).sum()) / (1 + len(null)) for (k, b), n in judged_too.items() if k == c for _ in range(n)])
        assert all(abs((p <= x).mean() - x) < 0.06 for x in np.unique(p) if x < 0.3)
    assert secrets_scan.thresholds(judged_too, plain) == {}
    assert secrets_scan.ordinary("") == [] and secrets_scan.ordinary("short text only") == []


def test_quality_rules_on_odd_rows(spark):
    rows = [(1, "a b c d e f g h i j k", "en", "s"), (2, None, None, None), (3, "", "en", None), (4, "a b c d e " * 10, "en", "s"), (1, "a b c d e f g h i j k", "en", "s"), (None, "x\nx\n \nx", "en", "s"), (5, "w " * 30_000, "de", "t")]
    df = spark.createDataFrame([(*r, 1) for r in rows], "doc_id long, text string, lang string, source string, n_words int")
    out = {r.doc_id: r for r in judged(df).collect()}
    assert (out[1].n_words, out[1].word_chars, out[1].n_repeat_words, out[1].base_failed) == (11, 11, 0, False)
    assert out[2].base_failed and out[3].base_failed and out[2].n_words == 0
    assert out[4].n_repeat_words == 50 and out[4].base_failed
    assert out[None].n_dup_lines == 2 and out[5].n_repeat_words == 30_000
    assert judged(df.limit(0)).count() == 0 and op8_quality_rules


def test_fences_follow_each_group_and_small_groups_take_the_merged_sketch(spark):
    """Two sources with words of different lengths: what is ordinary in one is beyond the other's fence."""
    r = random.Random(6)
    text = lambda n: " ".join("".join(r.choices("abcdefgh", k=r.randint(n - 1, n + 1))) for _ in range(60))
    rows = [(k, text(5), "en", "short") for k in range(300)] + [(1000 + k, text(11), "en", "long") for k in range(300)]
    rows += [(2000, text(11), "en", "short"), (2001, text(5), "en", "long"), (2002, text(5), "en", "few"), (2003, text(11), "en", "few"), (2004, text(40), "en", "few"), (2005, "# $ % & " * 3 + text(5), "en", "short")]
    kept = {x.doc_id: x.kept for x in judged(spark.createDataFrame(rows, "doc_id long, text string, lang string, source string")).collect()}
    assert not kept[2000] and not kept[2001] and not kept[2005]
    assert kept[2002] and kept[2003] and not kept[2004]
    assert sum(kept[k] for k in range(300)) > 290 and sum(kept[1000 + k] for k in range(300)) > 290


def test_toxicity_learns_words_and_stems(spark):
    r = random.Random(3)
    plain = ["".join(r.choices("aeiou", k=2)) + "".join(r.choices("bdlmn", k=2)) for _ in range(300)]
    texts, labels = [], []
    for k in range(900):
        words = [r.choice(plain) for _ in range(r.randint(5, 150))]
        bad = k % 3 == 0
        if bad:
            for _ in range(3 + len(words) // 30):
                words.insert(r.randrange(len(words)), "zork" + "".join(r.choices("aeiou", k=2)))
        texts.append((k, " ".join(words), 7))
        labels.append((k, int(bad)))
    texts += [(9000, None, 7), (9001, "", 7), (9002, "?!", 7), (None, "hello", 7), (9003, "word " * 20_000, 7), (0, texts[0][1], 7)]
    df = spark.createDataFrame(texts, "doc_id long, text string, score int")
    lab = spark.createDataFrame(labels, "doc_id long, toxic int")
    net = toxicity.fit(df, lab)
    out = toxicity.score(df, net, "score").withColumn("held", toxicity.held_out()).collect()
    assert len(out) == len(texts)
    truth, got = dict(labels), {x.doc_id: x for x in out}
    held = [x for x in out if x.held and x.doc_id in truth]
    good = sum((x.score >= 0.7) == bool(truth[x.doc_id]) for x in held)
    assert good / len(held) > 0.95
    assert got[9000].score == got[9001].score == got[9002].score <= 0.5 and 0 <= got[9003].score <= 1
    none = toxicity.fit(df, lab.limit(0))
    assert {x.score for x in toxicity.score(df, none, "score").collect()} == {0.0}
    assert toxicity.score(df.limit(0), net, "score").count() == 0


def test_toxicity_windows_cover_all_words():
    for n in (0, 1, 47, 48, 49, 80, 81, 500):
        seen = {k for a, z in toxicity.windows_of(n) for k in range(a, z)}
        assert seen == set(range(n))


def test_toxicity_gradients():
    net = toxicity.Network.initial({"a": 1, "b": 2})
    words, at, mask = toxicity._pack([["a", "b", "cc"], ["b", "dd"]])
    net.p = {k: v.astype(np.float64) for k, v in net.p.items()}
    y, one, keep = np.array([1.0, 0.0]), np.ones(2), np.zeros(len(words), bool)
    g, _ = net.gradients(words, at, mask, y, one, keep)
    r = np.random.default_rng(0)
    for name in ("rec", "in", "att", "att_v", "out", "word"):
        flat = net.p[name].reshape(-1)
        for k in r.choice(len(flat), 3):
            was = flat[k]
            flat[k] = was + 1e-3
            up = net.gradients(words, at, mask, y, one, keep)[1]
            flat[k] = was - 1e-3
            down = net.gradients(words, at, mask, y, one, keep)[1]
            flat[k] = was
            assert abs((up - down) / 2e-3 - g[name].reshape(-1)[k]) < 1e-3


def test_co_training_and_odd_rows(spark):
    rows = [(k, ("good plain words of prose here " * 5) if k % 2 else "### $$$ %%% ||| &&& " * 8, "en" if k % 3 else None, f"s{k % 2}", None) for k in range(300)] + [(1000, None, None, None, None), (1001, "", "en", "s", 0), (None, "text", "en", "s", 4)]
    df = spark.createDataFrame([(*r, 0.5) for r in rows], "doc_id long, text string, lang string, source string, n_chars long, score double")
    lab = spark.createDataFrame([(k, k % 2) for k in range(0, 200)], "doc_id long, quality int")
    out = {r.doc_id: r.score for r in score_quality(df, fit_quality(df, lab)).collect()}
    assert all((out[k] >= 0.5) == bool(k % 2) for k in range(300)) and len(out) == 303
    assert {r.score for r in score_quality(df, fit_quality(df, lab.limit(0))).collect()} == {0.5}
    assert score_quality(df.limit(0), fit_quality(df, lab)).count() == 0
    model = cotrain(np.eye(4), np.eye(4), np.array([1.0, 1, 1, 1]), np.zeros((0, 4)), np.zeros((0, 4)))
    assert model.scores(np.eye(4), np.eye(4)).tolist() == [1.0] * 4
