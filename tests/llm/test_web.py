import base64
import gzip
import hashlib
import random
from collections import Counter

import pytest
from pyspark.sql import functions as F

from decidra.llm import warc
from decidra.llm.common import scratch
from decidra.llm.url_filter import Rule, judged

digest = lambda b: base64.b32encode(hashlib.sha1(b).digest()).decode()


def records(n=6, zipped=True):
    made = [warc.record(k, f"http://h/{k}", b"payload %d " % k * (50 * k), digest(b"payload %d " % k * (50 * k)), None) for k in range(n)]
    return [warc.zipped(r) for r in made] if zipped else made


@pytest.mark.parametrize("zipped", [True, False])
def test_salvage_recovers_later_records(zipped):
    parts = records(6, zipped)
    at = sum(map(len, parts[:3]))
    for damage in (b"", b"\0" * 100, b"WARC/1.0\r\nbroken", b"\x1f\x8b\x08junk"):
        data = b"".join(parts[:3]) + parts[3][: len(parts[3]) // 2] + damage + b"".join(parts[4:])
        got = list(warc.salvaged(data))
        assert [g[3]["id"] for g in got if g[0] == "record"] == [f"<urn:page:{k}>" for k in (0, 1, 2, 4, 5)]
        assert got[0][1] == 0 and got[-1][2] == len(data)
        assert all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
        assert [g[1] for g in got if g[0] == "gap"] == [at]


def test_salvage_checks_digests_and_ends():
    parts = records(4, False)
    bad = parts[2].replace(b"payload 2", b"payload X", 1)
    got = list(warc.salvaged(parts[1] + bad + parts[3][:-10]))
    assert [(g[0], g[3] if g[0] == "gap" else g[3]["id"]) for g in got] == [("record", "<urn:page:1>"), ("gap", "payload digest")]
    assert list(warc.salvaged(b"")) == [] and list(warc.salvaged(b"noise"))[0][:3] == ("gap", 0, 5)


def test_salvage_reads_members_of_other_writers(monkeypatch):
    plain = records(5, False)
    one = lambda b: gzip.compress(b)
    ids = lambda data: [(g[0], g[3]["id"][-2] if g[0] == "record" else g[1:3]) for g in warc.salvaged(data)]
    want = [("record", str(k)) for k in range(5)]
    # all records in one member, and several in each
    for data in (one(b"".join(plain)), one(b"".join(plain[:2])) + one(b"".join(plain[2:]))):
        got = list(warc.salvaged(data))
        assert ids(data) == want and got[0][1] == 0 and got[-1][2] == len(data)
        assert all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))
    # damage within a member's content, and a member that breaks off
    bad = plain[2].replace(b"payload 2", b"payload X", 1)
    got = list(warc.salvaged(one(b"".join([*plain[:2], bad, *plain[3:]]))))
    assert [g[3]["id"][-2] if g[0] == "record" else "-" for g in got] == ["0", "1", "-", "3", "4"] and "payload digest (content" in got[2][3]
    noise = [warc.record(k, "u", p, digest(p), None) for k in range(6) for p in [random.Random(k).randbytes(20_000)]]
    cut, whole = one(b"".join(noise[:5]))[:70_000], one(noise[5])
    got = list(warc.salvaged(cut + whole))
    assert [g[3]["id"][-2] if g[0] == "record" else "-" for g in got] == ["0", "1", "2", "-", "5"] and got[3][:3] == ("gap", 0, len(cut)) and got[4][1:3] == (len(cut), len(cut + whole))
    # full members: a whole record isn't continued, a longer one is
    monkeypatch.setattr(warc, "MEMBER_BYTES", len(plain[3]))
    assert ids(one(plain[3]) + one(plain[4]) + one(plain[2])) == [("record", "3"), ("record", "4"), ("record", "2")]
    assert ids(warc.zipped(plain[4]) + warc.zipped(plain[2])) == [("record", "4"), ("record", "2")]
    short = one(plain[4][:-10])
    assert ids(short + one(plain[1])) == [("gap", (0, len(short))), ("record", "1")]


def foreign(payload, said, kind="response"):
    """A record of another writer, with the digest line as given."""
    block = b"HTTP/1.1 200 OK\r\n\r\n" + payload
    return f"WARC/1.1\r\nWARC-Type: {kind}\r\nWARC-Record-ID: <urn:x>\r\nWARC-Payload-Digest: {said}\r\nContent-Length: {len(block)}\r\n\r\n".encode() + block + b"\r\n\r\n"


def test_digests_of_other_writers():
    p = b"some payload"
    b32 = lambda name: base64.b32encode(hashlib.new(name, p).digest()).decode()
    good = [f"sha1:{b32('sha1')}", f"SHA1:{b32('sha1').lower()}", f"sha-1:{hashlib.sha1(p).hexdigest()}", b32("sha1"), hashlib.sha1(p).hexdigest().upper(), f"sha256:{b32('sha256')}", f"SHA-256: {hashlib.sha256(p).hexdigest()}"]
    good += [f"md5:{hashlib.md5(p).hexdigest()}", f"md5:{b32('md5').rstrip('=')}", f"sha512:{b32('sha512')}", "blake9:anything", "xxh64:00"]
    for said in good:
        assert [g[0] for g in warc.salvaged(foreign(p, said))] == ["record"], said
    for said in (f"sha1:{b32('sha256')}", f"sha256:{b32('sha1')}", "md5:" + "0" * 32, "sha1:short", hashlib.sha1(b"other").hexdigest()):
        assert [g[3] for g in warc.salvaged(foreign(p, said))] == ["payload digest"], said
    assert [g[3]["digest"] for g in warc.salvaged(foreign(p, f"sha1:{b32('sha1')}") + foreign(p, "blake9:x"))] == [b32("sha1"), "blake9:x"]


@pytest.mark.parametrize("damage", [b"", b"\0" * 99, b"\x1f\x8b\x08junk", b"WARC/1.0\r\nno"])
def test_members_and_plain_records_alternate(damage):
    plain, packed = records(7, False), records(7)
    parts = [packed[0], packed[1], plain[2], plain[3], packed[4], plain[5], packed[6]]
    for broken in (None, 1, 3, 4):
        kept = [parts[k] if k != broken else parts[k][: len(parts[k]) // 2] + damage for k in range(7)]
        got = list(warc.salvaged(b"".join(kept)))
        assert [g[3]["id"] for g in got if g[0] == "record"] == [f"<urn:page:{k}>" for k in range(7) if k != broken], broken
        assert got[0][1] == 0 and got[-1][2] == sum(map(len, kept)) and all(a[2] == b[1] for a, b in zip(got, got[1:], strict=False))


@pytest.mark.parametrize("n", [6, 400])
def test_a_wrong_checksum_costs_no_record(n):
    """One member whose checksum alone is wrong: all records are sound."""
    r = random.Random(n)
    noise = [warc.record(k, "u", p, digest(p), None) for k in range(n) for p in [r.randbytes(r.randrange(10, 900))]]
    data = bytearray(gzip.compress(b"".join(noise)))
    data[-8] ^= 1
    for more in (b"", warc.zipped(noise[0])):
        got = list(warc.salvaged(bytes(data) + more))
        assert sum(g[0] == "record" for g in got) == n + bool(more) and "incorrect data check" in [g[3] for g in got if g[0] == "gap"][0]
    # flipped bits in the compressed bytes lose what follows them, and nothing before
    for at in (len(data) // 3, len(data) // 2):
        hurt = bytearray(gzip.compress(b"".join(noise)))
        hurt[at] ^= 0xFF
        ids = [g[3]["id"] for g in warc.salvaged(bytes(hurt)) if g[0] == "record"]
        before = max(0, n * at // len(data) - n // 20 - 2)
        assert ids[:before] == [f"<urn:page:{k}>" for k in range(before)] and len(set(ids)) == len(ids)


def test_files_are_cut_by_bytes(spark, monkeypatch):
    monkeypatch.setattr(warc, "BUNDLE", 40_000)
    monkeypatch.setattr(warc, "FILE_BUNDLES", 2)
    r = random.Random(1)
    rows = [(k, "u", r.randbytes(3000).hex()) for k in range(120)] + [(200, "u", r.randbytes(90_000).hex())]
    path = scratch(spark, "test-warc-cut")
    warc.write(spark.createDataFrame(rows, "page_id long, url string, html string").coalesce(1), path)
    sizes = [x.length for x in spark.read.format("binaryFile").load(path).select("length").collect()]
    assert len(sizes) > 3 and max(sizes) < 40_000 + 110_000
    assert warc.read(spark, path).where("entry = 'record'").count() == 121


def test_archive_round_trip(spark):
    rows = [(1, "u1", "same"), (2, "u2", "same"), (3, None, None), (4, "u\r\n4", ""), (5, "u5", "é" * 1000), (None, "u6", "same"), (7, "u7", "seven"), (7, "u7", "seven"), (8, "u8", "x" * 20_000_000)]
    df = spark.createDataFrame([(*r, "clash") for r in rows], "page_id long, url string, html string, digest string")
    path = scratch(spark, "test-warc")
    warc.write(df, path)
    got = warc.read(spark, path, payloads=True).collect()
    assert all(g.entry == "record" for g in got)
    out = Counter((g.record_id, g.record_type, g.payload_bytes, g.payload_digest, g.refers_to) for g in got)
    want = Counter()
    for page, _, html in rows:
        b = (html or "").encode()
        tops = [p for p, _, h in rows if (h or "") == (html or "") and p is not None]
        top = max(tops)
        revisit = page != top
        want[f"<urn:page:{'' if page is None else page}>", "revisit" if revisit else "response", len(b), digest(b), f"<urn:page:{top}>" if revisit else None] += 1
    assert out == want
    assert {g.record_id: g.payload.decode() for g in got if g.record_type == "response"}["<urn:page:5>"] == "é" * 1000
    empty = scratch(spark, "test-warc-empty")
    warc.write(df.limit(0), empty)
    assert warc.read(spark, empty).count() == 0


def test_url_rules_and_reputation(spark):
    urls = [(k, f"http://{'bad' if k % 2 else 'good'}.site.org/p{k}") for k in range(400)] + [(500, None), (501, "no scheme"), (502, "HTTP://A.Example.COM?x"), (503, "http://a.example.com/en/7x#f"), (504, "http://example.com/en/1"), (505, "http://xexample.com/en/7"), (None, "http://new.site.org/"), (1, "http://bad.site.org/p1"), (506, "http://" + "a" * 100_000 + ".com/")]
    pages = spark.createDataFrame([(a, b, "clash") for a, b in urls], "page_id long, url string, host string")
    outcomes = spark.createDataFrame([(k, k % 2, 9) for k in range(400)] + [(None, 1, 9), (3, None, 9)], "page_id long, bad int, n int")
    rules = [Rule("block", "com/en/"), Rule("allow", "example.com/en/7")]
    out = {r.page_id: r for r in judged(pages, outcomes, rules).collect()}
    assert (out[500].host, out[500].path, out[501].host, out[501].rule) == ("", "", "", None)
    assert (out[502].host, out[502].path, out[502].rule) == ("a.example.com", "", None)
    assert (out[503].rule, out[503].verdict) == ("example.com/en/7", "allow") and out[504].verdict == "block" and out[505].rule == "com/en/"
    assert out[1].verdict == "block" and out[2].verdict == "allow" and out[506].verdict == "allow"
    assert judged(pages, outcomes.limit(0), rules).where(F.col("verdict") == "block").count() == 2
    assert judged(pages.limit(0), outcomes, rules).count() == 0
