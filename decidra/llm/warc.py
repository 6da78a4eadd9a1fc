"""WARC archives: a writer of one gzip member a record, and a reader that salvages damaged archives.

Writing goes through Spark's text sink, so that any file system will do and lost tasks are written again under its
commit protocol.  That sink ends each row with a separator.  The last byte of a gzip member is the highest byte of the
content's length, which is zero below 16 MB: the separator is that byte, and longer records are split over several members
(which concatenate to one stream).  A row of the sink is a bundle of about ``BUNDLE`` bytes of members, or one longer record, and a
file holds ``FILE_BUNDLES`` of them.

Reading takes files whole (``binaryFile``) and yields records.  A record whose compression, header, length or payload
digest fails its check is skipped: the reader looks for the next version line or the next gzip member, whichever comes
first, from which a valid record can be read, goes on there and logs the bytes between as quarantined.  So members and
plain records may alternate.  A member may hold any number of records; of one that breaks off, or whose checksum is wrong,
all bytes that can be unpacked are read.  A record that is longer than its member goes on in the next ones.  A member's content
is held whole.  Digests are checked by the algorithm that they name, in base32 or hexadecimal digits of either case; of an
algorithm that isn't known they are reported unchecked.

Defined results: a null payload is empty.  Of equal payloads (of at least ``least`` bytes) the record with the largest id
is the response, others revisit it; rows that repeat that id are responses all.  A null id counts as the smallest one
and is written as an empty id, which reads as null.  Other columns are ignored; an empty table gives an empty archive.
"""

from __future__ import annotations

import base64
import hashlib
import re
import zlib
from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map

PROFILE = "http://netpreserve.org/warc/1.0/revisit/identical-payload-digest"
MEMBER, VERSION = b"\x1f\x8b\x08", re.compile(rb"WARC/1\.[01]\r\n")
#: Bytes of content in a gzip member at most; bytes of members in a row of the sink, about; rows in a file at most.
MEMBER_BYTES, BUNDLE, FILE_BUNDLES = (1 << 24) - 1, 1 << 24, 8
#: Names of digests in archives.
ALGORITHMS = {"sha1": "sha1", "sha-1": "sha1", "sha256": "sha256", "sha-256": "sha256", "sha512": "sha512", "sha-512": "sha512", "md5": "md5"}
HEX32, BASE32 = "0123456789ABCDEFGHIJKLMNOPQRSTUV", "ABCDEFGHIJKLMNOPQRSTUVWXYZ234567"


def payload_digest(payload: Column) -> Column:
    """Bare upper-case base32 of the SHA-1: five bytes of it make eight digits to the base 32."""
    hexed = F.sha1(payload)
    return F.translate(F.concat(*(F.lpad(F.conv(F.substring(hexed, k, 10), 16, 32), 8, "0") for k in (1, 11, 21, 31))), HEX32, BASE32)


def record(page_id: int | None, url: str | None, payload: bytes, digest: str, refers_to: int | None, date: str = "1970-01-01T00:00:00Z") -> bytes:
    """The bytes of a response, or of a revisit, which keeps the payload's HTTP header only."""
    revisit = refers_to is not None
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {len(payload)}\r\n\r\n".encode()
    block = http if revisit else http + payload
    safe = re.sub(r"[\r\n]", " ", url or "")
    head = ["WARC/1.0", f"WARC-Type: {'revisit' if revisit else 'response'}", f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>", f"WARC-Target-URI: {safe}", f"WARC-Date: {date}", f"WARC-Payload-Digest: sha1:{digest}"]
    if revisit:
        head += [f"WARC-Refers-To: <urn:page:{refers_to}>", f"WARC-Profile: {PROFILE}"]
    head += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}"]
    return "\r\n".join(head).encode("utf-8", "surrogatepass") + b"\r\n\r\n" + block + b"\r\n\r\n"


def zipped(data: bytes) -> bytes:
    """One gzip member, or several of ``MEMBER_BYTES`` of content."""
    out = []
    for k in range(0, len(data), MEMBER_BYTES):
        c = zlib.compressobj(6, zlib.DEFLATED, 31)
        out.append(c.compress(data[k : k + MEMBER_BYTES]) + c.flush())
    return b"".join(out)


def write(pages: DataFrame, path: str, least: int = 0) -> None:
    """Writes an archive of ``pages`` (page_id, url, html) as files in the folder ``path``."""
    rows = pages.select(F.col("page_id").cast("long").alias("page_id"), F.col("url").cast("string").alias("url"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    rows = rows.withColumn("digest", payload_digest(F.col("payload"))).withColumn("key", F.coalesce(F.col("page_id").cast("string"), F.lit("")))
    # ids and digests are grouped, and pages are dealt by their ids: a payload that very many pages share is no key of theirs
    keys = pages.select(F.col("page_id").cast("long").alias("page_id"), F.coalesce(F.col("html").cast("string"), F.lit("")).cast("binary").alias("payload"))
    keys = keys.where(F.octet_length("payload") >= least).select("page_id", payload_digest(F.col("payload")).alias("digest"))
    several = keys.groupBy("digest").agg(F.max("page_id").alias("refers_to"), F.count("*").alias("n")).where("n > 1").drop("n")
    others = keys.distinct().join(several, "digest").where(~F.col("page_id").eqNullSafe(F.col("refers_to")))
    marked = rows.join(others.select(F.coalesce(F.col("page_id").cast("string"), F.lit("")).alias("key"), "digest", "refers_to"), ["key", "digest"], "left")

    def work(batches):
        import pyarrow as pa

        def row(members: list[bytes]):
            return pa.RecordBatch.from_arrays([pa.array([b"".join(members)[:-1]], pa.binary())], ["value"])  # the separator ends the last member

        bundle, size = [], 0
        for b in batches:
            for start in range(0, b.num_rows, 64):
                part = b.slice(start, 64)
                for r in zip(*(part.column(c).to_pylist() for c in ("page_id", "url", "payload", "digest", "refers_to")), strict=True):
                    member = zipped(record(*r))
                    if bundle and size + len(member) > BUNDLE:
                        yield row(bundle)
                        bundle, size = [], 0
                    bundle.append(member)
                    size += len(member)
        if bundle:
            yield row(bundle)

    members = arrow_map(marked.select("page_id", "url", "payload", "digest", "refers_to"), work, "value binary")
    members.select(F.col("value").cast("string").alias("value")).write.option("lineSep", "\0").option("compression", "none").option("maxRecordsPerFile", FILE_BUNDLES).text(path)


class Damaged(ValueError):
    """A record fails a check."""


class Short(Damaged):
    """A record is longer than the bytes given; ``need`` are wanted at least."""

    def __init__(self, why: str, need: int) -> None:
        super().__init__(why)
        self.need = need


def _headers(head: bytes) -> dict[str, str]:
    out = {}
    for line in head.split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise Damaged("header line without a colon")
        out[name.decode("latin-1").strip().lower()] = value.decode("utf-8", "replace").strip()
    return out


def digest_of(payload: bytes, said: str) -> bool | None:
    """Whether a labelled digest is the payload's; None if its algorithm isn't known.  Without a label it is a SHA-1."""
    label, colon, value = said.partition(":")
    name = ALGORITHMS.get(label.strip().lower()) if colon else "sha1"
    if name is None:
        return None
    value, real = (value if colon else label).strip(), hashlib.new(name, payload, usedforsecurity=False).digest()
    if len(value) == 2 * len(real):
        return value.lower() == real.hex()
    return value.rstrip("=").upper() == base64.b32encode(real).decode().rstrip("=")


def parsed(data: memoryview | bytes, at: int, check: bool = True) -> tuple[dict, int]:
    """The plain record at ``at`` and where the next one begins."""
    data = bytes(data) if isinstance(data, memoryview) else data
    if not VERSION.match(data, at):
        raise Damaged("no version line")
    end = data.find(b"\r\n\r\n", at)
    if end < 0:
        raise Short("header without an end", len(data) + 1)
    head = _headers(data[at:end])
    try:
        length = int(head["content-length"])
    except (KeyError, ValueError):
        raise Damaged("no length") from None
    block = data[end + 4 : end + 4 + length]
    after = end + 4 + length + 4
    if length >= 0 and after > len(data):
        raise Short("length doesn't fit", after)
    if length < 0 or len(block) < length or data[after - 4 : after] != b"\r\n\r\n":
        raise Damaged("length doesn't fit")
    kind = head.get("warc-type", "")
    is_http = kind in ("response", "revisit") and block.startswith(b"HTTP/")
    http, _, payload = block.partition(b"\r\n\r\n") if is_http else (b"", b"", block)
    said = head.get("warc-payload-digest", "")
    if check and said and kind != "revisit" and digest_of(payload, said) is False:
        raise Damaged("payload digest")
    said = said[5:] if said[:5].lower() == "sha1:" else said
    size = len(payload)
    if kind == "revisit":
        m = re.search(rb"(?i)\r\ncontent-length: *(\d+)", http)
        size = int(m[1]) if m else -1
    return {"type": kind, "id": head.get("warc-record-id"), "uri": head.get("warc-target-uri"), "digest": said or None, "refers_to": head.get("warc-refers-to"), "payload_bytes": size, "payload": payload, "header": head}, after


class _Starts:
    """Places at which a member or a record may begin.  What was found of one kind is kept while the other comes first."""

    def __init__(self, data: bytes):
        self.data, self.member, self.version = data, -1, -1

    def after(self, at: int) -> int:
        """The next place after ``at``; the end if there is none."""
        if self.member <= at:
            k = self.data.find(MEMBER, at + 1)
            self.member = k if k >= 0 else len(self.data)
        if self.version <= at:
            m = VERSION.search(self.data, at + 1)
            self.version = m.start() if m else len(self.data)
        return min(self.member, self.version)


def salvaged(data: bytes) -> Iterator[tuple[str, int, int, dict | str]]:
    """("record", start, end, record) and ("gap", start, end, reason), in order; together they cover all bytes.

    Of several entries in one member each starts with the member, and the last one has its bytes; gaps within it name
    their bytes of its content.  Records before the place where a member breaks off have no bytes, the gap that follows has.
    """
    at, size, gap, why = 0, len(data), None, ""
    starts = _Starts(data)
    while at < size:
        try:
            if data[at : at + 2] == MEMBER[:2]:
                content, after, broken = _member(data, at)
                entries, after, failed = _entries(data, content, after, broken)
                if not entries:
                    raise Damaged(failed)
            else:
                found, after = parsed(data, at)
                entries, broken = [("record", found)], None
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
            at = starts.after(at)
            continue
        if gap is not None:
            yield "gap", gap, at, why
            gap = None
        for k, (entry, what) in enumerate(entries):
            yield entry, at, after if k == len(entries) - 1 and not broken else at, what
        if broken:
            gap, why = at, broken
            at = starts.after(at)
        else:
            at = after
    if gap is not None:
        yield "gap", gap, size, why


def _entries(data: bytes, content: bytes, after: int, broken: str | None) -> tuple[list[tuple[str, dict | str]], int, str]:
    """Records and gaps in a member's content (none if there is no record), where the next member begins, and the first failure."""
    out, at, gap, why, first = [], 0, None, "", broken or "empty member"
    while at < len(content):
        begin = at
        try:
            try:
                found, end = parsed(content, at)
            except Short as e:
                if broken:
                    raise
                content, after, found, end = _continued(data, content, after, at, e)
        except Damaged as e:
            if gap is None:
                gap, why = at, str(e)
                first = why if not out and not broken else first
            m = VERSION.search(content, at + 1)
            if not m:
                break
            at = m.start()
            continue
        if gap is not None:
            out.append(("gap", f"{why} (content {gap} to {begin})"))
            gap = None
        out.append(("record", found))
        at = end
    has_record = any(e == "record" for e, _ in out)
    if gap is not None and has_record and not broken:
        out.append(("gap", f"{why} (content {gap} to {len(content)})"))
    return out if has_record else [], after, first


def _continued(data: bytes, content: bytes, after: int, at: int, short: Short) -> tuple[bytes, int, dict, int]:
    """The record at ``at`` with the members that continue it: its bytes, and what follows them in the last of these members; where the next member begins; the record and its end.

    A member that begins with a version line has a record of its own, unless the one before it is full.
    """
    parts, have, full = [content[at:]], len(content) - at, len(content) >= MEMBER_BYTES
    need = short.need - at
    while True:
        while have < need:
            if data[after : after + 2] != MEMBER[:2]:
                raise short
            more, next_after, broken = _member(data, after)
            if broken or not more or (VERSION.match(more) and not full):
                raise short
            parts.append(more)
            have, after, full = have + len(more), next_after, len(more) >= MEMBER_BYTES
        joined = b"".join(parts)
        try:
            found, end = parsed(joined, 0)
        except Short as e:  # its header ends in a later member
            parts, need = [joined], e.need
            continue
        return joined, after, found, end


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the member at ``at``, where the next one begins, and why it breaks off, if it does.

    It is fed in pieces, so that a member costs time for its own bytes alone.  A piece that fails is fed again byte by
    byte, for all that comes before the failure: a wrong checksum alone costs nothing of the content.
    """
    view, d, got, start = memoryview(data), zlib.decompressobj(31), [], at
    try:
        while not d.eof:
            if at >= len(data):
                return b"".join(got), at, "member without an end"
            got.append(d.decompress(view[at : at + 8192]))
            at = min(len(data), at + 8192)
    except zlib.error as e:
        again = zlib.decompressobj(31)
        for k in range(start, at, 8192):
            again.decompress(view[k : min(at, k + 8192)])
        try:
            for k in range(at, min(len(data), at + 8192)):
                got.append(again.decompress(view[k : k + 1]))
        except zlib.error:
            pass
        return b"".join(got), k, f"compression: {e}"
    return b"".join(got), at - len(d.unused_data), None


SCHEMA = "file string, entry string, start long, end long, record_type string, record_id string, uri string, payload_digest string, payload_bytes long, refers_to string, reason string"


def read(spark: SparkSession, path: str, payloads: bool = False) -> DataFrame:
    """Records and gaps (``entry``) of all files in ``path``; with a column ``payload`` (binary) if asked for."""

    def work(batches):
        import pyarrow as pa

        kinds = [pa.string(), pa.string(), pa.int64(), pa.int64(), pa.string(), pa.string(), pa.string(), pa.string(), pa.int64(), pa.string(), pa.string()] + [pa.binary()] * payloads
        names = [c.split()[0] for c in SCHEMA.split(", ")] + ["payload"] * payloads

        def packed(rows):
            return pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows, strict=True), kinds, strict=True)], names)

        for b in batches:
            for k in range(b.num_rows):
                rows, held, file = [], 0, b.column("path")[k].as_py()
                for entry, start, end, r in salvaged(b.column("content")[k].as_py()):
                    if entry == "gap":
                        rows.append((file, entry, start, end, None, None, None, None, None, None, r, *([None] * payloads)))
                    else:
                        rows.append((file, entry, start, end, r["type"], r["id"], r["uri"], r["digest"], r["payload_bytes"], r["refers_to"], None, *([r["payload"]] * payloads)))
                        held += len(r["payload"]) * payloads
                    if len(rows) >= 5000 or held > 8_000_000:
                        yield packed(rows)
                        rows, held = [], 0
                if rows:
                    yield packed(rows)

    files = spark.read.format("binaryFile").load(path).select("path", "content")
    return files.mapInArrow(work, SCHEMA + ", payload binary" * payloads)
