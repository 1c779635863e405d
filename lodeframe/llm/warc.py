"""WARC writing and a salvage reader.

Archives are blobs of gzip members, one record each, kept in a table (archive, content): the shape of Spark's
binaryFile source, so real archive files are read by the same reader. After a failed check the reader
searches for the next gzip member or version line, goes on from there, and logs the skipped bytes.
"""

from __future__ import annotations

import base64
import hashlib
import re
import urllib.parse
import zlib
from collections.abc import Iterable, Iterator
from dataclasses import dataclass, field

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import materialize

VERSION = b"WARC/1.1"
LINES = (b"WARC/1.0\r\n", b"WARC/1.1\r\n")
#: Bytes of a record's header at most.
HEADER = 1 << 22
MAGIC = b"\x1f\x8b\x08"
#: An archive is closed once it holds so many bytes.
ARCHIVE = 4 << 20
DATE = "2020-01-01T00:00:00Z"


def payload_digest(payload: bytes) -> str:
    return base64.b32encode(hashlib.sha1(payload).digest()).decode("ascii")


def _safe(value: str) -> str:
    """A header value without line breaks or controls, reversible by unquote."""
    return re.sub(r"[\x00-\x20\x7f%]", lambda m: f"%{ord(m[0]):02X}", value)


def write_record(page_id: int | None, url: str | None, payload: bytes, first: int | None, digest: str) -> bytes:
    """One record, gzip-compressed. ``first`` is the page that the record revisits, or None for a response."""
    head = [VERSION, f"WARC-Type: {'response' if first is None else 'revisit'}".encode(), f"WARC-Date: {DATE}".encode()]
    head.append(f"WARC-Record-ID: <urn:page:{'' if page_id is None else page_id}>".encode())
    if url is not None:
        head.append(f"WARC-Target-URI: {_safe(url)}".encode("utf-8", "surrogatepass"))
    head += [f"WARC-Payload-Digest: sha1:{digest}".encode(), f"Payload-Length: {len(payload)}".encode()]
    block = b"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: %d\r\n\r\n" % len(payload)
    if first is None:
        block += payload
    else:
        head += [b"WARC-Profile: http://netpreserve.org/warc/1.1/revisit/identical-payload-digest", f"WARC-Refers-To: <urn:page:{first}>".encode()]
    head += [b"Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}".encode()]
    packer = zlib.compressobj(1, zlib.DEFLATED, 31)
    return packer.compress(b"\r\n".join(head) + b"\r\n\r\n" + block + b"\r\n\r\n") + packer.flush()


@dataclass
class Record:
    offset: int
    headers: dict[str, str]
    payload: bytes
    page_id: int | None = None
    refers_to: int | None = None


@dataclass
class Salvage:
    """What a reading found: records and quarantined gaps (start, end, reason)."""

    records: list[Record] = field(default_factory=list)
    gaps: list[tuple[int, int, str]] = field(default_factory=list)


class BadRecord(ValueError):
    pass


def _page(urn: str | None) -> int | None:
    m = re.fullmatch(r"<urn:page:(-?\d+)>", urn or "")
    return int(m[1]) if m else None


def parse_record(data: bytes, at: int = 0) -> tuple[Record, int]:
    """The record at ``at`` and the offset after it; raises BadRecord when any check fails."""
    end = data.find(b"\r\n\r\n", at, at + HEADER) if data[at : at + 10] in LINES else -1
    if end < 0:
        raise BadRecord("no version line or header end")
    headers = {}
    for line in data[at:end].split(b"\r\n")[1:]:
        name, colon, value = line.partition(b":")
        if not colon:
            raise BadRecord("malformed header line")
        headers[name.strip().lower().decode("latin-1")] = value.strip().decode("utf-8", "replace")
    length = headers.get("content-length", "")
    if not re.fullmatch(r"\d+", length):
        raise BadRecord("no content length")
    start, stop = end + 4, end + 4 + int(length)
    if data[stop : stop + 4] != b"\r\n\r\n":
        raise BadRecord("block is cut short or longer than stated")
    head, _, payload = data[start:stop].partition(b"\r\n\r\n") if headers.get("content-type", "").startswith("application/http") else (b"", b"", data[start:stop])
    digest = headers.get("warc-payload-digest")
    if digest and headers.get("warc-type") == "response" and digest != f"sha1:{payload_digest(payload)}":
        raise BadRecord("payload digest differs")
    return Record(at, headers, payload, _page(headers.get("warc-record-id")), _page(headers.get("warc-refers-to"))), stop + 4


def _member(data: bytes, at: int) -> tuple[bytes, int, str | None]:
    """The content of the gzip member at ``at``, the offset reached, and what is wrong with it: then the content ends there."""

    def unpacked(most: int, upto: int | None = None) -> tuple[bytearray, int, str | None]:
        unpack, out, place, step = zlib.decompressobj(31), bytearray(), at, min(most, 1024)
        while not unpack.eof:
            # input in growing slices: decompressobj keeps a copy of the rest of what it is given, and most false starts end soon
            size = min(step, upto - place) if upto is not None and place < upto else min(most, step)
            step = min(4 * step, 262144)
            part = data[place : place + size]
            if not part:
                return out, place, "member is cut short"
            try:
                out += unpack.decompress(part)
            except zlib.error as e:
                return out, place, f"gzip: {e}"
            place += len(part)
        return out, place - len(unpack.unused_data), None

    out, place, wrong = unpacked(262144)
    if wrong and wrong.startswith("gzip"):
        # a failing call gives nothing back: its slice is read again by bytes
        out, place, wrong = unpacked(1, place)
    return bytes(out), place, wrong


def _next(data: bytes, marker: bytes):
    """A function that finds the first ``marker`` from a place on. Places only rise, so nothing is searched twice."""
    hit = -2

    def find(at: int) -> int:
        nonlocal hit
        if hit != -1 and hit < at:
            hit = data.find(marker, at)
        return len(data) if hit == -1 else hit

    return find


def _inside(data: bytes) -> tuple[list[Record], list[tuple[int, int, str]]]:
    """Records and gaps of a member's content; after a bad record it goes on at the next version line."""
    records, gaps, at, bad, version = [], [], 0, None, _next(data, b"WARC/1.")
    while at < len(data):
        try:
            record, after = parse_record(data, at)
        except BadRecord as e:
            bad = bad or (at, str(e))
            at = version(at + 1)
            continue
        if bad:
            gaps.append((bad[0], at, bad[1]))
            bad = None
        records.append(record)
        at = after
    if bad:
        gaps.append((bad[0], len(data), bad[1]))
    return records, gaps


def salvage(data: bytes) -> Salvage:
    """All records of an archive, plain or gzip by member or by stream; damaged stretches are skipped and logged.

    A bad record costs its member no other one: its gap is the member's, with the place inside in the reason. Of a member
    that fails its own check, the records before the damage are kept where there are several; one alone falls with it.
    The time is in proportion to the bytes, and to HEADER for each false version line.
    """
    found, at, bad = Salvage(), 0, None
    magic, version = _next(data, MAGIC), _next(data, b"WARC/1.")
    while at < len(data):
        gaps, wrong, versions = [], None, at + 1
        try:
            if data.startswith(MAGIC, at):
                inside, after, wrong = _member(data, at)
                records, gaps = _inside(inside)
                for r in records:
                    r.offset = at
                if wrong:
                    if len(records) + len(gaps) < 2:
                        records = []
                    found.records += records
                    # stored blocks hold plain version lines: what was read isn't searched for them again
                    versions = after if records else versions
                    raise BadRecord(wrong)
            else:
                record, after = parse_record(data, at)
                records = [record]
        except BadRecord as e:
            bad = bad or (at, str(e))
            at = min(magic(at + 1), version(versions))
            continue
        if bad:
            found.gaps.append((bad[0], at, bad[1]))
            bad = None
        found.records += records
        found.gaps += [(at, after, f"{why}, bytes {x} to {y} of the member") for x, y, why in gaps]
        at = after
    if bad:
        found.gaps.append((bad[0], len(data), bad[1]))
    return found


def damaged(data: bytes, spans: Iterable[tuple[int, int]], turn: int = 0) -> bytes:
    """``data`` with each span spoilt in one of four ways by turns: its magic, its middle, its check sum, or a third of it zeroed."""
    out = bytearray(data)
    for k, (start, end) in enumerate(spans, turn):
        third = (end - start) // 3
        lo, hi = ((start, start + 2), (start + third, start + third + 4), (end - 8, end - 4), (start + third, start + 2 * third))[k % 4]
        out[lo:hi] = bytes(hi - lo) if k % 4 == 3 else bytes(x ^ 0x5A for x in out[lo:hi])
    return bytes(out)


def write_archives(pages: DataFrame, least: int = 0, archive_bytes: int = ARCHIVE) -> DataFrame:
    """(archive, content) of WARC records for every row of (page_id, url, html), in the shared folder.

    Of equal payloads of at least ``least`` bytes the smallest page_id is the response (every row that has it) and others
    revisit it. A null html is empty; rows without an id are responses where no row of their payload has one.
    Only the small (digest, length) table is grouped; a payload that a third of all pages hold is joined in
    splits, and archives are cut by bytes.
    """
    rows = pages.select("page_id", "url", F.coalesce(F.col("html"), F.lit("")).cast("binary").alias("html")).withColumn("sha", F.sha1("html"))
    first = rows.where(F.length("html") >= least).groupBy("sha").agg(F.min("page_id").alias("first"), F.count("*").alias("n")).where("n > 1 and first is not null")
    joined = rows.join(first.select(F.col("sha").alias("_sha"), "first"), F.col("sha") == F.col("_sha"), "left").select("page_id", "url", "html", "first")

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        part, size = [], 0

        def close():
            body = b"".join(part)
            return pa.RecordBatch.from_arrays([pa.array([hashlib.sha1(body).hexdigest() + ".warc.gz"]), pa.array([body], pa.binary())], names=["archive", "content"])

        for b in batches:
            for page, url, html, base in zip(*(b.column(k) for k in range(4))):
                payload, page, base = html.as_py(), page.as_py(), base.as_py()
                record = write_record(page, url.as_py(), payload, base if base != page else None, payload_digest(payload))
                part.append(record)
                size += len(record)
                if size >= archive_bytes:
                    yield close()
                    part, size = [], 0
        if part:
            yield close()

    return materialize(joined.mapInArrow(work, "archive string, content binary"), "archives")


def _length(r: Record) -> int:
    """Bytes of a record's payload; of a revisit, which has none of its own, as its header states."""
    stated = r.headers.get("payload-length", "")
    return int(stated) if r.headers.get("warc-type") == "revisit" and stated.isdigit() else len(r.payload)


def _digest(r: Record) -> str | None:
    return r.headers.get("warc-payload-digest", "").removeprefix("sha1:") or None


RECORD = "archive string, offset long, page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long, payload binary, gap_end long, reason string"


def read_archives(archives: DataFrame, with_payload: bool = True) -> DataFrame:
    """Records and quarantined gaps of (archive, content): a gap has `reason`, `offset` and `gap_end` and no record."""

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content")):
                got, rows = salvage(content.as_py() or b""), []
                for r in got.records:
                    h = r.headers
                    url = h.get("warc-target-uri")
                    rows.append((name.as_py(), r.offset, r.page_id, None if url is None else urllib.parse.unquote(url), _length(r), _digest(r), h.get("warc-type"), r.refers_to, r.payload if with_payload else None, None, None))
                rows += [(name.as_py(), a, None, None, None, None, None, None, None, z, why) for a, z, why in got.gaps]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = [x.split()[0] for x in RECORD.split(", ")]
    types = [{"string": pa.string(), "long": pa.int64(), "binary": pa.binary()}[x.split()[1]] for x in RECORD.split(", ")]
    return archives.select("archive", "content").mapInArrow(work, RECORD)


#: Of the damaged copies that page_report reads, the records of pages with this remainder by the modulus are spoilt.
SPOILT, MODULUS = 3, 97


def page_report(pages: DataFrame) -> DataFrame:
    """Per page, read back from its archive: page_id, payload_bytes, payload_digest, record_type, refers_to, salvaged.

    Each archive is read twice: as it was written, which must leave no gap, and from a copy in which the records of some pages are
    spoilt. `salvaged` tells whether the page's record was found in its place in the copy: all but the spoilt ones are to be.
    """

    def work(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            for name, content in zip(b.column("archive"), b.column("content")):
                data = content.as_py()
                whole = salvage(data)
                if whole.gaps:
                    raise ValueError(f"{name.as_py()}: {whole.gaps[0]}")
                ends = [*(r.offset for r in whole.records[1:]), len(data)]
                copy = damaged(data, [(r.offset, z) for r, z in zip(whole.records, ends) if r.page_id is not None and r.page_id % MODULUS == SPOILT])
                there = {r.offset for r in salvage(copy).records}
                rows = [(r.page_id, _length(r), _digest(r), r.headers.get("warc-type"), r.refers_to, r.offset in there) for r in whole.records]
                if rows:
                    yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*rows), types)], names=names)

    names = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "salvaged"]
    types = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.bool_()]
    return write_archives(pages).select("archive", "content").mapInArrow(work, "page_id long, payload_bytes long, payload_digest string, record_type string, refers_to long, salvaged boolean")
