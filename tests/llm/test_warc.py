import base64
import hashlib

import pytest

from lodeframe.llm import warc

PAGES = "page_id LONG, url STRING, html STRING"


def pages():
    out = [(i, f"http://x/{i}?a=\n%20é", f"<html>{i % 7} é\r\n\r\nWARC/1.1\r\n</html>") for i in range(40)]
    out += [(100, None, None), (101, "u", ""), (102, "u", "long " * 300_000), (None, "n", "<html>3 é\r\n\r\nWARC/1.1\r\n</html>"), (None, "n", "only here"), (103, "u", "rep"), (103, "u", "rep")]
    return out


def test_report(spark):
    data = pages()
    got = sorted(map(str, warc.page_report(spark.createDataFrame(data, PAGES).selectExpr("*", "'x' AS sha", "1 AS first")).collect()))
    first = {}
    for i, _, h in data:
        if i is not None:
            first[h or ""] = min(i, first.get(h or "", i))
    want = []
    for i, _, h in data:
        b, f = (h or "").encode(), first.get(h or "")
        same = sum((x or "") == (h or "") for _, _, x in data) > 1 and f is not None and f != i
        want.append(f"Row(page_id={i}, payload_bytes={len(b)}, payload_digest='{base64.b32encode(hashlib.sha1(b).digest()).decode()}', record_type='{'revisit' if same else 'response'}', refers_to={f if same else None}, salvaged={i is None or i % 97 != 3})")
    assert got == sorted(want)


def test_payloads_and_urls_survive(spark):
    data = [p for p in pages() if p[0] is not None and p[0] < 100]
    records = warc.read_archives(warc.write_archives(spark.createDataFrame(data, PAGES), archive_bytes=2000)).collect()
    assert {r.page_id: r.url for r in records} == {i: u for i, u, _ in data} and len({r.archive for r in records}) > 1
    assert all(bytes(r.payload).decode() == data[r.page_id][2] for r in records if r.record_type == "response")


def plain(record):
    import zlib

    return zlib.decompress(record, 31)


@pytest.fixture()
def records():
    return [warc.write_record(i, f"u{i}", (f"payload {i} " * 40).encode(), None, warc.payload_digest((f"payload {i} " * 40).encode())) for i in range(6)]


@pytest.mark.parametrize("pack", [bytes, plain])
def test_salvage(records, pack):
    parts = [pack(r) for r in records]
    whole = warc.salvage(b"".join(parts))
    assert [r.page_id for r in whole.records] == list(range(6)) and not whole.gaps
    starts = [sum(map(len, parts[:k])) for k in range(7)]
    # one record damaged in its middle
    data = bytearray(b"".join(parts))
    middle = starts[2] + len(parts[2]) // 2
    data[middle : middle + 4] = b"\0\xff\0\xff"
    hurt = warc.salvage(bytes(data))
    assert [r.page_id for r in hurt.records] == [0, 1, 3, 4, 5]
    assert [g[:2] for g in hurt.gaps] == [(starts[2], starts[3])]
    # junk between, a record cut short, and a tail cut off
    data = parts[0] + b"junk \x1f\x8b\x08 more junk" + parts[1] + parts[2][: len(parts[2]) // 2] + parts[3] + parts[4][:-9]
    hurt = warc.salvage(data)
    assert [r.page_id for r in hurt.records] == [0, 1, 3]
    assert sum(b - a for a, b, _ in hurt.gaps) == len(data) - sum(len(parts[k]) for k in (0, 1, 3))


def test_digest_is_checked(records):
    data = plain(records[0]).replace(b"payload 0 payload", b"payload 9 payload", 1)
    got = warc.salvage(data + plain(records[1]))
    assert [r.page_id for r in got.records] == [1] and "digest" in got.gaps[0][2]


def test_gaps_in_table(spark, records):
    bad = records[0][:-3] + records[1]
    out = warc.read_archives(spark.createDataFrame([("a", bytearray(bad)), ("b", bytearray(b"")), ("c", None)], "archive STRING, content BINARY")).collect()
    assert [(r.page_id, r.offset, r.gap_end) for r in out if r.reason] == [(None, 0, len(records[0]) - 3)] and [r.page_id for r in out if not r.reason] == [1]


def test_empty(spark):
    assert warc.page_report(spark.createDataFrame([], PAGES)).count() == 0


@pytest.mark.parametrize("level", [0, 6])
def test_salvage_inside_members(records, level):
    """One bad record, a bad checksum or a cut costs a member of several records no others."""
    import zlib

    def member(body):
        packer = zlib.compressobj(level, zlib.DEFLATED, 31)
        return packer.compress(body) + packer.flush()

    texts = [plain(r) for r in records]
    digest, length, header = texts[2].replace(b"payload 2 payload", b"payload 9 payload", 1), texts[3].replace(b"\r\nContent-Length: ", b"\r\nContent-Length: 9", 1), texts[4].replace(b"WARC-Type:", b"WARC-Type")
    for k, hurt in ((2, digest), (3, length), (4, header)):
        first = member(b"".join([*texts[:k], hurt, *texts[k + 1 :]]))
        got = warc.salvage(first + records[0])
        assert [r.page_id for r in got.records] == [*(i for i in range(6) if i != k), 0]
        assert [g[:2] for g in got.gaps] == [(0, len(first))] and f"bytes {sum(map(len, texts[:k]))} to" in got.gaps[0][2]
    stream = member(b"".join(texts))
    wrong = stream[:-8] + bytes(x ^ 255 for x in stream[-8:-4]) + stream[-4:]
    got = warc.salvage(wrong + records[0])
    assert [r.page_id for r in got.records] == [*range(6), 0] and [g[:2] for g in got.gaps] == [(0, len(wrong))]
    cut = member(b"".join(texts) + bytes(range(256)) * 40)[:-200]
    got = warc.salvage(cut)
    assert [r.page_id for r in got.records] == list(range(6)) and [g[:2] for g in got.gaps] == [(0, len(cut))]


def test_the_four_damages_cost_one_record_each(records):
    data = b"".join(records)
    starts = [sum(map(len, records[:k])) for k in range(7)]
    for k in range(6):
        for turn in range(4):
            got = warc.salvage(warc.damaged(data, [(starts[k], starts[k + 1])], turn))
            assert [r.page_id for r in got.records] == [i for i in range(6) if i != k]
            assert sum(z - a for a, z, _ in got.gaps) == len(records[k])


def test_search_is_linear(records):
    """False starts of members and version lines cost their own bytes only."""
    import time

    def took(n):
        junk = (b"\x1f\x8b\x08" + b"\xff" * 5) * n + b"WARC/1.x" * n
        start = time.perf_counter()
        got = warc.salvage(records[0] + junk + records[1])
        assert [r.page_id for r in got.records] == [0, 1]
        return time.perf_counter() - start

    took(1_000)
    assert took(80_000) < 16 * max(took(10_000), 0.05)
