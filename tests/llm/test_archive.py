"""Archives: directories, indexes, ranges and the round trip."""

import base64
import gzip
import hashlib
import io
import json
import struct
import zipfile

import pytest

from pomelo.llm import archive

SCHEMA = "page_id long, url string, html string, digest string, first long, size int"


def frame(spark, rows):
    return spark.createDataFrame([(i, u, h, "x", 1, 2) for i, u, h in rows], SCHEMA)


def opened(data):
    return archive.Archive(lambda offset, length: data[offset:offset + length], len(data))


def zipped(members, method=zipfile.ZIP_STORED, comment=b""):
    out = io.BytesIO()
    with zipfile.ZipFile(out, "w", method) as z:
        for name, data in members:
            z.writestr(name, data)
        z.comment = comment
    return out.getvalue()


def test_directory_of_both_forms():
    few = [(f"archive/{i}.warc.gz", b"x" * i) for i in range(5)]
    for comment in (b"", b"a note with PK\x05\x06 inside it and more text to follow"):
        data = zipped(few, comment=comment)
        assert [(n, s) for n, _, s, _ in opened(data).members()] == [(n, len(d)) for n, d in few]
    many = zipped([(f"m/{i}", b"") for i in range(65_600)])  # needs the 64 bit end record
    assert archive._END64 in many
    assert sum(1 for _ in opened(many).members()) == 65_600
    with pytest.raises(ValueError):
        opened(b"no archive at all").directory()


def test_64_bit_values_of_an_entry():
    """Sizes and offsets that don't fit 32 bits stand in the extra field, in order."""
    plain = zipped([("archive/a.warc.gz", b"payload")])
    offset, length = opened(plain).directory()
    entry = bytearray(plain[offset:offset + length])
    name_length = struct.unpack_from("<H", entry, 28)[0]
    packed, size, local = struct.unpack_from("<II", entry, 20) + struct.unpack_from("<I", entry, 42)
    extra = struct.pack("<HHQQQ", 1, 24, size, packed, local)
    struct.pack_into("<II", entry, 20, 0xFFFFFFFF, 0xFFFFFFFF)
    struct.pack_into("<H", entry, 30, len(extra))
    struct.pack_into("<I", entry, 42, 0xFFFFFFFF)
    body = plain[:offset] + bytes(entry[:46 + name_length]) + extra
    end = struct.pack("<IHHHHIIH", 0x06054B50, 0, 0, 1, 1, len(body) - offset, offset, 0)
    found = list(opened(body + end).members())
    assert found == [("archive/a.warc.gz", 0, 7, 0)]


def test_ranges_with_and_without_an_index():
    records = [gzip.compress(archive._record(i, f"http://x/{i}", b"p%d" % i, 2, "D", None), mtime=0) for i in range(4)]
    joined, index, at = b"".join(records), [], 0
    for r in records:
        index.append("com,x)/ 2024 " + json.dumps({"offset": at, "length": len(r)}))
        at += len(r)
    members = [("archive/a.warc.gz", joined), ("archive/b.warc.gz", joined), ("indexes/a.cdxj", "\n".join(index)), ("datapackage.json", "{}")]
    data = zipped(members)
    ranges = list(opened(data).ranges())
    assert len(ranges) == 5 and ranges[-1][1] == len(joined)
    for offset, length in ranges:
        for headers, block in archive.parse_records(archive._plain(data[offset:offset + length])):
            assert headers["warc-type"] == "response" and block.endswith(block[-2:])
    with pytest.raises(ValueError):
        list(opened(zipped(members[:1], zipfile.ZIP_DEFLATED)).ranges())


def brute(rows, least=0):
    first, out = {}, []
    for i, _, h in rows:
        h = h or ""
        if len(h.encode()) >= least and i is not None:
            first[h] = min(first.get(h, i), i)
    copies = {}
    for _, _, h in rows:
        copies[h or ""] = copies.get(h or "", 0) + 1
    for i, _, h in rows:
        h = h or ""
        raw = h.encode()
        to = first.get(h) if copies[h] > 1 and len(raw) >= least else None
        revisit = to is not None and to != i
        out.append((i, len(raw), base64.b32encode(hashlib.sha1(raw).digest()).decode(), "revisit" if revisit else "response", to if revisit else None))
    return sorted(out, key=str)


ROWS = [(3, "http://a/3", "<p>same é</p>"), (1, "http://a/1\r\nX: y", "<p>same é</p>"), (2, None, "<p>same é</p>"), (4, "u", None),
        (5, "u", ""), (6, "u", "other\r\n\r\nWARC/1.1\r\n\x00"), (6, "u", "other\r\n\r\nWARC/1.1\r\n\x00"), (None, "u", "<p>same é</p>"),
        (7, "u", "long " * 200_000), (None, "u", "nameless"), (None, "u", "nameless")]


@pytest.mark.parametrize("least", [0, 1, 1000])
def test_round_trip(spark, least):
    got = archive.archived(frame(spark, ROWS).repartition(4), least).collect()
    assert sorted(map(tuple, got), key=str) == brute(ROWS, least)


def test_payloads_come_back_over_several_members_and_archives(spark, monkeypatch):
    rows = [(i, f"http://x/{i}?q=ü", f"<p>{i} é</p>" * (1 + i % 40)) for i in range(300)]
    manifest = archive.write_archives(frame(spark, rows).coalesce(2))
    assert sum(r["records"] for r in manifest.collect()) == 300
    got = {r["page_id"]: r for r in archive.read_archives(spark, manifest).collect()}
    assert {i: (u, h) for i, u, h in rows} == {i: (r["url"], r["html"]) for i, r in got.items()}


def test_writer_rolls(tmp_path, monkeypatch):
    monkeypatch.setattr(archive, "MEMBER_BYTES", 600)
    monkeypatch.setattr(archive, "ARCHIVE_BYTES", 2_000)
    writer = archive._Writer(f"file://{tmp_path}")
    for i in range(60):
        writer.add(archive._record(i, "u", hashlib.sha256(b"%d" % i).hexdigest().encode(), 64, "D", None))
    writer.close()
    assert len(writer.done) > 3 and sum(n for _, n in writer.done) == 60
    seen = []
    for path, _ in writer.done:
        file, opened_ = archive._open(path)
        with file:
            for offset, length in opened_.ranges():
                seen += [archive._page(h["warc-record-id"]) for h, _ in archive.parse_records(archive._plain(opened_.read(offset, length)))]
    assert seen == list(range(60))


def test_empty(spark):
    assert archive.archived(frame(spark, [])).count() == 0


def test_ranges_are_dealt_to_as_many_tasks_as_their_bytes_need(spark, monkeypatch):
    rows = [(i, f"http://x/{i}", hashlib.sha256(b"%d" % i).hexdigest() * 2_000) for i in range(300)]
    manifest = archive.write_archives(frame(spark, rows).repartition(8))
    monkeypatch.setattr(archive, "TASK_BYTES", 1 << 14)
    read = archive.read_archives(spark, manifest, payload=False)
    tasks = read.rdd.getNumPartitions()
    assert tasks > 4 and read.count() == 300
    monkeypatch.setattr(archive, "TASK_BYTES", 1 << 30)
    assert archive.read_archives(spark, manifest).rdd.getNumPartitions() == 1
