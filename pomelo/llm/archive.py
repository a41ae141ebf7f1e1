"""Web archives packed in ZIP files: writing them from pages, and reading records by ranges.

An archive is a ZIP file whose members are stored, not compressed. ``archive/*.warc.gz`` members hold
WARC records, each a gzip member of its own; ``indexes/*.cdxj`` members say where each record begins
and how long it is. A reader needs the directory at the file's end (in its 32 or 64 bit form), the
index, and then only the bytes of the records; no member is extracted.
"""

from __future__ import annotations

import base64
import gzip
import hashlib
import io
import json
import struct
import uuid
import zipfile
import zlib

import pyarrow as pa
from pyarrow import fs
from pyspark.sql import DataFrame, SparkSession, functions as F

from ..session import fresh_path, materialize
from .common import bound_batches

MEMBER_BYTES = 16 << 20   # a member is gathered in memory before it is written
ARCHIVE_BYTES = 1 << 30   # then the next archive begins
READ_BYTES = 4 << 20      # records that lie one behind the other are read together up to here
# Bytes of records that a task reads.
TASK_BYTES = 32 << 20
DATE = "2024-01-01T00:00:00Z"
_REVISIT = "http://netpreserve.org/warc/1.1/revisit/identical-payload-digest"


# -- writing ---------------------------------------------------------------------------------------

def _record(page_id, url, payload: bytes | None, size: int, digest: str, first) -> bytes:
    """One WARC record; ``first`` is the page a revisit refers to, None for a response."""
    def name(key) -> str:
        return f"<urn:page:{'' if key is None else key}>"

    kind = "response" if first is None else "revisit"
    http = f"HTTP/1.1 200 OK\r\nContent-Type: text/html; charset=utf-8\r\nContent-Length: {size}\r\n\r\n".encode()
    block = http + (payload or b"") if first is None else http
    lines = ["WARC/1.1", f"WARC-Type: {kind}", f"WARC-Record-ID: {name(page_id)}", f"WARC-Date: {DATE}"]
    if url is not None:
        clean = "".join(c if c > " " and c != "\x7f" else f"%{ord(c):02X}" for c in url)
        lines.append(f"WARC-Target-URI: {clean}")
    lines.append(f"WARC-Payload-Digest: sha1:{digest}")
    if first is not None:
        lines += [f"WARC-Refers-To: {name(first)}", f"WARC-Profile: {_REVISIT}"]
    lines += ["Content-Type: application/http; msgtype=response", f"Content-Length: {len(block)}", "", ""]
    return "\r\n".join(lines).encode() + block + b"\r\n\r\n"


class _Writer:
    """Writes the records of one task as archives with names of their own, so that an attempt that
    fails or runs twice never touches the files of another."""

    def __init__(self, folder: str) -> None:
        self.folder, self.zip, self.done = folder, None, []
        self.member, self.lines = io.BytesIO(), []

    def add(self, record: bytes) -> None:
        packed = gzip.compress(record, 6, mtime=0)
        self.lines.append(json.dumps({"offset": self.member.tell(), "length": len(packed)}))
        self.member.write(packed)
        if self.member.tell() >= MEMBER_BYTES:
            self._end_member()

    def _end_member(self) -> None:
        if not self.lines:
            return
        if self.zip is None:
            self.path = f"{self.folder}/{uuid.uuid4().hex}.zip"
            system, inner = fs.FileSystem.from_uri(self.path)
            system.create_dir(inner.rsplit("/", 1)[0], recursive=True)
            self.stream = system.open_output_stream(inner)
            self.zip, self.members, self.written, self.records = zipfile.ZipFile(self.stream, "w", zipfile.ZIP_STORED), 0, 0, 0
        name = f"part-{self.members:05d}"
        self.zip.writestr(f"archive/{name}.warc.gz", self.member.getvalue())
        self.zip.writestr(f"indexes/{name}.cdxj", "\n".join(self.lines))
        self.members, self.written, self.records = self.members + 1, self.written + self.member.tell(), self.records + len(self.lines)
        self.member, self.lines = io.BytesIO(), []
        if self.written >= ARCHIVE_BYTES:
            self.close()

    def close(self) -> None:
        self._end_member()
        if self.zip is not None:
            self.zip.close()
            self.stream.close()
            self.done.append((self.path, self.records))
            self.zip = None


def write_archives(pages: DataFrame, folder: str | None = None, page_id: str = "page_id", url: str = "url",
                   html: str = "html", min_bytes: int = 0) -> DataFrame:
    """Write a record per row of ``pages``; gives the archives written, ``path, records``.

    The payload is the html in UTF-8, empty for null. Of rows whose payloads are equal and hold at
    least ``min_bytes`` bytes, the one with the smallest id is written in full and the others as
    revisits of it; rows that repeat that id are written in full, too. A row without an id refers
    to one with an id; where none has one, all are written in full. Archives go to the shared
    folder, each under a name of its own, and the list of those that succeeded is written last.
    """
    spark = pages.sparkSession
    bound_batches(spark)
    folder = folder or fresh_path(spark, "archives")
    rows = (pages.select(F.col(page_id).alias("page_id"), F.col(url).alias("url"),
                         F.coalesce(F.col(html), F.lit("")).cast("binary").alias("payload"))
            .withColumn("size", F.octet_length("payload").cast("long")).withColumn("digest", F.sha1("payload")))
    firsts = (rows.filter(F.col("size") >= min_bytes).groupBy("digest").agg(F.min("page_id").alias("first"), F.count(F.lit(1)).alias("n"))
              .filter("n > 1").select("digest", "first"))
    revisit = F.col("first").isNotNull() & ~F.col("page_id").eqNullSafe(F.col("first"))
    rows = (rows.join(firsts, "digest", "left").withColumn("first", F.when(revisit, F.col("first")))
            .withColumn("payload", F.when(F.col("first").isNull(), F.col("payload")))
            .select("page_id", "url", "payload", "size", "digest", "first"))

    def run(batches):
        writer = _Writer(folder)
        for batch in batches:
            for key, address, payload, size, digest, first in zip(*(batch.column(i) for i in range(6))):
                named = base64.b32encode(bytes.fromhex(digest.as_py())).decode()
                writer.add(_record(key.as_py(), address.as_py(), payload.as_py(), size.as_py(), named, first.as_py()))
        writer.close()
        yield pa.RecordBatch.from_arrays([pa.array([p for p, _ in writer.done], pa.string()),
                                          pa.array([n for _, n in writer.done], pa.int64())], names=["path", "records"])

    return materialize(rows.mapInArrow(run, "path string, records long"), "manifest")


# -- reading ---------------------------------------------------------------------------------------

_END, _END64, _LOCATE64, _ENTRY = b"PK\x05\x06", b"PK\x06\x06", b"PK\x06\x07", b"PK\x01\x02"
_FULL16, _FULL32 = 0xFFFF, 0xFFFFFFFF


class Archive:
    """A ZIP file opened for range reads. ``read(offset, length)`` fetches bytes; ``size`` is the
    file's."""

    def __init__(self, read, size: int) -> None:
        self.read, self.size = read, size

    def directory(self) -> tuple[int, int]:
        """Offset and length of the central directory, from the 32 or the 64 bit end record."""
        tail_at = max(0, self.size - (22 + 65_535))
        tail = self.read(tail_at, self.size - tail_at)
        at = tail.rfind(_END)
        while at >= 0 and at + 22 + struct.unpack_from("<H", tail, at + 20)[0] != len(tail):
            at = tail.rfind(_END, 0, at)
        if at < 0:
            raise ValueError("no ZIP end record")
        entries, length, offset = struct.unpack_from("<HII", tail, at + 10)
        if entries == _FULL16 or length == _FULL32 or offset == _FULL32:
            locator = self.read(tail_at + at - 20, 20) if tail_at + at >= 20 else b""
            if locator[:4] == _LOCATE64:
                record = self.read(struct.unpack_from("<Q", locator, 8)[0], 56)
                if record[:4] != _END64:
                    raise ValueError("no ZIP64 end record")
                length, offset = struct.unpack_from("<QQ", record, 40)
        return offset, length

    def members(self):
        """Yield (name, method, compressed size, local header offset) of each directory entry."""
        offset, length = self.directory()
        data, at = self.read(offset, length), 0
        while at + 46 <= len(data) and data[at:at + 4] == _ENTRY:
            flags, method = struct.unpack_from("<HH", data, at + 8)
            packed, plain, n, m, k = struct.unpack_from("<IIHHH", data, at + 20)
            local = struct.unpack_from("<I", data, at + 42)[0]
            name = data[at + 46:at + 46 + n].decode("utf-8" if flags & 0x800 else "cp437")
            extra, e = data[at + 46 + n:at + 46 + n + m], 0
            while e + 4 <= len(extra):
                kind, size = struct.unpack_from("<HH", extra, e)
                if kind == 1:  # the 64 bit values that are present, in this order
                    values = iter(struct.unpack_from(f"<{size // 8}Q", extra, e + 4))
                    plain = next(values) if plain == _FULL32 else plain
                    packed = next(values) if packed == _FULL32 else packed
                    local = next(values) if local == _FULL32 else local
                e += 4 + size
            yield name, method, packed, local
            at += 46 + n + m + k

    def data_offset(self, local: int) -> int:
        n, m = struct.unpack_from("<HH", self.read(local, 30), 26)
        return local + 30 + n + m

    def ranges(self):
        """Yield (offset, length) of every record, or of a whole member that no index describes."""
        members = {name: (method, size, local) for name, method, size, local in self.members()}
        for name, (method, size, local) in members.items():
            if not name.startswith("archive/") or not name.endswith((".warc.gz", ".warc")):
                continue
            if method != zipfile.ZIP_STORED:
                raise ValueError(f"{name} is compressed; only stored members can be read by ranges")
            start = self.data_offset(local)
            stem = name[len("archive/"):].removesuffix(".gz").removesuffix(".warc")
            index = members.get(f"indexes/{stem}.cdxj")
            if index is None or index[0] != zipfile.ZIP_STORED:
                if size:
                    yield start, size
                continue
            for line in self.read(self.data_offset(index[2]), index[1]).decode().splitlines():
                entry = json.loads(line[line.index("{"):])
                yield start + entry["offset"], entry["length"]


def _open(path: str):
    system, inner = fs.FileSystem.from_uri(path)
    file = system.open_input_file(inner)
    return file, Archive(lambda offset, length: file.read_at(length, offset), file.size())


def _plain(data: bytes) -> bytes:
    """The bytes of consecutive gzip members, or the data itself if it is not compressed."""
    if data[:2] != b"\x1f\x8b":
        return data
    out = []
    while data:
        member = zlib.decompressobj(wbits=31)
        out.append(member.decompress(data) + member.flush())
        data = member.unused_data
    return b"".join(out)


def parse_records(data: bytes):
    """Yield (headers with lower-case names, block) of consecutive WARC records."""
    at = 0
    while at < len(data):
        end = data.index(b"\r\n\r\n", at)
        head = data[at:end].decode("utf-8").split("\r\n")
        if not head[0].startswith("WARC/"):
            raise ValueError("no WARC record")
        headers = {k.strip().lower(): v.strip() for k, _, v in (line.partition(":") for line in head[1:])}
        size = int(headers["content-length"])
        yield headers, data[end + 4:end + 4 + size]
        at = end + 4 + size + 4


def _page(name: str | None) -> int | None:
    text = (name or "").removeprefix("<urn:page:").removesuffix(">")
    return int(text) if text else None


def _described(headers: dict, block: bytes) -> tuple:
    http, _, body = block.partition(b"\r\n\r\n")
    sizes = [int(line.partition(b":")[2]) for line in http.split(b"\r\n") if line.lower().startswith(b"content-length:")]
    kind = headers["warc-type"]
    if kind == "response":
        size, digest = len(body), base64.b32encode(hashlib.sha1(body).digest()).decode()
    else:
        size, digest = (sizes or [0])[0], headers["warc-payload-digest"].removeprefix("sha1:")
    return (_page(headers.get("warc-record-id")), headers.get("warc-target-uri"), size, digest, kind,
            _page(headers.get("warc-refers-to")), body.decode("utf-8") if kind == "response" else None)


def read_archives(spark: SparkSession, paths: DataFrame, payload: bool = True) -> DataFrame:
    """The records of archives (column ``path``): ``page_id, url, payload_bytes, payload_digest,
    record_type, refers_to, html``; html only of responses, and only with ``payload``.

    First each archive's directory and indexes give ranges, neighbours together up to a bounded
    size, which are written; then they are dealt out, TASK_BYTES to a task, and read. A payload's size and digest are those of
    the bytes read, for a revisit those it states. No archives give no rows.
    """
    def locate(batches):
        for batch in batches:
            for path in batch.column("path").to_pylist():
                file, archive = _open(path)
                with file:
                    found, start, end = [], None, None
                    for offset, length in archive.ranges():
                        if start is not None and offset == end and offset + length - start <= READ_BYTES:
                            end += length
                            continue
                        if start is not None:
                            found.append((start, end - start))
                        start, end = offset, offset + length
                    if start is not None:
                        found.append((start, end - start))
                yield pa.RecordBatch.from_arrays(
                    [pa.array([path] * len(found), pa.string()), pa.array([o for o, _ in found], pa.int64()),
                     pa.array([n for _, n in found], pa.int64())], names=["path", "offset", "length"])

    def fetch(batches):
        for batch in batches:
            for path, offset, length in zip(*(batch.column(c).to_pylist() for c in ("path", "offset", "length"))):
                file, archive = _open(path)
                with file:
                    rows = [_described(*r) for r in parse_records(_plain(archive.read(offset, length)))]
                columns = list(zip(*rows)) if rows else [()] * 7
                types = [pa.int64(), pa.string(), pa.int64(), pa.string(), pa.string(), pa.int64(), pa.string()]
                names = ["page_id", "url", "payload_bytes", "payload_digest", "record_type", "refers_to", "html"]
                if not payload:
                    columns, types, names = columns[:6], types[:6], names[:6]
                yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, types)], names=names)

    schema = "page_id long, url string, payload_bytes long, payload_digest string, record_type string, refers_to long"
    ranges = materialize(paths.select("path").mapInArrow(locate, "path string, offset long, length long"), "ranges")
    total = ranges.agg(F.coalesce(F.sum("length"), F.lit(0)).alias("n")).first()["n"]
    # a number given is a number kept: the rows are so small that they would be joined in one task otherwise
    tasks = max(1, -(-total // TASK_BYTES))
    return ranges.repartition(tasks).mapInArrow(fetch, schema + (", html string" if payload else ""))


def archived(pages: DataFrame, min_bytes: int = 0) -> DataFrame:
    """Write ``pages`` as archives and read them back: ``page_id, payload_bytes, payload_digest,
    record_type, refers_to`` of every record."""
    manifest = write_archives(pages, min_bytes=min_bytes)
    return read_archives(pages.sparkSession, manifest, payload=False).select(
        "page_id", "payload_bytes", "payload_digest", "record_type", "refers_to")
